"""Deterministic sharded WARC archives.

Records are range-sorted by page id into shards whose limits come from a
hash-chosen sample of the ids, so equal tables give equal shards however they
are partitioned.  Every shard is a task of its own, so a task holds about
``shard_bytes`` of payload whatever the table's size; only the shards' limits
(8 bytes a shard) reach the driver.  A shard is written as files that roll over by compressed
size; headers, digests and record ids are made anew from the page itself, one
gzip member a record, without clocks or random numbers, so equal tables give
equal bytes.  Tasks write under temporary names that no two attempts share and
report them; files of the attempts that count get their final names, and the
manifest, written last, makes the archive valid.  Readers open only files that
the manifest lists.

Records with equal payloads of at least ``min_revisit`` bytes are written once:
the largest page id is the response and the others are revisits that refer to it.

Defined cases: a null payload is empty.  A null url leaves out the target
header.  A null page id sorts first, is written without an id and never is the
response of a group that has an id.  Rows repeating the largest id of a group
are all responses.  Extra columns are ignored.  An empty table gives an archive
without files.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import in_bits, map_rows, materialise, member_bits, parts, utf8
from lectern.operators.running import running_totals

MIN_REVISIT = 1000
#: Payload bytes meant for a shard (a table of 100 TB takes 1 GiB or so), compressed bytes after which a file is full,
#: ids sampled for each shard.
SHARD_BYTES, ROLL_BYTES, SAMPLES = 16 << 20, 1 << 20, 64
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "urn:lectern:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_SCHEMA = "shard int, roll int, temp string, name string, records long, bytes long, sha256 string"
RECORD_SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
                 "refers_to long, payload binary")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in the shared store (Hadoop writes ``file:/x`` for ``file:///x``)."""
    if uri.startswith("file:"):
        uri = "file://" + re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


# --- records -----------------------------------------------------------------

def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = head if revisit else head + payload
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda p: f"<{ID_PREFIX}{'' if p is None else p}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", sha(payload)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Block-Digest", sha(block)), ("Content-Type", "application/http;msgtype=response"),
               ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode("ascii") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if hashlib.sha1(block).digest() != base64.b32decode(fields["WARC-Block-Digest"][5:]):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't match")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
    if not revisit and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't match")
    number = lambda s: int(x) if (x := s[1 + len(ID_PREFIX):-1]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "payload_digest": digest.hex(),
            "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
            "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def members(stream, chunk: int = 1 << 20):
    """The gzip members of a file, one after another."""
    gz, out, waiting = zlib.decompressobj(31), [], b""
    while True:
        data = waiting or stream.read(chunk)
        if not data:
            break
        out.append(gz.decompress(data))
        waiting = gz.unused_data
        if gz.eof:
            yield b"".join(out)
            gz, out = zlib.decompressobj(31), []
    if b"".join(out):
        raise ValueError("archive ends inside a record")


# --- writer ------------------------------------------------------------------

def _limits(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """Ids at which a new shard begins: quantiles of a sample chosen by a hash of the id."""
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    if shards == 1:
        return np.zeros(0, np.int64)
    every = max(1, n // (SAMPLES * shards))
    ids = materialise(pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0))
                      .select("page_id", F.lit(0).cast("bigint").alias("all"), F.lit(1).cast("bigint").alias("one"))
                      .distinct(), "warc-sample")
    most = ids.count()
    ranked = running_totals(ids, ["all"], [F.col("page_id")], {"upto": ("sum", "one")}, "warc-ranks")
    # rank r lies in quantile (r - 1) * shards / most; the first of every quantile but the lowest is a limit
    first = F.pmod((F.col("upto") - 1) * shards, F.lit(max(1, most))) < shards
    return np.sort(ranked.filter(first & (F.col("upto") > 1)).select("page_id").toPandas()["page_id"].to_numpy(dtype=np.int64))


def link_copies(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Add ``refers_to`` and ``revisit`` to (page_id, url, body)."""
    spark = pages.sparkSession
    sha = F.when(F.octet_length("body") >= min_revisit, F.sha2("body", 256))
    hashed = pages.withColumn("sha", sha)
    owners = materialise(hashed.filter("sha IS NOT NULL").groupBy("sha")
                         .agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
                         .select("sha", "owner"), "warc-owners")
    bitmap = member_bits(owners.select(F.xxhash64("sha").alias("h")), "h")
    hit = F.coalesce(in_bits(spark, F.when(F.col("sha").isNotNull(), F.xxhash64("sha")), bitmap), F.lit(False))
    linked = (hashed.filter(hit).join(owners.withColumn("found", F.lit(True)), "sha", "left")
              .withColumn("revisit", F.coalesce("found", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("owner")))
              .select("page_id", "url", "body", F.when(F.col("revisit"), F.col("owner")).alias("refers_to"), "revisit"))
    single = hashed.filter(~hit).select("page_id", "url", "body", F.lit(None).cast("bigint").alias("refers_to"),
                                        F.lit(False).alias("revisit"))
    return single.unionByName(linked)


def write_archive(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  min_revisit: int = MIN_REVISIT, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive under ``root``; returns its manifest (one row a file)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        utf8(F.col(payload)).alias("body"))
    limits = _limits(rows, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        return pd.Series(np.searchsorted(limits, ids.fillna(low).to_numpy().astype(np.int64), side="right")).astype("int32")

    def write(batches):
        fs, base = open_fs(root)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        out, row = None, None

        def begin(shard, roll):
            nonlocal out, row
            temp = f"_temporary/{uuid.uuid4().hex}.warc.gz"
            out = fs.open_output_stream(f"{base}/{temp}", compression=None)
            row = [shard, roll, temp, f"part-{shard:05d}-{roll:05d}.warc.gz", 0, 0, hashlib.sha256()]

        def finish():
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_pylist([dict(zip(
                ("shard", "roll", "temp", "name", "records", "bytes", "sha256"), [*row[:6], row[6].hexdigest()]))], pa.schema([
                    ("shard", pa.int32()), ("roll", pa.int32()), ("temp", pa.string()), ("name", pa.string()),
                    ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

        for b in batches:
            cols = [b.column(c) for c in ("shard", "page_id", "url", "body", "refers_to", "revisit")]
            for i in range(b.num_rows):
                shard, *page = (c[i].as_py() for c in cols)
                if out is not None and row[0] != shard:
                    yield finish()
                if out is not None and row[5] >= roll_bytes:
                    roll = row[1] + 1
                    yield finish()
                    begin(shard, roll)
                elif out is None:
                    begin(shard, 0)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = gz.compress(record_bytes(*page)) + gz.flush()
                out.write(raw)
                row[4], row[5] = row[4] + 1, row[5] + len(raw)
                row[6].update(raw)
        if out is not None:
            yield finish()

    dealt = (link_copies(rows, min_revisit).withColumn("shard", shard_of("page_id"))
             .repartitionById(len(limits) + 1, F.col("shard"))
             .sortWithinPartitions("shard", "page_id", "url", F.sha1("body")))
    found = materialise(dealt.select("shard", "page_id", "url", "body", "refers_to", "revisit")
                        .mapInArrow(write, FILE_SCHEMA), "warc-attempts")

    def settle(batch: pa.RecordBatch):
        """Give final names; a file that an earlier attempt has settled stays."""
        fs, base = open_fs(root)
        for temp, name, size in zip(*(batch.column(c).to_pylist() for c in ("temp", "name", "bytes"))):
            if fs.get_file_info(f"{base}/{temp}").type == pafs.FileType.File:
                fs.move(f"{base}/{temp}", f"{base}/{name}")
            if fs.get_file_info(f"{base}/{name}").size != size:
                raise OSError(f"{name} isn't whole")
        yield batch.drop_columns(["temp"])

    map_rows(found.repartition(parts(spark), "name"), settle, FILE_SCHEMA.replace("temp string, ", "")).write.json(
        f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA.replace("temp string, ", "")).json(f"{root}/manifest")


def read_archive(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """One row a record of the files that the manifest lists, checked against their digests."""
    def run(batch: pa.RecordBatch):
        fs, base = open_fs(root)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                           ("payload", pa.binary())])
        for name in batch.column("name").to_pylist():
            rows, size = [], 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for raw in members(stream):
                    rows.append(parse_record(raw))
                    if not payload:
                        rows[-1]["payload"] = None
                    size += len(raw)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = manifest(spark, root).select("name")
    return map_rows(files.repartition(parts(spark), "name"), run, RECORD_SCHEMA)
