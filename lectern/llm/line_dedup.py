"""Line dedup over levelled sorted runs of line hashes.

A store keeps, for every line key seen so far, the 128-bit key hash and the id
of the document that owns it.  A run is one table bucketed and sorted by hash,
one file a bucket.  A new batch groups its own keys, which shuffles them once,
merge-anti-joins the runs one by one to find the keys nobody owns yet (a run
is read as it lies, without exchange or sort), and adds these as a run of level
0; when a level holds ``fanout`` runs they are merge-joined into one run of the
next level, so a store of n batches has about ``fanout * log(n)`` runs.  Runs
whose buckets differ in number from the session's partitions are shuffled.  A line stays only in the document that owns
its key.

A key is the line without ASCII white space at both ends, A-Z lower-cased;
keys under ``min_chars`` code points never count.  ``dedup_lines`` feeds the
batches in ascending id, so the owner is the smallest id holding the key.

Defined cases: a null or empty text is one empty line and stays as it is.  A
null id sorts after every id, and all rows with a null id are one document, as
are rows that repeat an id.  Extra columns are ignored.  An empty table gives
an empty result.
"""
from __future__ import annotations

import functools
import hashlib
import uuid
import weakref
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import in_bits, map_rows, materialise, member_bits, parts, utf8
from lectern.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Stands for a null id inside the store.
NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.translate(bare, UPPER, LOWER)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, hash): the keys of every line that counts."""
    return (docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"),
                        F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
            .select("id", line_key(F.col("line")).alias("key"))
            .filter(F.length("key") >= min_chars)
            .select("id", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash")))


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Scans of a bucket that is one file count as sorted; Spark reads this setting when it plans."""
    before = spark.conf.get(ORDERED, None)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.unset(ORDERED) if before is None else spark.conf.set(ORDERED, before)


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs of disjoint keys as one: a merge join that matches nothing."""
    return (a.join(b.select("hash", F.col("id").alias("other")).hint("merge"), "hash", "full_outer")
            .select("hash", F.coalesce("id", "other").alias("id")))


def _forget(spark: SparkSession, names: dict[str, str]) -> None:
    for name in names.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    names.clear()


class LineStore:
    """Levelled runs of (hash, id) under one folder; ``open`` finds the runs of an earlier session."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.levels: list[list[str]] = []
        self.names: dict[str, str] = {}  # catalog names of the runs
        # a store that is dropped unclosed leaves no names behind
        weakref.finalize(self, _forget, spark, self.names).atexit = False
        self.serial = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = FANOUT) -> LineStore:
        store = cls(spark, root, fanout)
        rows = spark.read.parquet(f"{store.root}/manifest")
        last = rows.agg(F.max("serial")).first()[0]
        for r in rows.filter(F.col("serial") == last).orderBy("level", "place").collect():  # one row a run
            while len(store.levels) <= r["level"]:
                store.levels.append([])
            store.levels[r["level"]].append(r["run"])
        store.serial = last
        return store

    def _table(self, path: str) -> DataFrame:
        """The run as a bucketed table; the session's catalog learns of it when it is first asked for."""
        if path not in self.names:
            name = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (hash BINARY, id BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) "
                           f"INTO {int(path.rsplit('-', 1)[1])} BUCKETS LOCATION '{path}'")
            self.names[path] = name
        return self.spark.table(self.names[path])

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("hash binary, id bigint").parquet(*paths) if paths else None

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        _forget(self.spark, self.names)

    def _write(self, rows: DataFrame) -> str:
        """Write rows that are hash partitioned by ``hash`` already, so that a bucket is one file."""
        self.serial += 1
        buckets = parts(self.spark)
        path, name = f"{self.root}/run-{self.serial:06d}-{buckets}", f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        self.names[path] = name
        return path

    def unowned(self, hashes: DataFrame) -> DataFrame:
        """(hash, id) of the keys of a batch that no run holds, with their smallest id."""
        fresh = hashes.groupBy("hash").agg(F.min("id").alias("id"))
        for path in (p for level in self.levels for p in level):
            fresh = fresh.join(self._table(path).select("hash").hint("merge"), "hash", "left_anti")
        return fresh

    def add(self, hashes: DataFrame) -> DataFrame:
        """Add a batch of (id, hash); returns the run of keys that the batch owns."""
        with sorted_buckets(self.spark):
            path = self._write(self.unowned(hashes))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(path)
        own = self.spark.read.schema("hash binary, id bigint").parquet(path)
        with sorted_buckets(self.spark):
            self._compact()
        self._commit()
        return own

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            path = self._write(functools.reduce(_merge, map(self._table, self.levels[level])))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(path)
            level += 1

    def _commit(self) -> None:
        rows = [(self.serial, k, i, p) for k, level in enumerate(self.levels) for i, p in enumerate(level)]
        (self.spark.createDataFrame(rows, "serial long, level int, place int, run string").coalesce(1)
         .write.mode("append").parquet(f"{self.root}/manifest"))


def _strip_lines(batch: pa.RecordBatch):
    out = {"n_lines": [], "n_dropped": [], "kept_text": []}
    texts, drops = batch.column("body").to_pylist(), batch.column("drops").to_pylist()
    for body, drop in zip(texts, drops):
        lines, gone = body.split(b"\n"), set(drop)
        stay = [x for x in lines if hashlib.md5(x.strip(BLANK).lower()).digest() not in gone]
        out["n_lines"].append(len(lines))
        out["n_dropped"].append(len(lines) - len(stay))
        out["kept_text"].append(b"\n".join(stay))
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()),
         pa.array(out["kept_text"], pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text (binary, UTF-8)."""
    spark = docs.sparkSession
    cuts = [i / batches for i in range(1, batches)]
    bounds = docs.select(F.percentile_approx(F.col(doc_id).cast("bigint"), cuts, 10000)).first()[0] or []
    at = sum([(F.col("id") > b).cast("int") for b in bounds], F.lit(0))
    path = scratch_path(spark, "line-hashes")
    line_hashes(docs, doc_id, text, min_chars).withColumn("batch", at).write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema("id bigint, hash binary, batch int").parquet(path)

    store, dropped = LineStore(spark, scratch_path(spark, "line-runs"), fanout), None
    for i in range(len(bounds) + 1):
        batch = hashes.filter(F.col("batch") == i).select("id", "hash")
        own = store.add(batch)
        lost = batch.distinct().join(own, ["hash", "id"], "left_anti")
        dropped = lost if dropped is None else dropped.unionByName(lost)
    drops = materialise(dropped.groupBy("id").agg(F.collect_set("hash").alias("drops")), "line-drops")
    store.close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    ident = F.coalesce("doc_id", F.lit(NO_ID))
    hit = in_bits(spark, ident, member_bits(drops, "id"))
    whole = rows.filter(~hit).select(
        "doc_id", F.size(F.split(F.coalesce("t", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_dropped"), utf8(F.col("t")).alias("kept_text"))
    cut = (rows.filter(hit).select("doc_id", ident.alias("id"), utf8(F.col("t")).alias("body"))
           .join(drops, "id", "left").select("doc_id", "body", F.coalesce("drops", F.array()).alias("drops")))
    return whole.unionByName(map_rows(
        cut, _strip_lines, "doc_id long, n_lines long, n_dropped long, kept_text binary", "body"))
