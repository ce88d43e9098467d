"""The registered queries of the training-data operators, and their SQL where it can say the same."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (byte_bpe, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, prefix_trie, suffix_dedup,
                         token_alignment, topk_search, toxicity, warc)
from lectern.llm.common import table
from lectern.session import scratch_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, packed=True)
    return byte_bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("bigint").alias("n_spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), root)
    return warc.read_archive(spark, root, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the language their markup declares, if any, and their source as host."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs), declared=language_id.markup_language(F.col("text")),
                                 host=F.col("source"))
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "rejected")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: visible text, declared language and address, judged by the model of the documents."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    found = language_id.identify(pages.withColumn("text", bare), language_id.fit(table(spark, sf_dir, "documents")), "page_id",
                                 declared=language_id.markup_language(F.col("html")), host=language_id.host_of(F.col("url")))
    return found.select(F.col("doc_id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "rejected")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_words=True)
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flags(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)
    # passages of 50 words are told beside the contract's columns, as many take less than its 400 bytes
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("bigint").alias("n_passages"),
                        F.expr("aggregate(passages, 0L, (n, p) -> n + p.end - p.start)").alias("n_passage_words"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), carry=False)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_toxicity, op3_line_dedup, op4_warc, op5_jaccard_join, op6_language_id, op7_best_fit_packing,
    op8_exact_dedup, op9_topk_search, op10_suffix_dedup, op11_token_alignment, op12_prefix_trie, op13_mixing, pages_language_id)}

_BLANK = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, i, line,
         {_LOWER.format(rf"regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g')")} AS k
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT l.*, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM lines l LEFT JOIN owners o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS owner FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN g USING (h)""",
    "op8_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BLANK}+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op9_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings),
s AS (SELECT q.vec_id AS query_id, o.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(o.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op12_prefix_trie": """
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
             FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                       lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM own),
l AS (SELECT c.*, least(h, coalesce(n, 0)) AS lead FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM own GROUP BY 1) USING (base)),
r AS (SELECT l.conv_id, pos AS d, role, text FROM l JOIN own ON own.conv_id = l.base AND pos <= h
      UNION ALL SELECT l.conv_id, pos - h + lead, role, text FROM l JOIN own ON own.conv_id = l.conv_id AND pos > h
      UNION ALL SELECT conv_id, 0, '', '' FROM l),
k AS (SELECT conv_id, d, octet_length(encode(text)) AS b, max(d) OVER (PARTITION BY conv_id) AS z,
             string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r),
nodes AS (SELECT key, min(conv_id) AS m, any_value(d) AS d, count(*) AS n, any_value(b) AS b, count(*) FILTER (d = z) AS e,
                 coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (d = z), '') AS ends FROM k GROUP BY key),
up AS (SELECT x.m, x.d, p.key AS parent, q.m AS parent_conv_id FROM nodes x JOIN k p ON p.conv_id = x.m AND p.d = x.d - 1 JOIN nodes q ON q.key = p.key),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY 1),
sub AS (SELECT a.key, sum((x.n - 1) * x.b) AS saved, count(*) FILTER (x.key NOT IN (SELECT key FROM kids)) AS leaves
        FROM nodes x JOIN k a ON a.conv_id = x.m AND a.d <= x.d GROUP BY a.key)
SELECT x.m AS conv_id, x.d AS depth, parent_conv_id, x.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM nodes x JOIN sub USING (key) LEFT JOIN kids USING (key) LEFT JOIN up ON up.m = x.m AND up.d = x.d""",
    "op13_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_BLANK.replace("[", "[^")}+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
o AS (SELECT *, coalesce(sum(z) OVER before, 0) AS zs, coalesce(sum(w) OVER before, 0) AS ws, sum(z) OVER () AS zt, sum(w) OVER () AS wt
      FROM w WINDOW before AS (ORDER BY 2 * z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (1.5 * zt - 2 * zs) * w / (wt - ws) > 2 * z AS above FROM o),
t AS (SELECT source, z, CASE WHEN above THEN 2 * z ELSE (1.5 * zt - 2 * coalesce(sum(z) FILTER (above) OVER (), 0)) * w
                 / (wt - coalesce(sum(w) FILTER (above) OVER (), 0)) END AS target FROM c),
r AS (SELECT *, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate FROM t)
SELECT doc_id, size, z::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52)
                                        < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
}
