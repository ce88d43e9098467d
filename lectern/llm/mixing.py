"""Mixing sources to target weights, with DataFrame functions only.

Method: sizes are summed per source, every source's target gives its
repetition rate, and a document is emitted floor(rate) times plus one copy that
a hash of its id draws with the rate's fraction as probability.

* Targets: the sources share ``share`` times all words by weight.  A target
  stops at ``most`` times its source's size and the excess is shared again by
  weight until none is above; every round is one small aggregate over the table
  of sources.  Weights go round by the source's place in code point order, null
  last.  Places come from a range sort and the counts of its partitions, so no
  task holds all sources.
* Draws: 52 bits of ``md5(seed:doc_id)``.  They depend on nothing else, so runs
  agree under any partitioning; rows that repeat an id draw alike.  A source's
  taken words have the target as mean and a standard deviation of at most half
  the root of the sum of its squared sizes.

Nulls: a null text has size 0, a null source is a source of its own, a null id
draws as the empty id.  A document without words is taken 0 words (it may be
emitted, as its source's rate says).  Sources without words have the target 0
and rate 0.  An empty table gives an empty result.  Other columns of the
documents travel inside the struct ``doc``, so none can clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ASCII_SPACE, materialise, parts

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"
#: Bits of a draw, a multiple of 4.
DRAW_BITS = 52
WORD = ASCII_SPACE.replace("[", "[^") + "+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null is 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("bigint")


def places(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` with ``place``: 0, 1, ... in ascending order of ``column``, null last; written."""
    spark = values.sparkSession
    order = F.col(column).asc_nulls_last()
    rows = materialise(values.repartitionByRange(parts(spark), order).sortWithinPartitions(order)
                       .withColumn("_id", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").count()  # at most one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_part").select(*values.columns, place.alias("place"))


def source_rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) of documents (source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(places(totals, "source", "source-places").select("source", "source_size", weight.alias("weight")), "sources")
    every = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (every["size"] or 0)
    rest, weighing, stopped = float(budget), every["weight"] or 0, 0
    while weighing:
        above = F.lit(rest) * F.col("weight") / F.lit(float(weighing)) > F.lit(most) * F.col("source_size")
        now = sources.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("size"),
                          F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if now["n"] <= stopped:
            break
        rest, weighing, stopped = budget - most * now["size"], now["weight"], now["n"]
    most_words = F.lit(most) * F.col("source_size")
    target = F.least(F.lit(rest) * F.col("weight") / F.lit(float(weighing)), most_words) if weighing else most_words
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << DRAW_BITS))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: str = SEED, carry: bool = True) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies[, doc]): how often each document is emitted.

    ``carry``: the whole row comes along as struct ``doc`` for ``emit``; without it the texts are
    read once and only ids, sources and sizes are kept.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                        *([F.struct(*docs.columns).alias("doc")] if carry else []))
    if not carry:
        sized = materialise(sized, "sized")
    rates = materialise(source_rates(sized.select("source", "size"), weights, share, most), "rates")
    same = sized["source"].eqNullSafe(rates["source"])
    extra = draw(sized["doc_id"], seed) < F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + extra.cast("int")).cast("int")
    return sized.join(rates, same).select(*(sized[c] for c in sized.columns if c != "doc"), "source_size", "target",
                                          copies.alias("copies"), *([sized["doc"]] if carry else []))


def emit(mixed: DataFrame) -> DataFrame:
    """(copy, doc): the mix itself, every document ``copies`` times (copy from 1)."""
    return mixed.filter("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "doc")
