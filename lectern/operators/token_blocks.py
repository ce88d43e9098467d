"""Token lists whose tokens are replaced by a table (survey B3, B4).

A block holds the token lists of a few MB of rows as numbers of its distinct
tokens.  Only a block's distinct tokens meet the table, so neither tokens nor
their places are exploded, shuffled or sorted, and a frequent token is as many
rows as there are blocks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, written


def token_blocks(df: DataFrame, ids: list[str], forms: str) -> DataFrame:
    """(block, ids, sizes, codes, terms): the rows of ``df`` an Arrow batch a block; a written table."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("forms")
            coded, sizes = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.ListArray.from_arrays([0, batch.num_rows], batch.column("id")),
                 pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([coded.indices.to_numpy().astype("<i4").tobytes()], pa.binary()),
                 pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)], ["block", "ids", "sizes", "codes", "terms"])
            made += 1

    bound_batches(df.sparkSession)
    rows = df.select(F.struct(*ids).alias("id"), F.coalesce(forms, F.array().cast("array<string>")).alias("forms"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"block long, ids array<{kind}>, sizes binary, codes binary, terms array<string>"), "token-blocks")


def block_forms(blocks: DataFrame) -> DataFrame:
    """(block, i, form): the distinct tokens of every block."""
    return blocks.select("block", F.posexplode("terms").alias("i", "form"))


def replaced(blocks: DataFrame, table: DataFrame, out: str) -> DataFrame:
    """(ids, out): the rows of ``token_blocks`` with the lemma of ``table`` (form, lemma; one row a form) for every token that has one."""
    import numpy as np
    import pyarrow as pa

    changed = (block_forms(blocks).join(table, "form").filter("lemma <> form").groupBy("block")  # at most the tokens of one block in a group
               .agg(F.map_from_entries(F.collect_list(F.struct("i", "lemma"))).alias("changed")))
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                terms = batch.column("terms")[n].as_py()
                for i, lemma in batch.column("changed")[n].as_py() or []:
                    terms[i] = lemma
                sizes, codes = (np.frombuffer(batch.column(c)[n].as_buffer(), "<i4") for c in ("sizes", "codes"))
                words = pa.array(terms, pa.string()).take(pa.array(codes))
                ids = batch.column("ids")[n].values
                yield pa.RecordBatch.from_arrays([*(ids.field(c) for c in kind.names), pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), words)],
                                                 [*kind.names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields] + [f"{out} array<string>"])
    return blocks.join(changed, "block", "left").mapInArrow(run, schema)
