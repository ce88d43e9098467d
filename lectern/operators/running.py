"""Running totals inside sorted groups of any size.

A window function sends a whole group to one task.  Here the rows are range
partitioned by (group, order), so a group that holds a third of all rows is
spread over many tasks.  Every task streams its sorted rows and writes totals
that start at its own first row; what the group gathered in earlier partitions
(one row a partition) is added when the written table is read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def running_totals(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]],
                   name: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with a running total (this row included) for every entry of ``totals``.

    ``totals``: new column -> ("sum" or "xor", bigint column without nulls);
    ``keys``: bigint columns without nulls.  Rows that are equal in ``keys`` and
    ``order`` come in any order.  The result is a table in the shared folder.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys]
    rows = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)

    def run(batches):
        part, row, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            fresh = np.append(last is None or (key[:, 0] != last).any(), (key[:, 1:] != key[:, :-1]).any(0))
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            goes_on = np.cumsum(fresh) == 0
            out = []
            for new, (kind, column) in totals.items():
                v = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
                op = np.add if kind == "sum" else np.bitwise_xor
                upto = op.accumulate(v)
                before = upto[start] - v[start] if kind == "sum" else upto[start] ^ v[start]
                got = upto - before if kind == "sum" else upto ^ before
                if goes_on.any():
                    got[goes_on] = op(got[goes_on], carry[new])
                carry[new] = got[-1]
                out.append(pa.array(got))
            last = key[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *out, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))],
                [*batch.schema.names, *totals, "_part", "_row"])
            row += n

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
                       + [f"`{t}` bigint" for t in totals] + ["_part int", "_row bigint"])
    found = written(rows.mapInArrow(run, schema), name)
    # one row a partition: its first group, its last group and what that one has gathered
    edges = (found.groupBy("_part").agg(F.min(F.struct("_row", *keys)).alias("a"), F.max(F.struct("_row", *keys, *totals)).alias("z"))
             .orderBy("_part").collect())
    carried, have, group = [], {}, None
    for e in edges:
        first, final = tuple(e["a"][k] for k in keys), tuple(e["z"][k] for k in keys)
        mine = {t: e["z"][t] for t in totals}
        if first == group:
            carried.append((e["_part"], *first, *have.values()))
            if final == first:
                mine = {t: have[t] + mine[t] if totals[t][0] == "sum" else have[t] ^ mine[t] for t in totals}
        have, group = mine, final
    keep = [*df.columns, *totals]
    if not carried:
        return found.select(*keep)
    schema = ", ".join(["_part int"] + [f"_k{i} bigint" for i in range(len(keys))] + [f"_t{i} bigint" for i in range(len(totals))])
    more = F.broadcast(spark.createDataFrame(carried, schema))  # at most one row a partition
    same = [found["_part"] == more["_part"], *(found[k] == more[f"_k{i}"] for i, k in enumerate(keys))]
    sums = [F.coalesce((F.col(t) + F.col(f"_t{i}")) if kind == "sum" else F.col(t).bitwiseXOR(F.col(f"_t{i}")), F.col(t)).alias(t)
            for i, (t, (kind, _)) in enumerate(totals.items())]
    return found.join(more, same, "left").select(*(found[c] for c in df.columns), *sums)
