"""Runs of the line store as the merge join reads them, and archives of many shards."""
import hashlib
import random

from lectern.llm import line_dedup, warc
from lectern.session import scratch_path

rng = random.Random(11)


def test_runs_are_merged_without_exchange_or_sort(spark):
    store = line_dedup.LineStore(spark, scratch_path(spark, "lines"), fanout=2)
    seen: dict[bytes, int] = {}
    for n in range(5):
        rows = [(rng.randrange(1000), hashlib.md5(str(rng.randrange(400)).encode()).digest()) for _ in range(300)]
        batch = spark.createDataFrame(rows, "id long, hash binary")
        if n == 3:  # runs on two levels
            with line_dedup.sorted_buckets(spark):
                plan = store.unowned(batch)._jdf.queryExecution().executedPlan().toString()
            assert [len(x) for x in store.levels] == [1, 1] and plan.count("SortMergeJoin") == 2
            # the batch's own exchange and sort, none for the runs
            assert plan.count("Exchange hashpartitioning(hash") == 1 and plan.count("Sort [hash") == 1, plan
        fresh: dict[bytes, int] = {}
        for i, h in rows:
            if h not in seen:
                fresh[h] = min(i, fresh.get(h, i))
        assert {bytes(r.hash): r.id for r in store.add(batch).collect()} == fresh
        seen |= fresh
    assert {bytes(r.hash): r.id for r in store.runs().collect()} == seen
    assert [len(x) for x in store.levels] == [1, 0, 1]
    store.close()
    assert spark.conf.get(line_dedup.ORDERED) == "false" and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_runs_with_another_number_of_buckets(spark):
    batch = lambda ks, i: spark.createDataFrame([(i, hashlib.md5(k.encode()).digest()) for k in ks], "id long, hash binary")
    root, before = scratch_path(spark, "lines"), spark.conf.get("spark.sql.shuffle.partitions")
    store = line_dedup.LineStore(spark, root, fanout=3)
    store.add(batch("abcdefgh", 1))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        again = line_dedup.LineStore.open(spark, root, fanout=3)
        assert again.add(batch("ghij", 2)).count() == 2
        assert again.add(batch("jk", 3)).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [len(x) for x in again.levels] == [0, 1] and again.runs().count() == 11


def test_archive_of_many_shards(spark):
    """One very long payload, clashing columns, and a shard for every few records, each in a task of its own."""
    rows = [(i * 7 % 5003, f"http://h/{i}", f"<p>{i}</p>" * (60_000 if i == 17 else 1 + i % 40), "clash", 1, 2) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, body string, shard int, revisit int")
    total = sum(len(r[2].encode()) for r in rows)
    files = None
    for part in (3, 11):
        root = scratch_path(spark, "warc")
        found = warc.write_archive(pages.repartition(part), root, shard_bytes=total // 200, roll_bytes=1 << 30).collect()
        names = sorted((r.name, r.sha256) for r in found)
        assert files in (None, names)
        files = names
        assert len({r.shard for r in found}) > 100 and sum(r.records for r in found) == len(rows)
        back = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archive(spark, root).collect()}
        assert back == {p: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for p, _, h, *_ in rows}
