"""Rows of shared buckets that are looked at: strangers end before they are stored, for all else nothing is missed."""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import links
from tidemark.llm.common import release, staged


@pytest.mark.parametrize("slice_rows", [20_000, 1_000_000])
def test_rows_with_a_plausible_partner_and_large_buckets_stay(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(links, "SLICE_ROWS", slice_rows)
    rng = random.Random(8)
    nodes = []
    for i in range(3000):
        own = {rng.randrange(3000) << 40 for _ in range(19)}
        own |= {1 << 60} if i % 2 else {2 << 60} if i % 20 == 0 else set()  # a bucket of 1500 rows, one of 150
        nodes.append((i.to_bytes(8, "little") + b"12345678", rng.randint(1, 60), b"12345678", sorted(own)))
    held = defaultdict(list)
    for node, size, _, own in nodes:
        for b in own:
            held[b].append((node, size))
    want = set()
    for b, rows in held.items():
        n = Counter(size for _, size in rows)
        want |= {(b, node) for node, size in rows if len(rows) > links.SMALL or n[size] > 1}
    assert len(want) < 0.6 * sum(map(len, held.values())) and max(map(len, held.values())) > links.SMALL
    table = staged(spark.createDataFrame(nodes, "node binary, size long, sketch binary, buckets array<long>"), "blocks")
    out, members = links.partnered_buckets(table, lambda left, right, n, m: n == m, (table,))
    assert {(r["bucket"], bytes(r["node"])) for r in members.collect()} == want
    assert {bytes(r["node"]) for r in out.collect()} == {x for _, x in want}
    release(out, members)


def test_pairs_with_hubs_are_looked_at_in_one_go_where_members_are_few(spark, monkeypatch):
    """Every part reads all nodes again, and has shuffles and tasks of its own."""
    made = []
    real = links.staged
    monkeypatch.setattr(links, "staged", lambda df, name: made.append(name) or real(df, name))
    nodes = real(spark.createDataFrame([(bytes([i]) * 16, b"12345678", 5) for i in range(6)], "node binary, sketch binary, size long"), "nodes")
    same = lambda left, right, n, m: (n == m).astype(float)
    like = links.Likeness(same, lambda *x: same(*x) > 0, lambda x, y: True, 1)
    fulls = lambda ends: real(ends.withColumn("full", ends.node), "fulls")
    got = links.bucket_components(nodes, links.F.array(links.F.lit(1).cast("long")), like, fulls).collect()
    assert {bytes(r["component"]) for r in got} == {bytes(16)} and len(got) == 6
    assert made.count("likely") == 1


def test_a_filter_takes_no_job_for_each_partition(spark):
    ids = staged(spark.range(1000), "ids")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("30", "false")):
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("filter", "")
    try:
        bits = links.row_filter(ids)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("filter"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert links.passes(bits, links.np.arange(1000)).all() and jobs < 10
