from collections import Counter

import pytest

from tidemark.llm.common import new_folder
from tidemark.llm.placement import fill_table, place, slot_of, write_shards

NAMES = [f"shard-{i:02d}" for i in range(13)]


def slow_table(names, slots):
    """By the rule: full orders of preference, turn by turn."""
    import hashlib

    orders = []
    for name in sorted(names):
        d = hashlib.sha256(name.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append((name, [(a + j * b) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for name, order in orders:
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = name
    return [owner[k] for k in range(slots)]


def test_table():
    table = [NAMES[i] for i in fill_table(NAMES, 1009)]
    assert table == slow_table(NAMES, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    less = [NAMES[:-1][i] for i in fill_table(NAMES[:-1], 1009)]
    assert sum(a != b for a, b in zip(table, less) if a != NAMES[-1]) < 0.15 * 1009
    for bad in ((NAMES, 1000), ([], 7), (["a", "a"], 7), (NAMES, 11)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_rows(spark, tmp_path):
    rows = [(i, "t" if i % 7 else None, i) for i in [*range(500), 3, 3]] + [(None, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    got = place(docs, ["doc_id"], NAMES, 1009)
    assert got.columns == ["doc_id", "text", "slot", "shard"] and got.count() == len(rows)
    table = fill_table(NAMES, 1009)
    slots = {r["doc_id"]: r["s"] for r in docs.select("doc_id", slot_of("doc_id", slots=1009).alias("s")).collect()}
    assert all(r["shard"] == NAMES[table[r["slot"]]] and r["slot"] == slots[r["doc_id"]] for r in got.collect())
    path = new_folder(spark, "shards")
    write_shards(docs, ["doc_id"], NAMES, path, 1009)
    assert spark.read.parquet(path).count() == len(rows)
    assert place(docs.limit(0), ["doc_id"], NAMES, 1009).collect() == []
