import hashlib
import random
import re

import pytest

from tidemark.llm.decontamination import benchmark_hits, contamination, keep_clean

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, names = split(text), set(), set()
        for name, x in items:
            x = split(x)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for p in range(len(own) - n + 1):
                if n and tuple(own[p : p + n]) in windows:
                    hit |= {*range(p, p + n)}
                    names |= {name} - {None}
        listed = ",".join(sorted(names))
        out.append((i, len(own), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,block", [(0, 1 << 20), (1, 1 << 20), (2, 300), (0, 1), (1, 1)])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c9", "é", "İx", "日本", "dd"][: 3 + 2 * seed]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 4, 9, 10, 11, 25]) + 3)) for i in range(12)] + [("9", text(12)), (None, text(30)), ("12", None), ("13", ""), ("14", "zz yy")]
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", "!? ", text(5), text(60), text(8) + items[rng.randrange(12)][1] + text(8)])) for _ in range(60)]
    got = contamination(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_long_text_and_empty_tables(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " * 300_000 + " ".join(words) + " y" * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert benchmark_hits(docs, items).collect()[0].asDict() == {"doc_id": 1, "n_words": 300_049, "hit_spans": [300_000, 300_040], "hit_items": ["5"]}
    assert contamination(docs.limit(0), items).collect() == []
    assert not contamination(docs, items.limit(0)).collect()[0]["contaminated"]


def test_joined_and_sent_items_give_the_same(spark):
    """A passage that a third of all documents and items share, equal items under many ids, repeated rows, clashing columns."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    common = text(40)
    items = [(i, common if i % 3 == 0 else f"{text(6)} {common} {text(9)}" if i % 3 == 1 else text(rng.randrange(1, 30))) for i in range(60)]
    docs = [(i % 150, f"{text(12)} {common} {text(5)}" if i % 3 == 0 else text(50), "i") for i in range(200)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, i string"), spark.createDataFrame(items, "item_id long, text string")
    hits = lambda b: sorted(map(repr, benchmark_hits(docs, items, block_bytes=b, carry=["doc_id", "i"]).collect()))
    assert hits(1) == hits(1 << 20) and sum("hit_spans=[]" in x for x in hits(1)) < 140
    rows = lambda b: sorted(map(repr, keep_clean(docs, items, block_bytes=b).collect()))
    assert rows(1) == rows(1 << 20) and 0 < len(rows(1)) < 140
    assert benchmark_hits(docs.limit(0), items, block_bytes=1).count() == 0


def test_items_do_not_reach_the_driver(spark, monkeypatch):
    """Beyond the bound only filters are collected: no item's text is in any answer that the driver gets."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    texts, seen = [" ".join(f"w{i}x{j}" for j in range(15)) for i in range(30)], []
    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    got = contamination(docs, items, block_bytes=100)
    assert not any(t in repr(seen) for t in texts)
    assert got.where("n_hit = 15 AND n_items = 1").count() == 30
