import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import syncmers
from tidemark.llm.syncmers import anchors, fingerprint_edits, likeness


def chained(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(text, k=8):
    h = [signed(chained(w)) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    if len(h) < k:
        return [chained(*h) >> 32] if h else []
    pairs = [signed(chained(a, b)) for a, b in zip(h, h[1:])]
    out, names = [], []
    for i in range(len(h) - k + 1):
        inner = pairs[i : i + k - 1]
        names.append(chained(*inner[0:-1:2], inner[-1]) >> 32)
        if min(inner) in (inner[0], inner[-1]):
            out.append(names[-1])
    return out or [min(names)]


def alike(x, y):
    """Different anchors that both have, less one for each break in their order, of all."""
    if not x and not y:
        return 1.0
    a, b = ([v for v in dict.fromkeys(own) if v in other] for own, other in ((x, y), (y, x)))
    breaks = sum(b.index(v) != b.index(u) + 1 for u, v in zip(a, a[1:]))
    return (len(a) - breaks) / len({*x} | {*y})


def test_rows(spark):
    rng = random.Random(4)
    text = lambda n: rng.choice([" ", "\n", " \t "]).join(rng.choice(["The", "a", "né", "日本語", "x,", "w1", "w2", "w3"]) for _ in range(n))
    docs = [(i * 7, rng.choice([text(rng.choice([1, 5, 8, 9, 40, 90])), text(30)])) for i in range(30)] + [(500, None), (501, ""), (502, " \n"), (503, "😀" * 9)]
    docs += [(3, docs[0][1]), (None, text(20))]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in docs + docs[:2]], "doc_id long, text string, h string, n int")
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprint_edits(frame).collect()}
    assert fingerprint_edits(frame).count() == len(docs) + 2
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0]), reverse=True)
    for j, (i, t) in enumerate(order):
        own, other = t or "", order[(j + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        a, b, c = brute(own), brute(edited), brute(other)
        want = (i, len(own), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), alike(a, b), alike(a, c))
        assert tuple(got[i, len(own)]) == want
    one = fingerprint_edits(frame.where("doc_id = 503")).collect()[0]
    assert one["near_next"] == 1.0 and fingerprint_edits(frame.limit(0)).collect() == []


def test_context_free_and_native(spark):
    w = [f"t{i}" for i in range(400)]
    rows = spark.createDataFrame([(" ".join(w),), (" ".join(w[:200] + ["new"] + w[200:]),), ("q " * 400_000,)], "text string")
    x, y, z = (r[0] for r in rows.select(anchors("text")).collect())
    assert len({*x} - {*y}) <= 8 and 0.2 < len(x) / 393 < 0.4 and len(z) == 399_993
    plan = fingerprint_edits(rows.withColumn("doc_id", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_sees_order(spark):
    rng = random.Random(6)
    whole = list(range(40))
    mixed = rng.sample(whole, 40)
    pairs = [(whole, whole), (whole, whole[20:] + whole[:20]), (whole, whole[::-1]), (whole, mixed), (whole, whole[:10] + [99] + whole[10:]), (whole, whole[:20]), (whole, [77]), ([], []), (whole, []), (whole + whole, whole)]
    pairs += [([rng.randrange(12) for _ in range(rng.randrange(15))], [rng.randrange(12) for _ in range(rng.randrange(15))]) for _ in range(60)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x array<bigint>, y array<bigint>").select("i", likeness("x", "y").alias("v")).collect()
    got = {r["i"]: r["v"] for r in rows}
    assert all(abs(got[i] - alike(x, y)) < 1e-12 for i, (x, y) in enumerate(pairs))
    assert [round(got[i], 3) for i in (0, 1, 2, 4, 5, 6, 7, 8, 9)] == [1.0, 0.975, 0.025, 0.976, 0.5, 0.0, 1.0, 0.0, 1.0] and got[3] < 0.2


def test_more_ranges_for_more_bytes(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 200)
    docs = [(i % 50, f"a{i % 60} b c d e f g h i{i % 7}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, fingerprint_edits(frame).collect()))
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 1 << 40)
    assert got == sorted(map(tuple, fingerprint_edits(frame).collect())) and len(got) == 300
