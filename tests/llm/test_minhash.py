import random
import re

import numpy as np
import pytest

from tidemark.llm.kernels import mix
from tidemark.llm.links import connected_components
from tidemark.llm.minhash import merge_registers, near_duplicates, possible, registers


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent):
    own = [sets_of(t, k) for _, t in rows]
    group = [*range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (name, _) in enumerate(rows):
        first = min((rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None), default=None)
        first = first if own[i] else name
        out.append((name, len(own[i]), first, name == first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,k,percent", [(0, 3, 85), (1, 5, 80), (2, 3, 85)])
def test_equals_brute_force(spark, seed, k, percent):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([2, 40, 200, 300]))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = rng.choice(["X", "Ünï", "zz", *w])
            texts.append(rng.choice([" ", "\n", "  \t"]).join(w).replace("w1", rng.choice(["w1", "W1"])))
    texts += [None, "", " \n\x0b", "one", "One", "one two", "\x1cone", "a b c", "c b a"] + texts[:3]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], (None, texts[1]), (None, "alone here with no id at all")]
    docs = spark.createDataFrame([(a, b, b"", "x") for a, b in rows], "doc_id long, text string, node binary, id string")
    got = near_duplicates(docs, k, percent).collect()
    assert sorted((r[0], r[1], r[2], r[3] if r[0] is not None or r[2] is not None else False) for r in got if r[0] is not None) == sorted(x for x in brute(rows, k, percent) if x[0] is not None)
    assert near_duplicates(docs.limit(0), k, percent).collect() == []


def test_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 100), (7, 7), (95, 100)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(i, 0) for i in range(61)] + [(90, 90), (95, 90), (100, 90)]


def test_registers_estimate():
    x = mix(np.arange(9000, dtype=np.uint64))
    a, b = registers(x[:6000]), registers(x[1000:7000])
    assert abs((a == b).mean() - 5 / 7) < 0.15
    assert (merge_registers(a, b) == registers(x[:7000])).all()
    n = np.array([6000.0])
    assert possible(a[None], b[None], n, n, 0.7)[0] and not possible(a[None], registers(x[3000:])[None], n, n, 0.85)[0]
    assert possible(a[None], a[None], n, n, 1.0)[0]
