import random
import re

import numpy as np
import pytest

from tidemark.llm.kernels import byte_table, words
from tidemark.llm.lines import MOST_BITS, SEPARATORS, dedup_lines, line_bounds, simhashes, within

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(line):
    return " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def blocks_of(lines):
    raw = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in raw])
    h, _, _, n = words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends, byte_table(SEPARATORS))
    return simhashes(h, n)


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, percent=80, least=5):
    """(id, text without dropped lines) by comparing all pairs of lines that share a block."""
    places = [(i, t, k, normal(x)) for i, t in docs if t is not None for k, x in enumerate(t.split("\n")) if normal(x)]
    long = sorted({x for *_, x in places if x.count(" ") + 1 >= least})
    blocks = dict(zip(long, blocks_of(long))) if long else {}
    group = {x: x for x in long}
    for i, x in enumerate(long):
        for y in long[:i]:
            z = blocks[x] ^ blocks[y]
            if (z.reshape(-1, 4) == 0).all(axis=1).any() and np.bitwise_count(z).sum() <= MOST_BITS and 100 * distance(x, y) <= (100 - percent) * max(len(x), len(y)):
                old, new = group[x], group[y]
                group = {k: new if g == old else g for k, g in group.items()}
    kept, seen = set(), set()
    for i, t, k, x in sorted(places, key=lambda p: (p[0] is None, p[0], p[2])):
        key = (group[x],) if x in group else (x, i, t)
        if key not in seen:
            seen.add(key)
            kept.add((i, t, k))
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not normal(x) or (i, t, k) in kept)) for i, t in docs]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(300)] + ["the", "OF", "a"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [line(rng.choice([1, 2, 4, 5, 8, 30, 60])) for _ in range(14)]

    def near(x):
        w = x.split(" ")
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(["zz", "The", w[0] + "s"])
        return rng.choice([" ", ", "]).join(w) + rng.choice(["", ".", "  "])

    docs = []
    for i in range(40):
        docs.append((i, rng.choice(["\n", "\n\n", "\n--\n"]).join(near(rng.choice(base)) if rng.random() < 0.5 else line(rng.choice([1, 3, 20])) for _ in range(rng.randrange(1, 8)))))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[0][1]), (104, "same one.\nsame one\nSame, one"), (105, "same one"), (None, docs[1][1])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, h int, node string")
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "h", "node", "n_lines", "dropped_lines"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(brute(docs), key=repr)


def test_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w69 ", "x ", 1)), (3, "other"), (3, "other")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"] == "", tuple(r["dropped_lines"])) for r in dedup_lines(docs).collect()}
    assert got == {(1, False, ()), (2, True, (0,)), (3, False, ())}
    assert dedup_lines(docs.limit(0)).collect() == []


def test_line_bounds():
    raw = [b"a\nb", b"", b"\n", b"c\n\nd"]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin, end, text = line_bounds(data, ends - [len(x) for x in raw], ends)
    assert [(t, bytes(data[a:b])) for a, b, t in zip(begin, end, text)] == [(i, x) for i, r in enumerate(raw) for x in r.split(b"\n")]


@pytest.mark.parametrize("seed", range(3))
def test_within(seed):
    rng = random.Random(seed)
    for _ in range(400):
        x = "".join(rng.choice("abé日𝄞"[: 2 + seed]) for _ in range(rng.randrange(0, 25)))
        y = list(x) if rng.random() < 0.8 else [rng.choice("abz") for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(6)):
            y[rng.randrange(len(y) + 1) : rng.randrange(len(y) + 1)] = rng.choice([[], ["b"], ["q", "a"]])
        true = distance(x, "".join(y))
        assert [within(x, "".join(y), k) for k in (true - 1, true, true + 1)] == [False, True, True]
