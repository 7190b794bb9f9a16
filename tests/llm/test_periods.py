import hashlib
import random
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.periods import branching_repeats, find_runs, maximal_runs, run_report, runs_of_texts, without_repeats
from tidemark.llm.queries import with_planted_runs


def brute(words, least, periods):
    """By the definition: for each period the stretches of words that equal those a period on, and which of these periods is the smallest."""
    out, n = {}, len(words)
    for p in range(1, n // periods + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, periods * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((i, j - i, p) for (i, j), p in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(2, 4))
def test_runs_of_small_alphabets(words, least, periods):
    symbols = np.append(np.array(words, dtype=np.int64), 99)
    assert maximal_runs(symbols, least, periods) == brute(words, least, periods)


def test_branching_repeats_are_all():
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.randrange(2) for _ in range(rng.randrange(40))]
        symbols = np.array([*words, 9])
        want = {(i, p) for p in range(1, len(words) // 2 + 1) for i in range(len(words) - 2 * p + 1) if words[i : i + p] == words[i + p : i + 2 * p] and symbols[i + p] != symbols[i + 2 * p]}
        starts, periods = branching_repeats(symbols)
        got = [*zip(starts.tolist(), periods.tolist())]
        assert {*got} == want and len(got) == len(want)


def planted(rng, n):
    """Text with a run or two inside, or none, and words at random."""
    out = [rng.choice(["a", "b", "é", "d1", "e"]) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        p, a = rng.randrange(1, 12), rng.randrange(n + 1)
        part = [rng.choice("abcdefgh") for _ in range(p)]
        out[a:a] = [part[i % p] for i in range(rng.randrange(4 * p + 30))]
    return out


def test_many_texts_at_once():
    rng = random.Random(2)
    texts = [[w.encode() for w in planted(rng, rng.randrange(1, 120))] for _ in range(80)] + [[], [b"x"] * 24, [b"x"] * 23]
    found = runs_of_texts(texts)
    assert found == [brute(t, 24, 3) for t in texts] and sum(map(len, found)) > 20


def test_long_and_repetitive_texts():
    """All words equal, two periods in a large one, and words of Fibonacci."""
    n = 200_000
    assert runs_of_texts([[b"x"] * n]) == [[(0, n, 1)]]
    part = [b"x"] * 30 + [b"y"]
    found = runs_of_texts([part * 2000])[0]
    assert (0, 62_000, 31) in found and len(found) == 2001
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs_of_texts([b]) == [brute(b, 24, 3)]


def test_rows(spark):
    """Nulls, empty texts, white space of other scripts, repeated rows and null ids."""
    run = "x " + "a b\tc\n" * 9
    rows = [(1, run, 7), (1, run, 7), (2, None, 7), (3, "", 7), (4, " \x0b\f\r\n", 7), (None, run + "  end", 7), (5, "a b " * 24, 7), (6, "one two", 7), (7, "q " * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = find_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = []
    for i, text, _ in rows:
        words = (text or "").encode().split()
        runs = brute(words, 24, 3)
        want.append((i, [tuple(r) for r in runs], without_repeats(words, runs).decode()))
    plain = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert ("x a b c" in {r[2] for r in plain}) and find_runs(docs.limit(0)).collect() == []
    assert run_report(got).where("doc_id = 2").first().asDict() == {"doc_id": 2, "n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": hashlib.sha256(b"").hexdigest(), "collapsed_sha256": hashlib.sha256(b"").hexdigest()}


def test_report_on_planted_documents(spark):
    """The query's rows, from words planted here anew."""
    import re
    import zlib

    rng = random.Random(3)
    rows = [(i, " ".join(planted(rng, rng.randrange(1, 90)))) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in run_report(find_runs(with_planted_runs(docs))).collect()}
    changed = 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            changed += 1
        runs = brute(words, 24, 3)
        keep = [w for j, w in enumerate(words) if not any(s + p <= j < s + m for s, m, p in runs)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert got[i] == (len(runs), *one, digest, hashlib.sha256(" ".join(keep).encode()).hexdigest())
    assert changed > 10 and len(got) == len(rows)
