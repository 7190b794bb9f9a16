import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import STATISTICS, isotonic, keep_good, score_quality, statistics, with_statistics


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        if good:
            text = ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(2, 12))) + "."
        else:
            text = rng.choice([f"{rng.choice(words)} " * rng.randrange(20, 90), " ".join(rng.choice(words).upper() + "!!" for _ in range(40)), " | ".join(rng.choice(words) for _ in range(40))])
        docs.append((i, text, "src0", "en"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 1)
    docs += [(None, "x y z", "s", "en"), (2000, None, "s", "en"), (2001, "", "s", "en"), docs[5]]
    labels += [labels[5], (None, 1, 1), (3, None, None)]
    frame = spark.createDataFrame([d + (1, [2.0]) for d in docs], "doc_id long, text string, source string, lang string, id int, x array<double>")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_quality(frame, known).collect()
    assert len(got) == len(docs)
    truth = {a: b for a, b, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 400 and sum(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = {r["doc_id"] for r in keep_good(frame, known).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}
    again = score_quality(frame, known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in again} == {r["doc_id"]: round(r["score"], 9) for r in got}


def test_few_labels(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in score_quality(docs, one).collect())


def test_statistics(spark):
    x = statistics(pa.array(["AB cd!!\nef", None, "", "a a a b"]))
    s = dict(zip(STATISTICS, x[0]))
    assert np.isclose(s["upper"], 0.2) and np.isclose(s["call"], 0.2) and np.isclose(s["newline"], 0.1) and np.isclose(s["words"], np.log1p(3)) and np.isclose(s["word_length"], 8 / 3)
    assert not x[1].any() and not x[2].any()
    t = dict(zip(STATISTICS, x[3]))
    assert (t["repeats"], t["unique_words"], t["top_word"], t["lines"]) == (0.5, 0.5, 0.75, np.log1p(1))
    assert len(with_statistics(spark.createDataFrame([(1, "q " * 300_000)], "doc_id long, text string")).first()["x"]) == len(STATISTICS)


@pytest.mark.parametrize("seed", range(4))
def test_isotonic(seed):
    rng = np.random.default_rng(seed)
    y, n = rng.random(9), rng.integers(1, 5, 9).astype(float)
    places, values = isotonic(np.arange(9.0), y * n, n)
    assert (np.diff(values) > 0).all()
    best = [max(min((y[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(values, 9))


def test_scores_match_a_plain_fit(spark):
    """Least squares on augmented rows and isotonic means by their min-max formula, with numpy alone."""
    import zlib

    from tidemark.llm.quality import BINS, FEATURES, PENALTY, Model

    rng = random.Random(5)
    docs, labels = corpus(400, 2)
    labels = [(i, y ^ (rng.random() < 0.15), t) for i, y, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["score"] for r in score_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    x = statistics(pa.array([t for _, t, *_ in docs]))
    fixed = Model(x.mean(axis=0), x.std(axis=0))  # for its projections
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1), -4, 4)
    waves = np.array([[np.sqrt(2 / FEATURES) * np.cos(row @ p + a) for p, a in zip(fixed.project.T, fixed.phase)] for row in z])
    f = np.column_stack([waves, z, np.ones(len(z))])
    y, rest = np.array([y for _, y, _ in labels], dtype=float), np.array([zlib.crc32(str(i).encode()) % 3 for i, *_ in docs])

    def weights(own):
        penalty = np.full(f.shape[1], PENALTY * own.sum())
        penalty[-1] = 1e-9
        return np.linalg.lstsq(np.vstack([f[own], np.diag(np.sqrt(penalty))]), np.concatenate([y[own], np.zeros(len(penalty))]), rcond=None)[0]

    unseen = np.where(rest == 2, f @ weights(rest == 0), f @ weights(rest == 2))[rest != 1]
    bins = np.rint(np.clip(unseen, -1, 2) * BINS)
    places = np.unique(bins)
    sums, counts = (np.array([w[bins == b].sum() for b in places]) for w in (y[rest != 1], np.ones(len(bins))))
    mean = lambda a, b: sums[a : b + 1].sum() / counts[a : b + 1].sum()
    n = len(places)
    values = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
    levels = np.unique(np.round(values, 12))
    middle = [np.average(places[np.round(values, 12) == v], weights=counts[np.round(values, 12) == v]) / BINS for v in levels]
    want = np.clip(np.interp(f @ weights(rest != 1), middle, levels), 0, 1)
    assert len(levels) > 3 and np.allclose([got[i] for i, *_ in docs], want, atol=1e-6)
