import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.decontamination import contamination
from tidemark.llm.minhash import keep_one_of_each, near_duplicates
from tidemark.llm.quality import score_quality
from tests_llm_helpers import brute_groups, brute_windows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, copies, shared lines, benchmark passages, and rows of every odd kind."""
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))).capitalize() + "."
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(5)]
    shared = " ".join(sentence() for _ in range(7))
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.75
        text = "\n".join(sentence() for _ in range(rng.randrange(2, 9))) if good else f"{rng.choice(words)} " * rng.randrange(20, 90)
        text += f"\n{shared}" if good and i % 40 == 0 else ""
        text += f"\n{items[i % 5][1]}" if good and i % 50 == 1 else ""
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(500, docs[10][1], "en", "a", 0), (501, None, None, None, None), (502, "", "en", "a", 0), (502, "", "en", "a", 0), (None, sentence(), "en", "a", 1), docs[7]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out = staged(out, name)
        kept.append((docs.collect(), out.collect()))
        docs = out
    rows = lambda x: sorted(map(tuple, x), key=repr)

    before, after = kept[0]
    good = score_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {(r["doc_id"]) for r in good.where("predicted = 1").collect()}
    assert rows(after) == rows(r for r in before if r["doc_id"] in good) and 250 < len(after) < 350

    before, after = kept[1]
    assert sorted(str(r["doc_id"]) for r in before) == sorted(str(r["doc_id"]) for r in after)
    lines = [x for _, t in {(r["doc_id"], r["text"]) for r in after} if t for x in t.split("\n") if len(x.split()) >= 5]  # repeated rows keep the same
    assert len(lines) == len({*lines}) and {x for r in before if r["text"] for x in r["text"].split("\n")} >= {*lines}
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)

    before, after = kept[2]
    groups = brute_groups([r["text"] for r in before], 5, 80)
    assert len(after) == len({*groups})
    assert all((r["doc_id"], r["text"]) in {(b["doc_id"], b["text"]) for b in before} for r in after)

    before, after = kept[3]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows(after) == rows(r for r in before if not brute_windows(r["text"], items, 10)) and len(after) < len(before)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= {*got.columns}
    rows = got.collect()
    assert len(rows) > 200
    for key in {r["sequence_id"] for r in rows}:
        at = 0
        for offset, length in sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == key):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY


@pytest.mark.parametrize("seed", [0, 1])
def test_one_of_each(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(f"v{rng.randrange(900)}" for _ in range(n)) for n in (3, 60, 90, 300)]
    docs = [(rng.choice([None, *range(30)]), rng.choice([None, "", *base, *[b.replace("v1", "z", rng.randrange(3)) for b in base]]), rng.randrange(3)) for _ in range(70)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, x int")
    got = keep_one_of_each(frame).collect()
    groups = brute_groups([t for _, t, _ in docs], 5, 80)
    assert len(got) == len({*groups})
    key = lambda i: (i is None, i or 0)
    least = {}
    for (i, _, _), g in zip(docs, groups):
        least[g] = min(least.get(g, key(i)), key(i))
    assert sorted(key(r["doc_id"]) for r in got) == sorted(least.values())
    assert keep_one_of_each(frame.limit(0)).collect() == []
    assert near_duplicates(frame).count() == len(docs)


def test_contamination_agrees(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, folder)
    assert clean.count() == contamination(docs, items).where(~F.col("contaminated")).count()
