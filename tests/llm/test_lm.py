import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.llm import lm
from tidemark.llm.links import matching
from tidemark.llm.queries import ORACLES

COLUMNS = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]


@pytest.mark.parametrize("seed,lot,hot", [(0, 1_000_000, 20_000), (1, 150, 30), (2, 40, 5)])
def test_equals_sql(spark, monkeypatch, tmp_path, seed, lot, hot):
    """All paths: several lots and buckets, hot n-grams and none."""
    monkeypatch.setattr(lm, "LOT", lot)
    monkeypatch.setattr(lm, "HOT", hot)
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", f"wörd{rng.randrange(9)}", f"x{rng.randrange(60)}", "9"])
    docs = [(i, rng.choice([None, "", "!", *[" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(6)]])) for i in range(120)]
    docs += [(200, docs[3][1]), (201, "the " * 3000), (7, docs[7][1])]
    labels = [(i, rng.randrange(2), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, 0)]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])
    table = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64").query("doc_id.notna()")
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", table)
    want = con.sql(ORACLES["op4_lm_scoring"]).fetchall()
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS half", "'x' AS id").repartition(3).write.parquet(f"{tmp_path}/documents")
    frame = spark.read.parquet(f"{tmp_path}/documents")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = matching(frame.select("doc_id", "text"), known.where("quality = 1").select("doc_id"), "doc_id")
    got = lm.cross_entropy_difference(frame, good)
    assert got.columns == COLUMNS
    got, want = sorted(map(tuple, got.collect())), sorted(want)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 3e-6 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "d " * 200_000)], "doc_id long, text string")
    got = lm.cross_entropy_difference(docs, docs.limit(0)).collect()
    assert len(got) == 3 and all(abs(r["score"]) < 1e-9 and r["target_loss"] > 0 for r in got)
    assert lm.cross_entropy_difference(docs.limit(0), docs).collect() == []


def test_target_words_score_higher(spark):
    rng = random.Random(4)
    text = lambda k: " ".join(f"{k}{rng.randrange(30)}" for _ in range(60))
    docs = [(i, text("t" if i % 4 == 0 else "b")) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = frame.where("doc_id % 4 = 0 AND doc_id < 120")
    got = {r["doc_id"]: r["score"] for r in lm.cross_entropy_difference(frame, target).collect()}
    assert min(v for k, v in got.items() if k % 4 == 0) > 0 > max(v for k, v in got.items() if k % 4)


def test_another_order_is_told():
    def row(lot, digest, docs, sums, ids=None, n=None):
        names = ["lot", "digest", "docs", "sums", "ids", "n"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lot, digest, docs, sums, ids, n), kinds)], names=names)

    head, part = np.zeros((2, 3)).tobytes(), (np.array([1], dtype=np.uint32).tobytes(), np.ones((2, 1)).tobytes())
    rows = [row(4, 9, None, head, [5, 6, 7], [2, 2, 2]), row(4, 9, *part)]
    assert pa.Table.from_batches(lm._lot_totals(rows)).to_pydict() == {"id": [5, 6, 7], "n_tokens": [2, 2, 2], "target": [0.0, 1.0, 0.0], "background": [0.0, 1.0, 0.0]}
    for other in (row(4, 8, *part), row(5, 9, *part)):
        with pytest.raises(ValueError, match="another order"):
            list(lm._lot_totals([*rows, other]))


def test_matching(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (9,), (None,), (2,)], "x int")
    assert sorted(map(tuple, matching(rows, ids, "doc_id").collect())) == [(2, "b"), (2, "d")]
