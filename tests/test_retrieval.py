import random

from tidemark.operators import retrieval
from tidemark.plans.catalogue import QUERIES


def test_all_queries_are_answered(spark, tmp_path, monkeypatch):
    """Small tiles, copies, zero and null vectors; each query gets what a search for it alone finds."""
    monkeypatch.setattr(retrieval, "VECTOR_TILE", 32)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 2)
    monkeypatch.setattr(retrieval, "HELD_TILES", 1)
    rng = random.Random(6)
    own = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(400)]
    rows = [(i, [0.0] * 6 if i == 7 else None if i == 9 else own[i % 350] if i % 5 else own[3], i % 40) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["vector_topk_each"](spark, str(tmp_path)).collect()
    assert {r["query"] for r in got} == {0, 100, 200, 300, 400, 500, 600} and len(got) == 140
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    query = {r["vec_id"]: r["embedding"] for r in v.where("vec_id % 100 = 0").collect()}
    for q in (0, 300):
        want = {(r["vec_id"], round(r["score"], 6)) for r in retrieval.nearest(v, query[q], 20, id_col="vec_id").collect()}
        assert {(r["vec_id"], r["score"]) for r in got if r["query"] == q} == want
