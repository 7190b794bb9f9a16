import random

from test_syncmers import brute
from tidemark.llm.queries import QUERIES
from tidemark.llm.syncmers import anchors


def test_every_text_with_tokens_has_an_anchor(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(1, 20) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", anchors("text").alias("x")).collect()
    assert all(r["x"] == brute(r["text"]) and r["x"] for r in rows)


def test_only_texts_without_tokens_are_alike(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(6)]
    spark.createDataFrame([*enumerate([*texts, "", " \n", None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op8_document_fingerprints"](spark, str(tmp_path)).collect()}
    assert {i: r["near_next"] for i, r in rows.items()} == {i: float(i > 6) for i in range(9)}
    assert all((r["fingerprint"] != "") == (i < 6) for i, r in rows.items())
