"""The operators applied to whole driver tables: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.placement import place

    shards = [f"shard-{i:03d}" for i in range(64)]
    return place(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], shards)


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), wide=True)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.syncmers import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that labels call good are the target, all documents the background."""
    from tidemark.llm.lm import cross_entropy_difference
    from tidemark.llm.links import matching

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    good = matching(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"), "doc_id")
    out = cross_entropy_difference(docs, staged(good, "target"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.search import top_products

    vectors = _table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs``, in which each text whose id's checksum is divisible by ten repeats some of its words from a word on; its white space becomes single spaces."""

    @F.pandas_udf("string")
    def plant(texts, sums):
        def one(text, h):
            if text is None or not (words := text.encode().split()):
                return text
            g = int(h) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            return b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)]).decode()

        import pandas as pd

        return pd.Series([one(t, h) for t, h in zip(texts, sums)], dtype=object)

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = h % 10 == 0
    return docs.withColumn("text", F.when(chosen, plant(F.when(chosen, F.col("text")), h)).otherwise(F.col("text")))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periods import find_runs, run_report

    return run_report(find_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {
    "op11_embedding_whitening": embedding_whitening,
    "op12_exact_topk_search": exact_topk_search,
    "op13_periodic_runs": periodic_runs,
    "op4_lm_scoring": lm_scoring,
    "op6_secret_scans": secret_scans,
    "op2_quality_classifier": quality_classifier,
    "op8_document_fingerprints": document_fingerprints,
    "op1_line_dedup": line_dedup,
    "op9_minhash_near_dedup": minhash_near_dedup,
    "op3_warc": warc,
    "op5_sharding": sharding,
    "op10_benchmark_decontamination": benchmark_decontamination,
    "op7_best_fit_packing": best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op4_lm_scoring": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT r, doc_id, CAST(substr(md5(text), 1, 1) >= '8' AS INT) AS half,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
        ), o AS (
            SELECT r, half, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, unnest(words) AS u, unnest(list_append(words[2:], '')) AS v FROM w WHERE len(words) > 0
        ), g AS (
            SELECT r, half, good, u, NULL AS v FROM o UNION ALL SELECT r, half, good, u, v FROM o
        ), c AS (
            SELECT u, v, 1 - half AS half, sum(CAST(good AS INT)) AS t, count(*) AS b FROM g GROUP BY ALL
        ), n AS (
            SELECT h.half, (SELECT count(DISTINCT u) + 1 FROM o) AS vocabulary, count(*) FILTER (good AND o.half <> h.half) AS t, count(*) FILTER (o.half <> h.half) AS b
            FROM (VALUES (0), (1)) AS h(half), o GROUP BY h.half
        ), x AS (
            SELECT r, half, u, v, count(*) AS k FROM g GROUP BY ALL
        ), y AS (
            SELECT x.r, x.k, x.v, n.vocabulary, n.t AS n, coalesce(c.t, 0) AS t, CASE WHEN n.b > 0 THEN coalesce(c.b, 0) * (n.t / n.b) ELSE 0 END AS b
            FROM x JOIN n ON n.half = x.half LEFT JOIN c ON c.u = x.u AND c.v IS NOT DISTINCT FROM x.v AND c.half = x.half
        ), p AS (
            SELECT r, sum(k * CASE WHEN v IS NULL THEN 0.5 * ln((t + 0.1) / (n + 0.1 * vocabulary)) - 0.5 * ln(t + 0.1 * vocabulary) ELSE 0.5 * ln(t + 0.1) END) AS t,
                   sum(k * CASE WHEN v IS NULL THEN 0.5 * ln((b + 0.1) / (n + 0.1 * vocabulary)) - 0.5 * ln(b + 0.1 * vocabulary) ELSE 0.5 * ln(b + 0.1) END) AS b
            FROM y GROUP BY r
        )
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(coalesce(-p.t / len(words), 0.0), 6) AS target_loss,
               round(coalesce(-p.b / len(words), 0.0), 6) AS background_loss, round(coalesce((p.t - p.b) / len(words), 0.0), 6) AS score
        FROM w LEFT JOIN p ON p.r = w.r
    """,
    "op12_exact_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.x, p.x) AS BIGINT) AS score
            FROM v q JOIN v p ON p.r <> q.r AND len(p.x) = len(q.x) WHERE q.vec_id % 20 = 0
        ), n AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < first THEN first END AS refers_to
        FROM m
    """,
}
