"""Nearest vectors, one result for each path, and fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import cosine

#: A list's ranks count from this number on.
RANK_OFFSET = 60
#: Vectors and queries of a tile; a task compares a tile of each at once and holds the best of so many tiles of queries.
VECTOR_TILE, QUERY_TILE, HELD_TILES = 2048, 256, 64


def overfetch(limit: int) -> int:
    """How many hits are fetched for so many results."""
    return min(200, max(8 * limit, 20))


def nearest(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest by cosine, with ``score``; ties by id. Each task keeps its best k. Null vectors are never near."""
    scored = vectors.where(vectors[vector_col].isNotNull()).withColumn("score", cosine(vector_col, F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def _tiles(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """(ids, vectors): packed longs and doubles of up to ``size`` rows of equal dimension; null vectors and those with nulls are left out."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            width = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(width):
                own = np.flatnonzero(width == n)
                for i in range(0, len(own), size):
                    rows = pa.array(own[i : i + size])
                    ids, values = batch.column(0).take(rows).to_numpy(), batch.column(1).take(rows).flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, values)], names=["ids", "vectors"])

    own = vectors.where(vectors[vector_col].isNotNull() & ~F.exists(vectors[vector_col], lambda x: x.isNull()) & (F.size(vectors[vector_col]) > 0))
    return own.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(pack, "ids binary, vectors binary")


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of both, summed in the order of dimensions, so that equal vectors have equal scores; 0 where a norm is 0."""
    out, nx, ny = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
    for a, b in zip(x.T, y.T):
        out += np.multiply.outer(a, b)
        nx, ny = nx + a * a, ny + b * b
    norm = np.multiply.outer(np.sqrt(nx), np.sqrt(ny))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row (a query's number) the first ``k`` by descending score and id."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[order][keep], scores[order][keep]


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, score): for each of ``queries`` what ``nearest`` gives, ids being longs. Tiles of queries meet tiles of vectors; each task keeps its best k for each query."""

    def compare(batches):
        import pyarrow as pa

        held = {}

        def out():
            for own, (row, ids, scores) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, dtype=np.int64)[row]), pa.array(ids), pa.array(scores)], names=["query", "id", "score"])

        for batch in batches:
            for q, x, v, y in zip(*(c.to_pylist() for c in batch.columns)):
                if len(x) // len(q) != len(y) // len(v):
                    continue
                ids = np.frombuffer(v, dtype=np.int64)
                scores = _cosines(*(np.frombuffer(b, dtype=np.float64).reshape(len(a) // 8, -1) for a, b in ((q, x), (v, y))))
                least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                row, column = np.nonzero(scores >= least[:, None])
                new = row, ids[column], scores[row, column]
                held[q] = _best(*(np.concatenate(z) for z in zip(held[q], new)), k) if q in held else _best(*new, k)
                if len(held) > HELD_TILES:
                    yield from out()
                    held = {}
        yield from out()

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = _tiles(vectors, VECTOR_TILE, id_col, vector_col).repartition(parts)  # packed once
    few = _tiles(queries, QUERY_TILE, id_col, vector_col).toDF("q", "x").repartition(parts)
    found = few.crossJoin(many).mapInArrow(compare, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("_n", F.row_number().over(order)).where(f"_n <= {k}").select("query", F.col("id").alias(id_col), "score")


def first_of_each(hits: DataFrame, path_col: str, *order) -> DataFrame:
    """One hit for each path, the first by ``order``, and ``rank`` among these. For lists of a bounded length."""
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy(path_col).orderBy(*order))).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lists: list[DataFrame], path_col: str) -> DataFrame:
    """(path, score, list, rank): reciprocal ranks of ranked lists (path, rank) summed for each path, and the first place that it has; best first."""
    tagged = [x.select(F.col(path_col), F.lit(i).alias("list"), "rank") for i, x in enumerate(lists)]
    each = reduce(DataFrame.unionByName, tagged)
    fused = each.groupBy(path_col).agg(F.sum(1.0 / (RANK_OFFSET + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.select(path_col, "score", "first.list", "first.rank").orderBy(F.col("score").desc(), "list", "rank", path_col)
