"""Exact top-k inner products: vectors in buckets by length, of which a query reads only what can still reach its list."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, staged
from tidemark.llm.vectors import EXACT, on_grid, usable

#: Bytes of a bucket's and of a block's vectors, and their rows at most.
TILE_BYTES, TILE_ROWS = 1 << 18, 2048
#: One bucket in so many, besides the longest ones, is searched first, to learn what a list must reach.
SAMPLE = 64
#: Buckets that a task reads at most, and tasks for each core where there are that many.
TASK_BUCKETS, TASKS = 64, 4
#: From this local cosine threshold on coordinates are looked at, so many of a query, and prune where they leave one in NARROW vectors at most.
STEEP, FOCUS, NARROW = 0.8, 3, 8
#: Slack of bounds that are computed in doubles.
SLACK = 1e-9


def _ints(rows: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as a matrix; short numbers were packed as two bytes each, others as eight."""
    if all(len(x) == 2 * width for x in rows):
        return np.frombuffer(b"".join(rows), dtype=np.int16).reshape(-1, width)
    return np.stack([np.frombuffer(x, dtype=np.int16 if len(x) == 2 * width else np.int64).astype(np.int64) for x in rows])


def _measured(batches):
    """id, width, length, packed entries of each usable vector."""
    import pyarrow as pa

    for batch in batches:
        for rows, values in usable(batch.column(1)):
            x = on_grid(values)
            short = np.abs(x).max(axis=1) < 1 << 15
            packed = [(v.astype(np.int16) if s else v).tobytes() for v, s in zip(x, short)]
            length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)), pa.array(length), pa.array(packed, pa.binary())], names=["id", "width", "length", "x"])


def _packed(batches):
    """Rows in order as tiles: width, longest, ids, entries; a tile holds vectors of one width."""
    import pyarrow as pa

    def tile(rows):
        x = _ints([r[3] for r in rows], rows[0][1])
        arrays = [[rows[0][1]], [rows[0][2]], [np.array([r[0] for r in rows], dtype=np.int64).tobytes()], [x.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int32(), pa.float64(), pa.binary(), pa.binary()))], names=["width", "longest", "ids", "x"])

    held, used = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[1] != held[0][1] or used + len(row[3]) > TILE_BYTES or len(held) == TILE_ROWS):
                yield tile(held)
                held, used = [], 0
            held.append(row)
            used += len(row[3])
    if held:
        yield tile(held)


def _tiles(rows: DataFrame, name: str) -> DataFrame:
    """(tile, width, longest, ids, x): the vectors from the longest on, in written tiles; those of equal length are spread by id."""
    order = ["width", F.col("length").desc(), "id"]
    packed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, "width int, longest double, ids binary, x binary")
    return staged(packed.withColumn("tile", F.monotonically_increasing_id()), name)


class _Block:
    """Vectors of a tile: ids, entries as doubles and as they are, lengths, directions, and orders by coordinate once asked for."""

    def __init__(self, width: int, ids: bytes, x: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.whole = np.frombuffer(x, dtype=np.int16 if len(x) == 2 * width * len(self.ids) else np.int64).reshape(-1, width).astype(np.int64)
        self.x = self.whole.astype(np.float64)
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.unit = np.divide(self.x, self.length[:, None], out=np.zeros_like(self.x), where=self.length[:, None] > 0)
        self.by_coordinate = {}

    def order(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by_coordinate:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.by_coordinate[f] = order, self.unit[order, f]
        return self.by_coordinate[f]


def _bounded(q: _Block, rows, p: _Block, columns) -> bool:
    """Whether doubles hold the products, and all sums on the way, exactly; raises OverflowError beyond longs."""
    most = (q.length[rows].max(initial=0) + 1) * (p.length[columns].max(initial=0) + 1)
    if most >= 2.0**62:
        raise OverflowError("a score does not fit in a long")
    return most < EXACT / 2


def candidates(q: _Block, p: _Block, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``q``, rows of ``p``, scores): all pairs that may be among a query's best ``k``, given that scores below ``least`` are not. ``p`` is a bucket, longest first.

    A query's local cosine threshold is ``least`` over its length and the bucket's longest; above 1
    nothing here can reach its list. A steep threshold prunes by coordinates, where that leaves
    little of the bucket: each coordinate of a direction at such an angle lies in a range around
    the query's own. Others prune by length: the vectors that are long enough are a prefix. What
    is left is verified by exact products.
    """
    top = p.length[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine, needed = least / (q.length * top), least / q.length
    flat = (q.length == 0) | (top == 0)  # scores are 0
    cosine, needed = np.where(flat, np.where(least <= 0, -1.0, 2.0), cosine), np.where(q.length == 0, -1.0, needed)
    alive = cosine <= 1 + SLACK
    row, column = _by_coordinate(q, p, np.flatnonzero(alive & (cosine >= STEEP)), cosine, alive)
    with_whole = alive.nonzero()[0]
    found = np.einsum("ij,ij->i", *((q.x[row], p.x[column]) if _bounded(q, row, p, column) else (q.whole[row], p.whole[column])))
    reaching = found >= least[row]
    row, column, found = row[reaching], column[reaching], found[reaching]
    if not len(with_whole):
        return row, column, found
    enough = np.searchsorted(-p.length, -needed[with_whole] * (1 - SLACK), side="right")
    prefix = slice(0, max(1, int(enough.max())))
    scores = q.x[with_whole] @ p.x[prefix].T if _bounded(q, with_whole, p, prefix) else q.whole[with_whole] @ p.whole[prefix].T
    floor = least[with_whole].copy()
    new = np.flatnonzero(np.isneginf(floor))
    if len(new) and scores.shape[1] > k:
        floor[new] = np.partition(scores[new], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    i, j = np.nonzero(scores >= floor[:, None])
    return np.concatenate([row, with_whole[i]]), np.concatenate([column, j]), np.concatenate([found, scores[i, j]])


def _by_coordinate(q: _Block, p: _Block, steep: np.ndarray, cosine: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are left by the ranges of the FOCUS largest coordinates of ``steep`` queries; those whose narrowest range has more than 1 / NARROW of the bucket stay ``alive`` and have none."""
    count = min(FOCUS, p.unit.shape[1])
    own = q.unit[steep]
    focus = np.argsort(-np.abs(own), axis=1, kind="stable")[:, :count]
    t, own = np.clip(cosine[steep], 0, 1)[:, None], np.take_along_axis(own, focus, axis=1)
    reach = np.sqrt((1 - t * t) * np.maximum(0.0, 1 - own**2)) + SLACK
    # The range ends at 1 or -1 where the query is nearer to the axis than the angle.
    low, high = np.where(own <= -t, -1 - SLACK, own * t - reach), np.where(own >= t, 1 + SLACK, own * t + reach)
    first, last = np.zeros(focus.shape, dtype=np.int64), np.zeros(focus.shape, dtype=np.int64)
    for f in np.unique(focus):
        at, values = focus == f, p.order(int(f))[1]
        first[at], last[at] = np.searchsorted(values, low[at]), np.searchsorted(values, high[at], side="right")
    best = (last - first).argmin(axis=1)[:, None]
    start, n = (np.take_along_axis(x, best, axis=1)[:, 0] for x in (first, last - first))
    narrow = np.flatnonzero(n * NARROW <= len(p.ids))
    alive[steep[narrow]] = False
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for f in np.unique(np.take_along_axis(focus, best, axis=1)[narrow]):
        mine = narrow[focus[narrow, best[narrow, 0]] == f]
        which = np.repeat(mine, n[mine])
        place = np.arange(len(which)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine]) + start[which]
        near = p.order(int(f))[0][place]
        inside = np.all([(p.unit[near, focus[which, j]] >= low[which, j]) & (p.unit[near, focus[which, j]] <= high[which, j]) for j in range(count)], axis=0)
        rows.append(steep[which[inside]])
        columns.append(near[inside])
    return np.concatenate(rows), np.concatenate(columns)


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each row by falling score, then id."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[order][keep], scores[order][keep]


def _search(k: int):
    """Rows of a bucket beside a block of queries (tile, ids, x, least) to (tile, at, query_id, id, score, own): the best ``k`` that the task has for each query."""

    def run(batches):
        import pyarrow as pa

        blocks, lists, bucket = {}, {}, (None, None)
        for batch in batches:
            for width, ids, x, tile, q_width, q_ids, q_x, least in zip(*(c.to_pylist() for c in batch.columns)):
                if width != q_width:
                    continue
                if bucket[0] != (ids, x):
                    bucket = (ids, x), _Block(width, ids, x)
                if tile not in blocks:
                    q = blocks[tile] = _Block(width, q_ids, q_x)
                    floor = np.full(len(q.ids), -np.inf)
                    for at, value in ((r["at"], r["least"]) for r in least or []):
                        floor[at] = value
                    lists[tile] = floor, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                floor, held = lists[tile]
                row, column, scores = candidates(blocks[tile], bucket[1], floor, k)
                if len(row):
                    held = _best(np.concatenate([held[0], row]), np.concatenate([held[1], bucket[1].ids[column]]), np.concatenate([held[2], scores.astype(np.int64)]), k)
                    count = np.bincount(held[0], minlength=len(floor))
                    full = np.flatnonzero(count >= k)
                    floor[full] = np.maximum(floor[full], held[2][np.cumsum(count)[full] - 1])
                    lists[tile] = floor, held
        for tile, (_, (row, ids, scores)) in lists.items():
            q = blocks[tile]
            norm = (q.whole[row] ** 2).sum(axis=1)
            own = (ids == q.ids[row]) & (scores == norm)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tile)), pa.array(row), pa.array(q.ids[row]), pa.array(ids), pa.array(scores), pa.array(own)], names=["tile", "at", "query_id", "id", "score", "own"])

    return run


FOUND = "tile long, at long, query_id long, id long, score long, own boolean"


def _compared(buckets: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Every bucket beside every block (tile, width, ids, x, least): a task takes one block and a share of the buckets, the longest first."""
    spark = buckets.sparkSession
    few, many = blocks.count(), buckets.count()
    shares = max(1, math.ceil(many / TASK_BUCKETS), min(many, math.ceil(TASKS * spark.sparkContext.defaultParallelism / max(1, few))))
    left = buckets.select("width", "longest", "ids", "x").repartition(shares).sortWithinPartitions(F.col("longest").desc()).drop("longest")
    right = blocks.select("tile", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "least").repartition(max(1, few)).hint("shuffle_replicate_nl")
    return left.crossJoin(right).mapInArrow(_search(k), FOUND)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner products, its own row left out; ties to smaller ids.

    An entry c counts as floor(64 c); scores are exact. A query's own row is one row of its id and
    entries: of equal rows the others stay, and each row of ``queries`` answers for itself, so a
    repeated one has its list as often. Vectors that are null or empty, or hold null or non-finite
    entries, take no part, nor do rows without id. Vectors are compared with those as long in
    dimensions. A query that finds nothing has no row.

    Vectors are dealt to buckets by length (norm), the longest first, and queries to blocks, both
    of bounded bytes and written once. First all blocks meet the longest bucket and one in SAMPLE:
    what a list holds then is what later vectors must reach. Then each block meets the other
    buckets, tasks keeping the best ``k`` and one for each query, so few rows are shuffled.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    measured = lambda d: d.where(d[id_col].isNotNull()).select(d[id_col].cast("long").alias("id"), d[vector_col].cast("array<double>").alias("v")).mapInArrow(_measured, "id long, width int, length double, x binary")
    buckets, blocks = _tiles(measured(vectors), "buckets"), _tiles(measured(queries), "blocks")
    longest = buckets.groupBy("width").agg(F.max("longest").alias("longest")).join(buckets, ["width", "longest"]).agg(F.min("tile")).first()[0]
    first = (F.col("tile") == F.lit(longest)) | (F.pmod(F.xxhash64("ids"), F.lit(SAMPLE)) == 0)
    none = F.lit(None).cast("array<struct<at:bigint,least:bigint>>").alias("least")
    seen = staged(_compared(buckets.where(first), blocks.select("*", none), k + 1), "seen")
    ordered = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("tile", "at").orderBy(F.col("score").desc(), "id")))
    reached = ordered(seen).where(F.col("n") == k + 1).groupBy("tile").agg(F.collect_list(F.struct("at", F.col("score").alias("least"))).alias("least"))  # a block's rows at most
    rest = _compared(buckets.where(~first), blocks.join(reached, "tile", "left"), k + 1)
    found = ordered(seen.unionByName(rest)).where(F.col("n") <= k + 1)
    own = F.min(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("tile", "at"))
    kept = found.withColumn("own_n", own).where(F.col("own_n").isNull() | (F.col("n") != F.col("own_n")))
    out = kept.select("query_id", (F.col("n") - F.when(F.col("own_n") < F.col("n"), 1).otherwise(0)).cast("int").alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)
    return out
