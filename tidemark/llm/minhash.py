"""MinHash near-duplicates with SetSketch registers.

A document's set is its word shingles. Register i holds the truncated logarithm, to a base near 1,
of the least of the exponential values that hash i gives the shingles; registers of parts merge by
maximum, and two sets agree in a register about as often as their Jaccard similarity. Documents
that agree in a band of registers are candidates. From the registers of both, and their known
sizes, the likelihood of each similarity follows; pairs whose registers all but rule out the
threshold go, the rest are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, staged
from tidemark.llm.kernels import byte_table, chunks, grams, randoms, whole, words
from tidemark.llm.links import Likeness, bucket_components, in_filter, passes, row_filter

#: Band by band: a pair at a similarity of 0.8 shares none of 30 bands of 4 registers once in 8 million times, at 0.85 once in 4 billion.
BANDS, ROWS = 30, 4
#: Registers: base, rate and greatest value of 16 bits.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair goes unseen when its registers are e to this power less likely at any similarity over the threshold than at the best.
RULED_OUT = 16.0
#: ASCII white space ends words.
SEPARATORS = b"\t\n\x0b\x0c\r "
#: Shingles hashed at once.
LOT = 1 << 14


def registers(shingles: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """m registers of a set of 64-bit shingle hashes, not empty."""
    factors = (randoms(m, 21) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    shifts = (randoms(m, 22) >> np.uint64(32)).astype(np.uint32)[:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(m, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(x), LOT):
        h = factors * x[i : i + LOT]
        h += shifts
        np.minimum(least, h.min(axis=1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype("<u2")


def merge_registers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(x, y)


def log_likelihoods(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each pair of register rows, the log-likelihood of each similarity of ``grid``; minus infinity where sizes exclude it."""
    more, fewer = (left > right).sum(axis=1)[:, None], (left < right).sum(axis=1)[:, None]
    same = left.shape[1] - more - fewer
    u = (n_left / (n_left + n_right))[:, None]
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = chance(u - (1 - u) * grid), chance(1 - u - u * grid)
        terms = [np.where(n > 0, n * np.log(np.maximum(p, 0)), 0.0) for n, p in ((more, up), (fewer, down), (same, 1 - up - down))]
    return np.where((up < 0) | (down < 0), -np.inf, sum(terms))


def alike(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """The share of equal registers of each pair; 0 where sizes exclude the threshold, or registers do by six deviations."""
    same = (left == right).mean(axis=1)
    fits = np.minimum(n_left, n_right) >= threshold * np.maximum(n_left, n_right) - 1e-9
    return np.where(fits & (same >= threshold - 6 * math.sqrt(threshold * (1 - threshold) / left.shape[1])), same, 0.0)


def possible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by sizes and by likelihood."""
    out = alike(left, right, n_left, n_right, threshold) > 0
    rows = np.flatnonzero(out)
    usual = np.sort(np.append(np.linspace(0.005, 1, 200), threshold))
    for i in range(0, len(rows), 500):
        own = rows[i : i + 500]
        sizes = n_left[own], n_right[own]
        most = (np.minimum(*sizes) / np.maximum(*sizes))[:, None] - 1e-12  # one in the other
        grid = np.hstack([np.broadcast_to(usual, (len(own), len(usual))), most])
        score = log_likelihoods(left[own], right[own], *sizes, grid)
        out[own] = np.where(grid >= threshold - 1e-9, score, -np.inf).max(axis=1) >= score.max(axis=1) - RULED_OUT
    return out


def shingle_sets(texts, k: int):
    """For an Arrow column of texts: (row, sorted hashes of its distinct shingles of k words; fewer words are one shingle)."""
    table = byte_table(SEPARATORS)
    for row, data, starts, ends in chunks(texts):
        h, _, _, n = words(data, starts, ends, table)
        g = grams(h, k)
        at = 0
        for i, size in enumerate(n.tolist()):
            yield row + i, np.unique(g[at : at + size - k + 1]) if size >= k else whole(h[at : at + size])
            at += size


def _name(shingles: np.ndarray) -> bytes:
    """16 bytes by which equal sets are told."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x, y, n_shingles, node, sketch) of each row, a sketch being its registers, x and y hashes of id and text; node and sketch are null for an empty set."""

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            n, nodes, sketched = [], [], []
            for _, x in shingle_sets(batch.column(3), k):
                n.append(len(x))
                nodes.append(_name(x) if len(x) else None)
                sketched.append(registers(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketched, pa.binary())], names=["id", "x", "y", "n_shingles", "node", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("id"), *_row_hashes(docs, id_col, text_col), docs[text_col].alias("text"))
    return own.mapInArrow(sketch, f"id {kind}, x long, y long, n_shingles long, node binary, sketch binary")


def _row_hashes(docs: DataFrame, id_col: str, text_col: str) -> list[F.Column]:
    """128 bits that tell a row by its id and text."""
    return [F.xxhash64(docs[id_col], docs[text_col]).alias("x"), F.xxhash64(docs[text_col], docs[id_col]).alias("y")]


def groups(docs: DataFrame, k: int, percent: int, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows as of ``sketches``, without sketches; node, component and least id of each different set)."""
    rows = staged(sketches(docs, k, id_col=id_col, text_col=text_col), "sketches")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min("x").alias("x"))
    nodes = staged(nodes, "nodes")
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width))))
    judge = lambda f: lambda left, right, n, m: f(left.view("<u2"), right.view("<u2"), n.astype(np.float64), m.astype(np.float64), percent / 100)

    def fulls(ends: DataFrame) -> DataFrame:
        held = staged(nodes.join(ends, "node", "left_semi").select("node", "x"), "ends")
        bits = docs.sparkSession.sparkContext.broadcast(row_filter(held.select("x")))

        def sets(batches):
            import pyarrow as pa

            for batch in batches:
                keep = np.flatnonzero(passes(bits.value, batch.column(0).to_numpy()))
                own = {_name(x): x.tobytes() for _, x in shingle_sets(batch.column(1).take(pa.array(keep)), k) if len(x)} if len(keep) else {}
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], names=["node", "full"])

        own = docs.select(_row_hashes(docs, id_col, text_col)[0], docs[text_col].alias("text")).mapInArrow(sets, "node binary, full binary")
        out = staged(own.join(held.select("node"), "node", "left_semi"), "fulls")
        release(held)
        bits.destroy()
        return out

    def confirm(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    linked = bucket_components(nodes.select("node", "sketch", "size"), bands, Likeness(judge(alike), judge(possible), confirm, 8), fulls)
    named = nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "id")
    return rows.drop("sketch"), named


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id (least id that links reach), kept (id = component_id).

    Links join rows whose sets of k-word shingles have 100 * intersection >= percent * union.
    Words are runs of other bytes than ASCII white space, A-Z as a-z; a text of fewer than k words
    is one shingle; null, empty and blank texts have an empty set and no links. Repeated rows are
    linked; of those, all that have the least id are kept. A null id is never a component's id
    unless all its rows have none; such rows have a null component_id, and are kept if alone.
    Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    rows, named = groups(docs, k, percent, id_col=id_col, text_col=text_col)
    first = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = rows.join(named.join(first, "component").select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group of linked rows one stays, with the least id (null last).

    Links are as in ``near_duplicates``. Rows without words are linked with nothing, so all stay.
    Of rows with the same id and text one stays, whichever: they may differ in other columns.
    """
    rows, named = groups(docs, k, percent, id_col=id_col, text_col=text_col)
    found = rows.join(named.select("node", "component"), "node").select("component", "id", "x", "y")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x", "y")).alias("best"))
    copies = found.groupBy("component", "x", "y").agg(F.count("*").alias("n"))
    stays = (F.col("x") == F.col("best.x")) & (F.col("y") == F.col("best.y"))
    copies = copies.join(best, "component").select("x", "y", stays.alias("stays"), "n").where("n > 1 OR NOT stays")
    copies = staged(copies.select("x", "y", "stays"), "copies")  # rows that go, or of which one stays
    likely = in_filter(docs.sparkSession.sparkContext.broadcast(row_filter(copies.select("x"))))
    own = docs.select(F.struct(*docs.columns).alias("row"), *_row_hashes(docs, id_col, text_col))
    # Rows that are no copies stay in their tasks.
    rest, some = own.where(~likely("x")), own.where(likely("x")).join(copies, ["x", "y"], "left")
    one = some.where("stays").dropDuplicates(["x", "y"])
    return rest.select("row.*").union(some.where("stays IS NULL").select("row.*")).union(one.select("row.*"))
