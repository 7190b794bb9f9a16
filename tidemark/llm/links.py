"""Links between nodes that share a bucket, and the groups that they connect, for similarity joins of any kind.

A bucket may hold a large share of all nodes, so its pairs are not listed. First every node is
compared with the hub of each of its buckets, the least node; the links found connect most of a
true group. Buckets whose nodes are still in different groups are then compared tile by tile, by
sketches, and groups with a plausible pair form a cluster. Last, clusters are compared in tiles
with the full objects; where sketches tell too little, buckets are. Of buckets with the same
nodes one is looked at. A tile joins groups as it goes and returns only the pairs that joined two,
fewer than it has nodes. So no candidate link that would join two groups is missed, and what is
stored grows with the nodes alone. Where sketches leave few pairs of a bucket, these pairs are
confirmed by themselves, and only the others' objects are dealt out in tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, staged
from tidemark.llm.kernels import cut_points, mix, packed, unpacked

#: (sketches of the left, of the right, sizes of the left, of the right) of pairs, a row each -> a number for each.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: (sketches, sizes) -> (rows on the left, on the right) -> which pairs a first look leaves.
Glance = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]
#: (node) -> (node, full: binary), a staged table of the full objects.
Fulls = Callable[[DataFrame], DataFrame]
#: Nodes on a side of what a task compares at once, by sketches and by full objects, and bytes of their objects, about.
TILE, FULL_TILE, TILE_BYTES = 512, 256, 16 << 20
#: Pairs of one node that are confirmed at once: a few at first, as a link makes others needless, then more, up to so many.
FEW, MANY = 4, 64
#: Bits of a filter by which tasks turn rows away: so many for each key, from the least to the most; a full filter only lets more rows pass.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
#: Bytes of a filter that are put together in one task.
FILTER_PART = 1 << 16
#: Rows of a bucket whose pairs are all judged by sketches before any is looked at, pairs that are judged at once, and rows that are held for it.
SMALL, PAIRS, LOT_ROWS = 512, 1 << 16, 20_000
#: Parts of all buckets that are looked at one after the other, at most, and rows of a part from which there are several: a part's shuffle is gone before the next one's.
SLICES, SLICE_ROWS = 4, 2_000_000
#: Rows on a side of what is judged by sketches alone, pairs for each row up to which pairs are listed, and pairs that are confirmed in one go, at least and for each object: their objects' shuffle is gone before the next one's, but each one shuffles all objects.
SIDE, LISTED, SLICE_PAIRS, SLICE_FULLS = 4096, 8, 400_000, 4
#: Bytes of a bucket where a node's buckets are one binary.
BLOCK_BYTES = 6
#: Rows of a bucket that are packed for their parts together, and those of a part, about.
LOT_PACKED, PART_ROWS = 1 << 17, 50_000
#: Pairs that are confirmed together, and bytes of their objects.
LOT_PAIRS, LOT_BYTES = 16_384, 4 << 20
#: Numbers that a task sorts at once.
PART = 2_000_000


@dataclass
class Likeness:
    """How nodes of one kind are compared."""

    #: A quick estimate: how alike a pair may be, 0 when it is no link.
    quick: Judge
    #: Which pairs may be links, by all that sketches and sizes tell.
    plausible: Judge
    #: Whether two full objects are a link.
    confirm: Callable[[bytes, bytes], bool]
    #: Bytes of a full object for each unit of a node's size, about.
    unit: int
    #: Whether sketches tell strangers apart: then groups with a plausible pair form clusters, and full objects are compared within these; else within buckets.
    clusters: bool = True
    #: Which of several full objects are links of one; by default each is confirmed by itself.
    confirm_many: Callable[[bytes, list[bytes]], list[bool]] | None = None
    #: Which pairs of a left and a right full object are links, where many at once take less than each by itself.
    confirm_pairs: Callable[[list[bytes], list[bytes]], list[bool]] | None = None
    #: The greatest size that a plausible partner of a node of each size may have; others are not even judged.
    longest: Callable[[np.ndarray], np.ndarray] | None = None
    #: Of sketches and sizes, a row each: which pairs of rows, by their numbers, a first look leaves; others are not plausible.
    glance: Glance | None = None


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), where component is the least node reachable.

    Alternating large and small stars: each round is two joins on the edges' ends, stored in the
    shared folder, until every group is a star. Self-links, repeated and null-ended edges do no harm.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        n, digest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, digest) == seen or not n:
            break
        seen = n, digest
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large.a == least.u).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, staged(small.where("a <> b").distinct(), "edges")
        release(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _matrix(column) -> np.ndarray:
    """Rows of bytes from an Arrow column of binaries of one length, none null."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _hashes(names: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes, a multiple of eight."""
    out = np.zeros(len(names), dtype=np.uint64)
    for word in np.ascontiguousarray(names).view(np.uint64).T:
        out = mix(out ^ word)
    return out


def _buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of an Arrow column, side by side, and how many each row has: of lists of longs, or of binaries with BLOCK_BYTES for each."""
    import pyarrow as pa

    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(), column.value_lengths().to_numpy()
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].reshape(-1, BLOCK_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :BLOCK_BYTES] = raw
    return mix(out.view(np.uint64).ravel()).view(np.int64), np.diff(at) // BLOCK_BYTES


def _count(nodes: DataFrame) -> int:
    """How many buckets all of ``nodes`` have, as ``_buckets`` reads them."""
    n = F.length("buckets") / BLOCK_BYTES if nodes.schema["buckets"].dataType.simpleString() == "binary" else F.size("buckets")
    return int(nodes.agg(F.sum(n)).first()[0] or 0)


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, plausible: Judge) -> DataFrame:
    """The pairs (a, b) that ``plausible`` lets pass, by the sketches and sizes in ``nodes``."""

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                keep = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), *(batch.column(i).to_numpy() for i in (4, 5)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("size").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    return both.mapInArrow(judge, "a binary, b binary")


def confirmed_pairs(pairs: DataFrame, fulls: DataFrame, like: Likeness, parts: int | None = None) -> DataFrame:
    """The pairs (a, b) that are links by the full objects (node, full); in ``parts`` tasks, or as many as their bytes ask for."""

    def judge(batches):
        import pyarrow as pa

        held, rows, size = [], 0, 0

        def lot():
            own = pa.concat_batches(held)
            x, y = (own.column(i).to_pylist() for i in (2, 3))
            keep = like.confirm_pairs(x, y) if like.confirm_pairs else [like.confirm(u, v) for u, v in zip(x, y)]
            return pa.RecordBatch.from_arrays([own.column(0), own.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if not like.confirm_pairs or rows >= LOT_PAIRS or size >= LOT_BYTES:
                yield lot()
                held, rows, size = [], 0, 0
        if held:
            yield lot()

    side = lambda x, y: fulls.select(F.col("node").alias(x), F.col("full").alias(y))
    both = pairs.join(side("b", "y"), "b")
    both = both.repartition(parts, "a") if parts else both
    return both.join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(judge, "a binary, b binary")


def _plausible(key: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, like: Likeness, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Left and right rows of the plausible pairs with the same ``key``, no less than 0, that are ``apart``, some at a time, those with the least keys first."""
    order = np.lexsort((sizes, key)) if like.longest else np.argsort(key, kind="stable")
    key, sketches, sizes = key[order] << 40, sketches[order], sizes[order]
    # Each row with those after it that have its key and a size that may be a partner's.
    most = (1 << 40) - 1
    own, last = (key + sizes, key + np.minimum(like.longest(sizes), most)) if like.longest else (key, key + most)
    after = np.searchsorted(own, last, side="right") - np.arange(len(own)) - 1
    total = np.cumsum(after)
    cuts = np.searchsorted(total, np.arange(PAIRS, (total[-1] if len(total) else 0) + PAIRS, PAIRS), side="left") + 1
    look = like.glance(sketches, sizes) if like.glance else None
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        k = after[a:b]
        row = np.arange(a, a + len(k))
        left, right = np.repeat(row, k), np.repeat(row + 1 - np.cumsum(k) + k, k)
        right += np.arange(len(right))
        if look:
            some = np.flatnonzero(look(left, right))
            left, right = left[some], right[some]
        some = np.flatnonzero(apart(order[left], order[right]))
        left, right = left[some], right[some]
        if len(left):
            good = like.plausible(sketches[left], sketches[right], sizes[left], sizes[right])
            yield order[left[good]], order[right[good]]


def _joined(rows: list[dict], like: Likeness, whole: bool):
    """Pairs of a left and a right row of one tile that join two components: of nodes that are links, or, without full objects, of components that may have some.

    Two minor nodes are a pair once, with the greater on the left, and of the buckets that a pair
    shares only the least one confirms it.
    """
    left, right = ([r for r in rows if r["left"] == side] for side in (True, False))
    if not left or not right:
        return
    many = like.confirm_many or (lambda x, ys: [like.confirm(x, y) for y in ys])
    number = {c: i for i, c in enumerate({r["component"] for r in rows})}
    rank = {x: i for i, x in enumerate(sorted({r["node"] for r in rows}))}
    roots = np.arange(len(number))
    own = np.array([number[r["component"]] for r in right])
    after = np.array([rank[r["node"]] if r["minor"] else -1 for r in right])
    sketches = np.frombuffer(b"".join(r["sketch"] for r in right), dtype=np.uint8).reshape(len(right), -1)
    sizes = np.array([r["size"] for r in right])
    lower = [[b for b in r.get("buckets", ()) if b < r["bucket"]] for r in right]
    holder, lower = np.repeat(np.arange(len(right)), [len(x) for x in lower]), np.array([b for x in lower for b in x], dtype=np.int64)
    for r in left:
        me = number[r["component"]]
        open_ = (roots[own] != roots[me]) & (after < rank[r["node"]])
        if len(lower) and open_.any():
            open_[holder[np.isin(lower, r["buckets"])]] = False
        other = np.flatnonzero(open_)
        if not len(other):
            continue
        mine = np.broadcast_to(np.frombuffer(r["sketch"], dtype=np.uint8), (len(other), sketches.shape[1]))
        of_me = np.full(len(other), r["size"])
        score = like.quick(mine, sketches[other], of_me, sizes[other])
        if whole and score.any():
            at = np.flatnonzero(score)
            score[at] *= like.plausible(mine[at], sketches[other[at]], of_me[at], sizes[other[at]])
        queue, step = other[np.argsort(-score, kind="stable")[: np.count_nonzero(score)]], FEW
        while len(queue):
            now, queue = queue[:step], queue[step:]
            for k, link in zip(now, many(r["full"], [right[k]["full"] for k in now]) if whole else [True] * len(now)):
                if link and roots[own[k]] != roots[me]:
                    roots[roots == roots[own[k]]] = roots[me]
                    yield (r["node"], right[k]["node"]) if whole else (r["component"], right[k]["component"])
            queue, step = queue[roots[own[queue]] != roots[me]], min(4 * step, MANY)


def tiles(rest: DataFrame, like: Likeness) -> DataFrame:
    """(a, b) by ``_joined`` for ``rest`` (bucket, node, component, size, sketch, and full objects or not, and all buckets of a node or not).

    In each bucket the nodes outside its largest component meet all nodes. Large buckets are dealt
    out in tiles of about TILE or FULL_TILE nodes a side, fewer where objects are large, each compared by itself.
    """
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("sum")).groupBy("bucket")
    sizes = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("sum").alias("sum")).where("most < all")
    whole = "full" in rest.columns
    payload = ["node", "component", "size", "sketch"] + [c for c in ("full", "buckets") if c in rest.columns]
    side = F.greatest(F.lit(1.0), F.least(F.lit(float(FULL_TILE)), F.lit(TILE_BYTES / like.unit) * F.col("all") / F.col("sum"))) if whole else F.lit(float(TILE))
    cuts = lambda n: F.ceil(n / side).cast("int")
    minor, rows, columns = F.col("component") != F.col("major"), cuts(F.col("all") - F.col("most")), cuts(F.col("all"))
    own = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_left = F.when(minor, F.transform(every(columns), lambda j: F.struct(F.pmod(own, rows).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("left"))))
    as_right = F.transform(every(rows), lambda i: F.struct(i.alias("i"), F.pmod(own, columns).cast("int").alias("j"), F.lit(False).alias("left")))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean>>")
    dealt = rest.join(sizes, "bucket").select("bucket", *payload, minor.alias("minor"), F.explode(F.concat(F.coalesce(as_left, none), as_right)).alias("t"))
    dealt = dealt.select("bucket", "t.i", "t.j", "t.left", "minor", *payload)

    def compare(batches):
        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                place = row["bucket"], row["i"], row["j"]
                if place != key:
                    found += _joined(held, like, whole)
                    held, key = [], place
                held.append(row)
            yield out(found)
        yield out(list(_joined(held, like, whole)))

    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a binary, b binary")


def repeated_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket), staged, of the buckets that several of ``nodes`` (buckets, as ``_buckets`` reads them) have.

    From packed lists of numbers: a row for each lot of nodes and range of buckets. A bucket that
    a lot has often is there twice.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _count(nodes) // PART)

    def lists(batches):
        import pyarrow as pa

        bounds, held, size = cut_points(parts), [], 0

        def lot():
            x, counts = np.unique(np.concatenate(held), return_counts=True)
            for own in (x, x[counts > 1]):
                cuts = np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])
                rows = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([packed(own[cuts[i] : cuts[i + 1]]) for i in rows], pa.binary())], names=["part", "list"])

        for batch in batches:
            held.append(_buckets(batch.column(0))[0].view(np.uint64))
            size += len(held[-1])
            if size >= PART:
                yield from lot()
                held, size = [], 0
        if size:
            yield from lot()

    def repeated(batches):
        import pyarrow as pa

        held, part = [], None

        def out():
            x, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[counts > 1].view(np.int64))], names=["bucket"])

        for batch in batches:
            for own, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if own != part:
                    if held:
                        yield out()
                    held, part = [], own
                held.append(unpacked(raw))
        if held:
            yield out()

    shared = nodes.select("buckets").mapInArrow(lists, "part long, list binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(repeated, "bucket long")
    return staged(shared, "shared")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets that several of ``nodes`` (node, buckets: array<long>) have. Most buckets have one node, so which are shared is found first."""
    shared = repeated_buckets(nodes)
    bits = nodes.sparkSession.sparkContext.broadcast(row_filter(shared))

    def likely(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(1).flatten().to_numpy()
            keep = np.flatnonzero(passes(bits.value, own))
            row = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy())[keep]
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), batch.column(0).take(pa.array(row))], names=["bucket", "node"])

    kind = nodes.schema["node"].dataType.simpleString()
    out = staged(nodes.mapInArrow(likely, f"bucket long, node {kind}").join(shared, "bucket", "left_semi"), "members")
    release(shared)
    bits.destroy()
    return out


def _judge_only(plausible: Judge) -> Likeness:
    return Likeness(plausible, plausible, lambda x, y: False, 1)


def partnered_buckets(nodes: DataFrame, like: Likeness | Judge, spent: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes in a bucket with a plausible partner; bucket and node of these, and ``likely`` as ``with_partners`` has it), of ``nodes`` (node, size, sketch, and buckets as ``_buckets`` reads them). ``like`` may be its ``plausible`` alone.

    Where nodes have many buckets, most that are shared are so by strangers. So sketches go with
    the rows, a part of all buckets at a time, and rows without a plausible partner end there.
    ``spent`` is deleted once it is known which buckets are shared.
    """
    like = like if isinstance(like, Likeness) else _judge_only(like)
    shared = repeated_buckets(nodes.select("buckets"))
    bits = nodes.sparkSession.sparkContext.broadcast(row_filter(shared))
    release(shared)

    def likely(batches):
        import pyarrow as pa

        for batch in batches:
            own, lengths = _buckets(batch.column(3))
            keep = np.flatnonzero(passes(bits.value, own))
            row = np.repeat(np.arange(len(batch)), lengths)[keep]
            n = np.bincount(row, minlength=len(batch))
            rows = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[rows])).astype(np.int32)), pa.array(own[keep]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(3)), lists], names=["node", "size", "sketch", "buckets"])

    kept = staged(nodes.select("node", F.col("size").cast("long").alias("size"), "sketch", "buckets").mapInArrow(likely, "node binary, size long, sketch binary, buckets array<long>"), "kept")
    bits.destroy()
    release(*spent)
    n = _count(kept)
    parts = min(SLICES, n // SLICE_ROWS + 1)
    slices = [staged(with_partners(kept, i, parts, n // parts, like), "members") for i in range(parts)]
    members = staged(reduce(DataFrame.union, slices), "members") if parts > 1 else slices[0]
    if parts > 1:
        release(*slices)
    bits = nodes.sparkSession.sparkContext.broadcast(row_filter(members.select(F.xxhash64("node"))))
    out = staged(kept.where(in_filter(bits)(F.xxhash64("node"))).select("node", "sketch", "size"), "nodes")
    release(kept)
    bits.destroy()
    return out, members


def with_partners(nodes: DataFrame, part: int, parts: int, rows: int, like: Likeness) -> DataFrame:
    """(bucket, node, likely) of ``nodes`` (node, size, sketch, buckets: array<long>) that have a plausible partner in a bucket of this one of ``parts``, of about ``rows`` rows; of buckets with more than SMALL rows all.

    Many small buckets, most of them of strangers, are looked at together. Rows are packed: one of
    Spark's has those of many nodes and a range of buckets. ``likely`` says of a row whether the
    least node of those that stay in its bucket is a plausible partner; null where that isn't known.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4 * tasks, rows // PART_ROWS + 1)

    def pack(batches):
        import pyarrow as pa

        bounds, held, count = cut_points(parts * ranges), [], 0

        def lot():
            raw = np.concatenate(held)
            key = mix(raw[:, :8].copy().view(np.uint64).ravel())
            order = np.argsort(key, kind="stable")
            raw, key = raw[order], key[order]
            # Rows of a bucket that is large already by this lot are by themselves, as nothing needs to hold them.
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            hot = np.repeat(n > SMALL, n)
            for large in (False, True):
                own, data = key[hot == large], raw[hot == large]
                cuts = np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])
                at = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.full(len(at), large)), pa.array(np.full(len(at), width), pa.int64()), pa.array(np.full(len(at), raw.shape[1]), pa.int64()), pa.array([data[cuts[i] : cuts[i + 1]].tobytes() for i in at], pa.binary())], names=["part", "large", "width", "stride", "rows"])

        for batch in batches:
            own, lengths = _buckets(batch.column(3))
            keep = np.flatnonzero(np.searchsorted(cut_points(parts), mix(own), side="right") == part)
            if not len(keep):
                continue
            row = np.repeat(np.arange(len(batch)), lengths)[keep]
            names, sketches = _matrix(batch.column(0)), _matrix(batch.column(2))
            width = names.shape[1]
            numbers = np.stack([own[keep], batch.column(1).to_numpy()[row]], axis=1).view(np.uint8)
            held.append(np.concatenate([numbers, names[row], sketches[row]], axis=1))
            count += len(keep)
            if count >= LOT_PACKED:
                yield from lot()
                held, count = [], 0
        if count:
            yield from lot()

    def run(batches):
        import pyarrow as pa

        def out(raw, likely, known):
            ends = np.arange(len(raw) + 1, dtype=np.int32) * width
            names = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[:, 16 : 16 + width].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(raw[:, :8].copy().view(np.int64).ravel()), names, pa.array(likely, pa.bool_(), mask=~known)], names=["bucket", "node", "likely"])

        def kept(raw, hot):
            key = mix(raw[:, :8].copy().view(np.uint64).ravel())
            order = np.argsort(key, kind="stable")
            raw, key = raw[order], key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            tile = np.repeat(np.arange(len(n)), n)
            large = ((n > SMALL) | np.isin(key[first], hot))[tile]
            small = np.flatnonzero(~large & (n > 1)[tile])
            sizes, names, sketches = raw[:, 8:16].copy().view(np.int64).ravel(), raw[:, 16 : 16 + width], np.ascontiguousarray(raw[:, 16 + width :])
            keep, name = large.copy(), _hashes(names)
            for left, right in _plausible(tile[small], sketches[small], sizes[small], like, lambda x, y: name[small[x]] != name[small[y]]):
                keep[small[left]] = keep[small[right]] = True
            stay = np.flatnonzero(keep)
            stay = stay[np.lexsort([*np.ascontiguousarray(names[stay]).view(">u8").T[::-1], tile[stay]])]
            own = tile[stay]
            begins = np.append(True, own[1:] != own[:-1])[: len(own)]
            hub = stay[np.flatnonzero(begins)][np.cumsum(begins) - 1]
            known, likely = ~large[stay], np.zeros(len(stay), dtype=bool)
            at = np.flatnonzero(known & ~begins)
            likely[at] = like.plausible(sketches[hub[at]], sketches[stay[at]], sizes[hub[at]], sizes[stay[at]])
            return out(raw[stay], likely, known)

        held, hot, now = [], [], None
        for batch in batches:
            for own, large, width, stride, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if own != now and held:
                    yield kept(np.concatenate(held), np.array(hot, dtype=np.uint64))
                    held, hot = [], []
                now = own
                raw = np.frombuffer(raw, dtype=np.uint8).reshape(-1, stride)
                if large:
                    hot += np.unique(mix(raw[:, :8].copy().view(np.uint64).ravel())).tolist()
                    yield out(raw, np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool))
                else:
                    held.append(raw)
        if held:
            yield kept(np.concatenate(held), np.array(hot, dtype=np.uint64))

    own = nodes.select("node", "size", "sketch", "buckets").mapInArrow(pack, "part long, large boolean, width long, stride long, rows binary")
    return own.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "bucket long, node binary, likely boolean")


def partner_pairs(rest: DataFrame, like: Likeness | Judge) -> DataFrame:
    """The plausible pairs of ``rest`` (bucket, node, component, size, sketch) that share a bucket but no component.

    (node, other) for each; where a bucket has more than LISTED times as many as rows, instead the
    rows of ``rest`` that are in one, once or more, with other null. Large buckets are dealt out
    in tiles of about SIDE rows a side.
    """
    like = like if isinstance(like, Likeness) else _judge_only(like)
    large = rest.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SIDE).select("bucket", F.ceil(F.col("n") / SIDE).cast("int").alias("cuts"))  # one for SIDE rows at most
    cuts = F.coalesce("cuts", F.lit(1))
    own = rest.join(F.broadcast(large), "bucket", "left").withColumn("own", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    places = F.transform(F.sequence(F.lit(0), cuts - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    payload = ["bucket", "node", "component", "size", "sketch"]
    dealt = own.select(*payload, "own", F.explode(places).alias("t")).select(*payload, "own", "t.i", "t.j")

    def run(batches):
        import pyarrow as pa

        def starts(rows):
            key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            return np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))

        def found(rows):
            first = starts(rows)
            n = np.diff(np.append(first, len(rows)))
            tile = np.repeat(np.arange(len(n)), n)
            sketches, sizes, name, component = _matrix(rows.column("sketch")), rows.column("size").to_numpy(), rows.column("node").to_pylist(), rows.column("component").to_pylist()
            number = {c: i for i, c in enumerate({*component})}
            component = np.array([number[c] for c in component])
            side, one = rows.column("own").to_numpy(), rows.column("i").to_numpy() == rows.column("j").to_numpy()
            count, partner, pairs = np.zeros(len(n), dtype=np.int64), np.zeros(len(rows), dtype=bool), []
            for left, right in _plausible(tile, sketches, sizes, like, lambda x, y: (component[x] != component[y]) & (one[x] | (side[x] != side[y]))):
                partner[left] = partner[right] = True
                count += np.bincount(tile[left], minlength=len(n))
                few = count[tile[left]] <= LISTED * n[tile[left]]  # else they would be too many to hold
                pairs.append((left[few], right[few]))
            many = count > LISTED * n
            ends = [sorted((name[x], name[y])) for left, right in pairs for x, y, t in zip(left.tolist(), right.tolist(), tile[left]) if not many[t]]
            whole = rows.select(payload).filter(pa.array(partner & many[tile]))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.nulls(len(whole), pa.binary())], names=[*payload, "other"])
            kinds = whole.schema
            none = lambda c: pa.nulls(len(ends), kinds.field(c).type)
            yield pa.RecordBatch.from_arrays([none("bucket"), pa.array([x for x, _ in ends], pa.binary()), none("component"), none("size"), none("sketch"), pa.array([y for _, y in ends], pa.binary())], names=[*payload, "other"])

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= LOT_ROWS:
                rows = pa.concat_batches(held)
                cut = int(starts(rows)[-1])  # the last one may go on
                if cut:
                    yield from found(rows.slice(0, cut))
                held, count = [rows.slice(cut)], len(rows) - cut
        if count:
            yield from found(pa.concat_batches(held))

    schema = rest.select(payload).withColumn("other", F.lit(None).cast("binary")).schema
    for field in schema:
        field.nullable = True
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, schema)


def bucket_components(nodes: DataFrame, buckets: F.Column, like: Likeness, full_objects: Fulls, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(node, component) for all nodes that a chain of links connects to others.

    ``nodes`` is a stored table (node, sketch, size) of binary names and sketches; ``buckets`` an
    array of longs, a node's buckets. Links are pairs that ``like`` confirms, of those that share
    a bucket or are in a cluster, and are plausible. Where buckets take much room, ``spent`` has the
    staged tables that ``nodes`` reads; they are deleted once buckets are known.
    """
    if like.clusters:
        members = shared_buckets(nodes.select("node", buckets.alias("buckets")))
    else:
        nodes, members = partnered_buckets(nodes.select("node", "size", "sketch", buckets.alias("buckets")), like, spent)
    same = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    same = staged(same.groupBy("hub", "n", "x", "y").agg(F.min("bucket").alias("bucket")).where("n > 1").select("bucket", "hub"), "same")
    crowded = staged(members.join(same, "bucket"), "crowded")
    release(members, same)
    ends = [F.col("hub").alias("a"), F.col("node").alias("b")]
    pairs = crowded.where("hub < node")
    if like.clusters:
        likely = plausible_pairs(pairs.select(ends).distinct(), nodes, like.plausible)
    else:  # of most it is known
        known = pairs.where("likely IS NOT NULL").where("likely").select(ends)
        likely = known.union(plausible_pairs(pairs.where("likely IS NULL").select(ends).distinct(), nodes, like.plausible)).distinct()
    likely = staged(likely, "likely")
    fulls = full_objects(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = staged(confirmed_pairs(likely, fulls, like).distinct(), "links")
    release(likely, fulls)
    groups = staged(connected_components(links), "groups")

    # Nodes without a link stay in their tasks; their component, which is themselves, is written as null.
    bits = nodes.sparkSession.sparkContext.broadcast(row_filter(groups.select(F.xxhash64("node"))))
    others, linked = crowded.where("node <> hub").select("bucket", "node"), in_filter(bits)(F.xxhash64("node"))
    alone = others.where(~linked).withColumn("component", F.lit(None).cast("binary"))
    placed = staged(others.where(linked).join(groups, "node", "left").select("bucket", "node", "component").union(alone), "placed")
    release(crowded)
    bits.destroy()
    rest = placed.withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").select("bucket")
    rest = staged(matching(rest, mixed, "bucket").join(nodes, "node").select("bucket", "node", "component", "size", "sketch"), "rest")
    release(placed)
    if like.clusters:
        clusters = connected_components(tiles(rest, like)).select(F.col("node").alias("component"), F.col("component").alias("bucket"))
        every = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        every = staged(every.join(clusters, "component").select("bucket", "node", "component", "size", "sketch"), "every")
        release(rest)
        rest = every
        fulls = full_objects(rest.select("node").distinct())
        more = [staged(tiles(rest.join(fulls, "node"), like), "links")]
        release(rest, fulls, groups)
    else:
        found = staged(partner_pairs(rest, like), "partners")
        release(rest, groups)
        pairs = staged(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
        rest = staged(found.where("other IS NULL").drop("other").dropDuplicates(["bucket", "node"]), "rest")
        release(found)
        fulls = full_objects(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(rest.select("node")).distinct())
        parts = pairs.count() // max(SLICE_PAIRS, SLICE_FULLS * fulls.count()) + 1
        tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # however few bytes
        more = [staged(confirmed_pairs(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i), fulls, like, tasks), "links") for i in range(parts)]
        if not rest.isEmpty():
            objects = fulls.join(rest.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "node")  # no more than a node has blocks
            more.append(staged(tiles(rest.join(objects, "node"), like), "links"))
        release(pairs, rest, fulls)
    out = staged(connected_components(reduce(DataFrame.union, [links, *more])), "groups")
    release(links, *more, *([] if like.clusters else [nodes]))
    return out


def row_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits for the one column of ``ids``, a stored table of hashes, longs or names whose first 8 bytes count; MOST_BITS at most, however many there are."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, ids.count() * KEY_BITS).bit_length()))

    def fill(batches):
        import pyarrow as pa

        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            x = batch.column(0)
            x = np.frombuffer(b"".join(y[:8] for y in x.to_pylist()), dtype=np.uint64) if pa.types.is_binary(x.type) else x.to_numpy().view(np.uint64)
            for at in _places(x, size):
                bits[at] = True
        raw = np.packbits(bits).reshape(-1, FILTER_PART)
        rows = np.flatnonzero(raw.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([raw[i].tobytes() for i in rows], pa.binary())], names=["part", "bits"])

    def merge(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(*(x.to_pylist() for x in batch.columns)):
                held[part] = held.get(part, 0) | np.frombuffer(raw, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((size // 8 // FILTER_PART, FILTER_PART), dtype=np.uint8)
    for row in ids.mapInArrow(fill, "part long, bits binary").repartition("part").mapInArrow(merge, "part long, bits binary").collect():  # MOST_BITS in all; one job, not one for each partition
        out[row["part"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out.ravel()


def _places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(36)).astype(np.int64) & size - 1, x.astype(np.int64) & size - 1


def passes(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which 64-bit values the filter lets pass: all that it was made of, and few others."""
    x = x.view(np.uint64)
    out = np.ones(len(x), dtype=bool)
    for at in _places(x, 8 * len(bits)):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def in_filter(bits):
    """A column function: which of a column of 64-bit hashes a broadcast filter lets pass."""

    @F.pandas_udf("boolean")
    def likely(x):
        import pandas as pd

        return pd.Series(passes(bits.value, x.to_numpy()))

    return likely


def matching(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key``, a long, is in the one column of ``ids``. A filter of bounded size turns most others away before they are shuffled."""
    ids = staged(ids.select(F.col(ids.columns[0]).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct(), "ids")
    bits = rows.sparkSession.sparkContext.broadcast(row_filter(ids.select(F.xxhash64(key))))
    return rows.where(in_filter(bits)(F.xxhash64(rows[key]))).join(ids, key, "left_semi")
