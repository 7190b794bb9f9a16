"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the least is kept, on both sides; a span of
``window`` words that a document shares with an item holds one whole window of k-grams, so both
keep the same fingerprint from it. Texts that share a fingerprint are then looked at whole: each
of their windows is looked up among the items' windows, and what hits cover is joined, which
extends a hit as far as it goes. Items shorter than a window must occur whole; for them every gram
of their length is a fingerprint. Windows are told by hashes, so words that repeat cost no more.

A benchmark of up to ``BLOCK_BYTES`` of different texts goes to the tasks as a whole, and documents
are never shuffled. A larger one is joined: both sides' fingerprints and windows are tables, tasks
turn most documents away by filters of bounded size, and what is left meets the items' windows by
a shuffle on their hash, each text and each window once, however often they occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, staged
from tidemark.llm.kernels import byte_table, chunks, grams, words
from tidemark.llm.links import in_filter, passes, row_filter

#: Bytes of item texts that a task holds at once, and parts that the texts or items of one window are dealt to.
BLOCK_BYTES, SALTS = 16 << 20, 16
#: What ends a word: ASCII without digits and letters.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Which of the hashes are the least of some window of w, the last of equal ones."""
    kept = np.zeros(len(g), dtype=bool)
    n = len(g) - w + 1
    if n <= 0:
        return kept
    least, at = g[:n].copy(), np.zeros(n, dtype=np.int8)
    for j in range(1, w):
        better = g[j : j + n] <= least
        at[better] = j
        np.minimum(least, g[j : j + n], out=least)
    kept[np.arange(n) + at] = True
    return kept


class _Lookup:
    """Items by a 64-bit hash; a table of bits turns most strangers away."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        first = np.append(True, (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1]))[: len(hashes)]
        self.hashes, self.items = hashes[first], items[first]
        self.shift = np.uint64(64 - max(20, 4 + int(len(hashes)).bit_length()))
        self.bits = np.zeros(1 << int(64 - self.shift), dtype=bool)
        self.bits[(hashes >> self.shift).astype(np.int64)] = True

    def found(self, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places of ``at`` whose hash is there."""
        at = at[self.bits[(g[at] >> self.shift).astype(np.int64)]]
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)] == g[at]]

    def items_of(self, g: np.ndarray) -> np.ndarray:
        """The items that have one of the hashes, each once."""
        g = np.unique(g)
        low, high = (np.searchsorted(self.hashes, g, side=x) for x in ("left", "right"))
        n = high - low
        return np.unique(self.items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])


class Items:
    """Fingerprints and windows of a block of items, (id or None, text) each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, k: int):
        table = byte_table(SEPARATORS)
        self.window, self.k, self.w, self.table = window, k, window - k + 1, table
        self.names = [x for x, _ in items]
        prints: list[np.ndarray] = []
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            h = words(raw, np.array([0]), np.array([len(raw)]), table)[0]
            if len(h) >= window:
                g = grams(h, k)
                prints.append(np.unique(g[winnow(g, self.w)]))
            if len(h):
                g = np.unique(grams(h, min(window, len(h))))
                windows.setdefault(min(window, len(h)), []).append((g, np.full(len(g), i)))
        self.prints = _Lookup(np.concatenate(prints), np.zeros(sum(map(len, prints)), dtype=np.int64)) if prints else None
        self.windows = {n: _Lookup(*map(np.concatenate, zip(*v))) for n, v in windows.items()}

    def hits(self, h: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """{text: (spans, items)} of hits in ``h``, the words of texts that begin at ``first``; ``last`` ends them, ``doc`` is each word's text."""
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for n, lookup in self.windows.items():
            if len(h) < n:
                continue
            inside = doc[: len(h) - n + 1] == doc[n - 1 :]
            if n == self.window:
                g = grams(h, self.k)
                kept = winnow(g, self.w)
                kept &= doc[: len(g)] == doc[self.k - 1 :]
                near = np.zeros(len(first), dtype=bool)
                near[doc[self.prints.found(g, np.flatnonzero(kept))]] = True
                inside &= near[doc[: len(inside)]]
            if not inside.any():
                continue
            g = grams(h, n)
            at = lookup.found(g, np.flatnonzero(inside))
            for own in np.split(at, np.flatnonzero(np.diff(doc[at])) + 1) if len(at) else ():
                spans, items = out.setdefault(int(doc[own[0]]), ([], set()))
                ends = np.flatnonzero(np.append(np.diff(own) > n, True))
                spans += zip(own[np.append(0, ends[:-1] + 1)].tolist(), (own[ends] + n).tolist())
                items.update(lookup.items_of(g[own]).tolist())
        return out


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, joined where they touch, flat: start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 6, *, carry: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of each row of ``docs`` with what of its text the items hold.

    Added: ``n_words``, ``hit_spans`` (array<int>: start, end, start, end ... in words, end
    exclusive, sorted and disjoint) and ``hit_items`` (array<string>: ids as strings, sorted,
    each once). Words are runs of letters, digits and non-ASCII, A-Z as a-z. Null and empty texts
    have no words; items without words never occur; an item without an id hits but isn't listed.
    Repeated rows and items count as one each would. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    carry = carry if carry is not None else ["doc_id"]
    own = items.select(items[item_col].cast("string").alias("i"), items[item_text_col].alias("t")).where(F.length("t") > 0).distinct()
    if (own.agg(F.sum(F.octet_length("t") + 32).alias("n")).first()["n"] or 0) > block_bytes:
        return _joined(docs, own, window, k, carry, text_col)
    block = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # block_bytes at most
    kinds = [docs.schema[c] for c in carry]
    out = T.StructType([T.StructField(f"c{i}", x.dataType) for i, x in enumerate(kinds)] + [T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("i", T.ArrayType(T.StringType()))])
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text_col].alias("t"))
    return _named(rows.mapInArrow(_scan(block, window, k, len(carry)), out), carry)


def _named(out: DataFrame, carry: list[str]) -> DataFrame:
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("n").alias("n_words"), F.col("s").alias("hit_spans"), F.col("i").alias("hit_items"))


def _windows_of(window: int, k: int):
    """For each item: its digest, and the fingerprints and windows of its text, (length of the window, 0 for fingerprints; hash), each once."""

    def run(batches):
        import pyarrow as pa

        table = byte_table(SEPARATORS)
        for batch in batches:
            names, sizes, hashes = [], [], []
            for row, data, starts, ends in chunks(batch.column(1)):
                h, _, _, n = words(data, starts, ends, table)
                for i, (a, b) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
                    own = h[a:b]
                    if not len(own):
                        continue
                    size = min(window, len(own))
                    parts = [(size, np.unique(grams(own, size)))]
                    if size == window:
                        g = grams(own, k)
                        parts.append((0, np.unique(g[winnow(g, window - k + 1)])))
                    for size, g in parts:
                        names.append(pa.array(np.full(len(g), row + i)))
                        sizes.append(np.full(len(g), size, dtype=np.int32))
                        hashes.append(g.view(np.int64))
            if names:
                at = pa.concat_arrays(names)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hashes))], names=["item", "size", "hash"])

    return run


def _candidates(filters, window: int, k: int):
    """(text, size, hash, at): the windows of a text that may be an item's, of texts that may share a fingerprint or a short item."""

    def run(batches):
        import pyarrow as pa

        table, bits = byte_table(SEPARATORS), filters.value
        for batch in batches:
            for row, data, starts, ends in chunks(batch.column(1)):
                h, _, _, n = words(data, starts, ends, table)
                doc = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                for size in sorted(bits.keys() - {0}):
                    if len(h) < size:
                        continue
                    g = grams(h, size)
                    inside = doc[: len(g)] == doc[size - 1 :]
                    if size == window:
                        small = grams(h, k)
                        kept = winnow(small, window - k + 1) & (doc[: len(small)] == doc[k - 1 :])
                        at = np.flatnonzero(kept)
                        near = np.zeros(len(n), dtype=bool)
                        near[doc[at[passes(bits[0], small[at])]]] = True
                        inside &= near[doc[: len(g)]]
                    at = np.flatnonzero(inside)
                    at = at[passes(bits[size], g[at])]
                    if len(at):
                        texts = batch.column(0).take(pa.array(row + doc[at]))
                        yield pa.RecordBatch.from_arrays([texts, pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(g[at].view(np.int64)), pa.array((at - first[doc[at]]).astype(np.int32))], names=["text", "size", "hash", "at"])

    return run


def _counted(batches):
    """The columns of a batch but the last, with the number of words of the last instead."""
    import pyarrow as pa

    table = byte_table(SEPARATORS)
    for batch in batches:
        counts = np.zeros(len(batch), dtype=np.int64)
        for row, data, starts, ends in chunks(batch.column(batch.num_columns - 1)):
            n = words(data, starts, ends, table)[3]
            counts[row : row + len(n)] = n
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "n"])


def _joined(docs: DataFrame, items: DataFrame, window: int, k: int, carry: list[str], text_col: str) -> DataFrame:
    """What ``benchmark_hits`` gives, by joins: nothing of the items but filters of bounded size reaches the driver or is broadcast.

    Texts and items are told by digests of their words' bytes, so equal ones are looked at once. A
    window may be in a large share of all texts: it is shuffled with SALTS copies of the item's
    side, which holds only windows that do occur.
    """
    spark = docs.sparkSession
    ids = items.select(F.md5(F.col("t").cast("binary")).alias("item"), "i", "t")
    parts = staged(ids.select("item", "t").distinct().mapInArrow(_windows_of(window, k), "item string, size int, hash long"), "items")
    known = staged(parts.select("size", "hash").distinct(), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # window + 1 at most
    filters = spark.sparkContext.broadcast({size: row_filter(known.where(F.col("size") == size).select("hash")) for size in sizes})
    digest = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    texts = docs.select(digest.alias("text"), docs[text_col].alias("t")).where(F.length("t") > 0)
    may = staged(texts.mapInArrow(_candidates(filters, window, k), "text string, size int, hash long, at int").distinct(), "may")
    salt, copies = F.pmod(F.xxhash64("text"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = parts.join(may.select("size", "hash").distinct(), ["size", "hash"], "left_semi")
    met = staged(met.where("size > 0"), "met")  # windows of items that texts may have
    hits = staged(may.select("*", salt).join(met.select("size", "hash").distinct().select("*", copies), ["size", "hash", "salt"], "left_semi"), "hits")
    span = F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("z"))
    spans = hits.groupBy("text").agg(F.array_sort(F.collect_set(span)).alias("x"))  # a text's own windows
    joined = F.aggregate(
        "x", F.array().cast("array<int>"),
        lambda held, x: F.when((F.size(held) > 0) & (x["a"] <= F.element_at(held, -1)), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.greatest(F.element_at(held, -1), x["z"])))).otherwise(F.concat(held, F.array(x["a"], x["z"]))),
    )
    pairs = hits.select("text", "size", "hash", "salt").distinct().join(met.select("*", copies), ["size", "hash", "salt"]).select("text", "item").distinct()
    named = pairs.join(ids.where("i IS NOT NULL").select("item", "i"), "item").groupBy("text").agg(F.array_sort(F.collect_set("i")).alias("i"))  # what the text is listed with
    found = staged(spans.select("text", joined.alias("s")).join(named, "text", "left"), "found")
    release(parts, known, may, met, hits)
    bits = spark.sparkContext.broadcast(row_filter(found.select(F.xxhash64("text"))))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], digest.alias("text"), docs[text_col].alias("t"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType())])
    likely, none = in_filter(bits)(F.xxhash64("text")), [F.array().cast("array<int>").alias("s"), F.array().cast("array<string>").alias("i")]
    clean = rows.where(~likely).mapInArrow(_counted, schema).select("*", *none)
    rest = rows.where(likely).mapInArrow(_counted, schema)
    rest = rest.join(found, "text", "left").select(*schema.names, *[F.coalesce(c, e).alias(c) for c, e in zip(("s", "i"), none)])
    return _named(clean.unionByName(rest), carry)


def _scan(block, window: int, k: int, width: int):
    """A task that looks its texts up among a block of items."""

    def scan(batches):
        import pyarrow as pa

        items = Items(block.value, window, k)
        for batch in batches:
            counts = np.zeros(len(batch), dtype=np.int64)
            spans, names = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for row, data, starts, ends in chunks(batch.column(width)):
                h, _, _, n = words(data, starts, ends, items.table)
                counts[row : row + len(n)] = n
                last = np.cumsum(n)
                doc = np.repeat(np.arange(len(n)), n)
                for d, (found, own) in items.hits(h, last - n, last, doc).items():
                    at, r = int(last[d] - n[d]), row + d
                    spans[r] = _merged([(a - at, z - at) for a, z in found])
                    names[r] = sorted({items.names[i] for i in own if items.names[i] is not None})
            arrays = [*batch.columns[:width], pa.array(counts), pa.array(spans, type=pa.list_(pa.int32())), pa.array(names, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:width], "n", "s", "i"])

    return scan


def hit_words(spans: str) -> F.Column:
    """How many words the spans of a ``hit_spans`` column hold."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, *, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row: its id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated; see ``benchmark_hits``."""
    hits = benchmark_hits(docs, items, window, carry=[id_col], **how)
    return hits.select(
        id_col, "n_words", hit_words("hit_spans").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item; see ``benchmark_hits``. Rows never leave their tasks."""
    hits = benchmark_hits(docs, items, window, carry=docs.columns, **how)
    return hits.where(F.size("hit_spans") == 0).select(*docs.columns)
