"""Fuzzy line dedup.

A normalised line has a SimHash cut into blocks. Lines that agree in a block are candidates, their
edit similarity confirms links, and of every connected group of lines one occurrence is kept in
the corpus, the first by document and line.

In a wide comparison, which the queries use, every line with words takes part. A line's features,
q-grams of its bytes, are dealt out to many classes by their hashes, and each block is the SimHash
of one class of a few features. By the pigeonhole principle a line that differs in fewer features
than it has blocks shares one, and a block, a SimHash of several features, is rarely shared by
chance. All candidates whose lengths and counts of code points allow a link are compared, but for long
ones whose SimHashes of all 5-grams lie far apart; these lose some of the pairs that are barely alike.

In a narrow one, a SimHash of 192 bits over a line's different words has 6 blocks, so candidates
are those whose SimHashes differ in 5 bits or fewer, and many beyond; and links are those that
differ in a quarter of the bits at most.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, staged
from tidemark.llm.decontamination import SEPARATORS
from tidemark.llm.distances import within_pairs
from tidemark.llm.kernels import STEP, _powers, byte_table, chunks, grams, mix, randoms, words
from tidemark.llm.links import BLOCK_BYTES, Likeness, bucket_components, in_filter, passes, row_filter

BLOCKS = 6
#: Bits in which the SimHashes of a link may differ: an angle of 45 degrees.
MOST_BITS = 48
#: Lines of fewer words are compared within their document only, and exactly: across documents they meet by chance.
MIN_WORDS = 5
#: Classes of features of a line, by its number of features: 2**j classes from LOW times as many on, to SPAN times that. Few features a class, so that a change leaves most alone.
LOW, SPAN, MOST_CLASSES = 0.9, 2.57, 11
#: Classes of a line that are looked at, and how often its features are dealt out to 2**j classes for them.
CLASSES, FEWER, DEALS = 192, 3, {1: 6, 2: 6, 3: 6, 4: 6, 5: 5, 6: 3, 7: 2}
#: Features of a class without which it is no block: one or two are common to too many lines.
LEAST = 3
#: All lines have blocks of their bytes' 5-grams, those of up to SHORT_BYTES of 3-grams too.
SHORT_BYTES = 40
#: Lines of up to so many bytes have blocks for what is left without one or two bytes.
TINY_BYTES = 12
#: Lines of so many code points or more whose SimHashes of 5-grams differ in more bits are no link: strangers differ in 96 or a little less, links in 64 at most but for most of those that are barely alike.
LONG_POINTS, WIDE_BITS = 60, 64
#: Bytes of a SimHash, and classes of code points whose counts follow it in the sketch of a wide comparison, half a byte each.
SIMHASH_BYTES, BAG = 4 * BLOCKS, 48
#: A line that makes up so small a part of all lines, or more, is common.
COMMON = 20_000


def line_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of texts that lie side by side, and each line's text; a text has one line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([starts, breaks + 1])
    text = np.concatenate([np.arange(len(starts)), np.searchsorted(ends, breaks, side="right")])
    order = np.lexsort((begin, text))
    begin, text = begin[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, ends[text], np.append(begin[1:], 0) - 1)
    return begin, end, text


def line_names(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each line's words, n words a line."""
    at = np.concatenate([[0], np.cumsum(n)])
    powers, unpowers = _powers(1 << max(20, int(len(h)).bit_length()))
    out = np.empty((len(n), 2), dtype=np.uint64)
    for i, x in enumerate((h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])
        out[:, i] = mix((sums[at[1:]] - sums[at[:-1]]) * unpowers[at[:-1]] + n.astype(np.uint64))
    return out


def _majority(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit hashes: 8 bytes a row for each run of n from ``at`` on; a bit is set when it is in more than half of the run's hashes."""
    parts = -(-n // 255)  # sums of 255 hashes fit in a byte
    first = np.cumsum(parts) - parts
    begin = np.repeat(at, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ones = np.uint64(0x0101010101010101)
    ends = np.append(begin[1:], x.shape[1])
    sums = np.empty((len(begin), len(x), 8, 8), dtype=np.uint8)  # run, row, byte, bit
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, x.shape[1], STEP)), len(begin))).tolist()
    for a, b in zip(cuts, cuts[1:]):
        low = int(begin[a])
        for r in range(len(x)):
            own = x[r, low : int(ends[b - 1])]
            t = np.empty_like(own)
            for k in range(8):
                np.right_shift(own, np.uint64(k), out=t)
                t &= ones
                sums[a:b, r, :, k] = np.add.reduceat(t, begin[a:b] - low).view(np.uint8).reshape(-1, 8)
    if len(first) < len(begin):
        sums = np.add.reduceat(sums.astype(np.uint32), first, axis=0)
    return np.packbits((sums > (n // 2)[:, None, None, None]).reshape(len(n), -1), axis=1)


#: Each byte with its bits turned round, as ``_majority`` has them.
_TURNED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(-1, 8)[:, ::-1], axis=1).ravel()


def _majorities(x: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``_majority`` of one row, as 64-bit values, bits in their order; of runs of 3 to 7, as most are, by adders on whole words."""
    out = np.empty(len(n), dtype=np.uint64)

    def add(a, b, c):
        both = a ^ b
        return both ^ c, a & b | both & c

    for k in range(3, 8):
        runs = np.flatnonzero(n == k)
        own = [x[at[runs] + i] for i in range(k)]
        one, two = add(*own[:3])
        if k == 3:
            out[runs] = two
        elif k == 4:  # three or four
            out[runs] = two & (one | own[3])
        elif k == 5:  # three or more
            low, high = add(one, *own[3:])
            out[runs] = two & high | (two | high) & low
        else:  # four or more
            low, high = add(*own[3:6])
            out[runs] = add(two, high, one & low if k == 6 else add(one, low, own[6])[1])[1]
    rest = np.flatnonzero((n < 3) | (n > 7))
    if len(rest):
        own, step = n[rest], np.cumsum(n[rest]) - n[rest]
        picked = x[np.repeat(at[rest] - step, own) + np.arange(own.sum())]
        out[rest] = _TURNED[_majority(picked[None], step, own)].view(np.uint64).ravel()
    return out


def simhashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each line of n words, n > 0: BLOCKS blocks of 4 bytes; a bit is set when it is in more than half of the hashes of the line's different words.

    A word counts once however often it occurs, or else lines of the same few frequent words would be alike.
    """
    if len(n) > 1 << 24:
        half = len(n) // 2
        cut = int(n[:half].sum())
        return np.concatenate([simhashes(h[:cut], n[:half]), simhashes(h[cut:], n[half:])])
    own = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(40)) | (h >> np.uint64(24)))
    own = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
    n = np.bincount((own >> np.uint64(40)).astype(np.int64), minlength=len(n))
    x = np.stack([mix((own << np.uint64(24)) + r) for r in randoms(BLOCKS // 2, 41)])
    return _majority(x, np.cumsum(n) - n, n)


def byte_grams(data: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, values: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte q-grams of each line of n words, n > 0, with a space before, between and behind words, and how many a line has."""
    size = last - first
    line = np.repeat(np.arange(len(n)), n)
    length = np.bincount(line, weights=size + 1, minlength=len(n)).astype(np.int64) + 1
    at = np.cumsum(size + 1) - size + line
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    v = np.full(int(length.sum()), values[32])
    v[np.repeat(at, size) + step] = values[data[np.repeat(first, size) + step]]
    count = np.maximum(length - q + 1, 0)
    return grams(v, q)[np.repeat(np.cumsum(length) - length - np.cumsum(count) + count, count) + np.arange(count.sum())], count


def gram_simhashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, values: np.ndarray, fives: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``simhashes`` of each line's byte 5-grams, which a typo leaves alone but for five; zeros for a line that has none. ``fives``: the 5-grams, where they are known."""
    g, count = fives or byte_grams(data, first, last, n, values, 5)
    out = np.zeros((len(n), 4 * BLOCKS), dtype=np.uint8)
    if len(g):
        out[count > 0] = simhashes(g, count[count > 0]).view(np.uint8).reshape(-1, 4 * BLOCKS)
    return out


def _bag_classes() -> np.ndarray:
    """A class for the last byte of each code point: a letter's own, a space's, one for two digits each, and for those beyond ASCII one of 16."""
    out = np.zeros(256, dtype=np.int64)
    out[97:123] = out[65:91] = np.arange(26)
    out[32] = 26
    out[48:58] = 27 + np.arange(10) // 2
    out[128:] = 32 + (np.arange(128) & 15)
    return out


def bags(data: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """How often each class of code points is in each line of n words, n > 0, of the texts in ``data``, with a space between words: BAG counts of four bits, 15 for 15 or more.

    Zeros for all, which no line has, where ``data`` isn't UTF-8.
    """
    out = np.zeros((len(n), BAG), dtype=np.int64)
    try:
        str(memoryview(np.ascontiguousarray(data)), "utf-8")
        told = not (data[starts[starts < len(data)]] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        told = False
    if told and len(n):
        classes = _bag_classes()
        line = np.repeat(np.repeat(np.arange(len(n)), n), last - first)
        at = np.flatnonzero(is_word[data])
        ends = np.append(data[1:] & 0xC0 != 0x80, True)[at]
        out = np.bincount(line[ends] * BAG + classes[data[at[ends]]], minlength=out.size).reshape(out.shape)
        out[:, classes[32]] += n - 1
    out = np.minimum(out, 15).astype(np.uint8)
    return out[:, ::2] << 4 | out[:, 1::2]


def edits_proved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An edit distance that the bags of each pair prove at least: an edit takes one code point away at most, and adds one at most."""
    apart = np.concatenate([(left >> 4).view(np.int8) - (right >> 4).view(np.int8), (left & 15).view(np.int8) - (right & 15).view(np.int8)], axis=1)
    more = np.maximum(apart, 0).sum(axis=1, dtype=np.int64)
    proved = np.maximum(more, more - apart.sum(axis=1, dtype=np.int64))
    return np.where(left.any(axis=1) & right.any(axis=1), proved, 0)


def class_blocks(h: np.ndarray, n: np.ndarray, kind: int, low: float, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) of lines of n features each: a block is the SimHash of a line's features in one class, with the class.

    A feature's class is a part of its hash, and of a line's 2**j classes each has a few features.
    So a change of a line touches a few of its blocks only, and lines whose features differ in
    fewer than they have blocks share one. Features of short lines are dealt out several times, by
    other parts of their hashes (DEALS), as so few classes are soon all touched. Lines whose number
    of features suits two j have blocks for both. Classes of fewer than ``least`` features give no block.
    """
    lines, blocks = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    at = np.cumsum(n) - n
    for j in range(1, MOST_CLASSES + 1):
        every = np.flatnonzero((n >= low * 2**j) & ((n < low * SPAN * 2**j) | (j == MOST_CLASSES)))
        if not len(every):
            continue
        own = h[np.repeat(at[every] - np.cumsum(n[every]) + n[every], n[every]) + np.arange(n[every].sum())]
        line, deals = np.repeat(np.arange(len(every), dtype=np.uint64) << np.uint64(40), n[every]), DEALS.get(j, 1)
        # Lines that have blocks for the next j too, which are needed for pairs on both sides of its beginning, have few here.
        most = np.repeat(np.where(n[every] >= 2 * low * 2**j, -(-CLASSES // (deals * FEWER)), -(-CLASSES // deals)).astype(np.uint64), n[every])
        for deal in range(deals):
            x = mix(own + np.uint64(j + 64 * deal)) >> np.uint64(24)
            some = (x >> np.uint64(40 - j)) < most
            x = (line | x)[some]
            x = np.sort(x)
            x = x[np.append(True, x[1:] != x[:-1])[: len(x)]]  # a feature counts once
            group = x >> np.uint64(40 - j)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(x)])
            size = np.diff(np.append(first, len(x)))
            x, first, size = x[np.repeat(size >= least, size)], first[size >= least], size[size >= least]
            if not len(first):
                continue
            group, first = group[first], np.cumsum(size) - size
            lines.append(every[(group >> np.uint64(j)).astype(np.int64)])
            signs = _majorities(mix(x & np.uint64((1 << 40) - 1)), first, size)
            blocks.append(mix(signs ^ mix(group & np.uint64((1 << j) - 1) | np.uint64((deal << 16 | kind << 8 | j) << 32))))
    return np.concatenate(lines), np.concatenate(blocks)


def _shortened(lines: list[bytes]) -> tuple[list[int], list[int]]:
    """(line, block) for what is left of each line without one or two of its bytes, and for the whole of it."""
    from hashlib import blake2b
    from itertools import combinations

    rows, blocks = [], []
    for i, line in enumerate(lines):
        left = {bytes(b for k, b in enumerate(line) if k not in gone) for away in range(3 if len(line) > 9 else 2) for gone in combinations(range(len(line)), away)}
        rows += [i] * len(left)
        blocks += [int.from_bytes(blake2b(b"-" + x, digest_size=8).digest(), "little") for x in left]
    return rows, blocks


def wide_blocks(data: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, values: np.ndarray, fives: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[bytes], np.ndarray]:
    """Of each line of n words, n > 0: its blocks, BLOCK_BYTES each, side by side, and its length in code points. ``fives``: its byte 5-grams, where they are known."""
    points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    begin = np.cumsum(n) - n
    length = np.add.reduceat(points[last] - points[first], begin) + n - 1 if len(n) else n
    size = np.add.reduceat(last - first, begin) + n - 1 if len(n) else n
    rows, blocks = [], []
    for q, chosen in ((5, n > 0), (3, size <= SHORT_BYTES)):
        own, some = np.repeat(chosen, n), np.flatnonzero(chosen)
        if len(some):
            line, block = class_blocks(*(fives if fives and q == 5 else byte_grams(data, first[own], last[own], n[some], values, q)), q, LOW)
            rows.append(some[line])
            blocks.append(block)
    tiny = np.flatnonzero(size <= TINY_BYTES)
    line, block = _shortened([b" ".join(data[a:b].tobytes() for a, b in zip(first[x : x + k], last[x : x + k])).lower() for x, k in zip(begin[tiny], n[tiny])])
    rows, blocks = np.concatenate([*rows, tiny[line]]).astype(np.int64), np.concatenate([*blocks, np.array(block, dtype=np.uint64)])
    order = np.argsort(rows, kind="stable")
    raw = np.ascontiguousarray(blocks[order].view(np.uint8).reshape(-1, 8)[:, :BLOCK_BYTES]).tobytes()
    ends = np.cumsum(np.bincount(rows, minlength=len(n))) * BLOCK_BYTES
    return [raw[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)], length


def named_lines(docs: DataFrame, min_words: int = MIN_WORDS, *, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, h (a hash of its text), n_lines, and for lines with words arrays of their numbers, names and SimHashes (null for short lines, and if ``wide``)."""
    width = 4 * BLOCKS

    def name(batches):
        import pyarrow as pa

        table = byte_table(SEPARATORS)
        for batch in batches:
            own = batch.column(2).to_numpy().view(np.uint64)  # short lines have names of their document
            for row, data, starts, ends in chunks(batch.column(3)):
                begin, end, text = line_bounds(data, starts, ends)
                h, first, last, n = words(data, begin, end, table)
                full = np.flatnonzero(n > 0)
                names, long = line_names(h, n)[full], n[full] >= min_words
                names[~long] = mix(names[~long] ^ mix(own[row + text[full[~long]]])[:, None])
                hashed = np.zeros(len(full), dtype=bool) if wide else long
                blocks = simhashes(h, n[full]) if len(full) and not wide else np.zeros((0 if wide else len(full), width), dtype=np.uint8)
                count = np.bincount(text, minlength=len(starts))
                lists = np.concatenate([[0], np.cumsum(np.bincount(text[full], minlength=len(starts)))]).astype(np.int32)
                numbers = (full - (np.cumsum(count) - count)[text[full]]).astype(np.int32)
                raw = names.tobytes()
                each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(full), [None, pa.py_buffer(raw)]).cast(pa.binary())
                sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(blocks), [None, pa.py_buffer(blocks.tobytes())]).cast(pa.binary())
                sketches = pa.nulls(len(full), pa.binary()) if wide else sketches.filter(pa.array(hashed)).take(pa.array(np.cumsum(hashed) - 1, mask=~hashed))
                arrays = [batch.column(0).slice(row, len(starts)), batch.column(1).slice(row, len(starts)), pa.array(count.astype(np.int32))]
                arrays += [pa.ListArray.from_arrays(pa.array(lists), x) for x in (pa.array(numbers), each, sketches)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "h", "n_lines", "lines", "nodes", "sketches"])

    kind = docs.schema[id_col].dataType.simpleString()
    i, text = docs[id_col], docs[text_col]
    return docs.select(i.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(i, text).alias("own"), text.alias("text")).mapInArrow(name, f"id {kind}, h long, n_lines int, lines array<int>, nodes array<binary>, sketches array<binary>")


def blocked_lines(docs: DataFrame, nodes: DataFrame, text_col: str) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(node, size, sketch, blocks) of each different line that has blocks, the sketch a SimHash of its 5-grams and its bag, and the staged tables that hold them; ``nodes`` (node, n) says how often each occurs."""
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(row_filter(nodes.where("n > 1").select("node")))

    def block(batches):
        import pyarrow as pa

        table = byte_table(SEPARATORS)
        for batch in batches:
            for _, data, starts, ends in chunks(batch.column(0)):
                begin, end, _ = line_bounds(data, starts, ends)
                h, first, last, n = words(data, begin, end, table)
                names, n = line_names(h, n)[n > 0], n[n > 0]
                every = np.sort(np.fromiter({names[i].tobytes(): i for i in range(len(names))}.values(), np.int64))  # once in a chunk
                bag = bags(data, starts, first, last, n, table[0])[every]
                own = np.repeat(np.isin(np.arange(len(n)), every), n)
                names, h, first, last, n = names[every], h[own], first[own], last[own], n[every]
                fives = byte_grams(data, first, last, n, table[1], 5)
                blocks, size = wide_blocks(data, h, first, last, n, table[1], fives)
                again = passes(often.value, np.ascontiguousarray(names[:, 0]))
                rows = [i for i, x in enumerate(blocks) if x]
                sketches = np.concatenate([gram_simhashes(data, first, last, n, table[1], fives), bag], axis=1)[rows] if rows else ()
                arrays = [pa.array([names[i].tobytes() for i in rows], pa.binary()), pa.array(size[rows], pa.int64()), pa.array([x.tobytes() for x in sketches], pa.binary()), pa.array([blocks[i] for i in rows], pa.binary()), pa.array(again[rows])]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "size", "sketch", "blocks", "again"])

    found = staged(docs.select(docs[text_col].alias("text")).where("text IS NOT NULL").mapInArrow(block, "node binary, size long, sketch binary, blocks binary, again boolean"), "blocks")
    several = staged(found.where("again").drop("again").dropDuplicates(["node"]), "blocks")
    return found.where("NOT again").drop("again").union(several), (found, several)


def normal_lines(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, full): the normalised text of each line named in ``nodes`` (node, and h of a text that has it), once, as UTF-8."""
    spark = docs.sparkSession
    bits, holders = (spark.sparkContext.broadcast(row_filter(nodes.select(c))) for c in ("node", "h"))

    def texts(batches):
        import pyarrow as pa

        table = byte_table(SEPARATORS)
        for batch in batches:
            held = batch.column(1).take(pa.array(np.flatnonzero(passes(holders.value, batch.column(0).to_numpy()))))
            for _, data, starts, ends in chunks(held):
                begin, end, _ = line_bounds(data, starts, ends)
                h, first, last, n = words(data, begin, end, table)
                names, at = line_names(h, n), np.cumsum(n)
                rows = np.flatnonzero((n > 0) & passes(bits.value, np.ascontiguousarray(names[:, 0])))
                lines = {names[i].tobytes(): b" ".join(data[a:b].tobytes() for a, b in zip(first[at[i] - n[i] : at[i]], last[at[i] - n[i] : at[i]])).lower() for i in rows}
                yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.binary()), pa.array(list(lines.values()), pa.binary())], names=["node", "full"])

    own = docs.where(docs[text_col].isNotNull()).select(F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    out = staged(own.mapInArrow(texts, "node binary, full binary").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    bits.destroy()
    holders.destroy()
    return out


#: Columns after which the whole column of distances is looked at.
LOOK = 48


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance of two texts is ``most`` or less.

    What both begin and end with goes; columns of the table of distances are then bits of whole numbers.
    """
    a, b = (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (x, y))
    for _ in range(2):
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        same = int(differ.argmax()) if differ.any() else n
        a, b = a[same:][::-1], b[same:][::-1]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= most:
        return True
    if len(b) - len(a) > most or not len(a):
        return False
    at = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a).tolist()}
    full = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    more, fewer, distance, left = full, 0, len(a), len(b)
    rows = np.arange(1, len(a) + 1)
    for j, c in enumerate(b.tolist(), 1):
        equal = at.get(c, 0)
        across = (((equal & more) + more) ^ more) | equal
        up, down = fewer | full & ~(across | more), more & across
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        left -= 1
        if distance - left > most:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        diagonal = equal | fewer
        more, fewer = down | full & ~(diagonal | up), up & diagonal
        if not j % LOOK:  # what a column has, and what must follow
            steps = [np.unpackbits(np.frombuffer(x.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)].astype(np.int32) for x in (more, fewer)]
            if (j + np.cumsum(steps[0] - steps[1]) + np.abs(len(a) - rows - left)).min() > most and j + abs(len(a) - left) > most:
                return False
    return distance <= most


def far(x: str, y: str, most: int) -> bool:
    """Whether trigrams prove an edit distance of more than ``most``: an edit takes three away from a text at most."""
    counts = []
    for s in (x, y):
        a = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
        if len(a) < 32:
            return False
        counts.append(np.bincount((a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)) >> np.uint32(20), minlength=4096))
    gone = counts[0] - counts[1]
    return max(int(gone[gone > 0].sum()), -int(gone[gone < 0].sum())) > 3 * most


def near(x: str, y: str, most: int) -> bool:
    """Whether words that both texts have once, in the same order, prove an edit distance of ``most`` or less: what lies between them is replaced place by place."""
    a, b = x.split(" "), y.split(" ")
    seen_a, seen_b = ({} for _ in range(2))
    for own, seen in ((a, seen_a), (b, seen_b)):
        for i, w in enumerate(own):
            seen[w] = -1 if w in seen else i
    ends: list[int] = []  # the least last place of an ascending chain of each length
    chain, before = [], []
    for w, i in seen_a.items():
        j = seen_b.get(w, -1)
        if i >= 0 and j >= 0:
            k = bisect_left(ends, j, key=lambda e: chain[e][1])
            before.append(ends[k - 1] if k else -1)
            ends[k : k + 1] = [len(chain)]
            chain.append((i, j))
    anchors, e = [(len(a), len(b))], ends[-1] if ends else -1
    while e >= 0:
        anchors.append(chain[e])
        e = before[e]
    cost, p, q = 0, 0, 0
    for i, j in reversed(anchors):
        if a[p:i] != b[q:j]:
            u, v = " ".join(a[p:i]), " ".join(b[q:j])
            cost += sum(map(ne, u, v)) + abs(len(u) - len(v)) + ((p == i) != (q == j))
            if cost > most:
                return False
        p, q = i + 1, j + 1
    return True


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), count=n, bitorder="little")


def within_many(x: str, ys: list[str], most: list[int], look: int = 64) -> list[bool]:
    """Whether the edit distance of ``x`` to each of ``ys`` is that one's ``most`` or less.

    As ``within``, but a whole number has the columns of all texts side by side, with a bit between
    two that stops carries. After every ``look`` columns texts that must exceed their ``most`` are
    given up, and taken out once they make up half of the bits.
    """
    codes = [np.frombuffer(f"{y} ".encode("utf-32-le"), dtype=np.uint32) for y in ys]
    n, most = np.array([len(c) for c in codes], dtype=np.int64), np.array(most)
    own, rows, out = np.concatenate([*codes, np.zeros(0, dtype=np.uint32)]), np.arange(len(ys)), np.zeros(len(ys), dtype=bool)
    own[np.cumsum(n) - 1] = 1 << 31  # the bit between: no character
    text = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32).tolist()

    def masks():
        first, between = np.cumsum(n) - n, np.cumsum(n) - 1
        real, starts = np.ones(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
        real[between], starts[first] = False, True
        return first, between, _number(real), _number(starts & real), {c: _number(own == c) for c in set(text)}

    if not text:
        return (n - 1 <= most).tolist()
    first, between, full, starts, at = masks()
    more, fewer = full, 0
    for j, c in enumerate(text, 1):
        equal = at[c]
        across = (((equal & more) + more) ^ more) | equal
        up, down = fewer | full & ~(across | more), more & across
        up, down = (up << 1) & full | starts, down << 1 & full
        diagonal = equal | fewer
        more, fewer = down | full & ~(diagonal | up), up & diagonal
        if not j % look or j == len(text):
            m, f = _bits(more, len(own)), _bits(fewer, len(own))
            value, left = np.cumsum(m.astype(np.int32) - f), len(text) - j
            value += np.repeat(j - np.where(first > 0, value[first - 1], 0), n)
            if not left:
                out[rows] = value[between] <= most
                break
            value += np.abs(np.repeat(between, n) - np.arange(len(own)) - 1 - left)  # what must follow
            value[between] = j + np.abs(n - 1 - left)  # nothing of the text used yet
            keep = np.minimum.reduceat(value, first) <= most
            if not keep.any():
                break
            if 2 * n[keep].sum() <= n.sum():
                bits = np.repeat(keep, n)
                own, n, most, rows = own[bits], n[keep], most[keep], rows[keep]
                more, fewer = _number(m[bits]), _number(f[bits])
                first, between, full, starts, at = masks()
    return out.tolist()


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two lines have an edit distance of at most 100 - ``percent`` hundredths of the longer."""
    a, b = x.decode("utf-8", "replace"), y.decode("utf-8", "replace")
    most = max(len(a), len(b)) * (100 - percent) // 100
    return near(a, b, most) or not far(a, b, most) and within(a, b, most)


#: Lines of more code points are compared one by one: words and trigrams often settle those sooner.
TOGETHER = 2048


def similar_many(x: bytes, ys: list[bytes], percent: int) -> list[bool]:
    """``similar`` for one line and each of a few."""
    a, others = x.decode("utf-8", "replace"), [y.decode("utf-8", "replace") for y in ys]
    short = [b for b in others if max(len(a), len(b)) <= TOGETHER]
    found = iter(within_many(a, short, [max(len(a), len(b)) * (100 - percent) // 100 for b in short]) if short else ())
    return [next(found) if max(len(a), len(b)) <= TOGETHER else similar(x, y, percent) for b, y in zip(others, ys)]


def similar_pairs(xs: list[bytes], ys: list[bytes], percent: int) -> list[bool]:
    """``similar`` for each pair."""
    a, b = ([x.decode("utf-8", "replace") for x in side] for side in (xs, ys))
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    out, together = np.zeros(len(a), dtype=bool), np.flatnonzero(longer <= TOGETHER)
    out[together] = within_pairs([a[i] for i in together], [b[i] for i in together], longer[together] * (100 - percent) // 100, lambda x, y, most: near(x, y, most) or not far(x, y, most) and within(x, y, most))
    for i in np.flatnonzero(longer > TOGETHER):
        out[i] = similar(xs[i], ys[i], percent)
    return out.tolist()


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits the SimHashes of each pair differ."""
    apart = np.bitwise_count(left[:, :SIMHASH_BYTES].view(np.uint64) ^ right[:, :SIMHASH_BYTES].view(np.uint64))
    return sum((apart[:, i] for i in range(1, apart.shape[1])), apart[:, 0].astype(np.int64))


def bits_glanced(sketches: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of rows differ in WIDE_BITS at most or have a line of fewer than LONG_POINTS."""
    words, short = np.ascontiguousarray(sketches[:, :SIMHASH_BYTES]).view(np.uint64).T.copy(), sizes < LONG_POINTS

    def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(words[0][left] ^ words[0][right])
        for word in words[1:]:
            apart += np.bitwise_count(word[left] ^ word[right])
        return (apart <= WIDE_BITS) | short[left] | short[right]

    return look


def line_groups(docs: DataFrame, nodes: DataFrame, percent: int, text_col: str, wide: bool = False) -> DataFrame:
    """(node, component) of the lines that links connect; ``nodes`` is a stored table (node, sketch, first, n), sketch null for lines that are compared exactly only."""
    if wide:
        own, spent = blocked_lines(docs, nodes, text_col)
        buckets = F.col("blocks")
    else:
        own, spent = nodes.where("sketch IS NOT NULL").select("node", "sketch", F.lit(0).cast("long").alias("size")), ()
        buckets = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * 4 + 1, F.lit(4))))

    def plausible(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        if not wide:
            return bits_apart(left, right) <= MOST_BITS
        longer, shorter = np.maximum(n, m), np.minimum(n, m)
        most = longer * (100 - percent) // 100
        out = longer - shorter <= most
        at = np.flatnonzero(out)
        long = at[shorter[at] >= LONG_POINTS]
        out[long] = bits_apart(left[long], right[long]) <= WIDE_BITS
        at = np.flatnonzero(out)
        out[at] = edits_proved(left[at, SIMHASH_BYTES:], right[at, SIMHASH_BYTES:]) <= most[at]
        return out

    def full_objects(ends: DataFrame) -> DataFrame:
        ends = staged(nodes.join(ends, "node", "left_semi").select("node", F.col("first.h").alias("h")), "ends")
        out = normal_lines(docs, ends, text_col)
        release(ends)
        return out

    def alike(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return plausible(left, right, n, m) * (1.01 - bits_apart(left, right) / (32 * BLOCKS))

    like = Likeness(alike, plausible, lambda x, y: similar(x, y, percent), 1, clusters=False, confirm_many=lambda x, ys: similar_many(x, ys, percent))
    like.confirm_pairs = lambda xs, ys: similar_pairs(xs, ys, percent)
    if wide and percent:
        like.longest, like.glance = lambda n: n * 100 // percent, bits_glanced
    return bucket_components(own, buckets, like, full_objects, spent)


def in_names(bits):
    """A column function: which of a column of names a broadcast filter lets pass."""

    @F.pandas_udf("boolean")
    def likely(names):
        import pandas as pd

        return pd.Series(passes(bits.value, np.frombuffer(b"".join(names), dtype=np.uint64)[::2]))

    return likely


def dropped_lines(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS, *, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, dropped) of each different (id, text) that loses lines: h hashes its text, ``dropped`` has their sorted numbers, from 0."""
    lines = staged(named_lines(docs, 1 if wide else min_words, wide=wide, id_col=id_col, text_col=text_col).drop("n_lines"), "lines")
    places = lambda *more: lines.select("id", "h", F.explode(F.arrays_zip("lines", "nodes", *more)).alias("x"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", F.col("x.lines").alias("line"))
    nodes = places("sketches").groupBy(F.col("x.nodes").alias("node")).agg(F.first("x.sketches").alias("sketch"), F.min(place).alias("first"), F.count("*").alias("n"))
    nodes = staged(nodes, "nodes")
    named = nodes.select("node", "first", "n").join(line_groups(docs, nodes, percent, text_col, wide), "node", "left")
    joined = named.where("component IS NOT NULL")
    keepers = joined.join(joined.groupBy("component").agg(F.min("first").alias("keeper")), "component").where("n > 1 OR first <> keeper").select("node", F.col("keeper").alias("first"), "n")
    keepers = staged(keepers.union(named.where("component IS NULL AND n > 1").select("node", "first", "n")), "keepers")
    likely = in_names(docs.sparkSession.sparkContext.broadcast(row_filter(keepers.select("node"))))

    # Lines that make up a COMMON-th of all are fewer than COMMON, so their keepers go to the tasks; the others are met by their names.
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * COMMON >= F.lit(total)
    each = places().select(F.struct(F.col("id").isNull().alias("none"), "id", "h", F.col("x.lines").alias("line")).alias("place"), F.col("x.nodes").alias("node"))
    each = each.where(likely("node")).join(F.broadcast(keepers.where(common).select("node", F.col("first").alias("kept"))), "node", "left")
    gone = each.where("kept IS NOT NULL AND place <> kept").select("place")
    rest = each.where("kept IS NULL").join(keepers.where(~common).select("node", "first"), "node").where("place <> first").select("place")
    gone = gone.union(rest).select("place.id", "place.h", "place.line").distinct()
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_list("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS, *, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without its dropped lines, and ``n_lines`` and ``dropped_lines`` (array<int>).

    Lines end at newlines. Normalised, they are their words (runs of letters, digits and
    non-ASCII) in lower case of A-Z. Lines of ``min_words`` words or more are linked at an edit
    similarity of ``percent`` hundredths within the corpus; shorter ones only when equal and in
    one document. ``wide`` links lines of any number of words, and finds more of the links. Of each group the first occurrence stays, by id (null last), text, line number.
    Lines without words stay. Null texts stay null. Rows with the same id and text keep the same
    lines. A text all of whose lines go becomes empty; columns of ``docs`` named like the two
    added ones are replaced.
    """
    found = dropped_lines(docs, percent, min_words, wide=wide, id_col=id_col, text_col=text_col).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("dropped").alias("dropped_lines"))
    found = staged(found, "dropped")
    bits = docs.sparkSession.sparkContext.broadcast(row_filter(found.select("_h")))

    @F.pandas_udf(T.StringType())
    def without(texts, gone):
        out = []
        for text, numbers in zip(texts, gone):
            if text is not None and numbers is not None and len(numbers):
                away = {*numbers.tolist()}
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    own = docs.drop("n_lines", "dropped_lines")
    lines = F.when(F.col(text_col).isNotNull(), F.size(F.split(text_col, "\n", -1))).alias("n_lines")
    none = F.array().cast("array<int>")
    # Texts that lose nothing stay in their tasks.
    touched = in_filter(bits)(F.xxhash64(own[text_col]))
    same = own.where(~touched).select(*own.columns, lines, none.alias("dropped_lines"))
    some = own.where(touched)
    some = some.join(found, some[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(some[text_col]) == found["_h"]), "left")
    columns = [F.col(c) if c != text_col else without(c, "dropped_lines").alias(c) for c in own.columns]
    return same.union(some.select(*columns, lines, F.coalesce("dropped_lines", none).alias("dropped_lines")))
