"""Best-fit packing by minimum bin slack.

Texts become token pieces of at most ``capacity`` tokens. How pieces can be packed depends on how
many there are of each length only, at most ``capacity`` numbers however large the corpus; from
these the driver plans bins. Each step takes the longest remaining length, finds by a bitset
subset-sum DP the fullest bin that holds it, and opens as many bins of that pattern as the counts
allow. Pieces then find their places by their rank among those of their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import id_text, staged
from tidemark.llm.kernels import chunks

#: Bytes of different words and their tokens that a Python worker remembers, from one task to the next; about WORD_BYTES more for each. Beyond, those seen most often stay, in KEPT of these bytes.
REMEMBERED, WORD_BYTES, KEPT = 48 << 20, 120, 2 / 3
#: Words encoded in one call.
LOT = 500
#: About so many pieces of one length are ranked in one group at most.
RANKED_TOGETHER = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Numbers for words as they come; ``new`` holds those whose tokens aren't known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class WordTokens:
    """Token ids of whole texts, each different word encoded once.

    Right for tokenizers whose tokens never span ASCII white space and ignore it, and never join
    an ASCII letter to a stop or comma after it, as those that split into runs of letters, digits
    and other signs do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of_worker(cls, path: str) -> WordTokens:
        """The one that this Python process keeps for the path."""
        import sys
        import types

        kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
        if getattr(kept, "path", None) != path:
            kept.path, kept.tokens = path, cls(path)
        return kept.tokens

    def forget(self) -> None:
        self.words, self.held = _Words(), 0
        self.flat, self.first = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)

    def forget_rare(self) -> None:
        """Words seen most often stay, as many as KEPT of REMEMBERED holds; what was seen counts half from now on."""
        names, sizes = list(self.words), np.diff(self.first)
        cost = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + WORD_BYTES + 4 * sizes
        often = np.argsort(-self.seen, kind="stable")
        keep = np.sort(often[np.cumsum(cost[often]) <= REMEMBERED * KEPT])
        self.words, self.held = _Words(), int(cost[keep].sum())
        self.words.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        first = np.append(0, np.cumsum(sizes[keep]))
        self.flat = self.flat[np.repeat(self.first[keep] - first[:-1], sizes[keep]) + np.arange(first[-1])]
        self.first, self.seen = first, self.seen[keep] // 2

    def _encode(self, new: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their number for each word: many words at once, told apart by where tokens begin."""
        ids, sizes = [], []
        for i in range(0, len(new), LOT):
            lot = new[i : i + LOT]
            got = self.encoder.encode(" ".join(lot), add_special_tokens=False)
            ends = np.cumsum([len(x) + 1 for x in lot])
            begin = np.fromiter((x for x, _ in got.offsets), dtype=np.int64)
            sizes.append(np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(lot)))
            ids.append(np.array(got.ids, dtype=np.uint32))
        return ids, sizes

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts that lie side by side in ``data``: all ids in a row, and how many each text has."""
        if self.held > REMEMBERED:
            self.forget_rare()
        letter = (data | 32) - np.uint8(97) < 26
        stop = (data == 44) | (data == 46)
        stop[1:] &= letter[:-1]
        stop[:-1] &= (data[1:] == 32) | (data[1:] == 10)
        stop[:1] = False
        stops = np.flatnonzero(stop)
        raw = np.insert(data, stops, np.uint8(32)).tobytes()
        texts = [raw[a:b] for a, b in zip(starts + np.searchsorted(stops, starts), ends + np.searchsorted(stops, ends))]
        split = [(x if b"<|" in x else x.lower()).split() for x in texts]  # special tokens are told apart by case
        known = np.concatenate([np.fromiter(map(self.words.__getitem__, x), dtype=np.int64, count=len(x)) for x in split])
        if new := self.words.new:
            ids, sizes = self._encode([x.decode("utf-8", "replace") for x in new])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
            self.flat = np.concatenate([self.flat, *ids])
            self.held += sum(len(x) + WORD_BYTES for x in new) + 4 * sum(map(len, ids))
            self.words.new = []
            self.seen = np.append(self.seen, np.zeros(len(new), dtype=np.int64))
        self.seen += np.bincount(known, minlength=len(self.seen))
        first = self.first[known]
        sizes = self.first[known + 1] - first
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - before[:-1], sizes) + np.arange(before[-1])]
        at = np.concatenate([[0], np.cumsum([len(x) for x in split])])
        return ids, np.diff(before[at])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, *, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A document is its ids, then ``end_id``; only those longer than ``capacity`` are cut. Null and
    empty texts are one piece of ``end_id`` alone. Rows are taken as they come: repeated rows give
    repeated pieces, a null id stays null. The file at ``tokenizer_path`` must be on every machine.
    """

    def cut(batches):
        import os
        import zlib

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = WordTokens.of_worker(tokenizer_path)
        for batch in batches:
            ids_of = batch.column(0)
            for row, data, starts, ends in chunks(batch.column(1)):
                ids, sizes = tokens.ids(data, starts, ends)
                at = np.concatenate([[0], np.cumsum(sizes)])
                out, rows = [], []
                for i in range(len(starts)):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append(row + i)
                        out.append((p, s, len(part), zlib.crc32(part.tobytes())) + ((part.view(np.int32),) if with_ids else ()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [ids_of.take(pa.array(rows))] + [pa.array(x, type=t) for x, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
        if tokens.held > REMEMBERED:
            tokens.forget_rare()

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how many in each)]) until nothing is left of ``counts``, {length: number}."""
    left = {k: v for k, v in counts.items() if v > 0}
    if left and not (0 < min(left) and max(left) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = []
    while left:
        longest = max(left)
        room = capacity - longest
        mask = (1 << room + 1) - 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= room), reverse=True):
            n, lot = min(left[length] - (length == longest), room // length), 1
            while n > 0 and not reach >> room & 1:
                lot = min(lot, n)
                steps.append((reach, length, lot))
                reach |= reach << length * lot & mask
                n, lot = n - lot, lot * 2
            if reach >> room & 1:
                break
        want, held = reach.bit_length() - 1, {longest: 1}
        for before, length, lot in reversed(steps):
            if not before >> want & 1:
                want -= length * lot
                held[length] = held.get(length, 0) + lot
        bins = min(left[x] // n for x, n in held.items())
        for x, n in held.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x]
        plan.append((bins, sorted(held.items(), reverse=True)))
    return plan


def best_fit_packing(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece and length, other columns ride along) with sequence_id and offset.

    Every piece gets one place; in each sequence places follow each other from 0 without gaps, up
    to ``capacity``. ``pieces`` is read twice, so it should be a stored table. Which of several
    pieces of one length takes which place follows doc_id and piece; of fully equal rows either
    may. An empty table gives an empty one. Null ids are pieces like others.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(16, total // RANKED_TOGETHER)
    mine = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = staged(mine.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one for each length
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for bins, held in plan_bins(counts, capacity):
        offset = 0
        for length, n in held:
            places.setdefault(length, []).append((used.get(length, 0), first_bin, n, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += length * n
        first_bin += bins
    table = {k: np.array(v, dtype=np.int64).T for k, v in places.items()}

    before = groups.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = mine.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))).join(before, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                starts, bins, per, at = table[int(x)]
                k = np.searchsorted(starts, rank[rows], side="right") - 1
                own = rank[rows] - starts[k]
                sequence[rows] = bins[k] + own // per[k]
                offset[rows] = at[k] + own % per[k] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut into pieces and packed; see ``token_pieces`` and ``best_fit_packing``."""
    pieces = token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids, id_col=id_col, text_col=text_col)
    return best_fit_packing(staged(pieces, "pieces"), capacity)
