"""Stretches of a text that repeat with a period, found on its suffix tree, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, short_batches

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts of a task are looked at together, up to so many words (one text, however long, at least), and so many leaves of their trees at once.
LOT_WORDS, LOT_LEAVES = 100_000, 1 << 21


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(starts of suffixes in order, ranks of all starts by their first 1, 2, 4, ... symbols); the ranks tell equal beginnings.

    By doubling: only suffixes that are not yet told apart are sorted again. ``symbols`` ends
    with one that occurs nowhere else, so all are told apart in the end.
    """
    order = np.argsort(symbols, kind="stable")
    first = np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]])
    rank, slots = np.empty(len(order), dtype=np.int64), np.arange(len(order))
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    ranks, h = [rank.astype(np.int32)], 1
    alone = first & np.concatenate([first[1:], [True]])
    slots = slots[~alone]
    while len(slots):
        starts = order[slots]
        key = rank[starts] * len(order) + rank[np.minimum(starts + h, len(order) - 1)]
        by = np.argsort(key, kind="stable")
        starts, key = starts[by], key[by]
        order[slots] = starts
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[starts] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        ranks.append(rank.astype(np.int32))
        slots, h = slots[~(first & np.concatenate([first[1:], [True]]))], 2 * h
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many symbols the suffix of each slot of ``order`` shares with the one before it; 0 for the first."""
    out, last = np.zeros(len(order), dtype=np.int64), len(order) - 1
    sets, slots = [], np.arange(1, len(order))
    for rank in ranks:
        slots = slots[rank[order[slots - 1]] == rank[order[slots]]]
        sets.append(slots)
    for t in reversed(range(len(ranks))):
        slots, rank = sets[t], ranks[t]
        a, b = order[slots - 1] + out[slots], order[slots] + out[slots]
        same = (np.maximum(a, b) <= last) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        out[slots[same]] += 1 << t
    return out


def inner_nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, first, last): the suffix tree's inner nodes, those with more than two children in steps of two.

    A node's leaves are the slots from ``first`` to ``last``, which share ``shared[slot]`` symbols,
    and no leaf before ``slot`` is in a child with one from ``slot`` on.
    """
    slots, n = np.flatnonzero(shared > 0), len(shared)
    wall = np.append(shared, 0)
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    after[-1] = n
    # Pointers jump over what shares more, until they meet what shares less; zeros stop all.
    todo = slots
    while len(todo := todo[wall[before[todo]] >= wall[todo]]):
        before[todo] = before[before[todo]]
    todo = slots
    while len(todo := todo[wall[after[todo]] > wall[todo]]):
        after[todo] = after[after[todo]]
    return slots, before[slots], after[slots] - 1


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every stretch of two equal halves that the symbol behind it doesn't continue.

    Two suffixes that start ``period`` apart meet in the node of just so many symbols, in different
    children. So for each node the leaves of the smaller part are looked up a period before and
    after: are these in the other part? Each leaf is in the smaller part of logarithmically many nodes.
    """
    order, ranks = suffix_order(symbols)
    shared = common_prefixes(order, ranks)
    place, n = ranks[-1], len(order)
    slot, first, last = inner_nodes(shared)
    left = slot - first <= last - slot + 1  # the part before the slot is the smaller one
    low, size = np.where(left, first, slot), np.where(left, slot - first, last - slot + 1)
    other_low, other_high = np.where(left, slot, first), np.where(left, last, slot - 1)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(size)
    cuts = np.searchsorted(ends, np.arange(LOT_LEAVES, (ends[-1] if len(ends) else 0) + LOT_LEAVES, LOT_LEAVES), side="right")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        which = np.repeat(np.arange(a, b), size[a:b])
        leaf = order[np.arange(len(which)) - np.repeat(ends[a:b] - size[a:b] - (ends[a - 1] if a else 0), size[a:b]) + low[which]]
        period = shared[slot[which]]
        for other, start in ((leaf + period, leaf), (leaf - period, leaf - period)):
            at = place[np.clip(other, 0, n - 1)]
            found = (other >= 0) & (other < n) & (at >= other_low[which]) & (at <= other_high[which])
            starts.append(start[found])
            periods.append(period[found])
    return np.concatenate(starts), np.concatenate(periods)


def _equal_before(symbols: np.ndarray, start: int, period: int) -> int:
    """How many symbols right before ``start`` equal those a period later."""
    at, step = start, 64
    while at > 0:
        low = max(0, at - step)
        other = np.flatnonzero(symbols[low:at] != symbols[low + period : at + period])
        if len(other):
            return start - (low + int(other[-1]) + 1)
        at, step = low, 2 * step
    return start


def maximal_runs(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``symbols``, by start, then period.

    A run is a stretch of ``least_words`` and ``least_periods`` (2 or more) times its smallest
    period, or longer, that no symbol beside it continues. Each one ends where a branching repeat
    of its period ends; turned back symbol by symbol that repeat gives all of the run. Repeats of
    multiples of the period end there too and give the same stretch: the smallest counts.
    """
    start, period = branching_repeats(symbols)
    need = np.maximum(least_words - 2 * period, (least_periods - 2) * period)
    for back in range(1, 9):  # most go here
        live = need < back
        inside = start >= back
        at = np.maximum(start - back, 0)
        keep = live | (inside & (symbols[at] == symbols[at + period]))
        start, period, need = start[keep], period[keep], need[keep]
    ends, out = start + 2 * period, {}
    for i in np.lexsort((period, ends)).tolist():
        s, p, end = int(start[i]), int(period[i]), int(ends[i])
        held = out.setdefault(end, [])
        if any(p % q == 0 and begin <= s for begin, q in held):
            continue
        begin = s - _equal_before(symbols, s, p)
        if end - begin >= max(least_words, least_periods * p):
            held.append((begin, p))
    return sorted((begin, end - begin, p) for end, held in out.items() for begin, p in held)


def _lots(batches) -> Iterator[tuple[object, list[list[bytes]]]]:
    """Ids and words of some texts at once."""
    import pyarrow as pa

    for batch in batches:
        held, first, words = [], 0, 0
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            own = text.split()  # at ASCII white space
            if held and words + len(own) > LOT_WORDS:
                yield batch.column(0).slice(first, len(held)), held
                held, first, words = [], i, 0
            held.append(own)
            words += len(own)
        if held:
            yield batch.column(0).slice(first, len(held)), held


def runs_of_texts(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text. One tree holds them all: words of different texts are different symbols."""
    import pyarrow as pa

    out = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if len(t) >= max(least_words, least_periods)]
    if not some:
        return out
    sizes = np.array([len(texts[i]) for i in some])
    words = pa.array([w for i in some for w in texts[i]], pa.large_binary()).dictionary_encode()
    text = np.repeat(np.arange(len(some)), sizes)
    symbols = np.append(text * len(words.dictionary) + words.indices.to_numpy(), len(some) * len(words.dictionary))
    begins = np.cumsum(sizes) - sizes
    for start, length, period in maximal_runs(symbols, least_words, least_periods):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[some[k]].append((start - int(begins[k]), length, period))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of all runs and in a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row: its id, runs (an array of start, length, period in words from 0, by start, then period) and collapsed, the text with each run cut to its first period.

    Words are what ASCII white space parts, taken as they are. A word that any run holds behind
    its first period goes; what stays is joined by single spaces, so white space is made uniform
    in texts without runs too. Null and empty texts have no runs and an empty ``collapsed``. Rows
    are taken one by one: repeated rows and null ids come back as they are. A text is looked at
    whole, in memory in proportion to its words (some 200 bytes each), in time a little more.
    """
    short_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
        for ids, texts in _lots(batches):
            found = runs_of_texts(texts, least_words, least_periods)
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in found], pa.list_(kind))
            collapsed = pa.array([without_repeats(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, runs, collapsed], names=["id", "runs", "collapsed"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_run(runs: str) -> F.Column:
    """The run of the greatest exact length / period, of equal ones the first; null without runs."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(F.col(runs), F.get(F.col(runs), F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def run_report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``find_runs``: its id, n_runs, the best run's start, length, period and exponent_milli (nulls without), runs_sha256, collapsed_sha256."""
    best = found.withColumn("best", best_run("runs"))
    line = lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
