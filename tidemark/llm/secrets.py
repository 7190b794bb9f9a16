"""Secret scans: three kinds of patterns, and values in credential context by what guessing them would cost.

The cost of a value is the least, over all its segmentations into dictionary words, dates,
repeats, keyboard walks and brute-force spans, of the sum of the segments' costs, as a power of
ten of guesses. A placeholder or a word is cheap; a value that only brute force explains is a
secret, however short it is.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.kernels import chunks
from tidemark.llm.periods import maximal_runs

#: Values from 10 to this power of guesses on are secrets.
SECRET = 8.0

#: The patterns of the base kinds, with the least length of the group that counts.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
KINDS = [*BASE, "guess"]
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?)["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"'<>(){},;]+))""", re.ASCII | re.IGNORECASE)
#: One of these, in lower case, is in every text that an assign or context pattern matches.
SIGNS = (b"pass", b"pwd", b"secret", b"token", b"api_key", b"api-key", b"apikey", b"credential")
#: Rows of a keyboard, each key's neighbours to the right in its row and below it.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
LEET = str.maketrans("4@8360!157$2", "aabegoilstsz")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:3[01]|[12]\d|0?[1-9])\2(?:19|20)\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")
LONGEST_DATE = 10


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c + 1), (r + 1, c), (r + 1, c - 1)):
                if rr < len(ROWS) and 0 <= cc < len(ROWS[rr]):
                    near.setdefault(key, set()).add(ROWS[rr][cc])
                    near.setdefault(ROWS[rr][cc], set()).add(key)
    return near


def ranked_words(vocabulary_path: str) -> dict[str, int]:
    """Ranks, from 1, of the whole words of three letters or more in a tokenizer's vocabulary file: its order is by frequency."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (x.removesuffix("</w>") for x, _ in sorted(vocabulary.items(), key=lambda e: e[1]) if x.endswith("</w>"))
    return {x: i for i, x in enumerate((x for x in words if len(x) >= 3 and x.isascii() and x.isalpha()), 1)}


class Ages:
    """The least of g + log10(x - at) over the (at, g) that were added, for growing x.

    Beside a younger one an older one only gains as x grows, as the logarithm rises less and less.
    So of two the older one wins from some x on, which is known at once; those that can still win
    are kept, the oldest first, with the x up to which each stays ahead of the one before it.
    """

    def __init__(self):
        self.held: list[tuple[int, float, float]] = []

    def add(self, at: int, g: float, x: int) -> None:
        """``x``, not before any asked for so far, is the first for which it counts."""
        held = self.held
        while held and held[-1][2] <= x:
            held.pop()
        if held and held[-1][1] + math.log10(x - held[-1][0]) <= g + math.log10(x - at):
            return
        until = math.inf
        while held:
            ratio = 10 ** min(g - held[-1][1], 300.0)  # the older one is ahead once (x - its at) / (x - at) is less
            until = (ratio * at - held[-1][0]) / (ratio - 1) if ratio > 1 else math.inf
            if until < held[-1][2]:
                break
            held.pop()
            until = math.inf
        held.append((at, g, until))

    def least(self, x: int) -> float:
        held = self.held
        while held[-1][2] <= x:
            held.pop()
        return held[-1][1] + math.log10(x - held[-1][0])


class GuessCost:
    """Costs of values by ranked words, {word: rank}."""

    def __init__(self, words: dict[str, int]):
        self.words, self.near = words, _neighbours()
        self.endings = {x[-3:] for x in words}
        self.longest = max(map(len, words), default=0)

    @staticmethod
    def brute(c: str) -> float:
        return math.log10(10 if c.isdigit() and c.isascii() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)

    def word(self, s: str) -> float | None:
        low = s.lower()
        rank, extra = self.words.get(low), 0.0
        if rank is None and (plain := low.translate(LEET)) != low:
            rank = self.words.get(plain)
            extra = math.log10(2) * sum(a != b for a, b in zip(low, plain))
        if rank is None:
            return None
        upper = sum(c.isupper() for c in s)
        if upper:
            extra += math.log10(2) if upper == len(s) or (upper == 1 and s[0].isupper()) else math.log10(sum(math.comb(len(s), k) for k in range(1, upper + 1)))
        return math.log10(rank + 1) + extra

    def cost(self, s: str) -> float:
        """log10 of the guesses: the least sum over all segmentations, by dynamic programming over the ends of segments.

        A segment costs the least of what it is: brute force; a word, as long as any is; a date or
        year; a walk of three keys or more, by its length and turns; a block said twice or more, at
        its own cost, by brute force or as a word, and the number of times. Walks and repeats that
        end at a place are as many as they are long, but only the cost of their length changes,
        and that slower and slower: ``Ages`` keeps the few that can be the least. Blocks are those
        of the value's runs, and those words that are themselves repeats. So time grows little
        faster than the length.
        """
        n = len(s)
        best = [0.0] + [math.inf] * n
        low, bare = s.lower(), [self.brute(c) for c in s]
        plain, sums = low.translate(LEET), [0.0, *accumulate(bare)]
        turns, walks, walked = [0] * (n + 1), Ages(), 0  # turns of the walk that ends here, how many steps it has
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if s[i] in "0123456789":
                for end in range(i + 6, min(n, i + LONGEST_DATE) + 1):
                    if DATE.fullmatch(s, i, end):
                        dates.setdefault(end, []).append(i)
        repeats = self._repeats(s)
        live: list[tuple[int, int, list, list]] = []  # end, period, and for each place in the period its cost and ages
        for j in range(1, n + 1):
            c = low[j - 1]
            top = best[j - 1] + bare[j - 1]
            if j > 1 and c in self.near.get(low[j - 2], ()):
                walked += 1
                if walked == 1:
                    turns[j], walks = 0, Ages()
                else:
                    turns[j] = turns[j - 1] + (self._way(low[j - 3], low[j - 2]) != self._way(low[j - 2], c))
                    walks.add(j - 3, best[j - 3] - math.log10(5) * turns[j - 1], j)
                    top = min(top, walks.least(j) + math.log10(47) + math.log10(5) * (turns[j] + 1))
            else:
                walked = 0
            if plain[j - 3 : j] in self.endings or low[j - 3 : j] in self.endings:
                for i in range(max(0, j - self.longest), j - 2):
                    if (w := self.word(s[i:j])) is not None:
                        top = min(top, best[i] + w)
            if j >= 4 and YEAR.fullmatch(s, j - 4, j):
                top = min(top, best[j - 4] + math.log10(200))
            for i in dates.get(j, ()):
                top = min(top, best[i] + math.log10(365 * 200 * 4))
            for end, period in repeats.get(j, ()):
                live.append((end, period, [None] * period, [None] * period))
            if live:
                live = [x for x in live if x[0] >= j]
                for _, period, costs, ages in live:
                    at = j % period
                    if ages[at] is None:
                        block = s[j - period : j]
                        whole, word = sums[j] - sums[j - period], self.word(block) if period > 2 else None
                        costs[at], ages[at] = whole if word is None else min(whole, word), Ages()
                    ages[at].add(j - 2 * period, best[j - 2 * period], j)
                    top = min(top, ages[at].least(j) - math.log10(period) + costs[at])
            best[j] = top
        return best[n]

    def _repeats(self, s: str) -> dict[int, list[tuple[int, int]]]:
        """{first end: (last end, period)} of stretches whose every block of ``period`` characters is said again: runs, and their multiples that may be words."""
        out: dict[int, list[tuple[int, int]]] = {}
        symbols = np.append(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64), -1)
        for start, length, period in maximal_runs(symbols, 2, 2):
            more = (p for p in range(2 * period, min(self.longest, length // 2) + 1, period) if any(self.word(s[start + r : start + r + p]) is not None for r in range(period)))
            for p in (period, *more):
                out.setdefault(start + 2 * p, []).append((start + length, p))
        return out

    @staticmethod
    def _way(a: str, b: str) -> tuple[int, int]:
        return PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]


def find_spans(text: str, costs: GuessCost, secret: float = SECRET) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans (kind, start, end) by start, then kind; and added ones with their costs: context values that cost enough and lie in no base span."""
    base = [(kind, *m.span()) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if len(m[group]) >= least]
    base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    begins, ends, added = [x[1] for x in base], [0, *accumulate((x[2] for x in base), max)], []
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        if ends[bisect_right(begins, start)] < end and (cost := costs.cost(m[group])) >= secret:
            added.append(("guess", start, end, cost))
    return base, added


def suspects(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the texts that lie side by side in ``data`` may hold a span of any kind; the others hold none."""
    out = np.zeros(len(starts), dtype=bool)
    raw = data.tobytes()
    low = raw.lower()
    for where, sign in ((raw, b"AKIA"), *((low, x) for x in SIGNS)):
        at = where.find(sign)
        while at >= 0:
            i = int(np.searchsorted(ends, at, side="right"))
            out[i] = True
            at = where.find(sign, int(ends[i]))
    digit = ((data - np.uint8(48)) < 10) | ((data - np.uint8(97)) < 6)
    for step in (1, 2, 4, 8):  # then true where 16 in a row begin
        digit[:-step] &= digit[step:]
        digit[max(0, len(digit) - step) :] = False
    out[np.searchsorted(ends, np.flatnonzero(digit), side="right")] = True
    return out


def scan_secrets(docs: DataFrame, vocabulary_path: str, *, secret: float = SECRET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, and max_cost (null without added spans).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, joined by
    commas; the digest is of the base ones alone. Null and empty texts have none. Rows are taken
    one by one, so repeated rows and null ids give rows like others. Whole texts are scanned; one
    without any sign of a span is passed over. The vocabulary file must be on every machine.
    """

    def scan(batches):
        import hashlib

        import pyarrow as pa

        costs = GuessCost(ranked_words(vocabulary_path))
        nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, None)
        for batch in batches:
            rows = [nothing] * len(batch)
            for row, data, starts, ends in chunks(batch.column(1)):
                for i in np.flatnonzero(suspects(data, starts, ends)):
                    base, added = find_spans(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"), costs, secret)
                    n = [sum(x[0] == kind for x in base) for kind in BASE]
                    named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                    spans = sorted([*base, *(x[:3] for x in added)], key=lambda x: (x[1], KINDS.index(x[0])))
                    rows[row + i] = (*n, hashlib.sha256(named.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), len(added), max((x[3] for x in added), default=None))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_cost"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_cost double")
    return out.withColumnRenamed("id", id_col)
