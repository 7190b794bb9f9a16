"""The least cost over all segmentations, held against one that tries every segment."""

import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from test_secrets import COSTS
from tidemark.llm.secrets import DATE, YEAR, Ages, GuessCost, find_spans

SMALL = GuessCost({"banana": 5000, "dada": 40, "ab": 3, "abc": 7, "qwe": 90, "aaa": 11, "wonderful": 800})


def alone(costs, s):
    """What a segment costs by itself."""
    options = [sum(map(costs.brute, s))]
    if len(s) >= 3 and (w := costs.word(s)) is not None:
        options.append(w)
    if YEAR.fullmatch(s):
        options.append(math.log10(200))
    if DATE.fullmatch(s):
        options.append(math.log10(365 * 200 * 4))
    low = s.lower()
    if len(s) >= 3 and all(b in costs.near.get(a, ()) for a, b in zip(low, low[1:])):
        ways = [costs._way(a, b) for a, b in zip(low, low[1:])]
        options.append(math.log10(47 * len(s)) + math.log10(5) * (1 + sum(a != b for a, b in zip(ways, ways[1:]))))
    for p in range(1, len(s) // 2 + 1):
        if len(s) % p == 0 and s == s[:p] * (len(s) // p):
            unit = sum(map(costs.brute, s[:p]))
            if p > 2 and (w := costs.word(s[:p])) is not None:
                unit = min(unit, w)
            options.append(unit + math.log10(len(s) // p))
    return min(options)


def exhaustive(costs, s):
    best = [0.0]
    for j in range(1, len(s) + 1):
        best.append(min(best[i] + alone(costs, s[i:j]) for i in range(j)))
    return best[-1]


PARTS = ["a", "b", "q", "w", "e", "A", "Q", "1", "0", "é", "banana", "dada", "abc", "qwe", "1990", "1990-1-12", "31.12.2004", "asdfg", "poiuy", "aaaa", "ababab", "w0nderful", "zx", "!", "日"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9), st.integers(1, 4))
def test_all_kinds_of_segments(parts, times):
    s = ("".join(parts) * times)[:70]
    assert abs(SMALL.cost(s) - exhaustive(SMALL, s)) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aqws12", max_size=48))
def test_walks_and_repeats_of_few_keys(s):
    assert abs(SMALL.cost(s) - exhaustive(SMALL, s)) < 1e-9


def test_long_repeats_and_walks():
    rng = random.Random(1)
    for s in ("a" * 150, "dada" * 40, "banana" + "a" * 90, "ab" * 60 + "abc" * 20, "qwertyuiop" * 12, "as" * 70, "".join(rng.choice("aqz") for _ in range(150))):
        assert abs(SMALL.cost(s) - exhaustive(SMALL, s)) < 1e-9


@pytest.mark.parametrize("word", ["wonderful", "different", "something", "important"])
def test_a_word_said_three_times_is_no_secret(word):
    assert COSTS.cost(word * 3) <= COSTS.word(word) + math.log10(3) + 1e-9
    assert find_spans(f"pwd={word * 3}", COSTS)[1] == []


def test_known_costs():
    assert abs(SMALL.cost("banana" + "a" * 17) - (math.log10(5001) + math.log10(26 * 17))) < 1e-9
    assert SMALL.cost("abcdefghi" * 5) <= 9 * math.log10(26) + math.log10(5) + 1e-9


def test_long_values_take_seconds():
    rng = random.Random(2)
    for s in ("a" * 100_000, "".join(rng.choice("ab") for _ in range(100_000)), "asdfghjkl" * 11_000, "".join(map(chr, (rng.randrange(33, 127) for _ in range(100_000))))):
        began = time.time()
        SMALL.cost(s)
        assert time.time() - began < 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.floats(-2, 2)), min_size=1, max_size=30))
def test_ages_give_the_least(steps):
    ages, added, x = Ages(), [], 0
    for gap, g in steps:
        x += gap
        added.append((x - 1, g))
        ages.add(x - 1, g, x)
        assert abs(ages.least(x) - min(h + math.log10(x - at) for at, h in added)) < 1e-9
    for more in (1, 5, 50, 5000):
        assert abs(ages.least(x + more) - min(h + math.log10(x + more - at) for at, h in added)) < 1e-9
