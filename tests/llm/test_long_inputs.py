"""Long and repetitive inputs take time in proportion to their length."""

import random
import time

import numpy as np
import public_tokenizers
from test_lines import distance

from tidemark.llm.kernels import byte_table, words
from tidemark.llm.decontamination import SEPARATORS, Items
from tidemark.llm.lines import near, similar
from tidemark.llm.secrets import GuessCost, find_spans, ranked_words


def test_cost_of_long_values():
    costs = GuessCost(ranked_words(public_tokenizers.path("word_bpe_49k.json")))
    began = time.time()
    for value in ("x" * 100_000, "qwerty" * 10_000, "1990-12-31" * 3000):
        assert costs.cost(value) > 0
    text = "pwd=" + "y" * 50_000 + " " + "a1b2c3d4e5f60718 pwd=z " * 3000
    assert len(find_spans(text, costs)[0]) == 3000
    assert time.time() - began < 60


def test_repeated_words_against_a_repetitive_item():
    items = Items([("1", "na " * 5000), ("2", "na na one"), (None, "x y")], 10, 6)
    raw = np.frombuffer(("na " * 300_000 + "na na one x y").encode(), np.uint8)
    h, _, _, n = words(raw, np.array([0]), np.array([len(raw)]), byte_table(SEPARATORS))
    began = time.time()
    spans, found = items.hits(h, np.array([0]), n, np.zeros(len(h), dtype=np.int64))[0]
    assert found == {0, 1, 2} and (0, 300_002) in spans and time.time() - began < 10


def test_words_in_common_prove_distances():
    rng = random.Random(3)
    proved = 0
    for _ in range(800):
        x = [rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randrange(5)) for _ in range(rng.randrange(1, 12))]
        y = list(x)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(y))
            y[i : i + rng.randrange(3)] = [rng.choice(["zz", "q", "ab1"])] * rng.randrange(3)
            y = y or ["k"]
        a, b = " ".join(x), " ".join(y)
        d = distance(a, b)
        assert d == 0 or not near(a, b, d - 1)
        proved += near(a, b, d)
        assert similar(a.encode(), b.encode(), 80) == (100 * d <= 20 * max(len(a), len(b)))
    assert proved > 300
