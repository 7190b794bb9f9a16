"""Which true pairs the wide comparison finds, against their edit similarity alone: typos in many words, words replaced, in lines of any length."""

import random
import string

import numpy as np
import pytest

from tidemark.llm import lines as own
from tidemark.llm.decontamination import SEPARATORS
from tidemark.llm.kernels import byte_table, words

#: Words of a line, words changed, whether each gets a typo or is replaced, and the least share that is found.
ROWS = [
    (10, 5, True, 0.9), (20, 8, True, 0.9), (20, 12, True, 0.7), (40, 4, True, 0.9), (40, 8, True, 0.9), (40, 16, True, 0.9), (40, 24, True, 0.65), (100, 20, True, 0.9), (100, 40, True, 0.9),
    (3, 1, False, 0.9), (4, 1, False, 0.9), (5, 1, False, 0.9), (8, 1, False, 0.9), (10, 1, False, 0.9), (50, 8, False, 0.9), (100, 16, False, 0.9),
]


def told(texts):
    raw, table = [t.encode() for t in texts], byte_table(SEPARATORS)
    data, ends = np.frombuffer(b"\n".join(raw), dtype=np.uint8), np.cumsum([len(r) + 1 for r in raw]) - 1
    h, first, last, n = words(data, ends - np.array([len(r) for r in raw]), ends, table)
    blocks, size = own.wide_blocks(data, h, first, last, n, table[1])
    each = [{b[i : i + own.BLOCK_BYTES] for i in range(0, len(b), own.BLOCK_BYTES)} for b in blocks]
    return each, size, own.gram_simhashes(data, first, last, n, table[1])


@pytest.mark.parametrize("count, changed, typo, least", ROWS)
def test_share_found(count, changed, typo, least):
    rng, pairs = random.Random(count * 1000 + changed), []
    letters = string.ascii_lowercase
    while len(pairs) < 200:
        x = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(count)]
        y = list(x)
        for i in rng.sample(range(count), changed):
            at = rng.randrange(len(x[i]))
            y[i] = x[i][:at] + rng.choice(letters.replace(x[i][at], "")) + x[i][at + 1 :] if typo else "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
        pair = " ".join(x), " ".join(y)
        if own.similar(pair[0].encode(), pair[1].encode(), 80):
            pairs.append(pair)
    left, right = (told([p[side] for p in pairs]) for side in (0, 1))
    bits = np.bitwise_count(left[2].view(np.uint8) ^ right[2].view(np.uint8)).reshape(len(pairs), -1).sum(axis=1)
    close = (np.minimum(left[1], right[1]) < own.LONG_POINTS) | (bits <= own.WIDE_BITS)
    found = [bool(a & b) and c for a, b, c in zip(left[0], right[0], close)]
    assert np.mean(found) >= least
