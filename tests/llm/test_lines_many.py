"""Edit distances of one line and several at once, and pairs that a tile looks at."""

import random

from tidemark.llm.lines import similar, similar_many, within_many
from tidemark.llm.links import Likeness, _joined


def distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def test_within_many_is_the_edit_distance():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab cé😀") for _ in range(n))
    for _ in range(400):
        x = some(rng.randint(0, 60))
        ys = [some(rng.randint(0, 60)) if rng.random() < 0.4 else "".join(c if rng.random() > 0.15 else some(1) for c in x) for _ in range(rng.randint(1, 8))]
        most = [rng.randint(0, 30) for _ in ys]
        assert within_many(x, ys, most, look=rng.choice([1, 7, 64])) == [distance(x, y) <= m for y, m in zip(ys, most)]


def test_similar_many_equals_similar_also_of_long_lines():
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 999)}" for _ in range(700)]
    lines = [" ".join(w if rng.random() > r else f"v{rng.randint(0, 999)}" for w in base[:k]).encode() for k in (0, 5, 80, 700) for r in (0, 0.1, 0.3, 0.6)]
    for x in lines:
        assert similar_many(x, lines, 80) == [similar(x, y, 80) for y in lines]
    assert similar_many(b"a", [], 80) == []


def test_a_tile_confirms_a_pair_once():
    asked = []

    def confirm(x: bytes, y: bytes) -> bool:
        asked.append(frozenset((x, y)))
        return False

    ones = lambda a, b, n, m: (n > 0).astype(float)
    like = Likeness(ones, lambda *x: ones(*x) > 0, confirm, 1, clusters=False)
    nodes = [bytes([i]) * 16 for i in range(1, 7)]  # 1 and 2 make the major component
    component = {x: nodes[0] if i < 2 else x for i, x in enumerate(nodes)}
    rows = []
    for left in (True, False):
        for x in nodes:
            minor = component[x] != nodes[0]
            if minor or not left:
                buckets = [1, 9] if x in nodes[4:] else [9]  # the last two also share a lower bucket
                rows.append({"bucket": 9, "left": left, "minor": minor, "node": x, "component": component[x], "size": 5, "sketch": b"12345678", "full": x, "buckets": buckets})
    assert list(_joined(rows, like, True)) == []
    pairs = {frozenset((x, y)) for x in nodes for y in nodes if component[x] != component[y]} - {frozenset(nodes[4:])}
    assert len(asked) == len(set(asked)) and set(asked) == pairs
