"""Pairs that sketches leave are confirmed by themselves: texts of a large bucket of strangers are not dealt out to tiles, whose rows grow with its square."""

import random
from collections import defaultdict

import numpy as np
import pytest

from test_lines import distance, normal
from tidemark.llm import links
from tidemark.llm.common import staged
from tidemark.llm.decontamination import SEPARATORS
from tidemark.llm.kernels import byte_table, words
from tidemark.llm.lines import bags, edits_proved


def bags_of(raw):
    ends = np.cumsum([len(x) for x in raw])
    data, starts, table = np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], byte_table(SEPARATORS)
    _, first, last, n = words(data, starts, ends, table)
    return bags(data, starts, first, last, n, table[0])


def test_bags_prove_no_more_than_the_edit_distance():
    rng = random.Random(3)
    for _ in range(60):
        x = "".join(rng.choice("abcXYZ 019é日𝄞") for _ in range(rng.randrange(1, 80))) + "e" * rng.randrange(30)
        y = list(x)
        for _ in range(rng.randrange(12)):
            i = rng.randrange(len(y))
            y[i : i + rng.randrange(2)] = rng.choice([[], ["b"], ["q", " "], ["é"]])
        pair = x + "k", "".join(y) + "k"
        both = bags_of([p.encode() for p in pair])
        assert edits_proved(both[:1], both[1:])[0] <= distance(*map(normal, pair))
    both = bags_of([b"All rights, reserved", b"ALL RIGHTS RESERVED", b"qwk vzx jjj"])
    assert edits_proved(both[[0, 0]], both[[1, 2]]).tolist() == [0, 19 - 3]  # two spaces and a v are in both
    assert not edits_proved(*(bags_of([x, b"\xff\xfe"])[:1] for x in (b"abc def", b"xyz")))  # not UTF-8: nothing is known


@pytest.mark.parametrize("side", [40, 4096])
def test_pairs_equal_brute_force_and_crowds_stay_in_their_buckets(spark, monkeypatch, side):
    monkeypatch.setattr(links, "SIDE", side)
    rng = random.Random(4)
    held = {b: rng.sample(range(2000), n) for b, n in enumerate([2, 3, 5, 8, 300, 120])}
    crowd = {*held[5]}  # all of these are plausible with each other
    size = {i: 5000 if i in crowd else rng.randrange(1, 400) for i in range(2000)}
    name = lambda i: i.to_bytes(16, "big")
    component = {i: name(i if i % 7 else 0) for i in range(2000)}
    rows = [(b, name(i), component[i], size[i], b"12345678") for b, own in held.items() for i in own]
    rest = staged(spark.createDataFrame(rows, "bucket long, node binary, component binary, size long, sketch binary"), "rest")
    got = links.partner_pairs(rest, lambda left, right, n, m: n == m).collect()
    want = {(name(min(x, y)), name(max(x, y))) for b in range(5) for x in held[b] for y in held[b] if x != y and size[x] == size[y] and component[x] != component[y]}
    left = defaultdict(set)
    for r in got:
        if r["other"] is None:
            left[r["bucket"]].add(bytes(r["node"]))
    pairs = {(bytes(r["node"]), bytes(r["other"])) for r in got if r["other"] is not None}
    assert want and want <= pairs and len(pairs - want) <= links.LISTED * 4 * len(crowd)
    assert left[5] == {name(i) for i in crowd} and [*left] == [5]


def test_texts_of_strangers_are_not_dealt_out(spark, monkeypatch):
    """One bucket of 900 nodes, three pairs of which are plausible: of tiles it would take 4 * 4, each with their texts."""
    monkeypatch.setattr(links, "tiles", lambda *_: pytest.fail("tiles of texts"))
    nodes = [(i.to_bytes(16, "big"), b"12345678", 10 * i) for i in range(1, 901)]
    nodes += [((1000 + i).to_bytes(16, "big"), b"12345678", 10 * i) for i in (5, 6, 7)]
    frame = staged(spark.createDataFrame(nodes, "node binary, sketch binary, size long"), "nodes")
    same = lambda left, right, n, m: n == m
    read = []
    like = links.Likeness(lambda *x: same(*x) * 1.0, same, lambda x, y: abs(int.from_bytes(x, "big") - int.from_bytes(y, "big")) == 1000, 1, clusters=False)
    fulls = lambda ends: read.append(ends.count()) or staged(ends.withColumn("full", ends.node), "fulls")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["component"], "big") for r in links.bucket_components(frame, links.F.array(links.F.lit(1).cast("long")), like, fulls).collect()}
    assert got == {5: 5, 6: 6, 7: 7, 1005: 5, 1006: 6, 1007: 7} and read == [0, 6]
