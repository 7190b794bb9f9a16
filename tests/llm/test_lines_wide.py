import random

from test_lines import distance, normal
from tidemark.llm.lines import dedup_lines, far


def lost(spark, lines, **more):
    """Which of the lines, a document each, are dropped."""
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    return {r["doc_id"] for r in dedup_lines(docs, **more).collect() if r["dropped_lines"]}


def test_short_and_unspaced_lines(spark):
    chinese = "这是一个很长的句子里面没有任何空格所以整行只算一个词但是仍然应该比较"
    lines = ["All rights reserved", "all rights, reserved.", "same one", "other", "Same one", chinese, chinese[:-1] + "完", "--", "--"]
    assert lost(spark, lines) == set()
    assert lost(spark, lines, wide=True) == {1, 4, 6}


def test_recall(spark):
    """Of pairs with an edit similarity of 0.8: a word of n replaced, or typos in three of ten or in one of three."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    vocabulary = [word() for _ in range(3000)]
    least = {"10": 0.75, "20": 0.7, "50": 0.85, "typos": 0.35, "short": 0.75}
    lines, kinds = [], []
    for kind in least:
        for _ in range(100):
            w = [rng.choice(vocabulary) for _ in range({"typos": 10, "short": 3}.get(kind) or int(kind))]
            x = list(w)
            for i in rng.sample(range(len(w)), 3 if kind == "typos" else 1):
                x[i] = x[i][:-1] + "0" if kind in ("typos", "short") else rng.choice(vocabulary)
            lines += [" ".join(w), " ".join(x)]
            kinds += [kind, kind]
    true = {k: {i + 1 for i in range(0, len(lines), 2) if kinds[i] == k and 100 * distance(normal(lines[i]), normal(lines[i + 1])) <= 20 * max(len(lines[i]), len(lines[i + 1]))} for k in least}
    old, new = lost(spark, lines), lost(spark, lines, wide=True)
    share = lambda found: {k: len(true[k] & found) / len(true[k]) for k in least}
    print(share(old), share(new))
    assert new <= set.union(*true.values())
    assert all(share(new)[k] >= least[k] > share(old)[k] for k in least)


def test_far():
    rng = random.Random(2)
    for _ in range(300):
        x = "".join(rng.choice("abcd é日") for _ in range(rng.randrange(20, 70)))
        y = list(x)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(y))
            y[i : i + rng.randrange(2)] = rng.choice([[], ["b"], ["q", "a"]])
        assert not far(x, "".join(y), distance(x, "".join(y)))
    assert far("abcdefgh" * 9, "ijklmnop" * 9, 10)
