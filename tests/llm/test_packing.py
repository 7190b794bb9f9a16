import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.packing import best_fit_packing, pack_documents, plan_bins, staged, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType()), T.StructField("piece", T.StringType())])
TEXTS = ["The cat's 42 hats, it's HERE.", None, "", "  \n\t ", "<|startoftext|> <|STARTOFTEXT|> a", "naïvé Ünïcode x y 日本語 'S", "word " * 900, "tail", "ends. (odd). a.'s b.,c, d., e. f,\ng", "cafe\u0301 \u0301x ﬁ Ǆ İstanbul ΣΑΣ ß \u200bz\u00a0w \x1cq \u3000日", "<|endoftext|>, <|ENDOFTEXT|>."]


def test_pieces_equal_whole_encoding(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (7, "tail", None, None)]
    got = token_pieces(spark.createDataFrame(rows, DOCS), PATH, 64, with_ids=True).collect()
    own = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, p, s, len(x := ids[s : s + 64]), zlib.crc32(np.array(x, "<u4").tobytes()), x) for p, s in enumerate(range(0, len(ids), 64))]
    assert Counter(map(repr, map(tuple, got))) == Counter(map(repr, want))


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_everything_and_fills(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 9), 64, 33]) for _ in range(rng.choice([0, 1, 7, 3000])))
    plan = plan_bins(counts, 64)
    used = Counter()
    for bins, held in plan:
        assert bins > 0 and sum(x * n for x, n in held) <= 64
        used.update({x: n * bins for x, n in held})
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    least = max(-(-total // 64), sum(n for x, n in counts.items() if x > 32))
    assert sum(bins for bins, _ in plan) <= least * 1.03 + 1


def test_first_bin_is_the_fullest_with_the_longest():
    assert plan_bins({60: 1, 50: 1, 40: 1, 30: 2}, 100)[0] == (1, [(60, 1), (40, 1)])
    with pytest.raises(ValueError):
        plan_bins({101: 1}, 100)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), f"{'a ' * rng.choice([0, 3, 3, 20, 700])}", None, None) for _ in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = pack_documents(docs, PATH, 128).collect()
    assert len(got) == token_pieces(docs, PATH, 128).count()
    assert check_packed(got, 128) <= -(-sum(r["length"] for r in got) // 128) * 1.05 + 1
    assert pack_documents(docs.limit(0), PATH).collect() == []
    assert best_fit_packing(staged(token_pieces(docs.limit(3), PATH, 128), "t"), 128).columns[-2:] == ["sequence_id", "offset"]
