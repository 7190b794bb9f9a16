"""What a worker remembers of words."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_frequent_words_stay_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    words, own, asked = packing.WordTokens(PATH), Tokenizer.from_file(PATH), []
    encode = words._encode
    words._encode = lambda new: asked.extend(new) or encode(new)
    for i in range(30):
        texts = ["the cat. ate of it " * 3 + " ".join(f"word{chr(97 + i % 26)}x{chr(97 + j)}yz{i}" for j in range(20)), "", f"<|endoftext|> Tail{i}, the."]
        raw = [x.encode() for x in texts]
        ends = np.cumsum([len(x) for x in raw])
        ids, sizes = words.ids(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(x) for x in raw], ends)
        want = [own.encode(x, add_special_tokens=False).ids for x in texts]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert len(words.words) < 200 and words.held < 40_000
    assert [asked.count(x) for x in ("the", "cat", "ate", "of")] == [1, 1, 1, 1]
