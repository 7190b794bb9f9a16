"""Embeddings of chunks by a pluggable model."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a model gets at once.
BATCH = 64


class TooLong(ValueError):
    """A model can't take so long an input; fewer texts at once may do."""


class Embedder(ABC):
    """A model; it is sent to the tasks, so it must pickle."""

    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of finite numbers for each text."""


class HashingEmbedder(Embedder):
    """Words hashed to signed coordinates: the same for the same text everywhere; for tests and as a default."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
        return out


def embed_in_halves(model: Embedder, texts: list[str]) -> np.ndarray:
    """In order; a batch that is too long is halved, down to one text, whose error stands."""
    try:
        out = np.asarray(model.embed(texts), dtype=np.float32)
    except TooLong:
        if len(texts) == 1:
            raise
        half = len(texts) // 2
        return np.concatenate([embed_in_halves(model, texts[:half]), embed_in_halves(model, texts[half:])])
    if out.shape != (len(texts), model.dimension) or not np.isfinite(out).all():
        raise ValueError(f"a model must give {model.dimension} finite numbers for each text")
    return out


def with_embeddings(chunks: DataFrame, model: Embedder) -> DataFrame:
    """``chunks`` (source, path, line_start, line_end, text) with ``embedding`` of a heading that names the place, and the text."""
    heading = F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.concat(F.lit("Source: "), "source"), F.concat(F.lit("Lines: "), "line_start", F.lit("-"), "line_end"), F.lit(""), "text")

    @F.pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd

        own = texts.tolist()
        return pd.Series([x for i in range(0, len(own), BATCH) for x in embed_in_halves(model, own[i : i + BATCH])], dtype=object)

    return chunks.withColumn("embedding", embed(heading))
