"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are scaled by their means and deviations over all documents. Cosines of
random projections of them approximate a Gaussian kernel; the normal equations of a ridge
regression on these are sums over rows, so each partition sums its own. Scores of rows that
their own fold's model has not seen are calibrated by isotonic regression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged
from tidemark.llm.kernels import byte_table, chunks, randoms, words
from tidemark.llm.lines import line_bounds, line_names

#: Labelled rows that a fit uses at most, about; of more, those with the least hashes of their ids.
SAMPLE_ROWS = 300_000
#: Random features, width of the kernel in units of the square root of the number of statistics, and ridge penalty a row.
FEATURES, WIDTH, PENALTY = 384, 0.6, 1e-4
#: Steps of a score that calibration tells apart.
BINS = 500

CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "stop": b".,;:", "call": b"!?", "quote": b"'\"()-", "table": b"|<>{}[]\\/=_", "sign": b"#$%&*@+^~`", "other": range(128, 256)}
STATISTICS = [*CLASSES, "length", "words", "word_length", "word_spread", "short_words", "long_words", "repeats", "repeats_2", "unique_words", "top_word", "lines", "line_length", "short_lines", "unique_lines", "full_lines", "pairs"]


def statistics(texts) -> np.ndarray:
    """A row of STATISTICS for each text of an Arrow column; null and empty texts have zeros."""
    kind = np.full(256, len(CLASSES), dtype=np.int64)
    for i, own in enumerate(CLASSES.values()):
        kind[list(own)] = i
    table = byte_table(b"\t\n\x0b\x0c\r ")
    out = []
    for _, data, starts, ends in chunks(texts):
        rows, size = len(starts), ends - starts
        counts = np.bincount(np.repeat(np.arange(rows) * 16, size) + kind[data], minlength=rows * 16).reshape(rows, 16)[:, : len(CLASSES)]
        begin, end, text = line_bounds(data, starts, ends)
        h, first, last, in_line = words(data, begin, end, table)
        n = np.bincount(text, weights=in_line, minlength=rows)
        doc = np.repeat(text, in_line)
        long = (last - first).astype(np.float64)
        total = lambda x: np.bincount(doc, weights=x, minlength=rows) / np.maximum(n, 1)
        mean = total(long)
        spread = np.sqrt(np.maximum(total(long**2) - mean**2, 0))
        again = lambda k: np.bincount(doc[k:], weights=(h[k:] == h[: len(h) - k]) & (doc[k:] == doc[: len(h) - k]), minlength=rows) / np.maximum(n, 1)
        names = line_names(h, in_line)[:, 0]
        full = in_line > 0
        lines = np.bincount(text[full], minlength=rows)
        per_line = lambda x: np.bincount(text[full], weights=x[full], minlength=rows) / np.maximum(lines, 1)
        ended = np.isin(data[np.maximum(end - 1, 0)], np.frombuffer(b".!?|", np.uint8)) if len(data) else full
        unique, top, pairs, same_lines = (np.zeros(rows) for _ in range(4))
        at, line_at = np.concatenate([[0], np.cumsum(n)]).astype(int), np.concatenate([[0], np.cumsum(lines)])
        named = names[full]
        for i in range(rows):
            own = h[at[i] : at[i + 1]]
            if len(own):
                runs = np.diff(np.concatenate([[-1], np.flatnonzero(np.diff(np.sort(own))), [len(own) - 1]]))
                unique[i], top[i] = len(runs) / len(own), runs.max() / len(own)
                pairs[i] = len(np.unique(own[1:] * np.uint64(31) + own[:-1])) / max(1, len(own) - 1)
                same_lines[i] = len(np.unique(named[line_at[i] : line_at[i + 1]])) / lines[i]
        columns = [*(counts / np.maximum(size, 1)[:, None]).T, np.log1p(size), np.log1p(n), mean, spread, total(long <= 3), total(long >= 14), again(1), again(2), unique, top, np.log1p(lines), np.log1p(per_line((end - begin).astype(float))), per_line(in_line <= 3), same_lines, per_line(ended), pairs]
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, x: array<double> of STATISTICS) of each row, and its own columns as c0, c1 ... if they are to be carried."""
    kept = docs.columns if carry else []

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            x = statistics(batch.column(1))
            at = np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32)
            x = pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, *batch.columns[2:]], names=["id", "x", *batch.schema.names[2:]])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    schema = T.StructType(schema.fields + [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)])
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(kept)])
    return own.mapInArrow(measure, schema)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing means nearest to total / n along sorted x (pool adjacent violators): places and values to interpolate."""
    blocks: list[list[float]] = []
    for place, t, k in zip(x, total, n):
        blocks.append([place * k, t, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Scaling, random features, ridge weights and calibration. Small, of fixed size; it goes to the tasks whole."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 5):
        d = len(mean)
        u = (randoms(2 * d * FEATURES + FEATURES, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 1e-17
        normal = np.sqrt(-2 * np.log(u[: d * FEATURES])) * np.cos(2 * math.pi * u[d * FEATURES : 2 * d * FEATURES])
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.project = normal.reshape(d, FEATURES) / (WIDTH * math.sqrt(d))
        self.phase = 2 * math.pi * u[2 * d * FEATURES :]
        self.weights: list[np.ndarray] = []  # of all rows, then of all but each fold
        self.places, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -4, 4)
        return np.hstack([np.cos(z @ self.project + self.phase) * math.sqrt(2 / FEATURES), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray, which: int = 0) -> np.ndarray:
        return self.features(x) @ self.weights[which]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; nondecreasing in the ridge score."""
        return np.clip(np.interp(self.raw(x), self.places, self.values), 0.0, 1.0)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, fold: F.Column, *, label_id: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``stats`` (id, x) of all documents and ``labels``; ``fold`` is 0 or 1, or null for rows that must not be learnt from, by the column ``id``.

    Of several labels of an id their mean counts; null labels and ids don't. Without any labelled
    row, or with one class alone, all scores are the mean label (half, if there is none).
    """
    scale = stats.select(*[F.avg(F.col("x")[i]) for i in range(len(STATISTICS))], *[F.stddev_pop(F.col("x")[i]) for i in range(len(STATISTICS))]).first()
    scale = np.array([0.0 if v is None else v for v in scale])
    model = Model(scale[: len(STATISTICS)], scale[len(STATISTICS) :])
    known = labels.select(labels[label_id].alias("id"), labels[label_col].cast("double").alias("y")).where("y IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.avg("y").alias("y")).withColumn("fold", fold).where("fold IS NOT NULL")
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 20) * sample_rows / total)
    # Of ``known`` there are about ``sample_rows`` at most, so it goes to the statistics, which stay where they are.
    rows = staged(stats.join(F.broadcast(known), "id").select("x", "y", "fold").repartition(32), "training")
    size = FEATURES + len(STATISTICS) + 1

    def sums(batches):
        import pyarrow as pa

        a = np.zeros((2, size, size + 2))
        for batch in batches:
            x, y, folds = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in (0, 1):
                for i in range(0, len(y), 4096):
                    own = folds[i : i + 4096] == k
                    z, t = model.features(x[i : i + 4096][own]), y[i : i + 4096][own]
                    a[k] += z.T @ np.column_stack([z, t, np.ones(len(t))])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], names=["a"])

    a = np.zeros((2, size, size + 2))
    for row in rows.mapInArrow(sums, "a binary").toLocalIterator():  # 32 at most, of fixed size
        a += np.frombuffer(bytes(row["a"])).reshape(a.shape)
    for part in (a.sum(axis=0), a[1], a[0]):
        n = max(1.0, part[-1, -1])
        penalty = PENALTY * n * np.eye(size)
        penalty[-1, -1] = 1e-9
        model.weights.append(np.linalg.solve(part[:, :size] + penalty, part[:, size]))

    def unseen(batches):
        import pyarrow as pa

        for batch in batches:
            x, y, folds = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            s = np.where(folds == 0, model.raw(x, 1), model.raw(x, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(s, -1, 2) * BINS).astype(np.int64)), pa.array(y)], names=["bin", "y"])

    bins = rows.mapInArrow(unseen, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # 3 * BINS + 1 at most
    if bins:
        model.places, model.values = isotonic(*(np.array([r[k] for r in bins], dtype=float) for k in ("bin", "y", "n")))
        model.places = model.places / BINS
    else:
        model.places, model.values = np.array([0.0]), np.array([0.5])
    return model


def crc_fold(i: F.Column, held: int = 1) -> F.Column:
    """Fold 0 or 1 by the CRC-32 of the id as text, modulo 3; null where the remainder is ``held``, and for a null id."""
    r = F.crc32(i.cast("string").cast("binary")) % 3
    return F.when(r != held, F.when(r == (held + 1) % 3, 0).otherwise(1)).cast("int")


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: its id, held_out (the CRC-32 of the id, modulo 3, is 1; such rows teach nothing), score, predicted (score >= 0.5).

    Only statistics of the text enter a score. Null texts are scored as empty; repeated rows alike;
    a row with a null id is scored and not held out.
    """
    stats = staged(with_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    model = fit(stats, labels, crc_fold(F.col("id")), label_id=id_col, label_col=label_col, sample_rows=sample_rows)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))) if len(batch) else np.zeros(0))], names=["id", "score"])

    scored = stats.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` predicts good, all columns. Texts are measured once: rows are stored with their statistics."""
    stats = staged(with_statistics(docs, id_col=id_col, text_col=text_col, carry=True), "statistics")
    model = fit(stats, labels, crc_fold(F.col("id")), label_id=id_col, label_col=label_col)

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(model.score(np.stack(x)) if len(x) else [], dtype=float)

    return stats.where(score("x") >= 0.5).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
