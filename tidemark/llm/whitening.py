"""Whitening of embeddings: leading eigenvectors of their covariance by block Lanczos, which only ever multiplies the matrix with a few vectors."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import short_batches
from tidemark.llm.vectors import on_grid, usable

#: What is added to each entry of the grid.
SHIFT = 1_000_000
#: A residual counts as none below this share of the largest eigenvalue, and an eigenvalue too.
RESIDUAL, NO_VARIANCE = 1e-13, 1e-12
#: Vectors that the driver holds of a basis before it starts anew from the best, and products with the matrix at most.
MOST_BASIS, MOST_STEPS = 512, 200
#: Partial sums of all tasks are added up in so many tasks, and their sums by the driver.
ADDERS = 16


def _added(vectors: DataFrame, vector_col: str, part: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vectors the sum of ``part`` over blocks of them (rows of the grid); a row for each task leaves it, ADDERS rows reach the driver."""

    def sums(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            for _, values in usable(batch.column(0)):
                own, n = part(on_grid(values, SHIFT)), values.shape[1]
                total[n] = total[n] + own if n in total else own
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array([str(x.dtype) for x in total.values()], pa.string())], names=["width", "sums", "kind"])

    def add(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            for n, own, kind in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(own, dtype=kind)
                total[n] = total[n] + own if n in total else own
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array([str(x.dtype) for x in total.values()], pa.string())], names=["width", "sums", "kind"])

    schema, out = "width int, sums binary, kind string", {}
    for row in vectors.select(vectors[vector_col].cast("array<double>")).mapInArrow(sums, schema).repartition(ADDERS).mapInArrow(add, schema).collect():
        own = np.frombuffer(row["sums"], dtype=row["kind"])
        out[row["width"]] = out[row["width"]] + own if row["width"] in out else own
    return out


def _fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many unit vectors as ``block`` has columns, at right angles to ``basis`` and each other: its columns made so, each twice over.

    A column of which nothing is left (a breakdown: the basis holds all that the matrix makes of
    it) is replaced by a random vector, a restart from a direction not yet seen.
    """
    count = min(block.shape[1], len(basis) - basis.shape[1])
    held = basis
    for i in range(count):
        column = block[:, i]
        while True:
            size, left = np.linalg.norm(column), column
            for _ in range(2):
                left = left - held @ (held.T @ left)
            if size > 0 and np.linalg.norm(left) > 1e-10 * size:
                break
            column = rng.standard_normal(len(basis))
        left = left / np.linalg.norm(left)
        left -= held @ (held.T @ left)
        held = np.column_stack([held, left / np.linalg.norm(left)])
    return held[:, basis.shape[1] :]


def leading(times: Callable[[np.ndarray], np.ndarray], size: int, count: int, most_basis: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of ``size`` rows that ``times`` multiplies with a block.

    Block Lanczos from random vectors. A block is as wide as the number of eigenvectors, so all
    copies of an eigenvalue show up at once. The basis is kept at right angles in full, with its
    images, so residuals are exact and cost no product. It ends when all residuals are below
    RESIDUAL of the largest eigenvalue, or stand still just above, or when the basis spans all. A
    basis that would exceed ``most_basis`` vectors is cut back to its best.
    """
    rng, count = np.random.default_rng(0), min(count, size)
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    block, worst = rng.standard_normal((size, count)), []
    most_basis = min(size, max(most_basis, 4 * count))
    for _ in range(MOST_STEPS):
        block = _fresh(block, basis, rng)
        image = times(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = basis @ turn[:, :count]
        worst.append(np.linalg.norm(images @ turn[:, :count] - found * values[:count], axis=0).max() / max(values[0], np.finfo(float).tiny))
        still = len(worst) > 4 and worst[-1] < 1e-10 and worst[-1] > worst[-5] / 2
        if basis.shape[1] == size or worst[-1] <= RESIDUAL or still:
            return values[:count], found / np.linalg.norm(found, axis=0)
        block = image
        if basis.shape[1] + count > most_basis:
            block = _fresh(block, basis, rng)  # before the cut: what the basis as a whole leads to
            best = turn[:, : 2 * count]
            basis, images = basis @ best, images @ best
    raise RuntimeError(f"no convergence in {MOST_STEPS} steps; the last residual is {worst[-1]:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = 32, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, components numbered from 1 by falling eigenvalue.

    An entry c becomes x = floor(64 c) + 1,000,000. ``n`` vectors with sums S are the fit list: all
    of them. Components are unit eigenvectors of the covariance (divisor n) of the x; ``whitened``
    is x - S/n projected on one, over the root of its eigenvalue. ``deviation``, a decimal of 38
    digits, is the exact sum of (n x - S)^2, and ``explained`` the eigenvalue's share of the trace
    that deviations sum up to. ``identity_error`` is the largest entry by which the covariance of
    ``whitened`` differs from the identity.

    Vectors that are null or empty, or hold null or non-finite entries, take no part; null and
    repeated ids stay, repeated rows count as often as they occur. Directions without variance
    make no component, so of few rows or dimensions there are fewer, and of equal rows, one row
    or none there are none: no rows at all. Vectors of different lengths raise ValueError.

    Each product with the covariance is one pass: tasks centre their rows exactly, then multiply,
    and give sums of dimensions x components numbers. The driver holds some MOST_BASIS vectors.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    counted = _added(vectors, vector_col, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    if not counted:
        return none
    if len(counted) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(counted)[:5]}")
    n, sums = int(counted[size := next(iter(counted))][0]), counted[size][1:]

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return n * x - sums

    def squares(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[(centred(x).astype(np.float64) ** 2).sum()]])

    trace = float(_added(vectors, vector_col, squares)[size][0]) / n**3
    if trace == 0:
        return none

    def times(block: np.ndarray) -> np.ndarray:
        def product(x):
            y = centred(x) / n
            return (y.T @ (y @ block)).ravel()

        return _added(vectors, vector_col, product)[size].reshape(size, -1) / n

    values, axes = leading(times, size, components)
    values = values[values > NO_VARIANCE * values[0]]
    count, axes = len(values), axes[:, : len(values)]

    def projected(x: np.ndarray) -> np.ndarray:
        return (centred(x) / n) @ axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = projected(x)
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = _added(vectors, vector_col, moments)[size] / n
    mean, second = found[:count], found[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())

    def rows(batches):
        import pyarrow as pa

        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for own, entries in usable(batch.column(1)):
                x = on_grid(entries, SHIFT)
                y, many = centred(x), len(own) * count
                exact = y if (y.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62 else y.astype(object)
                deviation = pa.array([Decimal(int(d)) for d in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(own)), count))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(own))), pa.array(np.full(many, n)), deviation.take(each),
                     pa.array(projected(x).ravel()), pa.array(np.tile(values / trace, len(own))), pa.array(np.full(many, error))], names=names)

    return vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v")).mapInArrow(rows, schema).withColumnRenamed("id", id_col)
