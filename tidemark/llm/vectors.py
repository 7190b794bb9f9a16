"""Vectors as matrices of whole numbers: what whitening and search share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Steps of the grid in a unit: an entry c becomes floor(SCALE * c).
SCALE = 64
#: Whole numbers up to here are exact as doubles, and so are sums and products that stay below.
EXACT = 1 << 53


def usable(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as doubles) of an Arrow column of lists, once for each length that occurs: the rows whose list isn't null or empty and holds finite numbers only."""
    import pyarrow as pa
    import pyarrow.compute as pc

    width = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = np.asarray(pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (width > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    for n in np.unique(width[good]):
        rows = np.flatnonzero(good & (width == n))
        yield rows, flat[ends[rows][:, None] + np.arange(n)]


def on_grid(values: np.ndarray, shift: int = 0) -> np.ndarray:
    """floor(SCALE * c) + shift as longs; raises OverflowError for entries that no double holds to a whole number."""
    cells = np.floor(SCALE * values)
    if len(cells) and np.abs(cells).max() >= EXACT:
        raise OverflowError(f"entries must be below 2**53 / {SCALE}")
    return cells.astype(np.int64) + shift
