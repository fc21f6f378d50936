"""Lists of numbers in Arrow batches, as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.ChunkedArray | pa.Array, most: float = np.inf, scale: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(scale * matrix) as int64) of the vectors of each length.

    A null vector, one with a null or non-finite entry, and one with an entry that gives ``most``
    or more in size are left out; so are vectors without entries.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.list_(pa.float64()))
    begins, ends = np.asarray(lists.offsets)[:-1].astype(np.int64), np.asarray(lists.offsets)[1:].astype(np.int64)
    values = np.asarray(lists.values.fill_null(float("nan")))
    size = np.where(np.asarray(lists.is_valid()), ends - begins, 0)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(scale * values[begins[at][:, None] + np.arange(n)])
            ok = (np.abs(x) < most).all(axis=1) & np.isfinite(x).all(axis=1)
        if ok.any():
            yield at[ok], x[ok].astype(np.int64)
