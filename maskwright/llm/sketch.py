"""Arrays of bounded size that all tasks add to: bucket counts and bit sets."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = 64


def _step(size: int) -> int:
    return -(-size // PARTS)


def encode(total: np.ndarray) -> list[tuple[int, bytes]]:
    """The parts of a task's counts, compressed."""
    step = _step(len(total))
    parts = ((i, total[i * step : (i + 1) * step]) for i in range(PARTS))
    return [(i, zlib.compress(x.tobytes(), 1)) for i, x in parts if x.any()]


def total(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counts: rows (part, counts) of :func:`encode`.  Parts of one
    number are added as they stream by."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
                held[i] = held[i] + got if i in held else got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["part", "counts"])

    out, step = np.zeros(size, np.int64), _step(size)
    for i, raw in parts.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        got = np.frombuffer(zlib.decompress(raw), np.int64)
        out[i * step : i * step + len(got)] += got
    return out


def summed(df: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """Counts of ``size`` buckets over all rows; ``buckets`` gives the bucket numbers of a
    batch, in arrays.  No task and not the driver hold more than ``size`` counts."""

    def count(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for b in buckets(batch):
                np.add.at(sums, b, 1)
        rows = encode(sums)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "counts"])

    return total(df.mapInArrow(count, "part int, counts binary"), size)
