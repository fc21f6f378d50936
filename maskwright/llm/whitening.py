"""Embedding whitening by TSQR: the covariance is never formed."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrices

FAN = 8  # R factors that one task of the tree merges
SIZE = float(1 << 47)  # entries of a code that are counted exactly


def _codes(batch: pa.RecordBatch, scale: float, offset: int, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, x in matrices(batch.column("v"), SIZE, scale):
        if dims is None or x.shape[1] == dims:
            yield at, x + offset


class Frame:
    """The fit list's size and exact sums; centred rows and their exact deviation."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dims = n, len(sums)
        self.low = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]  # S = n * low + rest
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: what is subtracted first is a whole number, so nothing cancels."""
        return (x - self.low).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n*x - S)^2, in whole numbers of any size."""
        d, n, r = x - self.low, self.n, self.rest
        most, top = int(np.abs(d).max(initial=0)), max(r)
        a = (d * d).sum(axis=1) if most * most * self.dims < 1 << 62 else (d.astype(object) ** 2).sum(axis=1)
        b = d @ np.array(r, np.int64) if most * top * self.dims < 1 << 62 else d.astype(object) @ np.array(r, object)
        c = sum(x * x for x in r)
        return [n * n * int(p) - 2 * n * int(q) + c for p, q in zip(a, b, strict=True)]


def _sums(scale: float, offset: int):
    """Per partition, length and dimension: rows and sum, exact."""

    def run(batches):
        got: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, x in _codes(batch, scale, offset):
                for k in range(0, len(x), 8192):  # below 2**61 each
                    part = x[k : k + 8192].sum(axis=0).tolist()
                    n, s = got.get(x.shape[1], (0, [0] * x.shape[1]))
                    got[x.shape[1]] = n + len(x[k : k + 8192]), [p + q for p, q in zip(s, part, strict=True)]
        for dims, (n, s) in got.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))],
                names=["dims", "dim", "n", "s"],
            )

    return run


def _merge(a: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if a is None else np.vstack([a, rows]), mode="r")


def _factors(frame: Frame, scale: float, offset: int):
    """The R factor of a partition's centred rows."""

    def run(batches):
        r = None
        for batch in batches:
            for _, x in _codes(batch, scale, offset, frame.dims):
                for k in range(0, len(x), 8192):
                    r = _merge(r, frame.centred(x[k : k + 8192]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    return run


def _merged(dims: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = None
        for x in rows.sort_values("part")["r"]:
            r = _merge(r, np.asarray(x).reshape(-1, dims))
        return pd.DataFrame({"part": [key[0]], "r": [r.ravel()]})

    return run


class Model:
    """What whitens: the frame, axes (a component a column, over its deviation) and shares."""

    def __init__(self, frame: Frame, axes: np.ndarray, values: np.ndarray, total: float):
        self.frame, self.axes, self.values = frame, axes, values
        self.share = values / total if total else values
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.frame.centred(x) @ self.axes


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int | None = 8, scale: float = 1024.0, offset: int = 100_000) -> Model | None:
    """The whitening model of all vectors, or None if there are none.

    An entry c counts as the whole number floor(scale * c) + offset.  Sums of each dimension are
    exact, rows are centred by them, and each partition keeps the R factor of its rows: one
    d x d matrix, whatever it reads.  Factors are merged FAN at a time, over as many shuffles
    as it takes until one is left; its right singular vectors are the covariance's eigenvectors
    and its squared singular values over n the eigenvalues, without the squaring that forming
    the covariance would cost.  Only d sums, one d x d factor and k x k sums reach the driver.

    Null vectors, vectors without entries and those with a null or non-finite entry (or one of
    2**47 or more in size after scaling) take no part.  Where lengths differ, the commonest
    counts, the longest of equally common ones, and the others take no part.  Repeated rows
    count each.  Directions without variance have no component, so one row alone has none.
    """
    v = vectors.select(F.col(vec_col).alias("v"))
    found = v.mapInArrow(_sums(scale, offset), "dims int, dim int, n long, s decimal(38,0)").groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = found.where("dim = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims", "n").first()
    if best is None:
        return None
    rows = found.where(F.col("dims") == best["dims"]).collect()  # a row a dimension
    frame = Frame(int(best["n"]), [int(r["s"]) for r in sorted(rows, key=lambda r: r["dim"])])
    factors, left = v.mapInArrow(_factors(frame, scale, offset), "part long, r array<double>"), v.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        factors = factors.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(_merged(frame.dims), "part long, r array<double>")
    r = np.asarray(factors.first()["r"]).reshape(-1, frame.dims)
    _, s, right = np.linalg.svd(r, full_matrices=False)
    rank = int((s > s[0] * max(frame.dims, 16) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    k = min(rank, components) if components is not None else rank
    values = s * s / frame.n
    model = Model(frame, right[:k].T / np.sqrt(values[:k]), values[:k], float(values.sum()))

    def products(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for _, x in _codes(batch, scale, offset, frame.dims):
                w = model.whiten(x)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["i", "p"])

    if k:
        got = v.mapInArrow(products, "i int, p double").groupBy("i").agg(F.sum("p").alias("p")).orderBy("i").collect()  # k x k
        model.identity_error = float(np.abs(np.array([x["p"] for x in got]).reshape(k, k) / frame.n - np.eye(k)).max())
    return model


SCHEMA = "id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int | None = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """A row per vector and component, by the model that :func:`fit` makes of them all.

    ``deviation`` is null where it is no long; ``deviation_exact`` has it up to 38 digits.  A null
    id stays a null id, repeated ids give rows each, and other columns are not read.  Without
    vectors, or without variance, there are no rows.
    """
    spark = vectors.sparkSession
    schema = SCHEMA.replace("id long", f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}", 1)
    model = fit(vectors, vec_col, components, scale, offset)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k, share, error, n = len(model.values), model.share, model.identity_error, model.frame.n

    def run(batches):
        for batch in batches:
            for at, x in _codes(batch, scale, offset, model.frame.dims):
                w, dev, m = model.whiten(x), model.frame.deviation(x), len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(at[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array([d if d < 1 << 63 else None for d in dev], pa.int64()).take(pa.array(each)),
                        pa.array([Decimal(d) if d < 10**38 else None for d in dev], pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`whiten` over ``embeddings``, whose rules for nulls, other
    lengths, repeated rows and an empty table hold."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
