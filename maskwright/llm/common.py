"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; only where none is named and all runs on one
    machine (tests, a laptop) a local folder is made and set.  A cluster that names none
    is refused.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and held in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: smaller than a checkpoint."""
    at = shared_path(df.sparkSession, "table")
    df.write.parquet(at)
    out = df.sparkSession.read.parquet(at)
    _tables[id(out)] = at
    return out


_tables: dict[int, str] = {}


def release(df: DataFrame) -> None:
    """Deletes what :func:`table` wrote for ``df``, which nothing reads any more."""
    at = _tables.pop(id(df), None)
    if at:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """What this process has freed goes back to the system: Arrow's pool and, where the C library
    can, its heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the same rows.  Its worker gives back what it freed with each
    batch and at the end, as the next operator in the worker would come on top of it."""

    def each(batches):
        for batch in batches:
            yield batch
            give_back()

    def whole(batches):
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return whole


HOT = 10_000  # keys at most that are broadcast by keyed_join
SPREAD = 1024


def keyed_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row a key, or nulls (a left join).

    ``weight`` says how many rows a key has.  Fewer than HOT keys can have more than one
    row in HOT each; those are broadcast, and their rows are dealt by a hash of the column
    ``spread``, so no key's rows go to one task.  The rest joins by key.
    """
    facts = cut(facts)
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    large = F.col(weight) > max(1, total // HOT)
    values = [c for c in facts.columns if c not in keys]
    hot, cold = fresh(rows, "_hot"), fresh(rows, "_cold")
    part = fresh(rows, "_part")
    some = rows.join(F.broadcast(facts.where(large).select(*keys, F.struct(*values).alias(hot))), keys, "left")
    some = some.withColumn(part, F.when(F.col(hot).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SPREAD))).cast("long"))
    rest = facts.where(~large).select(*keys, F.lit(0).cast("long").alias(part), F.struct(*values).alias(cold))
    out = some.join(rest, [*keys, part], "left").withColumn(hot, F.coalesce(hot, cold))
    return out.select(*rows.columns, *[F.col(f"{hot}.{v}").alias(v) for v in values])


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
