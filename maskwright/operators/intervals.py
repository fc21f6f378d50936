"""Spans that arrive as rows: overlap joins by bins, and what keeps clear of others.

Within one record's arrays :mod:`resolve` does this by folds.  Here spans are tables, from several
engines or runs, and a record may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fresh

BIN = 64


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def meeting(left: DataFrame, right: DataFrame, key: str, width: int = BIN, within: bool = False) -> DataFrame:
    """``left`` rows, distinct, that overlap a span of ``right`` with the same ``key`` (``within``: that
    lie in one).  Columns ``start`` and ``end``, end exclusive.

    Both sides are put into the bins of ``width`` that they touch and joined on (key, bin), so a
    record with very many spans is dealt over its bins, and pairs are tried only within a bin.
    An empty span (start = end) overlaps the span that it is strictly inside of, or lies within one
    at its edge too.  Null keys and places meet nothing.  Rows that repeat are one.
    """
    own, k, a, z, b = (fresh(left, n) for n in ("_bin", "_k", "_s", "_e", "_b"))
    spans = right.select(F.col(key).alias(k), F.col("start").alias(a), F.col("end").alias(z)).where(F.col(a).isNotNull() & F.col(z).isNotNull()).distinct()
    spans = spans.select("*", F.explode(_bins(F.col(a), F.col(z), width)).alias(b))
    mine = left.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("*", F.explode(_bins(F.col("start"), F.col("end"), width)).alias(own))
    test = (F.col(a) <= F.col("start")) & (F.col("end") <= F.col(z)) if within else (F.col("start") < F.col(z)) & (F.col(a) < F.col("end"))
    return mine.join(spans, (F.col(f"`{key}`") == F.col(k)) & (F.col(own) == F.col(b)) & test, "left_semi").drop(own).distinct()


def clear_of(left: DataFrame, right: DataFrame, key: str, width: int = BIN, within: bool = False, longest: int | None = None) -> DataFrame:
    """``left`` without the rows that :func:`meeting` gives; rows that repeat stay as often.

    With ``longest``, which no span of ``left`` exceeds (one that does raises), ``left`` is made and moved
    once: it has the one bin of its start, and ``right`` all bins in which what meets it may start.
    """
    if longest is not None:
        own, k, a, z, b = (fresh(left, n) for n in ("_bin", "_k", "_s", "_e", "_b"))
        spans = right.select(F.col(key).alias(k), F.col("start").alias(a), F.col("end").alias(z)).where(F.col(a).isNotNull() & F.col(z).isNotNull()).distinct()
        first, last = F.floor((F.col(a) - longest) / width), F.floor(F.greatest(F.col(z), F.col(a)) / width)
        spans = spans.select("*", F.explode(F.sequence(first, last)).alias(b))
        much = F.col("end") - F.col("start") > longest
        mine = left.withColumn(own, F.when(much, F.raise_error(F.lit(f"a span is longer than {longest}")).cast("long")).otherwise(F.floor(F.col("start") / width)))
        test = (F.col(a) <= F.col("start")) & (F.col("end") <= F.col(z)) if within else (F.col("start") < F.col(z)) & (F.col(a) < F.col("end"))
        return mine.join(spans, (F.col(f"`{key}`") == F.col(k)) & (F.col(own) == F.col(b)) & test, "left_anti").drop(own)
    k, a, z = (fresh(left, n) for n in ("_k", "_s", "_e"))
    gone = meeting(left, right, key, width, within).select(F.col(key).alias(k), F.col("start").alias(a), F.col("end").alias(z)).distinct()
    return left.join(gone, (F.col(f"`{key}`") == F.col(k)) & (F.col("start") == F.col(a)) & (F.col("end") == F.col(z)), "left_anti")


def fill_gaps_rows(deterministic: DataFrame, nlp: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Deterministic rows, and the NLP rows that touch none of them (resolve those first)."""
    return deterministic.unionByName(clear_of(nlp, deterministic, key, width), allowMissingColumns=True)


def outside_rows(found: DataFrame, placeholders: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Findings not wholly inside a marker that an earlier pass left."""
    return clear_of(found, placeholders, key, width, within=True)
