"""The same expressions over streams: rewriting is a projection, triage a windowed count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.risk import BANDS, band_rank
from ..plans.api import persistable, redact_frame
from ..plans.policy import Policy


def redact_stream(stream: DataFrame, columns: list[str], policy: Policy | None = None) -> DataFrame:
    """Redacts text columns of a streaming DataFrame; originals and findings are left out."""
    return persistable(redact_frame(stream, columns, policy), columns)


def triage_counts(df: DataFrame, time: str, band: Column, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Records per window and risk band; what comes later than ``late`` is left out."""
    src = df.withWatermark(time, late) if df.isStreaming else df
    out = src.groupBy(F.window(time, window).alias("w"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "band", "n")


def session_triage(df: DataFrame, key: str, time: str, band: Column, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, session_start, session_end, n, worst``: a key's records without a gap, and the worst
    risk band among them.

    State is one row per open session (its ends, a count and the worst rank), merged as records
    come, in any order; a session is given out once, when the watermark has passed its end by
    the gap, and its state then goes.  What comes later than ``late`` is left out.  A restart goes
    on from the checkpoint.  In a batch the same rows, all at once.  Null times have no session;
    null keys are a key; a null band counts as low.
    """
    src = df.withWatermark(time, late) if df.isStreaming else df
    rank = F.coalesce(band_rank(band), F.lit(1))
    out = src.where(F.col(time).isNotNull()).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("worst"))
    names = F.array(*[F.lit(name) for _, name in reversed(BANDS)])
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", F.element_at(names, F.col("worst").cast("int")).alias("worst"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet, each input once however often the query restarts."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
