"""Exact dedup by progressive refinement: length, prefix hash, full hash.  JVM only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, keyed_join, same

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z.

    Three levels, each over what the one before left open:

    1. byte length: a length that one row has settles that row;
    2. hash of the first ``prefix_chars`` characters within a length;
    3. SHA-256 of the whole text, only for rows whose (length, prefix) is shared.

    Levels 1 and 2 move a few bytes a row and combine on the map side, so a length
    or prefix that a third of all rows have costs one row a task.  Level 3 deals the
    surviving (length, prefix) keys over ``SALTS`` salts, so that the texts of a hot
    key meet in many tasks.  Groups and lengths that many rows have are broadcast, at
    most a fixed number of them (:func:`common.keyed_join`).

    Returns one row per input row: ``id_col``, ``keep_id`` (largest id of the group),
    ``group_size``, ``kept``, ``settled_by`` (length, prefix or full) and ``digest``
    (SHA-256, null where level 3 was not needed unless ``digest_all``, which hashes every
    text where it is read; groups still come from the open rows only).

    Null text counts as empty; empty texts are equal to each other.  Null ids: the
    largest known id stays; if a group has none, all its rows stay.  Rows that repeat
    an id and a text are the same document: they count in ``group_size`` and share
    ``kept``.  No other column is read.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), norm.alias("norm"),
    ).select("id", "norm", F.octet_length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("p"))
    by_prefix = rows.groupBy("n", "p").agg(F.count(F.lit(1)).alias("c"))
    by_length = by_prefix.groupBy("n").agg(F.sum("c").alias("cn")).where("cn > 1")
    open_keys = by_prefix.where("c > 1").join(by_length.select("n"), "n", "left_semi")
    open_keys = open_keys.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("open"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    if digest_all:  # asked for of every row: made where the text is read, so that no text moves
        salted = salted.select("id", "n", "p", "salt", F.sha2("norm", 256).alias("sha"))
        digest = F.col("sha")
    else:
        digest = F.when(F.col("open"), F.sha2("norm", 256))
    digests = cut(salted.join(open_keys, ["n", "p", "salt"], "left").select("id", "n", F.coalesce("open", F.lit(False)).alias("open"), digest.alias("digest")))
    groups = digests.where("open").groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    many = by_length.select("n", F.lit(True).alias("many"), "cn")
    found = keyed_join(keyed_join(digests, groups, ["digest"], "size", "id"), many, ["n"], "cn", "id")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        same(F.col("id"), keep).alias("kept"),
        F.when(F.col("open"), "full").when(F.col("many"), "prefix").otherwise("length").alias("settled_by"),
        "digest",
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`exact_dedup`, whose rules for nulls, ties, repeated and
    empty rows hold; the digest of every row."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS top, count(*) AS n FROM t GROUP BY h)
SELECT t.doc_id, g.top AS keep_id, CAST(g.n AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.top AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""
