"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, keyed_join

LINES = 3


def _windows(lines: Column, k: int) -> Column:
    """array<struct<pos,a,b>>: both hashes of each run of k lines that isn't all blank."""
    n = F.size(lines)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))

    def one(i):
        part = [F.get(lines, i + j) for j in range(k)]
        return F.struct(i.alias("pos"), F.xxhash64(*part).alias("a"), F.xxhash64(F.lit(k), *reversed(part)).alias("b"), F.length(F.trim(F.concat(*part))).alias("w"))

    return F.filter(F.transform(at, one), lambda x: x["w"] > 0)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """Removes later occurrences of windows of ``lines`` consecutive lines.

    Windows overlap: one starts at every line (text split at ``\\n``).  A window is
    known by two 64-bit hashes of its lines.  Of each window that occurs twice or
    more anywhere, the occurrence with the least (id, position) stays and every other
    covers its lines; the covered positions of a document are merged and removed.
    Every removed line has an equal earlier one, so the earliest stays.

    Returns the input columns, ``text_col`` rewritten, and ``removed_lines`` (array of
    positions, empty if none); a name that clashes gets underscores.

    Null and empty texts, and texts of fewer lines, are returned as they are.  Windows
    of blank lines only are left alone.  A null id counts before all others.  Rows
    that repeat an id with the same text are one document: all keep or lose the same
    lines.  With another text they are documents of their own whose ties in (id,
    position) go to the lesser text hash.

    Only hashes and positions are dealt by window: (hash, least place, count) combines
    on the map side, so a passage in a third of all documents gives a row a task, and
    windows that many places have come back to them by a broadcast of bounded size
    (:func:`common.keyed_join`); the covered positions of a document are at most its lines.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.split(F.col(text_col), "\n", -1).alias("l"))
    wins = src.select("id", "t", F.explode(_windows(F.col("l"), lines)).alias("w")).select("id", "t", F.col("w.pos").alias("pos"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    place = F.struct("id", "pos", "t")
    seen = wins.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = keyed_join(wins, seen, ["a", "b"], "c", "id").where(F.col("c").isNotNull() & ~(F.struct("id", "pos", "t").eqNullSafe(F.col("first"))))
    covered = later.groupBy("id", "t").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    covered = cut(covered.select("id", "t", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (lines - 1))))).alias("gone")))
    tag, gone = fresh(docs, "_hash"), fresh(docs, "removed_lines")
    d, c = docs.withColumn(tag, F.xxhash64(text_col)).alias("d"), covered.alias("c")
    out = d.join(c, F.col(f"d.{id_col}").eqNullSafe(F.col("c.id")) & (F.col(f"d.{tag}") == F.col("c.t")), "left")
    split = F.split(F.col(f"d.{text_col}"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("c.gone"))  # by hash: a long text costs its length
    text = F.when(F.col("c.gone").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    return out.select(
        *[(text if x == text_col else F.col(f"d.`{x}`")).alias(x) for x in docs.columns],
        F.coalesce("c.gone", F.array().cast("array<int>")).alias(gone),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, how many lines went and which, and the text that is left, of every row of ``documents``;
    rules for nulls, ties, repeats and empties are those of :func:`line_dedup`."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed"), "text")


def dedup_sql(table: str = "documents", tail: str = "") -> str:
    return f"""
lines_ AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {table}),
wins_ AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM lines_ WHERE len(l) >= 3),
keys_ AS (SELECT doc_id, pos, md5(l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3]) AS k FROM wins_ WHERE trim(l[pos + 1] || l[pos + 2] || l[pos + 3], ' ') <> ''),
later_ AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM keys_) WHERE rn > 1),
gone_ AS (SELECT doc_id, list_sort(list_distinct(flatten(list([pos, pos + 1, pos + 2])))) AS gone FROM later_ GROUP BY doc_id){tail}"""


OP4_SQL = f"""
WITH {dedup_sql()}
SELECT d.doc_id, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed,
CASE WHEN gone IS NULL THEN d.text ELSE array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM documents d JOIN lines_ USING (doc_id) LEFT JOIN gone_ USING (doc_id)
"""
