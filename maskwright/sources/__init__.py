"""Inputs and outputs of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SURVEY = T.StructType([T.StructField(c, T.StringType()) for c in ("ResponseID", "StartDate", "EndDate", "IPAddress", "Instrument", "Consent", *(f"Q{i}" for i in range(1, 6)))])


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType = SURVEY) -> DataFrame:
    """A record a line, by a given schema; a bad line fails the read, blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, text``: a row per file."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def string_leaves(df: DataFrame, id_col: str) -> DataFrame:
    """``id_col, path, text``: every string in a nested row, by walking the schema; array
    elements have their index in the path, map values their key."""

    def walk(kind: T.DataType, at: Column, path: Column) -> Column:
        none = F.array().cast("array<struct<path:string,text:string>>")
        if isinstance(kind, T.StringType):
            return F.when(at.isNotNull(), F.array(F.struct(path.alias("path"), at.alias("text")))).otherwise(none)
        if isinstance(kind, T.StructType):
            return F.flatten(F.array(none, *[walk(f.dataType, at[f.name], F.concat(path, F.lit("." + f.name))) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(at, lambda x, i: walk(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), none)
        if isinstance(kind, T.MapType):
            pairs = F.transform(F.map_entries(at), lambda e: walk(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"].cast("string"))))
            return F.coalesce(F.flatten(pairs), none)
        return none

    each = F.flatten(F.array(*[walk(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name)) for f in df.schema if f.name != id_col]))
    return df.select(id_col, F.explode(each).alias("x")).select(id_col, "x.*")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def read_inputs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``id, path, text`` of NDJSON, JSON or text, by ``kind`` or the file's ending.

    NDJSON: a record a line, JSON: one document a file; every string in it gives a row, and a
    line or file that is no JSON gives its raw text.  Text: a row a file.
    """
    kind = kind or {"ndjson": "ndjson", "jsonl": "ndjson", "json": "json"}.get(path.rsplit(".", 1)[-1].lower(), "text")
    raw = spark.read.text(path, wholetext=kind != "ndjson").select(F.input_file_name().alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    if kind == "text":
        return raw.select(F.col("file").alias("id"), F.lit("").alias("path"), F.col("raw").alias("text"))
    record = F.sha2(F.concat_ws("\n", "file", "raw"), 256)
    tree = F.try_parse_json("raw")
    bad = raw.where(tree.isNull()).select(record.alias("id"), F.lit("").alias("path"), F.col("raw").alias("text"))
    shape = spark.read.option("samplingRatio", 1.0).json(raw.where(tree.isNotNull()).select("raw").rdd.map(lambda r: r[0])).schema if kind in ("json", "ndjson") else None
    parsed = raw.where(tree.isNotNull()).select(record.alias("id"), F.from_json("raw", shape).alias("r"))
    return string_leaves(parsed, "id").select("id", "path", "text").unionByName(bad)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """One text column as text files, a row a line; line breaks within are escaped."""
    df.select(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\\r?\\n", "\\\\n").alias("value")).write.mode("error").text(path)


def write_corpus(corpus: DataFrame, records: str, manifest: str) -> None:
    """A generated corpus as NDJSON, and its manifest: what must not and what must appear."""
    corpus.select("response_id", "template", "answer").write.mode("error").json(records)
    secrets = F.transform("secrets", lambda s: s["literal"])
    corpus.select(F.col("response_id").alias("id"), secrets.alias("must_not_appear"), F.col("must_survive").alias("must_appear"), F.array_sort(F.array_distinct(F.transform("secrets", lambda s: s["kind"]))).alias("kinds")).write.mode("error").json(manifest)
