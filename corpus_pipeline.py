"""Training-data pipeline over ``documents``: screen, dedup, decontaminate, pack.

STAGES lists (name, function); each takes (spark, docs, sf_dir), works on all rows that
its predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from maskwright.llm.common import shared_path

#: SQL can't express the classifier, block-max WAND's verification or the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags go.  It learns from the labelled rows of ``docs``;
    null and empty texts are scored as empty, rows that repeat an id share their fate, a null
    id has no label, and without labels nothing is flagged that the bias alone would not be."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.screen(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document keeps its row even if no
    line is left.  ``n_chars`` follows the text.  Null texts stay null, ties in place go by
    the text's hash (:func:`line_dedup.line_dedup`), blank windows are left alone."""
    out = line_dedup.line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays, with all rows that
    repeat it.  Null ids, null and empty texts link with nothing and stay."""
    out = jaccard_join.jaccard_join(docs)
    rest = out.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(rest, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a passage holds a test item go; null and empty texts stay, and all
    stay where there are no items."""
    return decontamination.decontaminate(docs, decontamination.build_index(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens; a null or empty text is one piece of the end
    token, and every row is packed, repeated ids too."""
    pieces = packing.with_digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        at = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
