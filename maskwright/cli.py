"""Redacts text files: ``spark-submit -m maskwright.cli [options] files``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.tagger import Tagger, tagged_corpus, train
from .plans.api import findings_json, redact, summary
from .plans.policy import CATEGORIES, Policy
from .functions.masking import STYLES
from .sources import read_texts, write_texts


def main(argv: list[str] | None = None) -> int:
    """0; with ``--scan`` 1 if nothing was found; 2 if a file can't be read."""
    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("files", nargs="*", help="none or -: standard input")
    p.add_argument("--output", help="a folder that the executors write the texts to")
    p.add_argument("--style", choices=STYLES, default="mask")
    p.add_argument("--keep-prefix", type=int, default=0)
    p.add_argument("--keep-suffix", type=int, default=4)
    p.add_argument("--mask-char", default="*")
    p.add_argument("--categories", default="")
    p.add_argument("--nlp", action="store_true")
    p.add_argument("--nlp-backend", choices=("gazetteer", "tagger"), default="gazetteer")
    p.add_argument("--tagger-model", help="what Tagger.save wrote; without one a tagger is trained first")
    p.add_argument("--survey", action="store_true")
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--scan", action="store_true")
    p.add_argument("--summary", action="store_true")
    a = p.parse_args(argv)
    wanted = frozenset(x for x in a.categories.split(",") if x)
    if wanted - set(CATEGORIES):
        p.error(f"unknown categories: {', '.join(sorted(wanted - set(CATEGORIES)))}")
    policy = Policy(categories=wanted or None, default_style=a.style, keep_prefix=a.keep_prefix, keep_suffix=a.keep_suffix, mask_char=a.mask_char, nlp=a.nlp, survey=a.survey)
    spark = SparkSession.builder.getOrCreate()
    try:
        stdin = not a.files or a.files == ["-"]
        src = spark.createDataFrame([("-", sys.stdin.read())], "path string, text string") if stdin else read_texts(spark, a.files)
        backend = None
        if a.nlp and a.nlp_backend == "tagger":
            backend = Tagger.load(spark, a.tagger_model) if a.tagger_model else train(tagged_corpus(spark, 4000))
        df = redact(src, "text", policy, backend=backend)
        if a.output:
            write_texts(df, "redacted", a.output)
            return 0
        shown = findings_json(F.col("findings")) if a.scan else F.col("redacted") if a.format == "text" else F.to_json(F.struct(F.col("redacted").alias("text"), findings_json(F.col("findings")).alias("findings")))
        rows = df.select("path", shown.alias("out"), summary(F.col("findings")).alias("summary"), F.size("findings").alias("n")).toLocalIterator()
        total = 0
        for r in rows:
            total += r["n"]
            print(r["out"])
            if a.summary:
                print(r["summary"], file=sys.stderr)
    except Exception as e:  # noqa: BLE001  a path Spark can't read
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 1 if a.scan and not total else 0


if __name__ == "__main__":
    sys.exit(main())
