"""Lexicons of any size: look-up as joins, claims as a fold over a record's hits.

The terms are a DataFrame, so their forms and deletions are made by Spark and nothing of them
passes through the driver; whether a side is broadcast is left to Spark, by its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FINDING, FINDINGS, TOKEN, pinned, token_key, token_values
from .lexicon import FUZZY_LEAST, Lexicon

TERMS = "seq long, term string, category string, label string, aliases array<string>, exact_only boolean"


def deletions(key: Column, most: int) -> Column:
    """The key and what is left of it without up to ``most`` characters."""
    without = lambda k: F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    out = last = F.array(key)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda k: F.length(k) > 1), without)))
        out = F.concat(out, last)
    return F.array_distinct(out)


@dataclass(frozen=True)
class LexiconTable:
    """``terms``: seq, term, category, label, aliases, exact_only; where two terms share a form,
    the one with the lesser seq has it.  Null terms and aliases have no form, a null category
    is an internal term, a null label the term, null aliases none, a null exact_only false."""

    terms: DataFrame
    max_distance: int = 1

    @staticmethod
    def of(spark: SparkSession, lexicon: Lexicon) -> LexiconTable:
        rows = [(i, t.term, t.category, t.label or t.term, list(t.aliases), t.exact_only) for i, t in enumerate(lexicon.terms)]
        return LexiconTable(spark.createDataFrame(rows, TERMS), lexicon.max_distance)

    def _forms(self) -> DataFrame:
        t = self.terms.select(
            "seq", "term", F.coalesce("category", F.lit("internal_term")).alias("category"), F.coalesce("label", "term").alias("label"), F.coalesce("exact_only", F.lit(False)).alias("exact_only"),
            F.length(token_key(F.col("term"))).alias("long"), F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"),
        )
        return t.withColumn("form_key", token_key(F.col("form"))).where("form_key <> ''")

    def exact(self) -> DataFrame:
        """A row a key: ``form_key`` and ``t``, the first term that has it."""
        return self._forms().groupBy("form_key").agg(F.min(F.struct("seq", "long", "term", "label", "category")).alias("t"))

    def fuzzy(self) -> DataFrame:
        """A row a deletion of the forms of one word."""
        one = self._forms().where(~F.col("exact_only") & ~F.trim("form").contains(" "))
        one = one.select("seq", "long", "term", "label", "category", F.explode(deletions(F.col("form_key"), self.max_distance)).alias("form_key"))
        return one.groupBy("form_key").agg(F.min(F.struct("seq", "long", "term", "label", "category")).alias("t"))

    def longest(self) -> int:
        return self._forms().agg(F.coalesce(F.max(F.size(F.split(F.trim("form"), r"\s+"))), F.lit(1))).first()[0]


def hits(texts: DataFrame, lexicon: LexiconTable, sizes: Sequence[int] | None = None) -> DataFrame:
    """Candidate rows ``key, at, n, t, distance`` of ``texts`` (key, text): tokens ``at`` to
    ``at + n - 1`` are a form, or one token is nearly one.  ``sizes``: the n that are asked for,
    if not all up to the longest form; no others are made.

    Grams and deletions are exploded without the text and joined with the forms; what a
    repeated text gives twice is dropped in each task, before anything else moves.
    """
    # keys are pinned and grams exploded outer: else filters on their number are inferred and make all of them anew
    keys = pinned(texts.select("key", "text"), {"k": F.transform(token_values(F.coalesce("text", F.lit(""))), token_key)}).select("key", "k")

    def grams(n):
        at = F.when(F.size("k") >= n, F.sequence(F.lit(0), F.size("k") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.concat(*[F.get("k", i + j) for j in range(n)]).alias("gram")))

    every = keys.select("key", F.explode_outer(F.flatten(F.array(*[grams(n) for n in sizes or range(1, lexicon.longest() + 1)]))).alias("g")).select("key", "g.*").where("gram <> ''")
    forms = lexicon.exact()
    exact = every.join(forms, F.col("gram") == F.col("form_key")).select("key", "at", "n", "t", F.lit(0).alias("distance"))
    if not lexicon.max_distance or (sizes and 1 not in sizes):
        return exact.distinct()
    # which term is nearest hangs on the word alone: deletions are made of each distinct word once
    singles = keys.select("key", F.posexplode("k").alias("at", "gram")).where(F.length("gram") >= FUZZY_LEAST)
    words = singles.select("gram").distinct().join(forms, F.col("gram") == F.col("form_key"), "left_anti")
    near = words.select("gram", F.explode(deletions(F.col("gram"), lexicon.max_distance)).alias("form_key")).join(lexicon.fuzzy(), "form_key")
    gone = F.length("gram") - F.length("form_key")
    best = near.groupBy("gram").agg(F.min(F.struct(gone.alias("gone"), (-F.col("t.long")).alias("long"), F.col("t.seq").alias("seq"), F.col("t").alias("t"))).alias("b"))
    close = singles.join(best, "gram").select("key", "at", F.lit(1).alias("n"), F.col("b.t").alias("t"), F.lit(1).alias("distance"))
    return exact.unionByName(close).distinct()


def claims(found: DataFrame) -> DataFrame:
    """Of :func:`hits`, those that stand: the longest first, then the leftmost, each clear of those
    before it.  Phrases of one record are folded; single tokens need only be clear of them."""
    h = F.struct((-F.col("n")).alias("o"), "at", "n", "t", "distance")
    per = found.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, h))).alias("long"), F.collect_list(F.when(F.col("n") == 1, h)).alias("one"))
    meets = lambda x, y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])
    none = F.array().cast(per.schema["long"].dataType)
    per = per.withColumn("long", F.aggregate("long", none, lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))
    free = F.filter("one", lambda x: ~F.exists("long", lambda y: meets(x, y)))
    return per.select("key", F.explode(F.concat("long", free)).alias("h")).select("key", "h.at", "h.n", "h.t", "h.distance")


def places(texts: DataFrame) -> DataFrame:
    """``key, pos, start, end`` of every token: running sums over one text."""
    t = F.coalesce("text", F.lit(""))
    whole = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    each = F.arrays_zip(F.slice(F.split(t, TOKEN, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"))
    rows = texts.select("key", F.posexplode(each).alias("pos", "x")).select("key", "pos", F.length("x.gap").alias("gap"), F.length("x.whole").alias("whole"), F.length(F.regexp_replace("x.whole", r"[.\-&'’]+$", "")).alias("own"))
    to = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    start = (to - F.col("whole")).cast("int")
    return rows.select("key", "pos", start.alias("start"), (start + F.col("own")).alias("end"))


def join_findings(texts: DataFrame, lexicon: LexiconTable) -> DataFrame:
    """``key, found``: the lexicon's findings of each text that has any, by place.

    ``key`` names the text: rows of one key have one text.  Only texts with a claim are read
    again for the places of their tokens.
    """
    held = claims(hits(texts, lexicon))
    some = texts.dropDuplicates(["key"]).join(held.select("key").distinct(), "key", "left_semi")
    at = places(some)
    first = held.join(at.select("key", F.col("pos").alias("at"), "start"), ["key", "at"])
    whole = first.withColumn("last", F.col("at") + F.col("n") - 1).join(at.select("key", F.col("pos").alias("last"), "end"), ["key", "last"])
    near = F.col("distance") > 0
    known = [F.lit("canonical"), F.col("t.term"), F.lit("label"), F.col("t.label")]
    facts = F.struct(
        "start", "end", F.col("t.category").alias("category"), F.lit("lexicon_term").alias("detector"), F.lit("deterministic").alias("stage"), F.when(near, 0.85).otherwise(1.0).alias("confidence"),
        F.when(near, F.create_map(*known, F.lit("distance"), F.lit("1"), F.lit("fuzzy"), F.lit("true"))).otherwise(F.create_map(*known)).alias("metadata"),
    )
    # maps can't be sorted by: places are, and a text has one finding a place
    by = whole.select("key", F.struct("start", facts.alias("f")).alias("x")).groupBy("key").agg(F.collect_list("x").alias("xs"))
    order = F.array_sort("xs", lambda a, b: a["start"] - b["start"])
    return by.select("key", F.transform(order, lambda x: x["f"]).alias("found"))


def with_joined(df: DataFrame, text: str, lexicon: LexiconTable, out: str) -> DataFrame:
    """``df`` with ``out``: the lexicon's findings of the column ``text``, for
    :func:`plans.api.with_findings`.  Texts are known by their SHA-256, so equal texts are looked
    up as one.  For batches: a stream has no such join."""
    key = F.sha2(F.col(f"`{text}`"), 256)
    texts = df.select(key.alias("key"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    found = join_findings(texts, lexicon).select(F.col("key").alias(f"{out}_key"), F.col("found").alias(f"{out}_found"))
    joined = df.join(found, key == F.col(f"{out}_key"), "left")
    names = ("start", "end", "category", "detector", "stage", "confidence")
    each = F.transform(f"{out}_found", lambda x: F.struct(*[x[c].alias(c) for c in names], F.substring(F.col(f"`{text}`"), x["start"] + 1, x["end"] - x["start"]).alias("value"), x["metadata"].alias("metadata")).cast(FINDING))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(each, F.array().cast(FINDINGS)).alias(out))
