"""Which findings stand where several overlap, and how the text is rewritten."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.masking import PLACEHOLDER
from ..functions.text import FINDINGS, spans
from .detectors import RANK


def overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def rank_of(detector: Column, ranks: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])
    return F.coalesce(F.element_at(table, detector), F.lit(len(ranks)))


def resolve(found: Column, ranks: dict[str, int] = RANK) -> Column:
    """Findings without overlaps, by start.

    Taken greedily, the longest first, then deterministic before NLP, the surer, the
    earlier detector, the earlier start: a finding stays unless one that stays already
    overlaps it.  That is in sequence by nature (of a chain A-B-C, C stays if B lost to
    A), so it is a fold over one record's findings; keys are sorted as plain structs.
    """
    keys = F.sort_array(F.transform(found, lambda x, i: F.struct(
        (x["start"] - x["end"]).alias("a"), F.when(x["stage"] == "deterministic", 0).otherwise(1).alias("b"), (-x["confidence"]).alias("c"),
        rank_of(x["detector"], ranks).alias("d"), x["start"].alias("start"), i.alias("i"), x["end"].alias("end"),
    )))
    none = F.array().cast("array<struct<start:int,i:int,end:int>>")
    kept = F.aggregate(keys, none, lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["i"].alias("i"), x["end"].alias("end"))))))
    return F.when(F.size(found) < 2, found).otherwise(F.transform(F.sort_array(kept), lambda k: F.get(found, k["i"])))


def fill_gaps(deterministic: Column, nlp: Column) -> Column:
    """NLP findings that touch no deterministic one, resolved among themselves."""
    free = F.filter(nlp, lambda x: ~F.exists(deterministic, lambda y: overlaps(x, y)))
    return F.concat(deterministic, resolve(free, {}))


def outside_placeholders(text: Column, found: Column) -> Column:
    """Findings not wholly inside a marker that an earlier pass left, so a second pass
    changes nothing."""
    marks = spans(text, PLACEHOLDER)
    kept = F.filter(found, lambda x: ~F.exists(marks, lambda m: (x["start"] >= m["start"]) & (x["end"] <= m["end"])))
    return F.when(F.size(found) == 0, F.array().cast(FINDINGS)).when(text.contains("[") | text.contains("_"), kept).otherwise(found)


def splice(text: Column, found: Column, replacement) -> Column:
    """The text with each finding (none overlapping) replaced, left to right in one fold.
    Replacements are made once a finding, before the fold, which only puts parts together."""
    order = F.array_sort(F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"), replacement(x).alias("to"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, k):
        piece = F.substring(text, acc["at"] + 1, k["start"] - acc["at"])
        return F.struct(k["end"].alias("at"), F.concat(acc["out"], piece, k["to"]).alias("out"))

    done = F.aggregate(order, first, step)
    whole = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(whole)
