"""Re-identification risk of a record: signals that add up, by audience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import beginnings, fresh, headed, let
from ..plans.policy import DIRECT, QUASI

# Weights, factors, bands, wording.
WEIGHTS = {
    "direct_identifier": 0.45, "narrative": 0.20, "scenario": 0.15, "unique": 0.30, "protected": 0.15, "specific_event": 0.10, "confidentiality_request": 0.35, "short_response": 0.08, "internal_lexicon": 0.12, "named_organisation": 0.20,
    "employer_attribution": 0.25, "job_title": 0.12, "tenure": 0.10, "team_size_small": 0.12, "employment_status": 0.08, "health_detail": 0.12, "age": 0.06, "date_of_birth": 0.15, "location_specific": 0.10,
}
QUASI_FACTOR = {"internal": 1.0, "external_analyst": 0.8, "public": 0.6}
ATTRIBUTION_FACTOR = {"internal": 1.0, "external_analyst": 1.0, "public": 0.7}
BANDS = ((0.75, "critical"), (0.50, "high"), (0.25, "moderate"), (0.0, "low"))
SHORT_WORDS, SHORT_MOST = 12, 2.0
SMALL_CUES = ("1", "one", "2", "two", "3", "three", "4", "four", "5", "five", "a few", "several")
TEXT_SIGNALS = {
    "narrative": r"(?i)\b(?:bully|bullying|bullied|harass|harassment|harass(?:ed|ing)|abuse|abusive|aggress(?:ion|ive)|threat(?:en)?|intimidat\w+|humiliat\w+|degrad\w+|victimi[sz]e|retaliat\w+|gossip|back ?stab\w+|excluded|ostraci[sz]ed|manager|m supervisor|team lead|complain(?:t|ed|ts)?|grievance|report(?:ed)?\s+(?:it|this|them))\b",
    "scenario": r"(?i)\b(?:i\s+(?:told|asked|reported|raised|complained)|(?:they|he|she|my manager|my supervisor)\s+(?:said|told|asked|put|kept|made|always|never)\b|every\s+(?:week|day|shift)|each\s+(?:week|day|shift)|every\s+(?:single|day|week)\s+(?:shift|week|day))\b",
    "unique": r"(?i)\b(?:the\s+only|only\s+(?:one|woman|man|casual|temp)|no\s+one\s+else|nobody\s+else|i\s+am\s+the\s+only|first\s+woman|only\s+(?:woman|man)\s+in)",
    "protected": r"(?i)\b(?:pregnan\w+|breastfeed\w+|parental\s+leave|disab\w+|wheelchair|indigenous|aboriginal|torres\s+strait|lgb\w+|lgbt\w+|queer|gay|lesbian|bisexual|trans(?:gender)?|muslim|jewish|hindu|christian|caucasian|white\s+australian|overtime|on\s+call|second\s+job)\b",
    "specific_event": r"(?i)\b(?:incident|on\s+(?:the\s+)?\d{1,2}(?:st|nd|rd|th)?|last\s+(?:week|month|year|night|shift)|after\s+the\s+(?:meeting|restructure|reorg|change)|when\s+i\s+(?:arrived|started)|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})",
    "confidentiality_request": r"(?i)\b(?:(?:do\s+not|don'?t|never)\s+(?:want\s+)?(?:my\s+|our\s+)?(?:employer|manager|boss|supervisor|company|colleagues?|coworkers?|co-workers|HR|anyone)\s+(?:to\s+)?(?:find\s+out|know|see|be\s+told)|(?:please\s+)?(?:keep|make)\s+this\s+(?:anonymous|confidential)|(?:i\s+)?(?:am|'m|was)\s+(?:worried|concerned|nervous|scared)\s+about\s+(?:being\s+)?(?:identified|recognised|recognized|found\s+out|tracked)|this\s+(?:is\s+)?(?:not\s+)?anonymous|i\s+don'?t\s+want\s+my\s+name)",
}
#: What every match of a text signal has: one of these, where a word begins.  None begins another.
SIGNAL_CUES = {
    "narrative": ("bulli", "bully", "harass", "abus", "aggress", "threat", "intimidat", "humiliat", "degrad", "victimi", "retaliat", "gossip", "back stab", "backstab", "excluded", "ostraci", "manager", "supervisor", "team lead", "complain", "grievance", "report"),
    "scenario": ("told", "asked", "report", "raised", "complain", "said", "put", "kept", "made", "always", "never", "week", "day", "shift"),
    "unique": ("only", "else", "woman"),
    "protected": ("pregnan", "breastfeed", "parental", "disab", "wheelchair", "indigenous", "aboriginal", "torres", "lgb", "queer", "gay", "lesbian", "bisexual", "trans", "muslim", "jewish", "hindu", "christian", "caucasian", "white", "overtime", "call", "second"),
    "specific_event": ("incident", "week", "month", "year", "night", "shift", "meeting", "restructure", "reorg", "change", "arrived", "started", *"0123456789"),
    "confidentiality_request": ("employer", "manager", "boss", "supervisor", "company", "colleague", "coworker", "co-worker", "hr", "anyone", "anonymous", "confidential", "worried", "concerned", "nervous", "scared", "name"),
}
SIGNAL = "struct<name:string,weight:double,category:string>"


def word_count(text: Column) -> Column:
    """Parts between white space; only the first and the last can be empty."""
    at = lambda ws, i: F.coalesce((F.get(ws, i) == "").cast("int"), F.lit(0))
    return let(F.split(text, r"\s+"), lambda ws: F.size(ws) - at(ws, F.lit(0)) - F.when(F.size(ws) > 1, at(ws, F.size(ws) - 1)).otherwise(0))


def cues(text: Column) -> Column:
    """The :data:`SIGNAL_CUES` of all signals in a text, one after the other: one pass for six, and the
    signals without any are not tried."""
    every = tuple(sorted({w for ws in SIGNAL_CUES.values() for w in ws}))
    return F.array_join(F.regexp_extract_all(text, F.lit(headed(beginnings(every))), F.lit(0)), " ")


def assess(text: Column, found: Column, audience: str = "internal") -> Column:
    """struct(score, band, signals, words).

    Signals are sorted by weight.  The sum is taken to nine places before it is banded, so
    that weights which meet a band's edge are in it whatever the order of adding.
    """
    q, a = QUASI_FACTOR[audience], ATTRIBUTION_FACTOR[audience]
    has = lambda *cs: F.exists(found, lambda x: x["category"].isin(*cs))

    def last(category, name):
        of = F.filter(found, lambda x: x["category"] == category)
        return F.get(of, F.size(of) - 1)[name]

    def signal(name, when, factor=1.0, category=None):
        weight = F.lit(WEIGHTS[name]) * (factor if isinstance(factor, Column) else F.lit(float(factor)))
        one = F.struct(F.lit(name).alias("name"), weight.cast("double").alias("weight"), (category if isinstance(category, Column) else F.lit(category)).cast("string").alias("category")).cast(SIGNAL)
        return F.when(when, F.array(one)).otherwise(F.array().cast(f"array<{SIGNAL}>"))

    labels = F.size(F.filter(found, lambda x: x["category"].isin("internal_term", "award") & x["metadata"]["label"].isNotNull()))
    cue = F.regexp_replace(F.lower(F.trim(last("team_size", "metadata")["cue"])), r"[+ ]+$", "")
    parts = lambda n, seen: F.flatten(F.array(
        *[signal("direct_identifier", has(c), category=c) for c in DIRECT],
        *[signal(name, seen.rlike(beginnings(SIGNAL_CUES[name])) & text.rlike(headed(p))) for name, p in TEXT_SIGNALS.items()],
        signal("short_response", n.between(1, SHORT_WORDS), F.least(F.lit(SHORT_MOST), F.lit(float(SHORT_WORDS)) / F.greatest(n, F.lit(1)))),
        signal("internal_lexicon", labels > 0, F.lit(a) * F.least(F.lit(1.0) + F.lit(0.15) * (labels - 1), F.lit(1.6)), "internal_term"),
        signal("named_organisation", has("organisation_name"), a, "organisation_name"),
        signal("employer_attribution", has("award"), a, "award"),
        signal("employer_attribution", has("internal_term"), a, "internal_term"),
        signal("job_title", has("job_title"), F.lit(q) * F.when(last("job_title", "confidence") >= 0.8, 1.3).otherwise(1.0), "job_title"),
        signal("tenure", has("tenure"), q, "tenure"),
        signal("team_size_small", has("team_size"), F.lit(q) * F.when(cue.isin(*SMALL_CUES), 1.4).otherwise(1.0), "team_size"),
        signal("employment_status", has("employment_status"), q, "employment_status"),
        signal("health_detail", has("health_detail"), q, "health_detail"),
        signal("age", has("age"), q, "age"),
        signal("date_of_birth", has("date_au", "date_iso"), q, F.when(has("date_au"), "date_au").otherwise("date_iso")),
        signal("location_specific", has("street_address", "location"), q, F.when(has("street_address"), "street_address").otherwise("location")),
    ))
    none = F.array().cast(f"array<{SIGNAL}>")

    # each step is made once, as the next ones read it several times
    def combined(base):
        quasi = F.size(F.filter(base, lambda s: s["category"].isin(*QUASI)))
        bonus = F.struct(F.lit("quasi_combination").alias("name"), (F.least(F.lit(0.30), F.lit(0.10) * (quasi - 2)) * q).alias("weight"), F.lit(None).cast("string").alias("category")).cast(SIGNAL)
        return F.concat(base, F.when(quasi >= 3, F.array(bonus)).otherwise(none))

    def judged(signals, n):
        total = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + s["weight"])
        ordered = F.transform(F.sort_array(F.transform(signals, lambda s, i: F.struct((-s["weight"]).alias("k"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
        return let(F.least(F.lit(1.0), F.round(total, 9)), lambda score: F.struct(score.alias("score"), band(score).alias("band"), ordered.alias("signals"), n.alias("words")))

    full = let(word_count(text), lambda n: let(let(let(cues(text), lambda seen: parts(n, seen)), combined), lambda signals: judged(signals, n)))
    empty = (F.trim(text) == "") | text.isNull()
    blank = F.struct(F.lit(0.0).alias("score"), F.lit("low").alias("band"), none.alias("signals"), F.lit(0).alias("words"))
    return F.when(empty, blank).otherwise(full)


def band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def band_rank(b: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for _, x in reversed(BANDS)]), b)


def needs_review(b: Column, threshold: str = "high") -> Column:
    return band_rank(b) >= band_rank(F.lit(threshold))


def filter_by_band(df: DataFrame, column: str, least: str) -> DataFrame:
    """The rows whose band is ``least`` or above.

    A random column stands below the filter, which keeps the optimiser from pushing it down
    through the projections that make the band, and all findings with it, once more."""
    once = fresh(df, "_once")
    return df.withColumn(once, F.rand()).where(needs_review(F.col(column), least) & (F.col(once) >= 0)).drop(once)


def worst(*scores: Column) -> Column:
    """The highest of a record's scores, nulls left out; 0 without any."""
    return F.coalesce(F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(None), F.lit(0.0))


LABELS_SHOWN = 3  # fixed value


def label_detail(found: Column) -> Column:
    """``2 internal or award term(s): a, b``: how many labels, and the first three by name; null
    without any."""
    labels = F.filter(F.transform(F.filter(found, lambda x: x["category"].isin("internal_term", "award")), lambda x: x["metadata"]["label"]), lambda x: x.isNotNull())
    shown = F.slice(F.array_sort(F.array_distinct(labels)), 1, LABELS_SHOWN)
    return F.when(F.size(labels) > 0, F.concat(F.size(labels).cast("string"), F.lit(" internal or award term(s): "), F.array_join(shown, ", ")))


def risk_json(assessed: Column, found: Column | None = None) -> Column:
    """An assessment for an audit table: score to four places, band, words and signals; with the
    findings, the internal lexicon's signal says which labels."""
    detail = label_detail(found) if found is not None else F.lit(None).cast("string")
    each = F.transform(assessed["signals"], lambda s: F.struct(s["name"].alias("name"), s["weight"].alias("weight"), F.when(s["name"] == "internal_lexicon", detail).alias("detail"), s["category"].alias("category")))
    return F.to_json(F.struct(F.round(assessed["score"], 4).alias("score"), assessed["band"].alias("band"), assessed["words"].alias("word_count"), each.alias("signals")), {"ignoreNullFields": "false"})
