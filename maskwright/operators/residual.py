"""What rewriting left behind, against the size of the workforce it came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import LABEL, PSEUDONYM
from ..functions.text import fresh, pinned, spans
from ..functions.vocabulary import OCCUPATION_FAMILY
from .resolve import overlaps, splice

# One in so many people has such an attribute; patterns in the order they claim.
PERSON, WORKPLACE, TEMPORAL, NUMERIC, ORGANISATION, NARRATIVE = 8.0, 12.0, 40.0, 25.0, 60.0, 200.0
PROPER = 2000.0
NEAR_UNIQUE = 1000.0
WITHHELD = "[SENSITIVE RESPONSE WITHHELD FOR DISCLOSURE CONTROL]"
BRANCHES = (
    ("numeric", r"(?<![\w-])\d{6,}(?![\w-])", 1e9),
    ("numeric", r"(?<![\w-])\d{2,4}(?:[ -]\d{2,4}){1,4}(?![\w-])", 1e8),
    ("organisation", r"(?<![\w-])[A-Z]{2,4}-?\d{3,}(?:-\d{2,})*(?![\w-])", 5e6),
    ("organisation", r"(?<![.!?]\s)[A-Z][A-Za-z'’-]{2,}\s+(?:platform|system|portal|register|workflow|dashboard|tool|suite|network|intranet|repository|spreadsheet|helpdesk|ticketing)\b", PROPER),
    ("temporal", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", TEMPORAL * 0.1),
    ("person", r"(?i)\b\d{1,3}\s*(?:years?\s*old|yrs?)\b", PERSON * 3),
    ("person", rf"(?i)(?<![.!?]\s)\b(?:{OCCUPATION_FAMILY})\b", PERSON * 4),
    ("person", r"(?i)\b\d{1,2}\+?\s*(?:years?|yrs?)\b", PERSON * 2),
    ("person", r"\b\d{2,3}\s*-\s*\d{2,3}\b|\b\d{2,3}\+|\bunder\s+\d{1,3}\b|\b\d{2,3}\s+years\b|\b\d{2,3}\+?\s+people\b", PERSON),
    ("numeric", r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|\d{1,3})\s+(?:of\s+us\s+)?(?:incidents?|complaints?|reports?|people|staff|workers|members)\b", NUMERIC * 0.5),
    ("temporal", r"(?<!\d)(?:19|20)\d{2}(?!\d)", TEMPORAL * 0.5),
    ("organisation", r"(?<![.!?]\s)\b[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){1,3}\b", PROPER),
)
HARM = r"(?i)\b(?:bully\w*|harass\w*|abuse\w*|aggress\w*|threat\w*|humiliat\w*|grievance|complaint|incident|retaliat\w*|excluded|ostraci[sz]ed|anxiety|depression|ptsd|psychological|burnout|unsafe|danger\w*|injur\w*|discriminat\w*|bullied|singl(?:ed|ing)\s+(?:me\s+)?out|pick(?:ed|ing)\s+(?:me\s+)?on|target(?:ed|ing|s)?|shout(?:ed|ing)|embarrass\w*|undermin\w*|intimidat\w*|mock(?:ed|ing)|barrage|excluded\s+me|left\s+out|set\s+me\s+up|put\s+me\s+on|against\s+me|did\s+not\s+listen|would\s+not\s+listen|nobody\s+(?:cared|acted)|nothing\s+happened|no\s+action)\b"
NO_NAME = "My Our The This That These Those His Her Its Their Your A An I We They He She It No Not Yes But And So When After Before Since If Then There Here Now One Two Three Each Every New Old Both All Some Any Most Many Few More Less Just Still Very Really Quite Also Even Only TFN ABN ACN DOB BSB EAP PA ID HR APS".split()
ATTRIBUTE = "struct<kind:string,value:string,selectivity:double,start:int,end:int>"


@dataclass(frozen=True)
class Disclosure:
    """``population``: people the responses came from; the one figure that has no default
    worth having."""

    population: int = 1000
    min_cohort: float = 5.0
    independence: float = 1.0
    narrative: float = NARRATIVE


def measure(text: Column, policy: Disclosure = Disclosure()) -> Column:
    """array of attributes that survive: claimed in the branches' order, markers apart;
    a narrative last and without a place."""
    marks = spans(text, rf"(?:{LABEL}|{PSEUDONYM})")
    found = []
    for i, (kind, pattern, selectivity) in enumerate(BRANCHES):
        got = spans(text, pattern)
        if i == 1:  # white space apart, seven characters or more
            got = F.filter(got, lambda x: F.length(F.regexp_replace(x["value"], r"\s", "")) >= 7)
        if i == len(BRANCHES) - 1:
            got = F.filter(got, lambda x: ~F.split(x["value"], r"\s+")[0].isin(*NO_NAME))
        found.append(_attributes(got, kind, selectivity))
    each = F.filter(F.flatten(F.array(*found)), lambda x: ~F.exists(marks, lambda m: overlaps(x, m)))
    kept = F.aggregate(each, F.array().cast(f"array<{ATTRIBUTE}>"), lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    story = F.array(F.struct(F.lit("narrative").alias("kind"), F.lit("incident narrative").alias("value"), F.lit(policy.narrative).alias("selectivity"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).cast(ATTRIBUTE))
    none = F.array().cast(f"array<{ATTRIBUTE}>")
    return F.when(F.trim(text) == "", none).otherwise(F.concat(kept, F.when(text.rlike(HARM), story).otherwise(none)))


def _attributes(found: Column, kind: str, selectivity: float) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), F.lit(float(selectivity)).alias("selectivity"), x["start"].alias("start"), x["end"].alias("end")).cast(ATTRIBUTE))


def expected(profile: Column, policy: Disclosure) -> Column:
    """People of the workforce who match all attributes."""
    product = F.aggregate(profile, F.lit(1.0), lambda acc, x: acc * x["selectivity"])
    return F.lit(float(policy.population)) / product * F.lit(float(policy.independence))


def _reducible(profile: Column) -> Column:
    return F.filter(profile, lambda x: (x["selectivity"] >= NEAR_UNIQUE) & x["start"].isNotNull() & (x["kind"] != "narrative"))


def decide(profile: Column, policy: Disclosure = Disclosure()) -> Column:
    """struct(action, cohort, drivers): pass, generalise or suppress."""
    cohort = expected(profile, policy)
    few = (F.size(profile) > 0) & (cohort < policy.min_cohort)
    action = F.when(~few, "pass").when(F.size(_reducible(profile)) > 0, "generalise").otherwise("suppress")
    drivers = F.array_sort(F.array_distinct(F.transform(F.filter(profile, lambda x: x["selectivity"] >= NEAR_UNIQUE), lambda x: x["value"])))
    return F.struct(action.alias("action"), cohort.alias("cohort"), F.when(few, drivers).otherwise(F.array().cast("array<string>")).alias("drivers"))


def protect(df: DataFrame, column: str, policy: Disclosure = Disclosure(), out: str = "released", names: tuple[str, str, str] = ("action", "cohort", "post_cohort")) -> DataFrame:
    """Adds ``out`` (text to release) and, under ``names``, the action, the cohort and, after
    generalising, the cohort measured once more.  A name that clashes gets underscores."""
    text = F.col(column)
    profile, decision = fresh(df, "_profile"), fresh(df, "_decision")
    action, cohort, after = (fresh(df, n) for n in names)
    out = fresh(df, out)
    did = F.col(f"{decision}.action")
    df = pinned(pinned(df, {profile: measure(text, policy)}), {decision: decide(F.col(profile), policy)})
    cleaned = splice(text, _reducible(F.col(profile)), lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit(" REDACTED]")))
    df = df.withColumn(out, F.when(did == "suppress", WITHHELD).when(did == "generalise", cleaned).otherwise(text))
    df = df.withColumn(after, F.when(did == "generalise", expected(measure(F.col(out), policy), policy)))
    return df.withColumns({action: did, cohort: F.col(f"{decision}.cohort")}).drop(profile, decision)


def withheld(action: Column) -> Column:
    return action == "suppress"


def summarise(df: DataFrame) -> DataFrame:
    """One row: records, a count per action, escalation rate and mean cohort."""
    n = F.count(F.lit(1))
    count = lambda a: F.count(F.when(F.col("action") == a, 1))
    return df.agg(
        n.alias("records"), *[count(a).alias(a) for a in ("pass", "generalise", "suppress")],
        F.when(n > 0, F.bround((count("generalise") + count("suppress")) / n, 4)).otherwise(0.0).alias("escalation_rate"),
        F.coalesce(F.bround(F.avg("cohort"), 1), F.lit(0.0)).alias("mean_cohort"),
    )


VALUE_SHOWN = 60  # fixed value: characters


def profile_json(profile: Column) -> Column:
    """What :func:`measure` found, for an audit table: values cut to 60 characters, selectivities to
    two places."""
    span = lambda x: F.when(x["start"].isNotNull(), F.array(x["start"], x["end"]))
    each = F.transform(profile, lambda x: F.struct(x["kind"].alias("kind"), F.substring(x["value"], 1, VALUE_SHOWN).alias("value"), F.round(x["selectivity"], 2).alias("selectivity"), span(x).alias("span")))
    return F.to_json(each, {"ignoreNullFields": "false"})
