"""Rewriting of DataFrame columns.  All of it is projection: no shuffle, and the same plan
runs over a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.generalise import GENERALISERS, generalise
from ..functions.masking import masked
from ..functions.text import FINDINGS, aligned, fresh, pinned
from ..operators import detectors as d
from ..operators import residual, risk
from ..operators.cues import Cues, digits
from ..operators.implication import implications
from ..operators.lexicon import Lexicon, matches
from ..operators.lexicon_table import LexiconTable, with_joined
from ..operators.resolve import fill_gaps, outside_placeholders, resolve, splice
from .policy import CATEGORIES, Policy

RANKS = {name: i for i, name in enumerate([*d.RANK, "organisation_name", "lexicon_term", "award_code", "job_title", "tenure", "team_size", "employment_status", "health_detail", "implication"])}


def candidates(text: str, folded: str, policy: Policy, lexicon: Lexicon | LexiconTable | None = None, known: Cues | None = None) -> list[Column]:
    """Columns of unresolved deterministic findings, one per family that is asked for;
    ``text`` and ``folded`` are names of columns."""
    out = [d.detect(text, folded, d.with_checksums(d.DOCUMENT, policy.require_checksum), policy.categories, known)]
    if policy.survey:
        out.append(d.detect(text, folded, (*d.ORGANISATION, *d.AWARD, *d.QUASI), policy.categories, known))
        if (policy.enabled("internal_term") or policy.enabled("award")) and not isinstance(lexicon, LexiconTable):
            out.append(matches(F.col(f"`{text}`"), lexicon if lexicon is not None else Lexicon.load()))
        if policy.enabled("implication"):
            out.append(implications(text, folded, policy.implicates, known=known))
    return out


Backend = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def plugged(text: Column, backend: Backend) -> Column:
    """NLP findings of a backend of your own: a function of many texts that gives, for each, its
    (start, end, category, confidence).  A Pandas UDF; the function goes to the workers."""
    def run(texts: pd.Series) -> pd.Series:
        got = backend(list(texts))
        return pd.Series([[{"start": a, "end": b, "category": c, "detector": "plugged", "stage": "nlp", "confidence": float(p), "value": t[a:b], "metadata": {}} for a, b, c, p in found] for t, found in zip(texts, got, strict=True)])

    return F.pandas_udf(run, FINDINGS)(text)


def with_findings(df: DataFrame, column: str, policy: Policy = Policy(), out: str = "findings", lexicon: Lexicon | LexiconTable | None = None, backend: Backend | None = None) -> DataFrame:
    """Adds ``out``: resolved findings by start, then NLP findings in the gaps; those of
    ``backend`` if one is given, else of the gazetteer.

    Null, empty and blank text has none.  A :class:`LexiconTable` is joined, of any size;
    a :class:`Lexicon` is looked up within the projection.  Families, and the findings at the end, are pinned
    (:func:`pinned`), so that what reads them neither computes them again nor swells the plan.
    Columns of ``df``
    stay as they are, whatever their names, but for one named ``out``.
    """
    raw = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    at = {n: fresh(df, n) for n in ("_text", "_folded", "_cues", "_found", "_nlp")}
    df = df.withColumns({at["_text"]: raw, at["_folded"]: aligned(raw)})
    text, folded, kept = F.col(at["_text"]), F.col(at["_folded"]), F.col(at["_found"])
    known = Cues(at["_cues"])
    df = df.withColumn(at["_cues"], digits(folded))
    families = candidates(at["_text"], at["_folded"], policy, lexicon, known)
    names = [fresh(df, f"_found{i}") for i in range(len(families))]
    for name, family in zip(names, families, strict=True):
        df = df.withColumn(name, family)
    if isinstance(lexicon, LexiconTable) and policy.survey and (policy.enabled("internal_term") or policy.enabled("award")):
        names.append(fresh(df, "_joined"))
        df = with_joined(df, at["_text"], lexicon, names[-1])
    df = pinned(df, {name: F.col(name) for name in names})
    ok = lambda x: (x["confidence"] >= policy.min_confidence) & (x["category"].isin(*sorted(policy.categories)) if policy.categories is not None else F.lit(True))
    df = df.withColumn(at["_found"], F.filter(F.flatten(F.array(*[F.col(n) for n in names])), ok))
    df = df.withColumn(at["_found"], resolve(kept, RANKS))
    if policy.nlp:
        least = max(policy.nlp_min_confidence, policy.min_confidence)
        more = plugged(text, backend) if backend else d.detect(at["_text"], at["_folded"], d.GAZETTEER, policy.categories, known)
        wanted = lambda x: (x["confidence"] >= least) & (x["category"].isin(*sorted(policy.categories)) if policy.categories is not None else F.lit(True))
        df = df.withColumn(at["_nlp"], F.filter(more, wanted))
        df = df.withColumn(at["_found"], fill_gaps(kept, F.col(at["_nlp"]))).drop(at["_nlp"])
    found = F.when(F.trim(text) == "", F.array().cast(FINDINGS)).otherwise(outside_placeholders(text, kept))
    return pinned(df, {out: found}).drop(*(at[n] for n in ("_found", "_text", "_folded", "_cues")), *names)


def replacement(policy: Policy):
    """finding -> what stands in its place."""
    masks = {}
    for c in CATEGORIES:
        if policy.enabled(c):
            masks.setdefault(("generalise", c) if c in policy.generalise and c in GENERALISERS else ("keep",) if c in policy.generalise else (policy.style_of(c),), []).append(c)

    def of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for how, cs in masks.items():
            if how[0] == "generalise":
                v = generalise(how[1], x["value"])
            elif how[0] == "keep":
                v = x["value"]
            else:
                v = masked(how[0], x["category"], x["value"], policy.salt, policy.mask_char, policy.keep_prefix, policy.keep_suffix)
            out = F.when(x["category"].isin(*cs), v).otherwise(out)
        if policy.strict:
            out = F.when((out == "") & (x["end"] > x["start"]), F.raise_error(F.concat(F.lit("strict: empty replacement for "), x["category"])).cast("string")).otherwise(out)
        return F.coalesce(out, x["value"])

    return of


def redact(df: DataFrame, column: str, policy: Policy = Policy(), out: str = "redacted", findings: str = "findings", lexicon: Lexicon | LexiconTable | None = None, backend: Backend | None = None) -> DataFrame:
    """Adds the findings of a text column and the text without them.  Null stays null."""
    df = with_findings(df, column, policy, findings, lexicon, backend)
    return df.withColumn(out, splice(F.col(f"`{column}`"), F.col(findings), replacement(policy)))


def scan(df: DataFrame, id_col: str, column: str, policy: Policy = Policy(), lexicon: Lexicon | LexiconTable | None = None, backend: Backend | None = None) -> DataFrame:
    """A finding a row: ``id_col, ordinal, start, end, category, ...``."""
    found = with_findings(df.select(id_col, column), column, policy, "findings", lexicon, backend)
    names = ("start", "end", "category", "detector", "stage", "confidence", "value", "metadata")
    each = F.transform("findings", lambda x, i: F.struct(i.alias("ordinal"), *[x[c].alias(c) for c in names]))
    # outer, then without the empty ones: of an inner one the optimiser infers a filter on the
    # array's size, pushes it down to the scan and there makes the whole array once more
    return found.select(id_col, each.alias("findings")).select(id_col, F.inline_outer("findings")).where("start is not null")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def free_text_columns(df: DataFrame, prefix: str = "Q") -> list[str]:
    """String columns of answers: the prefix and a number."""
    return [c for c in text_columns(df) if c.startswith(prefix) and c[len(prefix) :].isdigit()]


def redact_frame(df: DataFrame, columns: Sequence[str] | None = None, policy: Policy | None = None, audience: str = "internal", review: str = "high", lexicon: Lexicon | LexiconTable | None = None, disclosure: residual.Disclosure | None = None, observe: Observation | str | None = None) -> DataFrame:
    """Adds, per text column (default: all), its ``_redacted``, ``_findings``, ``_risk``,
    ``_risk_band`` and ``_needs_review`` columns; with ``disclosure`` also ``_action`` and
    ``_cohort``, and ``_redacted`` is what may be released.

    ``observe`` counts in the pass that writes (:func:`measures`): an ``Observation`` for a batch,
    whose ``get`` has the counts after the first action, a name for a stream, whose progress has
    them for every batch."""
    from .policy import survey_policy

    policy = policy or survey_policy()
    columns = list(columns) if columns is not None else text_columns(df)
    made = {f"{c}_{x}" for c in columns for x in ("redacted", "findings", "risk", "risk_band", "needs_review", *(("action", "cohort") if disclosure else ()))}
    if taken := sorted(made & set(df.columns)):
        raise ValueError(f"the frame has columns {', '.join(taken)} already: rename or drop them")
    for c in columns:
        one, assessed = f"{c}_redacted", fresh(df, f"{c}_assessed")
        df = redact(df, c, policy, one, f"{c}_findings", lexicon)
        df = pinned(df, {assessed: risk.assess(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.col(f"{c}_findings"), audience)})
        at = F.col(assessed)
        df = df.withColumns({f"{c}_risk": at["score"], f"{c}_risk_band": at["band"], f"{c}_needs_review": risk.needs_review(at["band"], review)}).drop(assessed)
        if disclosure:
            whole, after = fresh(df, f"{c}_released"), fresh(df, f"{c}_after")
            df = residual.protect(df, one, disclosure, whole, (f"{c}_action", f"{c}_cohort", after)).drop(one, after).withColumnRenamed(whole, one)
    return df.observe(observe, *measures(columns, policy, disclosure is not None)) if observe is not None else df


def measures(columns: Sequence[str], policy: Policy, disclosed: bool = False) -> list[Column]:
    """The ingest summary of a redacted frame as aggregates: records, and per column findings, records
    to review, findings per category (of those that the policy asks for) and, with a disclosure,
    records per action."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    out = [F.count(F.lit(1)).alias("records")]
    for c in columns:
        found = F.col(f"{c}_findings")
        out += [total(F.size(found)).alias(f"{c}_findings"), total(F.col(f"{c}_needs_review")).alias(f"{c}_review")]
        kinds = F.transform(found, lambda x: x["category"])
        out += [total(F.size(kinds) - F.size(F.array_remove(kinds, k))).alias(f"{c}_{k}") for k in CATEGORIES if policy.enabled(k)]
        if disclosed:
            out += [total(F.col(f"{c}_action") == a).alias(f"{c}_{a}") for a in ("pass", "generalise", "suppress")]
    return out


def worst_risk(df: DataFrame, columns: Sequence[str], out: str = "worst_risk") -> DataFrame:
    """Adds the highest risk score of a record's columns, after :func:`redact_frame`."""
    return df.withColumn(fresh(df, out), risk.worst(*[F.col(f"{c}_risk") for c in columns]))


def roll_up(df: DataFrame, columns: Sequence[str], review: str = "high") -> DataFrame:
    """After :func:`redact_frame`, the record as a whole: ``record_risk`` (its worst column's),
    ``record_band``, ``worst_column`` (the first of equals), ``record_needs_review`` and
    ``record_findings``.  A name that clashes gets underscores; without columns a record is low."""
    scores = [F.coalesce(F.col(f"{c}_risk"), F.lit(0.0)) for c in columns]
    score = F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(0.0)
    first = F.coalesce(*[F.when(s == score, F.lit(c)) for s, c in zip(scores, columns, strict=True)]) if columns else F.lit(None).cast("string")
    count = sum((F.coalesce(F.size(f"{c}_findings"), F.lit(0)) for c in columns), F.lit(0))
    made = {"record_risk": score, "record_band": risk.band(score), "worst_column": first, "record_needs_review": risk.needs_review(risk.band(score), review), "record_findings": count}
    return df.withColumns({fresh(df, k): v for k, v in made.items()})


def redact_records(spark: SparkSession, texts: Sequence[str | None], policy: Policy | None = None, record_ids: Sequence[str | None] | None = None, **more) -> list[dict]:
    """A few records in order, on the driver, to look at a policy before the job: text, original,
    findings, risk, band and review of each; ``more`` goes to :func:`redact_frame`."""
    ids = list(record_ids) if record_ids is not None else [None] * len(texts)
    df = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(zip(ids, texts, strict=False))], "i int, record_id string, t string")
    rows = sorted(redact_frame(df, ["t"], policy, **more).collect(), key=lambda r: r["i"])
    return [{"record_id": r["record_id"], "text": r["t_redacted"] or "", "original_text": r["t"] or "", "findings": r["t_findings"], "risk": r["t_risk"], "band": r["t_risk_band"], "needs_review": r["t_needs_review"], **({"action": r["t_action"]} if "t_action" in r else {})} for r in rows]


def persistable(df: DataFrame, originals: Sequence[str]) -> DataFrame:
    """What may be written: neither the original texts nor the findings, which quote them."""
    gone = {*originals, *(f"{c}_findings" for c in originals)}
    return df.select(*[c for c in df.columns if c not in gone])


def findings_json(findings: Column) -> Column:
    """The audit payload without values: presentation, not for hashing."""
    return F.to_json(F.transform(findings, lambda x: F.struct(x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["detector"].alias("detector"), x["stage"].alias("stage"), F.bround(x["confidence"], 4).alias("confidence"), x["metadata"].alias("metadata"))))


def summary(findings: Column) -> Column:
    """``3 findings (2 deterministic, 1 nlp): email=2, name=1``."""
    kinds = F.array_sort(F.array_distinct(F.transform(findings, lambda x: x["category"])))
    count = lambda test: F.size(F.filter(findings, test))
    each = F.transform(kinds, lambda k: F.concat(k, F.lit("="), count(lambda x: x["category"] == k).cast("string")))
    return F.concat(F.size(findings).cast("string"), F.lit(" findings ("), count(lambda x: x["stage"] == "deterministic").cast("string"), F.lit(" deterministic, "), count(lambda x: x["stage"] == "nlp").cast("string"), F.lit(" nlp): "), F.array_join(each, ", "))


def audit_json(record_id: Column, findings: Column, assessed: Column, disclosure: Column | None = None) -> Column:
    """One object for an audit row: the record, what was found (without values), its risk and,
    if given, the disclosure decision (action, cohort, drivers)."""
    kinds = F.array_sort(F.array_distinct(F.transform(findings, lambda x: x["category"])))
    found = F.transform(findings, lambda x: F.struct(x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["detector"].alias("detector"), x["stage"].alias("stage"), F.bround(x["confidence"], 4).alias("confidence"), x["metadata"].alias("metadata")))
    parts = [record_id.alias("record_id"), F.size(findings).alias("finding_count"), kinds.alias("categories"), assessed.alias("risk"), *([disclosure.alias("disclosure")] if disclosure is not None else []), found.alias("findings")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def redact_text(spark: SparkSession, text: str | None, policy: Policy = Policy(), lexicon: Lexicon | LexiconTable | None = None) -> str | None:
    """One text, on the driver; for looking at a policy, not for data."""
    return redact(spark.createDataFrame([(text,)], "t string"), "t", policy, lexicon=lexicon).first()["redacted"]


def summarise_texts(spark: SparkSession, texts: Sequence[str | None], policy: Policy = Policy()) -> list[str]:
    """The summary of each of a few texts, on the driver."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = redact(df, "t", policy).select("i", summary(F.col("findings")).alias("s")).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["i"])]
