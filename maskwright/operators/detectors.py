"""Detectors as data: each a pattern, a test and a finding, compiled to one expression.

A branch that a policy doesn't ask for never enters the plan.  ``aligned`` patterns match
on the length-preserving fold, so full-width digits and typographic marks are found where
they stand; values are always the original text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import generalise as gen
from ..functions import vocabulary as v
from ..functions.parse import DATE_NAMED, DATE_NUMERIC, parse_date, parse_phone
from ..functions.text import FINDINGS, column, finding, meta, spans, token_key
from .cues import Cues

Test = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Branch:
    """``keep``, ``confidence``, ``metadata`` and ``category`` may be functions of the span
    and the text matched on.  ``gate``: a cheaper pattern that holds wherever the pattern
    matches.  ``trim``: characters to drop from the span's end.  ``clean``: (value) ->
    the part of it to report, null to reject.  ``parse``: value -> what the others read as
    ``x["p"]``, computed once; a null rejects."""

    detector: str
    categories: tuple[str, ...]
    pattern: str
    confidence: float | Callable = 1.0
    keep: Test | None = None
    metadata: Callable | None = None
    category: Callable | None = None
    group: int = 0
    gate: str | None = None
    fold: bool = True
    trim: str | None = None
    clean: Callable | None = None
    stage: str = "deterministic"
    parse: Callable | None = None


def run(b: Branch, text: Column | str, folded: Column | str, known: Cues | None = None) -> Column:
    """array of findings of one branch."""
    test = known.test(b.gate or b.pattern, b.pattern) if known else ""
    found = spans(folded if b.fold else text, b.pattern, b.group, b.gate, test)
    text, folded = column(text), column(folded)
    on = folded if b.fold else text

    def shift(x, value):
        lead = F.instr(x["value"], value) - 1
        s = x["start"] + lead
        return F.struct(s.alias("start"), (s + F.length(value)).alias("end"), value.alias("value"), x["whole"].alias("whole"))

    if b.trim:
        found = F.transform(found, lambda x: shift(x, F.regexp_replace(x["value"], rf"(?:{b.trim})+$", "")))
    if b.clean:
        found = F.filter(F.transform(found, lambda x: shift(x, b.clean(x["value"]))), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    if b.parse:
        found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), b.parse(x["value"]).alias("p")))
        found = F.filter(found, lambda x: x["p"].isNotNull())
    if b.keep:
        found = F.filter(found, lambda x: b.keep(x, on))
    call = lambda f, x: f(x, on) if callable(f) else f

    def make(x):
        category = call(b.category, x) if b.category else b.categories[0]
        return finding(x, category, b.detector, call(b.confidence, x), call(b.metadata, x) if b.metadata else None, b.stage, text)

    return F.transform(found, make)


def before(text: Column, x: Column, n: int) -> Column:
    at = F.greatest(x["start"] - n, F.lit(0))
    return F.substring(text, at + 1, x["start"] - at)


def after(text: Column, x: Column, n: int) -> Column:
    return F.substring(text, x["end"] + 1, F.lit(n))


def _pick(test: Column, yes: float, no: float) -> Column:
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))


def _digits(x, _):
    return meta(normalised=ck.digits_only(x["value"]))


# ---- document detectors, strongest first: the earlier wins a tie
# Patterns.
NINE = r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b"
CARD = rf"(?<![\d\-]){ck.CARD_START}(?:[\s-]?\d){{8,16}}(?![\d\-])"
BSB_LABEL = r"(?i)\b(?:bsb|routing|rtn|bank\s*state\s*branch|sb-?no|branch)\b|\b(?:acc(?:ount)?|a/c)\s*(?:no\.?|number|#)?"
BSB_ACCOUNT = r"^\s?[- ]?\s?\d{5,10}"
LICENCE = r"(?i)(\b(?:driver'?s?\s*licen[cs]e|drivers\s*licence|licence\s*(?:no|number|#)|dl|lic(?:ence)?)\b\.?\s*(?:no\.?|number|#)?\s*:?\s*)\b([A-Z0-9]{5,14})\b"
LICENCE_SHAPES = (("nsw", r"^\d{8}$"), ("qld", r"^[A-Z]\d{6}[A-Z]$"), ("wa", r"^[A-Z]\d{6}$"), ("sa", r"^\d{9}$"), ("vic", r"^[A-Z]\d{7}$"), ("tas", r"^[A-Z]{2}\d{5}$"), ("act", r"^\d{6}[A-Z]$"), ("nt", r"^\d{7}$"))
LICENCE_STOP = ("and", "the", "for", "exp", "expiry", "class")
CREDENTIAL = r"(?i)\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]+(?::[^\s/@]*)?@|\b(?:api[_-]?key|apikey|token|access[_-]?token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_\-./+=]{8,}"
LOCAL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL = rf"\b{LOCAL}(?:\.{LOCAL})*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}\b"
EMAIL_SPACED = r"(?i)(?<![\w.])(?:[A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-]\s){3,64}@\s?(?:[A-Za-z0-9\-]\s){1,63}(?:\.\s?(?:[A-Za-z0-9\-]\s){1,63}(?=\s?\.))*\.\s?(?:[A-Za-z]\s){1,62}[A-Za-z]"
PHONE = r"(?<![\w\d.+])(?:\+?61[\s.-]?)?(?:\(\d{2,4}\)|\d{1,4})(?:[\s.-]?\d){5,10}(?![\d])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
IPV4 = rf"(?i)(?<![\w.])(?<!release\s)(?<!version\s)(?<!build\s)(?<!v)\b(?:{OCTET}\.){{3}}{OCTET}(?![\w.])"
H16 = "[A-Fa-f0-9]{1,4}"
IPV6 = "|".join([rf"\b(?:{H16}:){{7}}{H16}\b", rf"\b(?:{H16}:){{1,7}}:\b", rf"\b(?:{H16}:){{1,6}}:{H16}\b", *[rf"\b(?:{H16}:){{1,{7 - k}}}(?::{H16}){{1,{k}}}\b" for k in range(2, 6)], rf"\b{H16}:(?::{H16}){{1,6}}\b", rf"::(?:{H16}:){{0,6}}{H16}\b"])
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
STATE = "|".join(v.STATES)
STATE_CODE = rf"\b(?:{STATE})\s+\d{{4}}\b|\b\d{{4}}\s+(?:{STATE})\b"
POST_LABEL = r"(?i)\b(?:post\s*code|postcode|zip|suburb|suburb/town|city)\b"
UNIT = r"(?:unit|u|flat|apt|apartment|suite|ste)\s*\d+[a-z]?(?:/\d+[a-z]?)?"
STREET = rf"(?i)\b\d{{1,5}}\s+(?:(?:{UNIT})\s+)?(?:[A-Z][A-Za-z'\u2019\-]+\s+){{1,4}}(?:{v.STREET})\b"
PO_BOX = r"(?i)\bPO\s+Box\s+\d+\b"


def _licence_state(x):
    state = F.lit("unknown")
    for name, shape in reversed(LICENCE_SHAPES):
        state = F.when(x["value"].rlike(shape), name).otherwise(state)
    return state


def _bsb_label(x, t):
    return before(t, x, 40).rlike(BSB_LABEL)


def _code(x):
    return F.regexp_extract(x["value"], r"\d{4}", 0)


def _in_state_pair(x, t):
    """Whether the code stands beside a state, both together a valid pair."""
    near = F.concat(F.regexp_extract(before(t, x, 8), rf"\b(?:{STATE})\s+$", 0), F.regexp_extract(after(t, x, 8), rf"^\s+(?:{STATE})\b", 0))
    return near != ""


DOCUMENT: tuple[Branch, ...] = (
    Branch("tfn", ("tfn",), NINE, keep=lambda x, t: ck.is_tfn(x["value"]), metadata=_digits, gate=r"\d{3}[- ]?\d{3}"),
    Branch("abn", ("abn",), r"\b\d{2}[- ]?\d{3}[- ]?\d{3}[- ]?\d{3}\b", keep=lambda x, t: ck.is_abn(x["value"]), metadata=_digits, gate=r"\d{3}[- ]?\d{3}"),
    Branch("acn", ("acn",), NINE, keep=lambda x, t: ck.is_acn(x["value"]), metadata=_digits, gate=r"\d{3}[- ]?\d{3}"),
    Branch("medicare", ("medicare",), r"(?<![\d\-])[1-9](?:[\s-]?\d){9}(?![\d\-])", keep=lambda x, t: ck.is_medicare(x["value"]), metadata=_digits, gate=r"\d[\s-]?\d[\s-]?\d[\s-]?\d"),
    Branch("medicare_enrolment", ("medicare_enrolment",), r"\b[1-9]\s\d{4}\s\d{4}\s\d\b", lambda x, t: _pick(ck.is_medicare_enrolment(x["value"]), 0.6, 0.4), metadata=lambda x, t: F.when(ck.is_medicare_enrolment(x["value"]), F.create_map().cast("map<string,string>")).otherwise(meta(checksum=F.lit("failed"))), gate=r"\d{4}\s\d{4}"),
    Branch(
        "credit_card", ("credit_card",), CARD, lambda x, t: _pick(ck.is_credit_card(x["value"]), 1.0, 0.4), gate=r"(?:\d[\s-]?){12}",
        metadata=lambda x, t: F.when(ck.is_credit_card(x["value"]), meta(brand=F.coalesce(ck.card_brand(x["value"]), F.lit("unknown")), length=F.length(ck.digits_only(x["value"])), luhn=ck.luhn(ck.digits_only(x["value"])))).otherwise(meta(checksum=F.lit("failed"))),
    ),
    Branch("iban", ("iban",), r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", lambda x, t: _pick(ck.iban_check(x["value"]), 1.0, 0.4), gate=r"[A-Z]{2}\d{2}"),
    Branch("bsb", ("bsb",), r"\b\d{6}\b", lambda x, t: _pick(_bsb_label(x, t), 1.0, 0.75), lambda x, t: ck.is_bsb(x["value"]) & (_bsb_label(x, t) | after(t, x, 20).rlike(BSB_ACCOUNT)), lambda x, t: meta(context=F.when(_bsb_label(x, t), "label").otherwise("account"))),
    Branch("drivers_licence", ("drivers_licence",), LICENCE, lambda x, t: _pick(_licence_state(x) != "unknown", 1.0, 0.7), lambda x, t: ~F.lower(x["value"]).isin(*LICENCE_STOP), lambda x, t: meta(state_format=_licence_state(x)), group=2, gate=r"(?i)\b(?:d|li)"),
    Branch("passport", ("passport",), r"\b(?![EIO])[A-Z]\d{7}\b", gate=r"[A-Z]\d{7}"),
    Branch("url_credential", ("url_credential",), CREDENTIAL, gate=r"://|[:=]", fold=False),
    Branch("email", ("email",), EMAIL, gate="@"),
    Branch("email_spaced", ("email",), EMAIL_SPACED, 0.9, metadata=lambda x, t: meta(note=F.lit("characters separated by spaces")), gate=r"\s@", trim=r"\s"),
    Branch("phone", ("phone",), PHONE, lambda x, t: _pick(x["p"].rlike("^(?:04|01300|01800)"), 1.0, 0.95), metadata=lambda x, t: meta(normalised=x["p"]), parse=parse_phone, gate=r"\d[\s.()-]*\d[\s.()-]*\d[\s.()-]*\d[\s.()-]*\d[\s.()-]*\d", trim="[.,;:]"),
    Branch("ipv4", ("ipv4",), IPV4, gate=r"\d\.\d", fold=False),
    Branch("ipv6", ("ipv6",), IPV6, gate=r"[A-Fa-f0-9]:|::", fold=False),
    Branch("mac", ("mac",), MAC, gate="[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", fold=False),
    Branch("state_postcode", ("postcode",), STATE_CODE, keep=lambda x, t: ck.valid_postcode(_code(x)), metadata=lambda x, t: meta(postcode=_code(x), state=F.regexp_extract(x["value"], STATE, 0)), gate=STATE),
    Branch("postcode", ("postcode",), r"\b\d{4}\b", 0.75, lambda x, t: ck.valid_postcode(x["value"]) & ~_in_state_pair(x, t) & F.concat(before(t, x, 30), x["value"], after(t, x, 30)).rlike(POST_LABEL), lambda x, t: meta(context=F.lit("label")), gate=POST_LABEL),
    Branch("street_address", ("street_address",), STREET, 0.85, gate=r"\d\s+[A-Za-z]"),
    Branch("street_address", ("street_address",), PO_BOX, 1.0, gate=r"(?i)box"),
    *[
        Branch("date", ("date_au", "date_iso"), p, lambda x, t: _pick(x["p"]["has_year"], 1.0, 0.8), metadata=lambda x, t: meta(iso=x["p"]["iso"], order=x["p"]["order"]), category=lambda x, t: F.when(x["p"]["order"] == "iso", "date_iso").otherwise("date_au"), gate=g, parse=parse_date)
        for p, g in ((DATE_NUMERIC, r"\d[/-]\d"), (DATE_NAMED, r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"))
    ],
)

CHECKED = {"tfn": ck.is_tfn, "abn": ck.is_abn, "acn": ck.is_acn, "medicare": ck.is_medicare, "medicare_enrolment": ck.is_medicare_enrolment, "credit_card": ck.is_credit_card, "iban": ck.iban_check}


def with_checksums(branches: tuple[Branch, ...], required: bool | None) -> tuple[Branch, ...]:
    """The branches with failed check digits dropped (True), kept at 0.4 (False), or as they
    are (None)."""

    def one(b: Branch) -> Branch:
        ok = CHECKED.get(b.detector)
        if ok is None or required is None:
            return b
        if required:
            return replace(b, keep=lambda x, t: ok(x["value"]))
        failed = lambda x, t: F.when(ok(x["value"]), b.metadata(x, t) if b.metadata else F.create_map().cast("map<string,string>")).otherwise(meta(checksum=F.lit("failed")))
        sure = b.confidence if callable(b.confidence) else lambda x, t: F.lit(b.confidence)
        return replace(b, keep=None, confidence=lambda x, t: F.when(ok(x["value"]), sure(x, t)).otherwise(0.4), metadata=failed)

    return tuple(map(one, branches))


# ---- organisations and awards
ORG_SUFFIX = rf"(\b)((?:[A-Z][\w&'’.\-]*\s+){{1,4}}(?:{v.ENTITY}))\b"
ORG_CONTEXT = rf"((?i:{v.EMPLOYMENT})\s+(?:the\s+)?)([A-Z][\w&'’.\-]*(?:\s+[A-Z][\w&'’.\-]*){{0,3}})"


def org_name(raw: Column) -> Column:
    """The name without a leading verb; null where only everyday words are left."""
    name = F.regexp_replace(F.regexp_replace(raw, r"^[ \t.,;:]+|[ \t.,;:]+$", ""), rf"(?i)^(?:(?:{v.TRIGGERS})\s+)+(?=\S)", "")
    words = F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, "^[.,]+|[.,]+$", ""))
    everyday = F.size(F.array_except(words, F.lit(v.GENERIC_WORDS))) == 0
    bad = token_key(name).isin(*v.GENERIC_NAMES) | everyday | F.arrays_overlap(words, F.lit(v.FUNCTION_WORDS))
    return F.when((name != "") & ~bad, name)


def _org(reason: str):
    return lambda x, t: meta(entity=x["value"], reason=F.lit(reason))


ORGANISATION: tuple[Branch, ...] = (
    Branch("organisation_name", ("organisation_name",), ORG_SUFFIX, 0.95, metadata=_org("entity suffix"), group=2, clean=org_name, gate=rf"\s(?:{v.ENTITY})\b"),
    Branch("organisation_name", ("organisation_name",), ORG_CONTEXT, 0.8, metadata=_org("employment context"), group=2, clean=org_name, gate=rf"(?i:{v.EMPLOYMENT})\s+(?:the\s+)?[A-Z]"),
    Branch("organisation_name", ("abn",), r"(?i)\bABN\s*:?\s*\d{1,4}(?:[ -]?\d{1,4}){1,4}\b", 0.95, metadata=lambda x, t: meta(reason=F.lit("employer identifier")), gate="(?i)abn"),
)
AWARD: tuple[Branch, ...] = (Branch("award_code", ("award",), r"(?i)\bMA\d{6}\b", metadata=lambda x, t: meta(code=F.upper(x["value"])), fold=False),)

# ---- quasi-identifiers
BEFORE, AFTER, OCC = v.TENURE_BEFORE, v.TENURE_AFTER, v.OCCUPATIONS
YEARS = r"\d{1,2}(?:\.\d)?\s*\+?\s*years?"


def _cue(x, _):
    return meta(cue=F.lower(x["value"]))


def health_value(raw: Column) -> Column:
    """The longest plausible condition: words up to the first that can't be of one."""
    words = F.split(F.trim(raw), r"\s+")
    plain = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:!?]+|[.,;:!?]+$", "")
    first = F.lower(words[0])
    level = rf"(?i)^(?:{v.APS_LEVEL}|ses|so[0-3]|grade\s*\d{{1,2}}|band\s*[a-z]?\d{{1,2}}|step\s*\d|class\s*\d|category\s*\d)$"
    bad = raw.rlike(level) | first.endswith("ing") | (first.endswith("ed") & ~first.isin(*v.CONDITION_ED)) | gen.is_banded(raw)
    # connectors among NO_HEALTH end it too, as every other function word
    stop = lambda w: (plain(w) == "") | plain(w).isin(*v.NO_HEALTH)
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))
    fold = F.aggregate(words, start, lambda a, w: F.when(a["done"] | stop(w) | (F.size(a["kept"]) >= 4), F.struct(F.lit(True).alias("done"), a["kept"].alias("kept"))).otherwise(F.struct(F.lit(False).alias("done"), F.concat(a["kept"], F.array(w)).alias("kept"))), lambda a: a["kept"])
    text = F.regexp_replace(F.array_join(fold, " "), rf"(?i)(?:\s+(?:{'|'.join(v.HEALTH_CONNECTORS)}))+$", "")
    return F.when(~bad & ~text.rlike(r"^[\d\s]*$") & ~F.lower(text).isin(*v.HEALTH_CONNECTORS), text)


def _quasi(detector: str, *rows) -> list[Branch]:
    return [Branch(detector, (detector,), p, c, metadata=_cue, group=2, gate=g, clean=clean or (lambda r: F.trim(r))) for p, c, g, clean in rows]


JOB_LABEL = rf"(?i)(\b(?:my\s+(?:job\s*title|role|position|occupation)|job\s*title|position\s*title|designation|i\s+(?:am|work|worked)\s+as\s+an?)\s*:?\s*)((?:(?:[a-z]+\s+){{0,2}})(?:{OCC}))\b"
TEAM = rf"(?i)(\b(?:{v.TEAM_NOUN})\b\s*(?:(?:of|with|has|had|was|is|comprising|consisting\s+of)\s*)?(?:just|only|about|around|approximately|roughly)?\s*)({v.COUNT})\s*(?:\+\s*)?(?:\s*(?:people|staff|workers|employees|members|persons|of\s+us|strong))?(?!\s*(?:year|month|week|hour|day|minute))(?![\d:/\-])"
HEALTH = r"(?i)(\b(?:i\s+(?:am|'m|have|suffer\s+from)|my\s+(?:condition|illness|injury|disease|disorder|symptom)s?|diagnosed\s+with|struggling\s+with)\s+(?:(?:is|was|are|were)\s+)?)([A-Za-z0-9][A-Za-z0-9\-']*(?:\s+[A-Za-z0-9][A-Za-z0-9\-']*){0,4})"
QUASI: tuple[Branch, ...] = (
    *_quasi("job_title", (JOB_LABEL, 0.95, None, None), (r"(?i)(\b(?:grade|band|class|category|step|pay\s*point)\s*[:#]?\s*)([a-z]{1,2}\s?\d{1,2}|\d{1,2}[a-z]?)\b", 0.9, None, None), (rf"(?i)(\b)((?:registered|enrolled|senior|junior|trained)?\s*(?:{OCC}))\b", 0.55, None, None)),
    *_quasi(
        "tenure",
        (r"(?i)(\b(?:since|from|started\s+there\s+in|been\s+(?:here|with\s+\w+)\s+since|i\s+(?:joined|started)\s+(?:in|here\s+in))\s+)((?:19|20)\d{2})\b", 0.75, None, None),
        (rf"(?i)(\b{BEFORE}|\b)({YEARS}{AFTER})", 0.85, r"(?i)years?\s", None),
        (rf"(?i)(\b{BEFORE})({YEARS})(?!{AFTER})", 0.85, r"(?i)years?", None),
    ),
    *_quasi("team_size", (TEAM, 0.85, None, None)),
    *_quasi("employment_status", (rf"(?i)(\b(?:i\s+am|i'?m|as)\s+(?:(?:a|an|currently|still|now)\s+)*)({v.STATUS})\b", 0.85, None, None), (rf"(?i)(,\s*|^)({v.STATUS})\s*(?:,|$|\.)", 0.6, None, None)),
    *_quasi("health_detail", (r"(?i)(\b)(anxiety|depression|ptsd|psychological\s+distress|mental\s+health|panic\s+attacks?|burnout|psychosis|psychological\s+safety|mental\s+illness)\b", 0.8, None, health_value), (HEALTH, 0.7, None, health_value)),
)

# ---- gazetteer stage, on raw text
NAME_LABEL = rf"(?i)(\b(?:name|patient|customer|client|employee|staff|member|contact|applicant|claimant|guardian|parent|spouse|next\s*of\s*kin|nok|manager|supervisor|team\s*lead|coordinator|colleague|co-?worker|my\s+boss|boss|colleague'?s?\s*name)\b\s*[:\-]\s*)((?:{v.HONORIFIC}\.?\s+)?[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+){{1,3}})"
PLACE = r"[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+)"


def _name_ok(x, _):
    words = F.split(x["value"], r"\s+")
    capital = F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))
    return (F.size(capital) >= 2) & ~words[0].isin(*v.NAME_STOP)


def _city(yes: float, no: float):
    return lambda x, t: _pick(x["value"].rlike("|".join(v.CITIES)), yes, no)


def _gazetteer(category: str, pattern: str, confidence, keep=None, gate=None, clean=None) -> Branch:
    return Branch("gazetteer", (category,), pattern, confidence, keep, group=2, gate=gate, fold=False, clean=clean, stage="nlp")


GAZETTEER: tuple[Branch, ...] = (
    _gazetteer("name", NAME_LABEL, 0.8, _name_ok),
    _gazetteer("name", rf"(\b)((?:{v.HONORIFIC})\.?\s+[A-Z][a-z'\u2019-]+(?:\s+[A-Z][a-z'\u2019-]+){{1,3}})", 0.75, _name_ok),
    _gazetteer("street_address", r"(?i)(\b(?:address|residential\s*address|home\s*address|mailing\s*address|street|addr\.?)\b\s*[:\-]\s*)([^,;\n]{6,80}?(?:,\s*[A-Z][a-z'\u2019-]+\s+\d{4})?)", 0.7, lambda x, t: F.length(F.trim(x["value"])) >= 6),
    _gazetteer("location", rf"((?i:\b(?:based\s+in|located\s+in|living\s+in|resident\s+in|currently\s+in|from))\s+)({PLACE}{{0,2}})", _city(0.75, 0.6)),
    _gazetteer("location", rf"(\b(?:in|at|on|from)\s+(?:the\s+|our\s+|my\s+)?)({PLACE}?)\s+{v.PLACE_NOUN}\b", _city(0.8, 0.65)),
    _gazetteer("age", r"(?i)((?<![\d-]))(\d{1,3})\s?(?:-|\s)?\s*(?:years?|yrs?)\s*(?:old|of\s+age)(?![\d-])\b", 0.7, lambda x, t: x["value"].cast("int") <= 120),
    _gazetteer("age", r"(?i)(\b(?:i\s+am|i'?m|im|aged|age\s+of)\s+)(\d{1,3})(?![\d-])(?!\s*-)(?!\s?(?:-|\s)?\s*(?:years?|yrs?)\s*(?:old|of\s+age))", 0.7, lambda x, t: x["value"].cast("int") <= 120),
    _gazetteer("gender", r"(?i)(\b(?:sex|gender|dob|date\s*of\s*birth)\b\s*[:\-]\s*)([A-Za-z/ ]{3,20})", 0.7, lambda x, t: F.lower(F.trim(x["value"])).isin("male", "female", "m", "f", "non-binary", "other")),
)

#: Rank of a detector in ties; what isn't listed comes after.
RANK = {name: i for i, name in enumerate(dict.fromkeys(b.detector for b in DOCUMENT if b.detector != "email_spaced"))}


def claimed_in_turn(found: Sequence[Column]) -> Column:
    """Findings of several branches in turn; one that overlaps an earlier one is dropped."""
    each = F.flatten(F.array(*found))
    return F.aggregate(each, F.array().cast(FINDINGS), lambda kept, x: F.when(F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), kept).otherwise(F.concat(kept, F.array(x))))


def detect(text: Column | str, folded: Column | str, branches: Sequence[Branch], categories: frozenset[str] | None = None, known: Cues | None = None) -> Column:
    """array of all findings of the branches that a policy's categories ask for.
    ``folded``: the text aligned, a column of its own so that it is made once.  Both may be
    names, which is quicker to plan; ``known``, the text's cues, is only asked then."""
    wanted = [b for b in branches if categories is None or categories & set(b.categories)]
    if not wanted:
        return F.array().cast(FINDINGS)
    # organisation names claim places in the order of their two patterns
    names = [run(b, text, folded, known) for b in wanted if b in ORGANISATION[:2]]
    rest = [run(b, text, folded, known) for b in wanted if b not in ORGANISATION[:2]]
    return F.flatten(F.array(*rest, *([claimed_in_turn(names)] if names else [])))
