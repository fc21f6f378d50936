"""Word sequences that identify a person or a workplace, as a table of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import FINDING, FINDINGS, finding, meta, quoted, spans, spans_sql
from .cues import Cues
from .detectors import claimed_in_turn


@dataclass(frozen=True)
class Implication:
    """The match, its trailing white space trimmed, is the finding.  ``gate``: words of
    which one must be in the text before the pattern, which may backtrack, is tried."""

    name: str
    pattern: str
    label: str
    confidence: float = 0.8
    implicates: str = "person"
    gate: str = ""


# The rules.
_W2, _W3 = r"(?:\w+\s+){0,2}", r"(?:\w+\s+){0,3}"
_P, _WORK = "person", "workplace"
RULES: tuple[Implication, ...] = (
    Implication("only_one_on_team", rf"(?:the\s+)?only\s+{_W2}?{v.KIND}(?:\s+(?:{v.ROLE}))?\s+(?:in|on|of|at)\s+(?:{v.ARTICLE}\s+)?{_W2}{v.ROSTER}", "claims to be the only person of their kind in a named group", gate=r"only\s"),
    Implication("one_of_n", rf"one\s+of\s+(?:just\s+|only\s+)?{v.FEW}\s+{_W2}(?:on|in|of|at)\s+(?:{v.ARTICLE}\s+)?{v.ROSTER}", "states membership of a very small named group", gate=r"one\s+of"),
    Implication("sole_holder", rf"(?:i\s+am|i'?m|the)\s+(?:sole|only|lone)\s+{_W2}?(?:{v.ROSTER}|{v.ROLE})", "describes sole responsibility for a group or role", gate=r"\b(?:sole|only|lone)\s"),
    Implication("no_one_else", r"(?:no\s+one\s+else|not\s+anyone\s+else|nobody\s+else)(?:\s+\w+){0,3}", "claims no one else shares this duty", gate="else"),
    Implication("unique_attribute", rf"(?:{v.SELF}\s+)?the\s+{v.PHASE}\s+{_W2}(?:here|(?:on|at|in)\s+the(?:\s+\w+)?)", "identifies by comparative age or seniority within a group", gate=rf"the\s+{v.PHASE}\s"),
    Implication("only_one_does", rf"(?:the\s+)?only\s+one\s+(?:who\s+|that\s+|to\s+)?{_W3}?(?:does|do|did|handles|covers|operates|runs|starts)(?:\s+the\s+[\w'’-]+(?:\s+[\w'’-]+){{0,2}})?", "claims a unique duty", gate=r"only\s+one"),
    Implication("shift_group", rf"(?:the\s+)?(?<![\d-])(?:\d{{1,2}}|{v.FEW})\s+(?:people|staff|workers|employees|members|of\s+us)\s+(?:on|across|covering)\s+(?:{v.ARTICLE}\s+)?{_W2}{v.SHIFT}", "describes the size of a named shift group", 0.75, gate="people|staff|workers|employees|members|of us"),
    Implication("covers_sites", rf"{v.SELF}\s+(?:the\s+)?(?:sole|only|entire)?\s*\w*\s*(?:cover|covering|covers)\s+(?:all\s+)?(?:{v.ARTICLE}\s+)?{_W2}?(?:sites|depots|stores|branches|locations|facilities)", "describes sole coverage of several workplaces", implicates=_WORK, gate="cover"),
    Implication("unique_training", rf"(?:the\s+)?only\s+one\s+(?:here|on\s+the\s+\w+|at\s+the\s+\w+)\s+(?:who|that|to)\s+{_W3}?(?:trained|certified|qualified|ticketed)", "states a unique qualification in a group", gate=r"only\s+one"),
    Implication("post_event", rf"(?:after|since|when|following|post)\s+(?:the|our)\s+{_W2}{v.EVENT}", "anchors the response to a workplace event", 0.75, _WORK, gate=r"(?:after|since|when|following|post)\s+(?:the|our)\s"),
    Implication("named_site", rf"(?!(?i:{v.NO_NAME})\s)(?-i:[A-Z])[A-Za-z'’-]+(?:\s+[A-Za-z'’-]+){{0,2}}\s+{v.SITE}\b", "names a workplace site", 0.7, _WORK, gate=rf"\b{v.SITE}\b"),
    Implication("site_change", r"(?:when|after|since)\s+(?:they|we|the\s+company|it|the\s+\w+)\s+(?:was|were|is|are|got|got\s+)?\s*(?:closed|moved|sold|merged|renamed|demolished|reopened|shut\s?down)", "describes a change to a specific site", implicates=_WORK, gate=r"closed|moved|sold|merged|renamed|demolished|reopened|shut\s?down"),
    Implication("named_site_lowercase", rf"(?:work\s+out\s+of|based\s+(?:in|at)|site\s+is|located\s+(?:at|in)|posted\s+to)\s+(?:the\s+|our\s+|my\s+)?[a-z][a-z'’-]+(?:\s+[a-z][a-z'’-]+){{0,2}}\s+{v.SITE}\b", "names a workplace site without capitalisation", 0.65, _WORK, gate=r"out\s+of|based|site\s+is|located|posted"),
    Implication("internal_thing", rf"\b(?:the|our|my|your|his|her|its|their)\b\s+(?:{v.NO_VERB}\w+\s+){{0,2}}?{v.INTERNAL}", "describes an internal system or process", 0.65, _WORK, gate=rf"\b{v.INTERNAL}"),
    Implication("names_third_party", rf"(?:my|our|his|her|their)\s+{_W2}{v.RELATION}\s+(?-i:[A-Z])[A-Za-z'’\-]+", "names a colleague by role and name", 0.9, gate=rf"\b{v.RELATION}\s"),
    Implication("reported_by", rf"(?:told|said|reported|mentioned)\s+(?:it\s+)?(?:to|by)\s*(?:{v.ARTICLE}\s+)?{_W2}{v.RELATION}(?:\s+(?-i:[A-Z])[A-Za-z'’\-]+)?", "attributes a statement to a specific person", 0.7, gate="told|said|reported|mentioned"),
    # anchored at a word, so "upgrade 2" has no grade
    Implication("classification", r"\b(?:pay\s*)?(?:grade|band|step|category|classification)\s*[:#]?\s*[a-z]?\d{1,2}\b(?:\s+(?:increment|point|salary|rate))?", "states a pay grade or classification, unique within an employer", 0.85, gate="grade|band|step|category|classification"),
    Implication("department_structure", rf"\b(?:my|our|the|his|her)\b\s+(?!(?:{v.NO_MODIFIER})\s)(?:{_W3}?{v.DEPARTMENT}|{v.NO_SERVICE}{v.NO_VERB}(?:\w{{3,}}\s+){{1,2}}{v.DEPARTMENT_QUALIFIED})\b(?:\s+(?:of|for)\s+(?:the\s+)?\w+){{0,2}}?", "identifies the respondent by their department or branch", 0.7, _WORK, gate=rf"\b(?:{v.DEPARTMENT}|{v.DEPARTMENT_QUALIFIED})\b"),
    Implication("unit_by_preposition", rf"\b(?:in|at|within|across|into)\s+(?:(?:the\s+|a\s+|an\s+|my\s+|our\s+)?{_W3}?{v.DEPARTMENT}|(?:the\s+|a\s+|an\s+|my\s+|our\s+){v.NO_SERVICE}{v.NO_VERB}(?:\w{{3,}}\s+){{1,2}}{v.DEPARTMENT_QUALIFIED})\b", "identifies an administrative unit by preposition", 0.65, _WORK, gate=rf"\b(?:{v.DEPARTMENT}|{v.DEPARTMENT_QUALIFIED})\b"),
    Implication("government_process", rf"\b(?:the|our|my|a|an)\b\s+{_W2}?{v.GOVERNMENT}", "describes an administrative act that only happens in government", 0.7, _WORK, gate=rf"\b{v.GOVERNMENT}"),
    Implication("workplace_type", rf"(?:\b(?:our|my|their|its)\b\s+{v.WORKPLACE}\b|\b(?:the|a|an)\b\s+{v.WORKPLACE_STRONG}\b)(?:\s+(?:in|at|near)\s+(?:the\s+)?\w+){{0,2}}?", "identifies the type of workplace without naming it", 0.65, _WORK, gate=rf"\b(?:{v.WORKPLACE}|{v.WORKPLACE_STRONG})\b"),
    Implication("senior_role", rf"\b(?:i\s+am|i'?m|as)\b\s+(?:the\s+|a\s+|an\s+)?{v.SENIOR}\b(?:\s+of\s+(?:the\s+)?\w+){{0,2}}?", "names a role that has very few holders in any organisation", gate=rf"\b{v.SENIOR}\b"),
    Implication("occupation_family", rf"\b(?:i\s+am|i'?m|as|works?\s+as\s+an?|my\s+(?:role|title|job|position)\s+is)\b\s+(?:a\s+|an\s+|the\s+)?{v.OCCUPATION_FAMILY}\b", "names a specific occupation family", 0.7, gate=rf"\b{v.OCCUPATION_FAMILY}\b"),
    Implication("occupation_with_structure", rf"(?:a|an|the)\s+{v.PUBLIC_ROLE}\s+(?:in|at|with)\s+(?:the\s+|my\s+)?{_W2}{v.DEPARTMENT}", "an occupation inside a named unit identifies one person", 0.85, gate=rf"\b{v.PUBLIC_ROLE}\s"),
    Implication("aps_level", rf"(?:a|an|as\s+an?)\s+{v.APS_LEVEL}\b(?:\s+(?:in|at|of)\s+(?:the\s+|my\s+)?{_W2}{v.DEPARTMENT})?", "states an APS officer level, usually unique within a branch", 0.85, gate=rf"\b{v.APS_LEVEL}\b"),
    Implication("aps_level_alone", rf"{v.APS_LEVEL}\b(?:[,.;:]\s*|\s+(?:officer|role|classification|position)?)", "states an APS officer level", 0.7, gate=rf"{v.APS_LEVEL}\b"),
    Implication("seniority_in_unit", rf"(?:one\s+of|there\s+are|only)\s+(?:just\s+|only\s+)?{v.FEW}\s+(?:of\s+us\s+|of\s+them\s+|people\s+|of\s+|left\s+|remaining\s+)*{_W2}?(?:{v.APS_LEVEL}s?\b|(?:{v.OCCUPATION_FAMILY})s?\b|senior|junior|acting|permanent|provisional|others?|ones?|us)?(?:\s+(?:in|of|on)\s+(?:the\s+|my\s+)?(?:{_W3}?{v.DEPARTMENT}|{_W2}{v.DEPARTMENT_QUALIFIED}|{_W2}{v.ROSTER}))?", "states seniority within a small named unit", 0.85, gate=rf"(?:one\s+of|there\s+are|only)\s+(?:just\s+|only\s+)?{v.FEW}\s"),
    Implication("cohort_marker", rf"\b(?:i\s+am|i'?m|came\s+through|am)\b\s+(?:part\s+of\s+|through\s+|in\s+|on\s+)?{v.COHORT}\b", "places the respondent in a small named cohort", 0.75, gate="cohort|intake|team|site|secondment|manager"),
    Implication("clearance", rf"\b(?:i\s+(?:am|'m|hold|have)|my|(?:to\s+)?get|hold)\b\s+(?:a\s+|an\s+|the\s+)?{v.CLEARANCE}\s*(?:{v.CLEARANCE_LEVEL}\b)?", "names a security clearance level", 0.9, gate=v.CLEARANCE),
    Implication("corporate_marker", rf"\b(?:our|my|the|a|an)\b\s+{_W2}?{v.CORPORATE}", "identifies a corporate setting", 0.65, _WORK, gate=rf"\b{v.CORPORATE}"),
)


def rule_spans(text: Column | str, folded: Column | str, rule: Implication, known: Cues | None = None) -> Column:
    pattern, gate = "(?i)" + rule.pattern, "(?i)" + (rule.gate or rule.pattern)
    if isinstance(text, str) and isinstance(folded, str):  # names: the same in one SQL text
        end = "x.start + length(regexp_replace(x.value, '\\\\s+$', ''))"
        facts = ", ".join(quoted(v) for kv in (("rule", rule.name), ("label", rule.label), ("implicates", rule.implicates)) for v in kv)
        parts = f"'start', x.start, 'end', {end}, 'category', 'implication', 'detector', 'implication', 'stage', 'deterministic', 'confidence', {rule.confidence}D, 'value', substring(`{text}`, x.start + 1, {end} - x.start), 'metadata', map({facts})"
        return F.expr(f"transform({spans_sql(folded, pattern, 0, gate, known.test(gate, pattern) if known else '')}, x -> CAST(named_struct({parts}) AS {FINDING}))")
    found = spans(folded, pattern, gate=gate)

    def make(x):
        end = x["start"] + F.length(F.regexp_replace(x["value"], r"\s+$", ""))
        y = F.struct(x["start"].alias("start"), end.alias("end"), x["value"].alias("value"))
        return finding(y, "implication", "implication", rule.confidence, meta(rule=F.lit(rule.name), label=F.lit(rule.label), implicates=F.lit(rule.implicates)), text=text)

    return F.transform(found, make)


def implications(text: Column | str, folded: Column | str, implicates: frozenset[str] = frozenset((_P, _WORK)), rules: tuple[Implication, ...] = RULES, known: Cues | None = None) -> Column:
    """Findings of the rules, surest first, each keeping clear of those before it."""
    live = [r for r in sorted(rules, key=lambda r: -r.confidence) if r.implicates in implicates]
    if not live:
        return F.array().cast(FINDINGS)
    return claimed_in_turn([rule_spans(text, folded, r, known) for r in live])


def describe(rules: tuple[Implication, ...] = RULES) -> list[dict]:
    """What each rule says, for a report."""
    return [{"rule": r.name, "label": r.label, "confidence": r.confidence, "implicates": r.implicates} for r in rules]
