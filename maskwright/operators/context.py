"""Compositional context rules: groups of phrases that must meet in a sentence or paragraph."""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of each group.  Authored here; a deployment gives its own.
GROUPS: dict[str, tuple[str, ...]] = {
    "psych_condition": ("anxiety", "depression", "ptsd", "panic attacks", "adjustment disorder", "psychological injury", "burnout", "insomnia"),
    "causal_marker": ("because of", "caused by", "as a result of", "due to", "after", "since", "led to", "triggered by"),
    "employment_link": ("at work", "my job", "the workplace", "my employer", "my role", "the restructure", "work related"),
    "admin_action": ("performance management", "performance improvement plan", "show cause", "disciplinary", "counselled", "transferred", "demoted", "formal warning", "restructure"),
    "first_person": ("i", "me", "my", "i was", "i am"),
    "person_marker": ("my manager", "my supervisor", "my boss", "he", "she", "the team leader", "a colleague", "a coworker", "the director"),
    "harm_behaviour": ("bullied", "harassed", "humiliated", "threatened", "intimidated", "assaulted", "yelled at", "screamed at", "belittled"),
    "harm_behaviour_soft": ("excluded", "ignored", "undermined", "singled out", "gossiped about", "micromanaged"),
    "protected_attribute": ("pregnant", "disability", "aboriginal", "indigenous", "muslim", "gay", "transgender", "religion", "ethnicity", "age"),
    "frequency_marker": ("every day", "every week", "every shift", "repeatedly", "constantly", "again and again", "for months"),
    "claim_marker": ("claim", "workers compensation", "compensation claim", "claim number", "the insurer"),
    "claim_decision": ("accepted", "declined", "denied", "rejected", "approved", "under review"),
    "capacity_restriction": ("light duties", "suitable duties", "unfit for work", "reduced hours", "return to work", "medical restriction", "certificate of capacity"),
    "third_party_subject": ("a worker", "an employee", "the worker", "the employee", "one of the staff", "a team member"),
    "substance": ("alcohol", "drunk", "cannabis", "drug test", "ice", "opioids", "intoxicated"),
    "consequence": ("stood down", "dismissed", "terminated", "suspended", "sacked", "lost his licence"),
    "self_harm": ("suicide", "suicidal", "kill myself", "self harm", "end my life", "hurt myself"),
    "trauma_material": ("child abuse material", "graphic footage", "fatality", "dead body", "traumatic material", "crash scene"),
    "exposure_verb": ("viewed", "watched", "attended", "exposed to", "witnessed", "saw", "reviewed"),
    "surveillance": ("cameras", "keystroke", "monitoring", "tracked", "gps", "surveillance", "recorded"),
    "surveillance_objection": ("without consent", "not told", "objected", "invasion of privacy", "uncomfortable", "secretly"),
    "uniqueness": ("the only", "only one", "no one else", "the first", "sole"),
    "identity_combinator": ("night shift", "depot", "regional office", "team of", "years of service", "the only woman", "part time", "apprentice"),
    "event": ("incident", "accident", "meeting", "investigation", "restructure", "closure"),
    "confidentiality": ("confidential", "anonymous", "do not tell", "off the record", "please keep this"),
    "enforcement": ("improvement notice", "prohibition notice", "prosecuted", "the regulator", "enforceable undertaking", "fined"),
    "fdv": ("domestic violence", "family violence", "intervention order", "violent partner", "abusive partner"),
    "quote_frame": ("he said", "she said", "told me", "called me", "said to me", "shouted"),
    "slur_threat": ("useless", "idiot", "stupid", "kill you", "watch your back", "you people"),
    "reasonable_adjustment": ("reasonable adjustment", "workplace adjustment", "flexible hours", "sit stand desk", "modified duties"),
    "denial": ("refused", "denied", "rejected", "ignored", "not approved", "knocked back"),
    "third_party_role": ("manager", "supervisor", "director", "colleague", "team leader", "nurse", "officer"),
    "business_as_usual": ("policy states", "training module", "toolbox talk", "annual refresher", "fact sheet", "guidance material"),
    "negation": ("never", "not been", "no one has", "was not", "did not", "have not"),
    "service_context": ("customers", "clients", "patients", "members of the public"),
}
NAME = "@capitalised_name"
# Capitalised words that are no names.
NAME_STOP = frozenset(
    """january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    the this that these those there their they them then than when where which while who why how my our your his her its we i he she you it
    after before since until because however although despite during following whs src aps ses hr gp eap art aat nsw vic qld wa sa tas act nt
    australia australian commonwealth code regulations section part division clause""".split()
)
CEILING = {"clause": 15, "sentence": 80, "paragraph": 400}


@dataclass(frozen=True)
class Rule:
    """Every element of ``all_of`` is a choice of groups; each needs a phrase of its own,
    not overlapping, all within ``most`` tokens of a unit."""

    id: str
    name: str
    all_of: tuple[tuple[str, ...], ...]
    unit: str = "sentence"
    guards: tuple[str, ...] = ("business_as_usual",)
    action: tuple[str, ...] = ("escalate",)
    weight: float = 0.2
    most: int | None = None

    @property
    def ceiling(self) -> int:
        return self.most or CEILING[self.unit]


# The rules.
RULES: tuple[Rule, ...] = (
    Rule("SC-01", "Condition caused by work", (("psych_condition",), ("causal_marker", "employment_link")), "sentence", ("business_as_usual", "negation"), ("escalate", "tokenise"), 0.18),
    Rule("SC-02", "Reasonable administrative action fact pattern", (("admin_action",), ("psych_condition",), ("causal_marker", "employment_link", "first_person")), "paragraph", ("business_as_usual",), ("escalate", "restrict"), 0.3),
    Rule("SC-03", "Behaviour directed at a person", (("harm_behaviour", "harm_behaviour_soft"), ("person_marker", "first_person")), "clause", ("business_as_usual", "negation", "service_context"), ("escalate", "label_clause"), 0.22),
    Rule("SC-04", "Attribute-based harassment", (("harm_behaviour", "harm_behaviour_soft"), ("protected_attribute",)), "sentence", ("business_as_usual", "negation", "service_context"), ("escalate", "generalise"), 0.2),
    Rule("SC-05", "Repeated behaviour against a person", (("harm_behaviour", "harm_behaviour_soft"), ("frequency_marker",), ("person_marker", "first_person")), "sentence", ("business_as_usual", "negation", "service_context"), ("escalate", "label_clause"), 0.2),
    Rule("SC-06", "Claim-linked health information", (("claim_marker",), ("psych_condition", "capacity_restriction"), ("first_person", "claim_marker")), "sentence", ("business_as_usual",), ("escalate", "mask", "tokenise"), 0.25),
    Rule("SC-07", "Case history disclosure", (("claim_marker",), ("claim_decision",)), "sentence", ("business_as_usual",), ("escalate", "mask"), 0.22),
    Rule("SC-08", "Third-party capacity or restriction", (("capacity_restriction",), ("person_marker", NAME, "third_party_subject")), "sentence", ("business_as_usual",), ("escalate", "tokenise", "mask"), 0.2),
    Rule("SC-09", "Substance and consequence", (("substance",), ("consequence", "admin_action")), "sentence", ("business_as_usual", "negation"), ("escalate", "restrict"), 0.25),
    Rule("SC-10", "Self-harm content", (("self_harm",),), "sentence", (), ("suppress", "escalate", "restrict"), 0.4),
    Rule("SC-11", "Traumatic material exposure", (("trauma_material",), ("exposure_verb",), ("first_person", "person_marker")), "sentence", ("business_as_usual",), ("escalate", "tokenise", "suppress"), 0.25),
    Rule("SC-12", "Surveillance objection", (("surveillance",), ("surveillance_objection", "first_person")), "sentence", ("business_as_usual",), ("keep", "escalate"), 0.15),
    Rule("SC-13", "Protected attribute uniqueness", (("protected_attribute",), ("uniqueness",)), "sentence", ("business_as_usual",), ("escalate", "generalise"), 0.22),
    Rule("SC-14", "Quasi-identifier accumulation", (("identity_combinator",), ("identity_combinator",), ("event", "psych_condition", "uniqueness", "third_party_subject")), "sentence", ("business_as_usual",), ("escalate", "generalise"), 0.2),
    Rule("SC-15", "Confidentiality request with a named role", (("confidentiality",), ("person_marker", "identity_combinator")), "sentence", (), ("escalate", "restrict"), 0.35),
    Rule("SC-16", "Enforcement exposure with a person or site", (("enforcement",), ("person_marker", "identity_combinator", "first_person")), "paragraph", ("business_as_usual",), ("escalate", "mask"), 0.22),
    Rule("SC-17", "Family and domestic violence disclosure", (("fdv",),), "paragraph", ("business_as_usual",), ("suppress", "escalate", "restrict"), 0.4),
    Rule("SC-18", "Quoted abuse or threat", (("quote_frame",), ("slur_threat",), ("person_marker", "first_person")), "clause", ("business_as_usual", "service_context"), ("escalate", "label_clause", "suppress"), 0.22),
    Rule("SC-19", "Performance and condition about a named worker", (("admin_action",), ("psych_condition",), (NAME, "third_party_subject")), "paragraph", ("business_as_usual",), ("escalate", "mask", "tokenise"), 0.25),
    Rule("SC-20", "Adjustment denied or refused", (("reasonable_adjustment",), ("psych_condition", "capacity_restriction"), ("denial",)), "sentence", ("business_as_usual",), ("escalate",), 0.2),
    Rule("SC-21", "Third-party role plus name", (("third_party_role",), (NAME,)), "clause", ("business_as_usual",), ("escalate", "mask"), 0.2, most=6),
)


def validate(rules=RULES, groups=GROUPS) -> None:
    """Raises on a rule that names an unknown group or unit, or has no element."""
    for r in rules:
        unknown = {g for e in (*r.all_of, r.guards) for g in e} - {*groups, NAME}
        if unknown or not r.all_of or r.unit not in CEILING:
            raise ValueError(f"{r.id}: unknown groups {', '.join(sorted(unknown)) or 'none'}, {len(r.all_of)} elements, unit {r.unit}")


def rules_from_json(text: str) -> tuple[tuple[Rule, ...], dict[str, tuple[str, ...]]]:
    """(rules, groups) of ``{"rules": [{"id", "name", "all_of", "proximity", "guards", "action",
    "risk_weight", "max_words_between"}], "groups": {name: [phrase]}}``; what a rule leaves out has
    its default, and without groups those of this module hold."""
    d = json.loads(text)
    groups = {k: tuple(v) for k, v in d["groups"].items()} if d.get("groups") else GROUPS
    rules = tuple(Rule(r["id"], r.get("name", r["id"]), tuple(map(tuple, r["all_of"])), r.get("proximity", "sentence"), tuple(r.get("guards", ())), tuple(r.get("action", ("escalate",))), float(r.get("risk_weight", 0.2)), r.get("max_words_between")) for r in d["rules"])
    validate(rules, groups)
    return rules, groups


class Phrases:
    """Every occurrence of every group's phrases in one pass over a text, overlapping ones
    included: their patterns by first word, tried at each word.  Case does not matter, any white
    space stands between the words of a phrase, and both ends are word edges."""

    def __init__(self, groups: dict[str, tuple[str, ...]]):
        self.first: dict[str, list[tuple[re.Pattern, str]]] = {}
        for group, phrases in groups.items():
            for p in phrases:
                words = p.lower().split()
                lead = re.match(r"\w+|\W", words[0])[0]
                whole = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, words)) + r"(?!\w)", re.I)
                self.first.setdefault(lead, []).append((whole, group))
        self.leads = re.compile(r"\w+|[^\w\s]")

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, group) by start."""
        out = []
        for m in self.leads.finditer(text):
            for whole, group in self.first.get(m[0].lower(), ()):
                if hit := whole.match(text, m.start()):
                    out.append((m.start(), hit.end(), group))
        return out


def names(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Capitalised words that neither begin a sentence nor are known not to be names."""
    out = []
    starts = [a for a, _ in units]
    for m in re.finditer(r"\b[A-Z][a-z]{2,}\b", text):
        i = bisect_right(starts, m.start()) - 1
        before = text[units[i][0] if i >= 0 else 0 : m.start()].rstrip()
        if before and before[-1] not in ".!?" and m[0].lower() not in NAME_STOP:
            out.append((m.start(), m.end(), NAME))
    return out


def tightest(phrases: list[tuple[int, int, int]], elements: int, tokens: list[int], ceiling: int) -> tuple[int, int, int] | None:
    """(start of the first element's phrase, start, end) of the window with the fewest tokens
    that has a phrase for each element, none overlapping; None if none is within the ceiling.

    phrases: (start, end, bits of the elements it can stand for) by start.  One sweep keeps,
    for each set of elements, the chain of phrases that has ended and starts latest: of the
    windows that end with a given phrase that one is the tightest.  So all phrases count,
    and the work grows with their number, not with the product of the choices.  Of equal
    windows the first stands.
    """
    every = (1 << elements) - 1
    done: dict[int, tuple[int, int]] = {}  # elements -> (start of the chain, the first element's phrase)
    open_: list[tuple[int, int, int, int]] = []
    best: tuple[int, int, int, int] | None = None
    for start, end, can in phrases:
        while open_ and open_[0][0] <= start:
            _, had, first, anchor = heapq.heappop(open_)
            if had not in done or first > done[had][0]:
                done[had] = (first, anchor)
        for i in range(elements):
            if not can >> i & 1:
                continue
            for had, (first, anchor) in ((0, (start, -1)), *done.items()):
                if had >> i & 1:
                    continue
                now = (end, had | 1 << i, first, start if i == 0 else anchor)
                if now[1] != every:
                    heapq.heappush(open_, now)
                    continue
                gap = bisect_left(tokens, end) - bisect_left(tokens, first)
                if gap <= ceiling and (best is None or gap < best[0]):
                    best = (gap, now[3], first, end)
    return best[1:] if best else None


@dataclass
class Scanner:
    rules: tuple[Rule, ...] = RULES
    groups: dict[str, tuple[str, ...]] = field(default_factory=lambda: GROUPS)

    def __post_init__(self):
        validate(self.rules, self.groups)
        self.phrases = Phrases(self.groups)
        self.served = [{g: sum(1 << i for i, e in enumerate(r.all_of) if g in e) for e in r.all_of for g in e} for r in self.rules]
        self.named = any(NAME in s for s in self.served)

    def scan(self, text: str) -> Iterator[tuple[str, int, int, str | None]]:
        """(rule, start, end, guard) of each place where a rule holds, once per anchor;
        guard is the group that cancels it, if one does."""
        sentences = [m.span() for m in re.finditer(r"[^.!?\n]+[.!?]*", text)]
        found = self.phrases.find(text)
        if self.named:
            found = sorted(found + names(text, sentences))
        if not found:
            return
        units = {"sentence": sentences, "clause": sentences, "paragraph": [m.span() for m in re.finditer(r"[^\n]+", text)]}
        tokens = [m.start() for m in re.finditer(r"[A-Za-z0-9']+", text)]
        within: dict[str, dict[int, list]] = {}
        for kind in ("sentence", "paragraph"):
            starts, held = [a for a, _ in units[kind]], {}
            for p in found:
                i = bisect_right(starts, p[0]) - 1
                if i >= 0 and p[1] <= units[kind][i][1]:
                    held.setdefault(i, []).append(p)
            within[kind] = held
        within["clause"] = within["sentence"]
        opens, seen = [a for a, _ in sentences], set()
        for r, served in zip(self.rules, self.served, strict=True):
            for _, here in sorted(within[r.unit].items()):
                mine = [(s, e, served[g]) for s, e, g in here if g in served]
                got = tightest(mine, len(r.all_of), tokens, r.ceiling) if mine else None
                if got is None or (r.id, got[0]) in seen:
                    continue
                seen.add((r.id, got[0]))
                beside = within["sentence"].get(bisect_right(opens, got[0]) - 1, ())
                yield r.id, got[1], got[2], next((g for g in r.guards if any(x == g for _, _, x in beside)), None)


@lru_cache(4)
def _scanner(rules, groups) -> Scanner:
    return Scanner(rules, dict(groups))


def context_findings(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES, groups: dict[str, tuple[str, ...]] = GROUPS, cancelled: bool = False) -> DataFrame:
    """``id_col, rule, name, start, end, actions, weight``; with ``cancelled`` also what a guard
    cancels, and ``guard``, the group that did (null: a finding).

    An Arrow map without a shuffle: one pass over a text finds the phrases of all groups,
    which a gate of regular expressions, group by group, would cost more than.  Null and
    blank texts have none; other columns are not read.
    """
    by_id, key = {r.id: r for r in rules}, (rules, tuple(sorted(groups.items())))
    validate(rules, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(*key)
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for rule, a, b, guard in s.scan(text.as_py() or ""):
                    r = by_id[rule]
                    of.append(i)
                    rows.append((rule, r.name, a, b, ",".join(r.action), r.weight, guard))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[batch.schema.names[0], "rule", "name", "start", "end", "actions", "weight", "guard"])

    src = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    out = src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, rule string, name string, start int, end int, actions string, weight double, guard string")
    return out if cancelled else out.where("guard is null").drop("guard")


def rule_counts(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rule, n`` hits per rule, rules without any included; of findings with their
    ``guard`` also ``cancelled``, what guards took."""
    every = found.sparkSession.createDataFrame([(r.id,) for r in rules], "rule string")
    guarded = "guard" in found.columns
    hit = F.col("guard").isNull() if guarded else F.lit(True)
    counts = [F.count(F.when(hit, 1)).alias("n"), *([F.count(F.when(~hit, 1)).alias("cancelled")] if guarded else [])]
    names_ = ["n", "cancelled"][: len(counts)]
    return every.join(found.groupBy("rule").agg(*counts), "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in names_])
