"""Gates behind the digit: what is left out must not matter, and must be left out."""

import random
import re

from pyspark.sql import functions as F

from maskwright.functions import vocabulary as v
from maskwright.functions.text import FINDINGS, beginnings, headed, spans_sql, treed
from maskwright.operators import detectors as d
from maskwright.operators import risk
from maskwright.operators.cues import Cues, needs_digit
from maskwright.operators.implication import RULES
from maskwright.plans.api import scan


def test_needs_digit_tells_only_what_holds():
    for p in (r"\d{3}", r"(?i)\bMA\d{6}\b", r"a(?:1|2)", r"(?:x\d)+", r"[0-5]x"):
        assert needs_digit(p), p
    for p in (r"\d*a", r"(?:\d|b)", r"a(?=\d)", r"[\da]", r"(?:\d)?b", r"(?<!\d)c", "(?x) \\d", "@"):
        assert not needs_digit(p), p


def test_gates_stand_behind_the_digit(spark):
    behind = [b.detector for b in d.DOCUMENT if Cues("c").test(b.gate or b.pattern, b.pattern)]
    assert len(behind) >= 17 and {"tfn", "phone", "postcode", "street_address"} <= set(behind)
    assert "email" not in behind and "url_credential" not in behind
    assert "`c` AND" in spans_sql("t", r"\d{4}", test="`c` AND ") and "contains(`t`, '@')" in spans_sql("t", d.EMAIL, gate="@")


def test_texts_with_and_without_digits_have_the_same_findings(spark):
    rows = [(0, "mail jo@example.com, password=hunterhunter"), (1, "TFN 123 456 782"), (2, "TFN １２３ ４５６ ７８２"), (3, "PO Box 12, born 4 May 1990"), (4, None), (5, "no such thing"), (6, "VIC 3000 at 12 Wattle Street")]
    df = spark.createDataFrame(rows, "i int, t string")
    found = {(r["i"], r["detector"]) for r in scan(df, "i", "t").collect()}
    assert {(0, "email"), (0, "url_credential"), (1, "tfn"), (2, "tfn"), (3, "street_address"), (3, "date"), (6, "state_postcode"), (6, "street_address")} <= found
    assert not {i for i, _ in found} & {4, 5}


# ---- risk signals behind the beginnings of words
def _one(rng, parsed):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            what, x = rng.choice(arg)
            out += chr(x) if str(what) == "LITERAL" else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": rng.choice(" \t\n\x0b"), "CATEGORY_WORD": rng.choice("aZ9_")}[str(x)]
        elif kind == "BRANCH":
            out += _one(rng, rng.choice(arg[1]))
        elif kind == "SUBPATTERN":
            out += _one(rng, arg[3])
        elif kind == "MAX_REPEAT":
            out += "".join(_one(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert kind == "AT"
    return out


def _signal_texts():
    rng = random.Random(7)
    for name, p in risk.TEXT_SIGNALS.items():
        for _ in range(400):
            s = "".join(rng.choice((c.lower(), c.upper())) if c.isascii() else c for c in _one(rng, re._parser.parse(p)))
            yield name, rng.choice(("", "x ", "(", "é-", "9 hr.")) + s + rng.choice(("", " x", ".", ", é"))


def test_every_match_of_a_signal_has_a_cue():
    assert risk.SIGNAL_CUES.keys() == risk.TEXT_SIGNALS.keys()
    every = sorted({w for ws in risk.SIGNAL_CUES.values() for w in ws})
    # none hides another: not by beginning it, and not by holding its beginning at a word's start
    assert not [(a, b) for a in every for b in every if a != b and re.search(beginnings((a,)), b)]
    n = 0
    for name, t in _signal_texts():
        if re.search(risk.TEXT_SIGNALS[name], t):
            n += 1
            seen = " ".join(re.findall(beginnings(tuple(every)), t))
            assert re.search(beginnings(risk.SIGNAL_CUES[name]), seen), (name, t)
    assert n > 2300


def test_signals_behind_their_cues_are_those_of_the_plain_patterns(spark):
    odd = ["", " ", "no cue", "émanager", "manageré", "Kmanager", "managerK", "İhr", "é manager", "́manager", "émanager", " manager ", "on 3", "on the 3rd", "xon 3", "a_report it", "ManAger", "team\tlead", "team lead", "back stabbing", "backstab", "only only only", "I TOLD", "bullying", "bulls", "hr", None]
    rows = [(i, t) for i, t in enumerate([*odd, *(t for _, t in _signal_texts())])]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    got = F.transform(risk.assess(F.col("t"), F.array().cast(FINDINGS))["signals"], lambda s: s["name"])
    want = F.array_compact(F.array(*[F.when((F.trim("t") != "") & F.col("t").rlike(p), F.lit(n)) for n, p in risk.TEXT_SIGNALS.items()]))
    wrong = df.select("t", F.array_sort(F.array_except(got, F.array(F.lit("short_response")))).alias("got"), F.array_sort(F.coalesce(want, F.array().cast("array<string>"))).alias("want")).where("got <> want").collect()
    assert wrong == []
    assert df.where(risk.cues(F.col("t")) == "").count() >= 5


def test_words_are_counted_and_signals_are_tried_behind_one_pass(spark):
    texts = ["", " ", "one", " two words ", "\tthree\n\nwords \x0b here", "no break", None, "a b ", " a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(risk.word_count(F.col("t"))).collect()] == [0, 0, 1, 2, 3, 1, None, 2, 1]
    plan = df.select(risk.assess(F.col("t"), F.array().cast(FINDINGS)).alias("a"))._jdf.queryExecution().analyzed().toString()
    # the pass over the text once, and no pattern of a signal is tried but behind its cues
    assert plan.count("regexp_extract_all") == 1 and plan.count("wheelchair|indigenous") == 1
    for name, p in risk.TEXT_SIGNALS.items():
        assert re.search(re.escape(beginnings(risk.SIGNAL_CUES[name])) + r"\) AND RLIKE\(t#\d+, " + re.escape(headed(p)), plan), name


# ---- gates of the implication rules
def test_words_of_gates_stand_in_a_tree():
    assert treed(r"(?i)\s(?:store|stores|depot|shut\s?down|yard)\b") == r"(?i)\s(?:(?:depot|s(?:t(?:o(?:r(?:e(?:[s])?))))|yard)|shut\s?down)\b"
    assert treed("(?i)store|stores|depot|yard|Mine") == "(?i)(?:(?:depot|mine|s(?:t(?:o(?:r(?:[e]))))|yard))"
    for same in (r"a\sb|c|d|e|f\b", r"\s(?:a|b|c|d)|(?:e|f)\b", "only", r"(?:a|b)(?:c|d)", r"(?i:ab|cd|ef|gh)\s"):
        assert treed(same) == same
    gates = [b.gate for b in (*d.DOCUMENT, *d.ORGANISATION, *d.QUASI) if b.gate] + ["(?i)" + r.gate for r in RULES]
    words = sorted({w for g in gates for w in re.findall("[A-Za-z]{2,}(?: [a-z]+)*", g)})
    rng = random.Random(3)
    texts = ["".join(rng.choice(("", " ", "x", "-", "\n")) + w[rng.randint(0, 1) * rng.randint(0, 1) :] + rng.choice(("", " ", "s", "."))) for w in words for _ in range(3)]
    for g in gates:
        assert [bool(re.search(g, t)) for t in texts] == [bool(re.search(treed(g), t)) for t in texts], g


def test_gates_of_rules_hold_wherever_the_rules_match(spark):
    """And they ask for what is around a word, so that few texts reach the patterns behind them."""
    flat = lambda p: [w for w in re.findall(r"[A-Za-z][A-Za-z '-]+", p) if len(w) > 2]
    lists = [flat(x) for x in (v.DEPARTMENT, v.DEPARTMENT_QUALIFIED, v.GOVERNMENT, v.WORKPLACE, v.WORKPLACE_STRONG, v.SENIOR, v.OCCUPATION_FAMILY, v.PUBLIC_ROLE, v.CORPORATE, v.INTERNAL, v.RELATION, v.CLEARANCE, v.EVENT, v.COHORT, v.PHASE, v.ROSTER, v.KIND)] + [list(v.SITE_WORDS), ["EL 1", "APS 4", "SES 2", "so2", "O3", "grade 1"]]
    lead = ["the", "I am the", "I am a", "as an", "my", "our", "in the", "since the", "after our", "the only", "only", "only one who", "one of two", "there are three of us left in the", "I work as a", "hold a", "came through the", "told by my", "based in the", "Penrith", "the Acme big", "I'm in the"]
    tail = ["", "on the night shift", "here", "was closed", "Joanne", "in the branch", "at the site", "on our roster", "covers the sites"]
    rng = random.Random(9)
    join = lambda *x: re.sub(" ", lambda _: rng.choice((" ", " ", "  ", "\n")), " ".join(x))
    rows = [(join(rng.choice(lead), rng.choice(("", "", "old ", "big new ")) + rng.choice(rng.choice(lists)), rng.choice(tail)) + rng.choice(("", ".", "s", " x")),) for _ in range(12000)]
    df = spark.createDataFrame(rows, "t string").repartition(4)
    each = [F.count_if(F.col("t").rlike("(?i)" + r.pattern) & x).alias(f"{r.name}_{i}") for r in RULES for i, x in enumerate((F.lit(True), ~F.col("t").rlike("(?i)" + r.gate), ~F.col("t").rlike(treed("(?i)" + r.gate))))]
    got = df.agg(*each).first().asDict()
    assert not [k for k, n in got.items() if not k.endswith("_0") and n]
    assert sum(n > 0 for k, n in got.items() if k.endswith("_0")) >= 20
    held = {r.name: bool(re.search("(?i)" + r.gate, "the newsite restores mypit, storesx")) for r in RULES}
    assert not held["named_site"] and not held["workplace_type"]
