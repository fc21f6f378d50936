"""The lexicon as a table: the same findings by literals, by dictionary and by joins."""

import random

import pytest
from maskwright.operators import lexicon as lx
from maskwright.operators.lexicon import Lexicon, Term
from maskwright.operators.lexicon_table import LexiconTable, deletions, with_joined
from maskwright.plans.api import redact, scan
from maskwright.plans.policy import Policy
from pyspark.sql import functions as F

OWN = (Term("Project Kestrel", aliases=("kestrel tool", "Kestrel")), Term("timesheet"), Term("rosterhub", exact_only=True), Term("payroller"), Term("kestrel tool shed", label="shed"), Term("tool shed", aliases=("timesheet",)))
TEXTS = [
    "ProjectKestrel and the kestrel-tool", "my timeshete, time sheet; timesheets.", "rosterhubb rosterhub", "payrolle payroler payoller", "Project Kestrel timesheet, Kestrel", None, "", "none",
    "kestrel tool shed", "the project kestrel tool shed tool", "Project Kestrel timesheet, Kestrel", "payrrollerr and timshet, ptimesheett", "time sheet tool shed kestrel tool shed",
]


def found(df, column="m"):
    return {r["i"]: sorted((x["start"], x["end"], x["value"], x["category"], x["confidence"], tuple(sorted(x["metadata"].items()))) for x in r[column]) for r in df.collect()}


@pytest.mark.parametrize("most", [0, 1, 2])
def test_three_ways_agree(spark, monkeypatch, most):
    own = Lexicon(OWN, most)
    r = random.Random(most)
    words = ["kestrel", "tool", "shed", "project", "timesheet", "time", "sheet", "payroller", "rosterhub", "timeshet", "and", "payrollr", "ztimesheet", "timesheetxy"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.coalesce("t", F.lit("")).alias("t"))
    coded = found(df.select("i", lx.by_dictionary(F.col("t"), own).alias("m")))
    joined = found(with_joined(df, "t", LexiconTable.of(spark, own), "m"))
    assert joined == coded and sum(map(len, coded.values())) > 100
    if most < 2:
        literal = found(df.select("i", lx.matches(F.col("t"), own).alias("m")))
        assert literal == coded


def test_scan_and_redact_with_a_table(spark):
    own = Lexicon((*OWN, *(Term(f"systemname{i:05d}", exact_only=True) for i in range(20_000))), 2)
    df = spark.createDataFrame([(1, "log in to systemname01234 or ProjectKestrel"), (2, None), (3, "jo@example.com has a timshet")], "i int, t string")
    policy = Policy(survey=True, categories=frozenset(("internal_term", "email")), default_style="label")
    table = LexiconTable.of(spark, own)
    rows = lambda lexicon: sorted((r.i, r.start, r.end, r.category, r.value, r.confidence) for r in scan(df, "i", "t", policy, lexicon).collect())
    assert rows(table) == rows(own) and len(rows(table)) == 4
    assert {r.i: r.redacted for r in redact(df, "t", policy, lexicon=table).collect()} == {r.i: r.redacted for r in redact(df, "t", policy, lexicon=own).collect()}


def test_terms_that_lack_things(spark):
    terms = spark.createDataFrame([(2, "Alpha", None, None, None, None), (1, None, "award", "x", [None, "alpha"], False), (3, "...", None, None, ["", "beta gamma"], None)], "seq long, term string, category string, label string, aliases array<string>, exact_only boolean")
    df = spark.createDataFrame([(1, "alpha betagamma")], "i int, t string")
    assert [(x[2], x[3]) for x in found(with_joined(df, "t", LexiconTable(terms, 1), "m"))[1]] == [("alpha", "award"), ("betagamma", "internal_term")]
    empty = LexiconTable(terms.where("seq > 9"), 1)
    assert found(with_joined(df, "t", empty, "m")) == {1: []}


def test_deletions_are_those_of_the_dictionary(spark):
    for key in ("a", "ab", "aab", "abca"):
        got = spark.range(1).select(deletions(F.lit(key), 2).alias("d")).first()["d"]
        assert set(got) == set(lx.less(key, 2)) and len(got) == len(set(got))
