"""Detectors, resolution, rewriting, risk, residual and context on records with known results."""

import itertools
import json
import random
import re

import maskwright as mw
import pytest
from maskwright.functions import checks as ck
from maskwright.functions import vocabulary
from maskwright.operators import context, implication, residual
from maskwright.operators.lexicon import Lexicon, Term, by_dictionary, join_matches
from maskwright.operators.lexicon import matches as lexicon_matches
from maskwright.plans.api import free_text_columns, persistable, redact, redact_frame, scan, summary
from maskwright.plans.corpus import generate, outcomes, recall, report
from maskwright.plans.policy import Policy, survey_policy
from maskwright.plans.queries import redact_conversations_triage
from pyspark.sql import functions as F

FOUND = {
    "Call 0412 345 678 or (03) 9123 4567.": {("phone", "0412 345 678"), ("phone", "(03) 9123 4567")},
    "jo.b@example.com from 10.1.2.3, version 1.2.3.4": {("email", "jo.b@example.com"), ("ipv4", "10.1.2.3")},
    "j a n e @ e x a m p l e . c o m": {("email", "j a n e @ e x a m p l e . c o m")},
    "TFN 123 456 782, ABN 64 004 085 616, ACN 004 085 616": {("tfn", "123 456 782"), ("abn", "64 004 085 616"), ("acn", "004 085 616")},
    "TFN 123 456 789": set(),
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112": {("credit_card", "4111 1111 1111 1111"), ("credit_card", "4111 1111 1111 1112")},
    "born 12/03/1985, not 31/02/2024, met 3 March 2021": {("date_au", "12/03/1985"), ("date_au", "3 March 2021")},
    "on 2021-03-04": {("date_iso", "2021-03-04")},
    "12 Smith Street, NSW 2000; postcode 3000; year 3000": {("street_address", "12 Smith Street"), ("postcode", "NSW 2000"), ("postcode", "3000")},
    "BSB 062000 acct; 062000 alone is far away from any such label at all, 062001": {("bsb", "062000")},
    "driver licence: 12345678, passport N1234567, E1234567": {("drivers_licence", "12345678"), ("passport", "N1234567")},
    "MAC 00:1A:2B:3C:4D:5E, 2001:db8:0:0:0:0:0:1": {("mac", "00:1A:2B:3C:4D:5E"), ("ipv6", "2001:db8:0:0:0:0:0:1")},
    "password=hunter2hunter": {("url_credential", "password=hunter2hunter")},
    "０４１２ ３４５ ６７８": {("phone", "０４１２ ３４５ ６７８")},
    "GB82WEST12345698765432": {("iban", "GB82WEST12345698765432")},
    "nothing at all here": set(),
    "": set(),
    None: set(),
}


def test_document_detectors(spark):
    texts = list(FOUND)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {i: set() for i in range(len(texts))}
    for r in scan(df, "i", "t").collect():
        got[r.i].add((r.category, r.value))
        assert texts[r.i][r.start : r.end] == r.value and r.stage == "deterministic"
    for i, t in enumerate(texts):
        if t and "far away" in t:
            assert ("bsb", "062000") in got[i]
        else:
            assert got[i] == FOUND[t], t


SURVEY = {
    "I am the only woman on the night shift at Acme Pty Ltd.": {("implication", "the only woman on the night shift"), ("organisation_name", "Acme Pty Ltd")},
    "My timeshete and the time sheet": {("internal_term", "timeshete"), ("internal_term", "the time sheet")},
    "I have depression.": {("health_detail", "depression")},
    "I have family here and CO2 levels rise after the upgrade 2": set(),
    "They pay under MA000077.": {("award", "MA000077")},
    "team of five": {("team_size", "five")},
    "the Safety Committee met": set(),
}


def test_survey_detectors(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SURVEY)], "i int, t string")
    got = {i: set() for i in range(len(SURVEY))}
    for r in scan(df, "i", "t", survey_policy()).collect():
        got[r.i].add((r.category, r.value))
    for i, (t, want) in enumerate(SURVEY.items()):
        if "Safety Committee" in t:
            assert all(c == "internal_term" for c, _ in got[i])
        else:
            assert want == got[i], t


def test_styles_and_idempotence(spark):
    df = spark.createDataFrame([("mail jo@example.com, ring 0412 345 678",), (None,), ("  ",)], "t string")
    for style, want in (("label", "mail [EMAIL], ring [PHONE]"), ("remove", "mail , ring "), ("mask", "mail **************, ring **** *** ***"), ("partial", "mail **********.com, ring ******** 678")):
        once = redact(df, "t", Policy(default_style=style))
        assert [r.redacted for r in once.collect()] == [want, None, "  "]
    salt = bytes(range(32))
    tokens = redact(df, "t", Policy(default_style="token", salt=salt)).select("redacted")
    again = redact(tokens.withColumnRenamed("redacted", "t"), "t", Policy(default_style="token", salt=salt))
    assert [r.redacted for r in again.collect()] == [r.t for r in again.collect()]
    with pytest.raises(Exception, match="strict"):
        redact(df, "t", Policy(default_style="remove", strict=True)).collect()
    assert summary_of(redact(df, "t")) == "2 findings (2 deterministic, 0 nlp): email=1, phone=1"


def summary_of(df):
    return df.select(summary(F.col("findings")).alias("s")).first().s


def test_policy():
    p = Policy(categories=frozenset(("email",)), salt=b"x", styles={"email": "hash"})
    assert Policy.from_json(p.to_json()) == p
    for bad in ({"categories": frozenset(("nope",))}, {"default_style": "nope"}, {"salt": "zz"}):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(i, f"ring 04{i:08d} or jo{i}@example.com") for i in range(40)], "i int, t string")
    one, many = (sorted(map(str, scan(df.repartition(n), "i", "t").drop("metadata").collect())) for n in (1, 7))
    assert one == many and len(one) == 80


def test_redact_frame_and_risk(spark):
    df = spark.createDataFrame([("R1", "I was bullied by my manager, I am the only woman in my unit. My TFN is 123 456 782."), ("R2", "Fine."), ("R3", None)], "ResponseID string, Q1 string")
    assert free_text_columns(df) == ["Q1"]
    out = redact_frame(df, ["Q1"], disclosure=residual.Disclosure(population=30))
    rows = {r.ResponseID: r for r in out.collect()}
    assert rows["R1"].Q1_risk_band == "critical" and rows["R1"].Q1_needs_review and "123 456 782" not in rows["R1"].Q1_redacted
    assert rows["R2"].Q1_risk == pytest.approx(0.16) and not rows["R2"].Q1_needs_review
    assert rows["R3"].Q1_risk == 0 and rows["R3"].Q1_redacted is None
    assert not {"Q1", "Q1_findings"} & set(persistable(out, ["Q1"]).columns)


def test_residual_follows_the_population(spark):
    df = spark.createDataFrame([("he is 44 years old and was bullied",), ("case AB-12345 is open",), ("all good",)], "t string")
    got = {n: [r.action for r in residual.protect(df, "t", residual.Disclosure(population=n)).collect()] for n in (30, 4000, 10**9)}
    assert got == {30: ["suppress", "generalise", "pass"], 4000: ["suppress", "generalise", "pass"], 10**9: ["pass", "pass", "pass"]}
    assert residual.protect(df, "t").collect()[1].released == "case [ORGANISATION REDACTED] is open"


def test_lexicon_merge_and_join(spark):
    own = Lexicon((Term("Project Kestrel", label="own project", aliases=("kestrel tool",)),))
    both = Lexicon.load().merged(own)
    df = spark.createDataFrame([(1, "ProjectKestrel and the kestrel-tool"), (2, "stop work authorty")], "i int, t string")
    assert {(r.i, r.value) for r in scan(df, "i", "t", Policy(survey=True, categories=frozenset(("internal_term",))), both).collect()} == {(1, "ProjectKestrel"), (1, "kestrel-tool")}
    assert {(r.id, r.label) for r in join_matches(df, "i", "t", both).collect()} == {(1, "own project")}


PROBES = {"SC-01": "My anxiety got worse because of the restructure.", "SC-07": "My claim was declined.", "SC-10": "He spoke of suicide.", "SC-17": "It was domestic violence.", "SC-21": "I saw the manager Karen there."}
GUARDED = ["The training module says anxiety is caused by stress.", "Policy states a claim was declined."]


def test_context_rules(spark):
    texts = [*PROBES.values(), *GUARDED, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = context.context_findings(df, "i", "t")
    got = {i: {r.rule for r in found.collect() if r.i == i} for i in range(len(texts))}
    for i, rule in enumerate(PROBES):
        assert rule in got[i]
    assert not any(got[i] for i in range(len(PROBES), len(texts)))
    assert context.rule_counts(found).count() == len(context.RULES)
    with pytest.raises(ValueError):
        context.validate((context.Rule("X", "x", (("nope",),)),))


def test_triage_covers_every_role(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "Call 0412 345 678."), (2, 0, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = redact_conversations_triage(spark, str(tmp_path)).groupBy("role").agg(F.sum("n").alias("n")).collect()
    assert {r.role: r.n for r in got} == {"system": 1, "user": 1, "assistant": 1, None: 1}


def test_every_injector_is_planted(spark):
    rows = generate(spark, 600).select(F.explode("secrets").alias("s")).select("s.*").collect()
    wanted = "phone email tfn acn medicare date_au organisation_name implication credit_card bsb site implication_workplace third_party suburb aps_unit aps_level public_role seniority_in_unit government_act workplace_type cohort clearance"
    assert set(wanted.split()) <= {r.kind for r in rows}
    assert {r.kind for r in rows if r.form == "leet"} == {"implication", "site", "implication_workplace"}
    assert all(any(c.isdigit() for c in r.literal) for r in rows if r.form == "leet")
    cards = spark.createDataFrame([(r.literal,) for r in rows if r.kind == "credit_card"], "v string")
    assert cards.where(~ck.luhn(F.col("v"))).count() == 0


def test_generated_recall(spark):
    made = generate(spark, 150).cache()
    out = outcomes(made)
    assert out.where("not present").count() == 0
    total = recall(out).where("kind is null and form is null").first()
    assert total.planted > 100 and total.recall >= 0.95
    manifest = spark.createDataFrame([("a", ["x"], ["y"], ["email"]), ("b", ["x"], [], [])], "id string, must_not_appear array<string>, must_appear array<string>, categories array<string>")
    result = spark.createDataFrame([("a", "y z", ["email"])], "id string, redacted string, categories array<string>")
    assert {r.id: r.ok for r in report(result, manifest).collect()} == {"a": True, "b": False}


def test_bundled_lexicon():
    terms = Lexicon.load().exact()
    for form in ("critical incident", "the code of conduct", "return to work", "our eba", "pcbus", "whs act 2011", "safework nsw", "the swms", "job hazard analyses", "ndis", "the fair work act", "ohs act 2004", "toolbox talks", "psychosocial risks", "ma000018", "aged care award"):
        assert form.replace(" ", "") in terms, form


NAMED = ("I saw the manager Karen there.", "I saw the manager  Karen there.", "The manager (Karen) was there.", 'Ask a nurse, "Karen" I think.', "He was director 2 Karen then.")
NOT_NAMED = ("The manager was there. Karen left.", "The manager left on Monday.", "Karen, the manager of all")


def test_capitalised_names(spark):
    texts = [*NAMED, *NOT_NAMED]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i for r in context.context_findings(df, "i", "t").where("rule = 'SC-21'").collect()}
    assert got == set(range(len(NAMED)))


def test_tightest_brute_force():
    r = random.Random(2)
    for _ in range(400):
        k = r.randint(1, 3)
        phrases = sorted((s := r.randint(0, 60), s + r.randint(1, 9), r.randint(1, 2**k - 1)) for _ in range(r.randint(0, 9)))
        tokens = sorted(r.sample(range(70), 30))
        gaps = []
        for chosen in itertools.permutations(phrases, k):
            apart = all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(chosen, 2))
            if apart and all(p[2] >> i & 1 for i, p in enumerate(chosen)):
                lo, hi = min(p[0] for p in chosen), max(p[1] for p in chosen)
                gaps.append(sum(lo <= t < hi for t in tokens))
        got = context.tightest(phrases, k, tokens, 12)
        want = min((g for g in gaps if g <= 12), default=None)
        assert (got is None) == (want is None)
        if got:
            assert sum(got[1] <= t < got[2] for t in tokens) == want


def test_overlapping_phrases_and_guards(spark):
    groups = {"a": ("claim",), "b": ("compensation claim",), "c": ("policy",)}
    rules, _ = context.rules_from_json('{"rules": [{"id": "R1", "all_of": [["a"], ["b"]]}, {"id": "R2", "all_of": [["a"]], "guards": ["c"]}], "groups": {"a": ["claim"], "b": ["compensation claim"], "c": ["policy"]}}')
    df = spark.createDataFrame([(1, "a compensation claim"), (2, "claim, then a compensation\tclaim"), (3, "the policy on a claim"), (4, None), (5, " ")], "i int, t string")
    found = context.context_findings(df, "i", "t", rules, groups, cancelled=True)
    assert {(x.i, x.rule, x.guard) for x in found.collect()} == {(1, "R2", None), (2, "R1", None), (2, "R2", None), (3, "R2", "c")}
    assert {(x.rule, x.n, x.cancelled) for x in context.rule_counts(found, rules).collect()} == {("R1", 1, 0), ("R2", 2, 1)}


def test_near_is_one_edit_away():
    for word in ("depot", "nurse"):
        letters = "abnt"
        close = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        close |= {word[:i] + c + word[i + k :] for i in range(len(word)) for k in (0, 1) for c in letters}
        close |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
        far = {word[:i] + c + d + word[i + 2 :] for i in range(len(word) - 1) for c in "xz" for d in "xz"} | {word + "x"}
        pattern = re.compile(vocabulary.near(word))
        assert all(pattern.fullmatch(x) for x in close) and not any(pattern.fullmatch(x) for x in far)


def test_lexicon_by_literals_and_by_dictionary(spark):
    own = Lexicon((Term("Project Kestrel", aliases=("kestrel tool",)), Term("timesheet"), Term("rosterhub", exact_only=True), Term("payroller")))
    texts = ["ProjectKestrel and the kestrel-tool", "my timeshete, time sheet; timesheets.", "rosterhubb rosterhub", "payrolle payroler payoller", "Project Kestrel timesheet, Kestrel", None, "", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    literal = df.select("i", lexicon_matches(F.coalesce("t", F.lit("")), own).alias("m")).collect()
    coded = df.select("i", by_dictionary(F.coalesce("t", F.lit("")), own).alias("m")).collect()
    plain = lambda rows: {r.i: sorted((x.start, x.end, x.value, x.confidence, tuple(sorted(x.metadata.items()))) for x in r.m) for r in rows}
    assert plain(literal) == plain(coded) and sum(map(len, plain(coded).values())) > 8
    two = Lexicon(own.terms, max_distance=2)
    policy = Policy(survey=True, categories=frozenset(("internal_term",)))
    off = spark.createDataFrame([(1, "the timshet is late"), (2, "rosterhu")], "i int, t string")
    assert [r.value for r in scan(off, "i", "t", policy, two).collect()] == ["timshet"]
    assert scan(off, "i", "t", policy, own).count() == 0
    large = own.merged(Lexicon(tuple(Term(f"systemname{i:05d}", exact_only=True) for i in range(20_000))))
    got = scan(spark.createDataFrame([(1, "log in to systemname01234 or ProjectKestrel")], "i int, t string"), "i", "t", policy, large)
    assert {r.value for r in got.collect()} == {"systemname01234", "ProjectKestrel"}


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "ring 0412 345 678, he is 44 years old", "a", "b", "c", "d")], "i int, t string, _text string, _found string, action string, cohort string")
    out = redact(df, "t").first()
    assert (out._text, out._found, out.redacted.startswith("ring *")) == ("a", "b", True)
    kept = residual.protect(df, "t", residual.Disclosure(population=30))
    row = kept.first()
    assert (row.action, row.cohort) == ("c", "d") and row["action_"] == "generalise" and "released" in kept.columns
    with pytest.raises(ValueError, match="t_redacted"):
        redact_frame(df.withColumn("t_redacted", F.lit(1)), ["t"])


def test_checksums_by_policy(spark):
    df = spark.createDataFrame([(1, "TFN 123 456 789, card 4111 1111 1111 1112")], "i int, t string")
    got = {k: {(r.category, r.confidence) for r in scan(df, "i", "t", Policy(require_checksum=k, categories=frozenset(("tfn", "credit_card")))).collect()} for k in (None, True, False)}
    assert got == {None: {("credit_card", 0.4)}, True: set(), False: {("tfn", 0.4), ("credit_card", 0.4)}}


def test_fold_maps_back(spark):
    row = spark.createDataFrame([("José straße, 5T0P!",), (None,)], "t string").select(mw.fold(F.col("t")).alias("f")).select("f", mw.original_span(F.col("f"), F.lit(4), F.lit(11)).alias("s")).collect()
    assert row[0].f.text == "josestrassestopi" and (row[0].s.start, row[0].s.end) == (5, 11) and row[1].f.text is None


def test_reports(spark):
    df = spark.createDataFrame([("R1", "mail jo@example.com, I am the only woman here", "ok"), ("R2", None, None)], "ResponseID string, Q1 string, Q2 string")
    out = mw.worst_risk(redact_frame(df, ["Q1", "Q2"]), ["Q1", "Q2"])
    scores = {r.ResponseID: (r.worst_risk, r.Q1_risk, r.Q2_risk) for r in out.collect()}
    assert scores["R1"][0] == max(scores["R1"][1:]) > 0 and scores["R2"][0] == 0
    assert {r.ResponseID for r in mw.filter_by_band(out, "Q1_risk_band", "high").collect()} == {"R1"}
    audit = mw.with_findings(df, "Q1").select(mw.audit_json(F.col("ResponseID"), F.col("findings"), F.struct(F.lit(0.5).alias("score"))).alias("j"), mw.total_overlap(F.col("findings")).alias("n")).collect()
    first = json.loads(audit[0].j)
    assert first["record_id"] == "R1" and first["finding_count"] == 1 and first["categories"] == ["email"] and audit[0].n == 14 and "jo@" not in audit[0].j
    assert mw.redact_text(spark, "mail jo@example.com", Policy(default_style="label")) == "mail [EMAIL]" and mw.redact_text(spark, None) is None
    assert mw.summarise_texts(spark, ["x", "jo@example.com"]) == ["0 findings (0 deterministic, 0 nlp): ", "1 findings (1 deterministic, 0 nlp): email=1"]
    assert Policy().cache_key() == Policy().cache_key() != Policy(nlp=True).cache_key()
    assert len(Lexicon.load().describe()) > 80 and {d["rule"] for d in implication.describe()} >= {"clearance", "aps_level"}


def test_own_nlp_backend(spark):
    backend = lambda texts: [[(m.start(), m.end(), "name", 0.9) for m in re.finditer("Karen", t)] for t in texts]
    df = spark.createDataFrame([(1, "Karen rang 0412 345 678"), (2, None), (3, "none")], "i int, t string")
    got = {(r.i, r.category, r.stage) for r in scan(df, "i", "t", Policy(nlp=True), backend=backend).collect()}
    assert got == {(1, "name", "nlp"), (1, "phone", "deterministic")}


def test_first_characters_change_no_match(spark):
    from maskwright.functions.text import headed, spans
    from maskwright.operators import detectors, risk
    from maskwright.plans import expected

    texts = [t for cases in (expected.IDENTIFIERS, expected.IMPLICATIONS, expected.RISK, expected.RESIDUAL) for t, _ in cases] + ["ONLY one; PO BOX 12\nÉté, ſole", "", "b a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").localCheckpoint()
    patterns = {b.pattern for b in (*detectors.DOCUMENT, *detectors.ORGANISATION, *detectors.QUASI, *detectors.GAZETTEER)} | {f"(?i){r.gate or r.pattern}" for r in implication.RULES} | {*risk.TEXT_SIGNALS.values(), "(?i)b|a", "x?"}
    changed = [p for p in sorted(patterns) if headed(p) != p]
    assert len(changed) > 60 and headed("x?") == "x?" and headed("[a&&b]|c") == "[a&&b]|c"
    same = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) == F.regexp_extract_all("t", F.lit(headed(p)), F.lit(0)) for p in changed]
    assert df.where(~F.forall(F.array(*same), lambda x: x)).count() == 0
    # by column and by name alike, with and without a group
    for p, g in (("(?i)(\\b(?:the|my) )(\\w+)", 2), ("[a-z]+", 0), ("zzz", 0)):
        assert df.where(spans(F.col("t"), p, g) != spans("t", p, g)).count() == 0


def test_one_row_group_is_dealt_and_nothing_is_made_twice(spark, tmp_path):
    from maskwright.plans import expected  # noqa: F401  registers its queries
    from maskwright.plans.queries import QUERIES

    spark.range(40).selectExpr("id AS c_custkey", "id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plans = {n: QUERIES[n](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString() for n in ("risk_text_signals", "residual_decide", "exp_gaps", "exp_identifiers", "exp_labelled", "eval_overmasking")}
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert all("RoundRobinPartitioning" in p for p in plans.values()) and "InMemoryRelation" not in plans["eval_overmasking"]
    assert plans["risk_text_signals"].count("humiliat") == 1
