"""Phrases, spans as rows, cohorts, sessions and observed counts against plain Python."""

import random
import time
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from maskwright.operators import cohorts, intervals, phrases, risk
from maskwright.plans.api import redact_frame
from maskwright.plans.corpus import contamination, generate, vocabulary
from maskwright.plans.policy import Policy
from maskwright.streaming import session_triage
from pyspark.sql import Observation
from pyspark.sql import functions as F


# ---- phrases
def occurrences(text, phrase):
    return [i for i in range(len(text)) if text.startswith(phrase, i)]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_by_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(phrases, "LANE", 7)
        monkeypatch.setattr(phrases, "LANES", 5)
    r = random.Random(1)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "", "aaaaaaaaaaaaaaaaaaaa", "é" * 30]
    forms = sorted({"".join(r.choice("abé ") for _ in range(r.randint(1, 5))) for _ in range(60)}) + ["aaa", "aaa", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "aaab", "y")], "id long, text string, n string").repartition(3)
    table = spark.createDataFrame(list(enumerate(forms)), "pid long, phrase string")
    got = sorted((str(x.id), x.pid, x.n, x.first) for x in phrases.find_phrases(df, "id", "text", table, "pid", "phrase", 1 << 15 if small else phrases.TABLE_BYTES).collect())
    want = sorted((str(i), p, len(at), at[0] + 1) for i, t in [*enumerate(texts), (None, "aaab")] for p, f in enumerate(forms) if t and f and (at := occurrences(t, f)))
    assert got == want and len(want) > 500


def test_generator_against_probes(spark):
    words = [r.phrase for r in vocabulary(spark).collect()]
    assert len(words) > 20
    probes = spark.createDataFrame([("a", f"So {words[0].upper()}!"), ("b", "nothing of it"), ("c", None)], "id string, text string")
    assert [(r.id, r.phrase) for r in contamination(probes, "id", "text").collect()] == [("a", words[0])]
    made = generate(spark, 20).select("response_id", "answer")
    assert contamination(made, "response_id", "answer").select("response_id").distinct().count() == 20


# ---- spans
@pytest.mark.parametrize("within", [False, True])
def test_spans_clear_of_others(spark, within):
    r = random.Random(2)
    span = lambda k, most: (k, s := r.randint(0, 900), s + r.randint(0, most))
    left = [span(r.choice("aab"), 90) for _ in range(300)] + [("c", 1, 5), (None, 1, 5), ("a", None, 3)]
    right = [span(r.choice("ab"), 150) for _ in range(25)] + [(None, 0, 100), ("a", 7, None)]
    left += left[:3]
    df = spark.createDataFrame([(*x, "v") for x in left], "k string, start int, end int, _b string")
    spans = spark.createDataFrame(right, "k string, start int, end int")
    ok = lambda a, b: b[1] <= a[1] and a[2] <= b[2] if within else a[1] < b[2] and b[1] < a[2]
    full = lambda x: None not in x
    hit = lambda x: full(x) and any(full(y) and x[0] == y[0] and ok(x, y) for y in right)
    rows = lambda d: sorted(map(str, ((x.k, x.start, x.end) for x in d.collect())))
    assert rows(intervals.clear_of(df, spans, "k", 16, within)) == sorted(str(x) for x in left if not hit(x))
    assert rows(intervals.meeting(df, spans, "k", 16, within)) == sorted({str(x) for x in left if hit(x)})
    assert intervals.outside_rows(df, spans.limit(0), "k").count() == len(left)
    both = intervals.fill_gaps_rows(spans, df, "k")
    assert both.count() == len(right) + sum(not any(full(x) and full(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in right) for x in left)


@pytest.mark.parametrize("within", [False, True])
def test_short_spans_clear_of_others_in_one_pass(spark, within):
    r = random.Random(7)
    left = [("a", s, s + r.randint(0, 5)) for s in (r.randint(0, 400) for _ in range(300))] + [(None, 1, 2), ("a", None, 3), ("b", 15, 16)]
    right = [("a", s, s + r.randint(0, 60)) for s in (r.randint(0, 400) for _ in range(9))] + [(None, 0, 9), ("a", 7, None), ("b", 16, 16)]
    df, spans = spark.createDataFrame(left + left[:4], "k string, start int, end int"), spark.createDataFrame(right, "k string, start int, end int")
    rows = lambda d: sorted(map(str, d.collect()))
    got = intervals.clear_of(df, spans, "k", 16, within, longest=5)
    assert rows(got) == rows(intervals.clear_of(df, spans, "k", 16, within)) and 3 < got.count() < 300
    assert str(got._jdf.queryExecution().optimizedPlan()).count("LeftSemi") == 0
    with pytest.raises(Exception, match="longer than 4"):
        intervals.clear_of(df, spans, "k", 16, within, longest=4).collect()


# ---- cohorts
def test_release_by_brute_force(spark):
    r = random.Random(3)
    people = [(i, r.choice(["x", "y", None]), r.randint(1, 3), r.choice("pqrst")) for i in range(120)]
    df = spark.createDataFrame(people, "id long, a string, b int, c string")
    strangers = spark.createDataFrame([(500, "z", 1, "p"), (501, None, None, None)], "id long, a string, b int, c string")
    got = {x.id: (x.action, tuple(x.withheld), x.cohort, x.own_cohort) for x in cohorts.release(df.unionByName(strangers), "id", df, ["a", "b", "c"], 6).collect()}
    for i, *own in [*people, (500, "z", 1, "p"), (501, None, None, None)]:
        best = None
        for k in range(4):
            for gone in combinations(range(3), k):
                n = sum(all(p[j + 1] == own[j] for j in range(3) if j not in gone) for p in people)
                level = sum(4 >> j for j in gone)
                if n >= 6 and (best is None or (k, -n, level) < best[0]):
                    best = ((k, -n, level), tuple("abc"[j] for j in gone))
        alike = sum(p[1:] == tuple(own) for p in people)
        assert got[i] == ("pass" if best[0][0] == 0 else "generalise", best[1], -best[0][1], alike or None), i
    assert {x.action for x in cohorts.release(df, "id", df.limit(3), ["a"], 6).collect()} == {"suppress"}
    assert cohorts.cohort_sizes(df, ["a", "b"], 1000).where("n is not null").count() == 0
    assert cohorts.selectivities(df, ["b"]).agg(F.sum("n")).first()[0] == 120


# ---- sessions
def test_sessions_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    r = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(r.choice("uvw"), start + timedelta(minutes=r.randint(0, 3000)), r.random()) for _ in range(300)]
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 60] for i in range(0, 300, 60)]
    for p in parts:
        r.shuffle(p)  # out of order within the watermark
    parts[1].append(parts[0].pop())  # and a row that comes in a later file
    parts.append([("z", start + timedelta(days=9), 0.1)])  # moves the watermark past them all
    schema, src, out = "k string, at timestamp, v double", str(tmp_path / "in"), str(tmp_path / "out")
    whole = spark.createDataFrame([x for p in parts for x in p], schema)
    want = sorted(map(tuple, session_triage(whole, "k", "at", risk.band(F.col("v"))).where("k <> 'z'").collect()))

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = session_triage(s, "k", "at", risk.band(F.col("v")), late="10 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    for half in (parts[:3], parts[3:]):
        for p in half:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
            time.sleep(0.05)
        run()  # a query of its own: the state comes from the checkpoint
    spark.createDataFrame([("z", start + timedelta(days=40), 0.1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = sorted(map(tuple, spark.read.parquet(out).where("k <> 'z'").collect()))
    assert got == want and len(want) > 20 and {x[4] for x in want} >= {"high", "critical"}


# ---- observed counts
def test_counts_come_with_the_pass_that_writes(spark, tmp_path):
    rows = [(1, "mail jo@example.com or sam@example.com"), (2, "ring 0412 345 678"), (3, None), (4, "jo@example.com, call 0412 345 679")]
    df = spark.createDataFrame(rows, "i int, t string")
    policy = Policy(categories=frozenset(("email", "phone")), default_style="label")
    seen = Observation()
    redact_frame(df, ["t"], policy, observe=seen).write.format("noop").mode("overwrite").save()
    want = {"records": 4, "t_findings": 5, "t_email": 3, "t_phone": 2}
    assert {k: seen.get[k] for k in want} == want
    plain = redact_frame(df, ["t"], policy)
    again = plain.agg(F.sum(F.size("t_findings")), F.sum(F.col("t_needs_review").cast("long"))).first()
    assert (seen.get["t_findings"], seen.get["t_review"]) == tuple(again)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, t string").parquet(str(tmp_path / "in"))
    q = redact_frame(stream, ["t"], policy, observe="ingest").drop("t", "t_findings").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    got = [p.observedMetrics["ingest"] for p in q.recentProgress if "ingest" in p.observedMetrics]
    q.stop()
    assert sum(x["records"] for x in got) == 4 and sum(x["t_email"] for x in got) == 3


def test_risk_signals_of_observed_counts_are_made_once(spark):
    df = spark.createDataFrame([(1, "the manager bullied jo@example.com"), (2, None)], "i int, t string")
    out = redact_frame(df, ["t"], Policy(categories=frozenset(("email",))), observe=Observation()).select("i", "t_redacted")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("bully|bullying") == 1


# ---- secrets planted in real texts
def test_plant_keeps_the_text_and_adds_secrets(spark):
    from maskwright.plans.corpus import generate_for, outcomes, over_masking, plant, recall

    rows = [(i, f"some words of text {i}.") for i in range(40)] + [(40, None), (None, "no id"), (41, "12 Words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.response_id: r for r in plant(df, "doc_id", "text").collect()}
    assert len(got) == 43 and got[None].answer == "no id" and got[None].secrets == [] and got["41"].must_survive == [] and got["3"].must_survive == ["some words"]
    for i, t in rows[:40]:
        r = got[str(i)]
        assert r.answer.startswith(t) and all(s.literal in r.answer for s in r.secrets)
    policy = Policy(categories=frozenset(("email", "phone", "tfn")), default_style="label")
    total = {(r.kind, r.form): r for r in recall(outcomes(plant(df, "doc_id", "text"), policy)).collect()}
    assert total[("email", "clean")].recall == 1 and total[(None, None)].planted == sum(len(r.secrets) for r in got.values())
    assert over_masking(plant(df, "doc_id", "text"), policy).count() == 0
    one = generate_for(df.where("doc_id is not null"), "doc_id").select("response_id", "answer", "secrets").collect()
    assert sorted(map(str, one)) == sorted(map(str, generate(spark, 42).select("response_id", "answer", "secrets").collect()))


def test_split_sentences_keep_their_edges(spark, tmp_path):
    from maskwright.plans.relational import split_sentences

    # the n-th sentence begins and ends with the digit n, which was trimmed off; null texts, control characters
    texts = ["0 a 0. 1 b 1! 2 c 2? 3 d 3", " two.  4 x 4 ", None, "", "one", "a.\u000b b. c", "a\u0001b. c"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.sentences, r.joined) for r in split_sentences(spark, str(tmp_path)).collect()}
    assert got == {0: (4, texts[0]), 1: (2, "two. 4 x 4"), 2: (None, None), 3: (0, ""), 4: (1, "one"), 5: (2, "a.\u000b b. c"), 6: (3, "a b. c")}
