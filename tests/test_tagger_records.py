"""The trained back end, record roll-ups, audit objects and the generator's smaller parts."""

import json

import maskwright as mw
from maskwright.operators import residual, risk
from maskwright.operators.tagger import TAGS, Tagger, gold_tags, score, sentences, tagged_corpus, train
from maskwright.plans.api import redact_frame, redact_records, roll_up, scan
from maskwright.plans.corpus import split_answers, valid_dob
from maskwright.plans.policy import Policy
from pyspark.sql import functions as F


def test_tagger_finds_new_names_where_the_gazetteer_has_no_label(spark, tmp_path):
    corpus = tagged_corpus(spark, 1200)
    model = train(corpus, rounds=4)
    again = train(corpus.repartition(7).orderBy(F.rand(1)), rounds=4)
    assert (model.weights == again.weights).all()  # neither order nor dealing matters
    held = tagged_corpus(spark, 300, held_out=True)
    gold = held.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    policy = Policy(nlp=True, categories=frozenset(("name", "location")))
    f1 = {}
    for name, backend in (("tagger", model), ("gazetteer", None)):
        rows = {r.category: r for r in score(scan(held, "id", "text", policy, backend=backend), gold).collect()}
        f1[name] = rows[None].f1 or 0
    assert f1["tagger"] > 0.5 > f1["gazetteer"]
    model.save(spark, str(tmp_path / "m"))
    loaded = Tagger.load(spark, str(tmp_path / "m"))
    text = held.first().text
    assert loaded.find(text) == model.find(text) and loaded([None, ""]) == [[], []]
    assert (train(corpus.limit(0)).weights == 0).all()


def test_sentences_and_tags():
    words = [w for s in sentences("Hi Anita Smith. In Swan Hill") for w in s]
    tags = gold_tags(words, [{"start": 3, "end": 14, "category": "name"}, {"start": 19, "end": 28, "category": "location"}])
    assert [TAGS[t] for t in tags] == ["O", "B-name", "I-name", "O", "O", "B-location", "I-location"]
    assert max(map(len, sentences("a " * 999))) == 200


def test_records_roll_up(spark):
    df = spark.createDataFrame([("R1", "mail jo@example.com, I am the only woman here", "ok"), ("R2", None, None)], "id string, Q1 string, Q2 string")
    out = roll_up(redact_frame(df, ["Q1", "Q2"], Policy(survey=True, default_style="label")), ["Q1", "Q2"])
    rows = {r.id: r for r in out.collect()}
    assert rows["R1"].worst_column == "Q1" and rows["R1"].record_risk == rows["R1"].Q1_risk and rows["R1"].record_band == rows["R1"].Q1_risk_band and rows["R1"].record_findings >= 2
    assert (rows["R2"].record_risk, rows["R2"].record_band, rows["R2"].record_needs_review, rows["R2"].record_findings) == (0.0, "low", False, 0)
    few = redact_records(spark, ["jo@example.com", None], Policy(default_style="label"), ["a", "b"])
    assert [(r["record_id"], r["text"], r["original_text"]) for r in few] == [("a", "[EMAIL]", "jo@example.com"), ("b", "", "")]


def test_audit_objects(spark):
    df = spark.createDataFrame([(1, "the timesheet, the code of conduct, our intranet and MA000018")], "i int, t string")
    found = mw.with_findings(df, "t", Policy(survey=True))
    row = found.select(risk.label_detail(F.col("findings")).alias("d"), risk.risk_json(risk.assess(F.col("t"), F.col("findings")), F.col("findings")).alias("j")).first()
    assert row.d == "4 internal or award term(s): aged care award, internal policy, internal system"
    got = json.loads(row.j)
    assert set(got) == {"score", "band", "word_count", "signals"} and [s["detail"] for s in got["signals"] if s["name"] == "internal_lexicon"] == [row.d]
    long = "Ref " + "A1" * 60
    profile = spark.createDataFrame([(long,)], "t string").select(residual.profile_json(residual.measure(F.col("t"))).alias("j")).first().j
    assert all(len(x["value"]) <= 60 and x["span"] for x in json.loads(profile) if x["kind"] != "narrative")


def test_answers_split_at_sentences(spark):
    texts = ["One. Two! Three? Four", "only one", "", None, "A.B. C"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").crossJoin(spark.range(6).toDF("k"))
    rows = df.select("i", "t", split_answers(F.col("t"), F.col("k")).alias("a")).collect()
    for r in rows:
        if r.i in (1, 2, 3):
            assert (r.a.Q1, r.a.Q2) == (r.t, None)
        else:
            assert f"{r.a.Q1} {r.a.Q2}" == r.t and r.a.Q1[-1] in ".!?"
    assert len({r.a.Q1 for r in rows if r.i == 0}) > 1
    days = [r.d for r in spark.range(200).select(valid_dob(F.col("id")).alias("d")).collect()]
    assert all(1 <= int(d[:2]) <= 28 and 1 <= int(d[3:5]) <= 12 and 1955 <= int(d[6:]) <= 2005 for d in days)
