"""Queries whose expected rows are written out by hand: a text for every detector, implication
rule, residual branch, risk signal and context rule, carried over a whole table by its key.

What is found is compared whole: nothing is filtered, and no value comes from the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import context, residual, risk
from .api import redact, scan, with_findings
from .policy import Policy, survey_policy
from .queries import dealt, query, read

Case = tuple[str, tuple[tuple, ...]]

# ---- texts, and what is in them: (start, category, value); (rule, value); (kind, value, one in so
# many); (signal, weight); (rule, guard that cancels it)
IDENTIFIERS: tuple[Case, ...] = (
    ("TFN 123 456 782 and ABN 64 004 085 616 on one form", ((4, "tfn", "123 456 782"), (24, "abn", "64 004 085 616"))),
    ("ABN 51 004 085 612 holds, ABN 51 004 085 613 does not", ((4, "abn", "51 004 085 612"),)),
    ("ACN 004 085 616, then 004085617", ((4, "acn", "004 085 616"),)),
    ("Medicare 2123 45670 0 or 2123456719, not 9123456701", ((9, "medicare", "2123 45670 0"), (25, "medicare", "2123456719"))),
    ("enrolment 2123 4567 0 1 here, 3 2123 4567 0", ((30, "medicare_enrolment", "3 2123 4567 0"),)),
    ("card 4111 1111 1111 1111, amex 3782 822463 10005, bad 4111-1111-1111-1112", ((5, "credit_card", "4111 1111 1111 1111"), (31, "credit_card", "3782 822463 10005"), (54, "credit_card", "4111-1111-1111-1112"))),
    ("IBAN GB82WEST12345698765432 and GB00WEST12345698765432", ((5, "iban", "GB82WEST12345698765432"), (32, "iban", "GB00WEST12345698765432"))),
    ("BSB 062-000 or BSB 062000, acc 123456", ((19, "bsb", "062000"), (31, "bsb", "123456"))),
    ("passport N1234567 but not E1234567 or NN123456", ((9, "passport", "N1234567"),)),
    ("driver licence 12345678; licence no: 123456789 and DL AB1234", ((15, "drivers_licence", "12345678"), (37, "drivers_licence", "123456789"), (54, "drivers_licence", "AB1234"))),
    ("mail jo.b+x@mail.example.com, j a n e @ e x a m p l e . c o m", ((5, "email", "jo.b+x@mail.example.com"), (30, "email", "j a n e @ e x a m p l e . c o m"))),
    ("ring (03) 9123 4567, 0412 345 678, +61 412 345 678 or 1300 123 456", ((5, "phone", "(03) 9123 4567"), (21, "phone", "0412 345 678"), (35, "phone", "+61 412 345 678"), (54, "phone", "1300 123 456"))),
    ("hosts 10.1.2.3, 999.1.1.1, version 1.2.3.4 and 2001:db8:0:0:0:0:0:1", ((6, "ipv4", "10.1.2.3"), (47, "ipv6", "2001:db8:0:0:0:0:0:1"))),
    ("MAC 00:1A:2B:3C:4D:5E or 00-1a-2b-3c-4d-5e, not 00:1A:2B", ((4, "mac", "00:1A:2B:3C:4D:5E"), (25, "mac", "00-1a-2b-3c-4d-5e"))),
    ("url https://user:secret@host.example/x and password=hunter2hunter", ((4, "url_credential", "https://user:secret@"), (43, "url_credential", "password=hunter2hunter"))),
    ("born 12/03/1985, due 2021-03-04, met 3 March 2021, never 31/02/2024", ((5, "date_au", "12/03/1985"), (21, "date_iso", "2021-03-04"), (37, "date_au", "3 March 2021"))),
    ("lives at 12 Smith Street, NSW 2000; postcode 3000; year 3000", ((9, "street_address", "12 Smith Street"), (26, "postcode", "NSW 2000"), (45, "postcode", "3000"), (56, "postcode", "3000"))),
    ("write to PO Box 123 or GPO Box 45B, 7 Wattle Creek Rd", ((9, "street_address", "PO Box 123"), (36, "street_address", "7 Wattle Creek Rd"))),
    ("", ()),
    ("nothing of the kind, room 12 at 9", ()),
)
IMPLICATIONS: tuple[Case, ...] = (
    ("I am the only woman on the night shift", (("only_one_on_team", "the only woman on the night shift"),)),
    ("I was one of three nurses in our ward", (("seniority_in_unit", "one of three"),)),
    ("I am the sole electrician", (("sole_holder", "the sole electrician"),)),
    ("nobody else knows this", (("no_one_else", "nobody else knows this"),)),
    ("I am the youngest person here", (("unique_attribute", "I am the youngest person here"),)),
    ("I am the only one who operates the crane", (("only_one_does", "the only one who operates the crane"),)),
    ("there were four people on the night shift", (("shift_group", "four people on the night shift"),)),
    ("I'm covering all the sites", (('covers_sites', "I'm covering all the sites"),)),
    ("she is only one on the floor who is certified", (("unique_training", "only one on the floor who is certified"),)),
    ("it began after the merger", (("post_event", "after the merger"),)),
    ("I work near Kestrel Bay depot", (("named_site", "Kestrel Bay depot"),)),
    ("it got worse when they moved", (("site_change", "when they moved"),)),
    ("I am based at the harbour depot", (("named_site_lowercase", "based at the harbour depot"),)),
    ("I saved it on our rostering portal", (("internal_thing", "our rostering"),)),
    ("my manager Karen shouted", (("names_third_party", "my manager Karen"),)),
    ("it was reported to my supervisor", (("reported_by", "reported to my supervisor"),)),
    ("I am pay grade 7 increment", (("classification", "pay grade 7 increment"),)),
    ("my payments branch is small", (("department_structure", "my payments branch"),)),
    ("she moved across payments branch", (("unit_by_preposition", "across payments branch"),)),
    ("we wrote a ministerial submission", (("government_process", "a ministerial submission"),)),
    ("we work at a refinery near town", (("workplace_type", "a refinery"),)),
    ("I am the director of policy", (("senior_role", "I am the director"),)),
    ("my role is data analyst", (("occupation_family", "my role is data analyst"),)),
    ("she is a policy officer in the water department", (("occupation_with_structure", "a policy officer in the water department"),)),
    ("I was hired as an aps 6 in the grants branch", (("aps_level", "as an aps 6 in the grants branch"),)),
    ("he is EL1, I think", (("aps_level_alone", "EL1,"),)),
    ("there are only two of us left in the unit", (("seniority_in_unit", "there are only two of us left"),)),
    ("I am part of the graduate cohort", (("cohort_marker", "I am part of the graduate cohort"),)),
    ("I hold a security clearance", (("clearance", "I hold a security clearance"),)),
    ("we got the annual bonus", (("corporate_marker", "the annual bonus"),)),
    ("nothing of that kind happened", ()),
)
RESIDUAL: tuple[Case, ...] = (
    ("number 12345678 stays", (("numeric", "12345678", 1000000000.0),)),
    ("ring 0412 345 678 now", (("numeric", "0412 345 678", 100000000.0),)),
    ("file AB-12345 is open", (("organisation", "AB-12345", 5000000.0),)),
    ("we use the Kestrel portal daily", (("organisation", "Kestrel portal", 2000.0),)),
    ("since 12/03/2019 it rains", (("temporal", "12/03/2019", 4.0),)),
    ("she is 44 years old", (("person", "44 years old", 24.0),)),
    ("we met a data analyst there", (("person", "data analyst", 32.0),)),
    ("after 18 years I left", (("person", "18 years", 16.0),)),
    ("ages 25-34 and under 18", (("person", "25-34", 8.0), ("person", "under 18", 8.0))),
    ("three complaints came in", (("numeric", "three complaints", 12.5),)),
    ("it was in 2019", (("temporal", "2019", 20.0),)),
    ("near the Harbour Bridge we stood", (("organisation", "Harbour Bridge", 2000.0),)),
    ("I was bullied", (("narrative", "incident narrative", 200.0),)),
    ("all good", ()),
    ("he is 44 years old and in 2019 file AB-12345 had three complaints", (("numeric", "three complaints", 12.5), ("organisation", "AB-12345", 5000000.0), ("person", "44 years old", 24.0), ("temporal", "2019", 20.0))),
)
RISK: tuple[Case, ...] = (
    ("My TFN is 123 456 782 and that is all there is to say about this matter in writing today", (("direct_identifier", 0.45),)),
    ("the manager was abusive to the whole of the team while we waited for the bus to come along again", (("narrative", 0.2),)),
    ("I told them about it and every shift it went on as before without anybody doing a thing about that", (("scenario", 0.15),)),
    ("I am the only woman who drives the big truck up to the quarry and back down again in one day here", (("unique", 0.3),)),
    ("I am pregnant and nobody who sits near to me in that long room has ever asked how I am these days", (("health_detail", 0.12), ("protected", 0.15))),
    ("it happened last week when the rain came through the roof of the shed and on to the new green desks", (("specific_event", 0.1),)),
    ("please keep this confidential, as I would not like a word of it to go round the tea room once again", (("confidentiality_request", 0.35),)),
    ("all fine here", (("short_response", 0.16),)),
    ("I put it in the timesheet, as one does, and then went home to feed the dog and the two old grey cats", (("employer_attribution", 0.25), ("internal_lexicon", 0.12))),
    ("I have been with Wirrin Pty Ltd for a while and the work there is as good as it ever was before then", (("named_organisation", 0.2),)),
    ("we are paid under MA000077 like all of the others who came in with the boats at the end of that year", (("employer_attribution", 0.25),)),
    ("I am a registered nurse and work with good people who care for the ones that need it most of the time", (("job_title", 0.12),)),
    ("after 18 years of service I left the place with a cake and a card and a walk along the beach at dawn", (("tenure", 0.1),)),
    ("our team of five does it all with one desk, one lamp and a kettle that sings when the tea is on again", (("team_size_small", 0.168),)),
    ("I am casual here and like it well enough to stay on through the winter if the sun comes out some days", (("employment_status", 0.08),)),
    ("my anxiety grew with the noise of the road works outside the long window over the old sandstone bridge", (("health_detail", 0.12),)),
    ("she is 44 years old and walks to the hill and back each day with a hat on and a stick made of plain ash", (("age", 0.06), ("scenario", 0.15))),
    ("the form says 12/03/1985 in the box at the top and a blue stamp next to it that no one can read by now", (("date_of_birth", 0.15), ("specific_event", 0.1))),
    ("the shop is at 12 Smith Street with a red door and a bell that rings whenever the wind is up at night", (("direct_identifier", 0.45), ("location_specific", 0.1))),
    ("I am a registered nurse aged 44, casual, with anxiety, in our team of five", (("age", 0.06), ("employment_status", 0.08), ("health_detail", 0.12), ("job_title", 0.12), ("quasi_combination", 0.3), ("team_size_small", 0.168))),
    ("", ()),
    ("job title: nurse, and the rest of it is as plain as day and long enough to be no short answer at all", (("job_title", 0.156),)),
)
CONTEXT: tuple[Case, ...] = (
    ("My anxiety got worse because of the restructure.", (("SC-01", ""), ("SC-02", ""))),
    ("They started performance management. My depression followed because of it.", (("SC-01", ""), ("SC-02", ""))),
    ("She was humiliated by my supervisor.", (("SC-03", ""),)),
    ("He was harassed over his religion.", (("SC-03", ""), ("SC-04", ""))),
    ("I was ignored every week by my boss.", (("SC-03", ""), ("SC-05", ""))),
    ("The claim number lists my insomnia.", (("SC-06", ""),)),
    ("The claim was declined.", (("SC-07", ""),)),
    ("A worker is on light duties.", (("SC-08", ""),)),
    ("He was drunk and stood down.", (("SC-09", ""),)),
    ("Someone spoke of suicide.", (("SC-10", ""),)),
    ("I viewed graphic footage.", (("SC-11", ""),)),
    ("The cameras run and I was not told.", (("SC-12", ""),)),
    ("I am the only one with a disability.", (("SC-13", ""),)),
    ("A part time apprentice saw the accident.", (("SC-14", ""),)),
    ("Confidential: it is about my manager.", (("SC-15", ""),)),
    ("The regulator spoke to me.", (("SC-16", ""),)),
    ("It is domestic violence.", (("SC-17", ""),)),
    ("He said you are useless to my manager.", (("SC-18", ""),)),
    ("A disciplinary meeting gave the employee anxiety.", (("SC-19", ""),)),
    ("Flexible hours were refused despite my burnout.", (("SC-20", ""),)),
    ("I saw the manager Karen there.", (("SC-21", ""),)),
    ("The training module says anxiety is caused by noise.", (("SC-01", "business_as_usual"),)),
    ("Nothing to add.", ()),
)
LABELLED = (
    ("mail jo@example.com, ring 0412 345 678", "mail [EMAIL], ring [PHONE]"),
    ("[EMAIL] and jo@example.com", "[EMAIL] and [EMAIL]"),
    ("TFN 123 456 782, card 4111 1111 1111 1111, BSB 062000", "TFN [TFN], card [CREDIT CARD], BSB [BSB]"),
    ("host 10.1.2.3 at 12 Smith Street, NSW 2000", "host [IPV4] at [STREET ADDRESS], [POSTCODE]"),
    ("born 12/03/1985; MAC 00:1A:2B:3C:4D:5E", "born [DATE AU]; MAC [MAC]"),
    ("plain", "plain"),
    ("", ""),
)
SURE = {3: "host [IPV4] at 12 Smith Street, [POSTCODE]"}  # of findings with a confidence of 0.99 only
GAPS: tuple[Case, ...] = (
    ("Name: Jane Smith, jo@example.com", ((6, "name", "nlp", "Jane Smith"), (18, "email", "deterministic", "jo@example.com"))),
    ("I am based in Hobart, aged 44", ((14, "location", "nlp", "Hobart"), (27, "age", "nlp", "44"))),
    ("Sex: female, she is 44 years old", ((5, "gender", "nlp", "female"), (20, "age", "nlp", "44"))),
    ("Dr Jane Smith rang 0412 345 678", ((0, "name", "nlp", "Dr Jane Smith"), (19, "phone", "deterministic", "0412 345 678"))),
)


def _quoted(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)


def expected_sql(table: str, key: str, cases: tuple[Case, ...], columns: str) -> str:
    """The cases' rows for each key, by its remainder."""
    rows = [f"({i}, {', '.join(map(_quoted, r))})" for i, (_, rs) in enumerate(cases) for r in rs]
    return f"SELECT {key}, {columns} FROM {table} JOIN (VALUES {', '.join(rows)}) AS v(i, {columns}) ON {key} % {len(cases)} = i"


def carried(spark, sf: str, table: str, key: str, texts: list[str]) -> DataFrame:
    text: Column = F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))
    return dealt(read(spark, sf, table).select(key)).select(key, text.alias("t"))


def _texts(cases) -> list[str]:
    return [c[0] for c in cases]


@query("exp_identifiers", expected_sql("customer", "c_custkey", IDENTIFIERS, "start, category, value"))
def exp_identifiers(spark, sf):
    return scan(carried(spark, sf, "customer", "c_custkey", _texts(IDENTIFIERS)), "c_custkey", "t").select("c_custkey", "start", "category", "value")


@query("exp_implications", expected_sql("supplier", "s_suppkey", IMPLICATIONS, "rule, value"))
def exp_implications(spark, sf):
    found = scan(carried(spark, sf, "supplier", "s_suppkey", _texts(IMPLICATIONS)), "s_suppkey", "t", Policy(survey=True, categories=frozenset(("implication",))))
    return found.select("s_suppkey", F.col("metadata")["rule"].alias("rule"), "value")


@query("exp_residual", expected_sql("part", "p_partkey", RESIDUAL, "kind, value, selectivity"))
def exp_residual(spark, sf):
    found = carried(spark, sf, "part", "p_partkey", _texts(RESIDUAL)).select("p_partkey", residual.measure(F.col("t")).alias("m"))
    return found.select("p_partkey", F.explode_outer("m").alias("m")).where("m is not null").select("p_partkey", "m.kind", "m.value", "m.selectivity")


@query("exp_risk_signals", expected_sql("supplier", "s_suppkey", RISK, "signal, weight"))
def exp_risk_signals(spark, sf):
    found = with_findings(carried(spark, sf, "supplier", "s_suppkey", _texts(RISK)), "t", survey_policy())
    each = found.select("s_suppkey", risk.assess(F.col("t"), F.col("findings"))["signals"].alias("s")).select("s_suppkey", F.explode_outer("s").alias("s"))
    return each.where("s is not null").select("s_suppkey", F.col("s.name").alias("signal"), F.round("s.weight", 6).alias("weight"))


@query("exp_context_rules", expected_sql("customer", "c_custkey", CONTEXT, "rule, guard"))
def exp_context_rules(spark, sf):
    found = context.context_findings(carried(spark, sf, "customer", "c_custkey", _texts(CONTEXT)), "c_custkey", "t", cancelled=True)
    return found.select("c_custkey", "rule", F.coalesce("guard", F.lit("")).alias("guard"))


@query("exp_labelled", expected_sql("customer", "c_custkey", tuple((t, ((want, SURE.get(i, want)),)) for i, (t, want) in enumerate(LABELLED)), "labelled, sure"))
def exp_labelled(spark, sf):
    df = redact(carried(spark, sf, "customer", "c_custkey", _texts(LABELLED)), "t", Policy(default_style="label"), "labelled").drop("findings")
    return redact(df, "t", Policy(default_style="label", min_confidence=0.99), "sure").select("c_custkey", "labelled", "sure")


@query("exp_gaps", expected_sql("customer", "c_custkey", GAPS, "start, category, stage, value"))
def exp_gaps(spark, sf):
    return scan(carried(spark, sf, "customer", "c_custkey", _texts(GAPS)), "c_custkey", "t", Policy(nlp=True)).select("c_custkey", "start", "category", "stage", "value")
