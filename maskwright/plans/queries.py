"""Queries over the tables, one or more per operator, and the SQL that checks them.

The tables hold few Australian numbers, so many queries carry them in: a text made from a
key the same way in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions import generalise as gen
from ..functions import masking
from ..functions import parse
from ..functions.text import aligned, aligned_table, pinned, spans, token_values
from ..operators import residual, risk
from ..operators.detectors import EMAIL, OCTET
from .api import redact, scan
from .policy import Policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt over all cores: hundreds of thousands of keys are one row group, so
    one task, however much is then made of each.  By turns, so that no key can gather rows."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism)


# ---- carriers: the same digits in both dialects
def digits(key: str, n: int, a: int = 7919, b: int = 104729) -> tuple[str, str]:
    m = 10**n
    return f"lpad(CAST(({key} * {a}L + {b}L) % {m}L AS STRING), {n}, '0')", f"lpad(CAST(({key} * {a} + {b}) % {m} AS VARCHAR), {n}, '0')"


def wsum(ws, less: int = 0) -> str:
    return " + ".join(f"(CAST(substr(d, {i}, 1) AS INT) - {less}) * {w}" for i, w in enumerate(ws, 1))


def _check(name: str, table: str, key: str, n: int, make: Callable[[Column], Column], sql: str, a: int = 7919, b: int = 104729):
    col, text = digits(key, n, a, b)

    @query(name, f"SELECT {key}, d, {sql} AS ok FROM (SELECT {key}, {text} AS d FROM {table})")
    def run(spark, sf):
        return read(spark, sf, table).select(key, F.expr(col).alias("d")).withColumn("ok", make(F.col("d")))


_check("chk_tfn", "orders", "o_orderkey", 9, ck.is_tfn, f"({wsum(ck.TFN_WEIGHTS)}) % 11 = 0")
_check("chk_abn", "orders", "o_orderkey", 11, ck.is_abn, f"({wsum(ck.ABN_WEIGHTS, 1)}) % 89 = 0", 7919 * 104729)
_check("chk_abn_official", "orders", "o_orderkey", 11, lambda d: ck.is_abn(d, True), f"({wsum(ck.ABN_WEIGHTS)} - 10) % 89 = 0", 7919 * 104729)
_check("chk_acn", "orders", "o_orderkey", 9, ck.is_acn, f"(10 - ({wsum(ck.ACN_WEIGHTS)}) % 10) % 10 = CAST(substr(d, 9, 1) AS INT)")
_check("chk_medicare", "orders", "o_orderkey", 10, ck.is_medicare, f"substr(d, 1, 1) <> '0' AND (10 - ({wsum(ck.MEDICARE_WEIGHTS)}) % 10) % 10 = CAST(substr(d, 10, 1) AS INT)", 104729 * 7919)
_check("chk_medicare_enrolment", "orders", "o_orderkey", 10, ck.is_medicare_enrolment, "substr(d, 1, 1) <> '0' AND substr(d, 2, 1) <> '0'", 104729 * 7919)
_check("chk_bsb", "customer", "c_custkey", 6, ck.is_bsb, "substr(d, 1, 2) NOT IN ('00', '97', '99')")
LUHN = "list_sum([CASE WHEN (16 - i) % 2 = 1 THEN (CASE WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN CAST(substr(d, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, i, 1) AS INT) * 2 END) ELSE CAST(substr(d, i, 1) AS INT) END FOR i IN range(1, 17)]) % 10 = 0"
_check("chk_luhn", "orders", "o_orderkey", 16, ck.luhn, LUHN, 7919 * 104729 * 97)
BRAND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(d, '^(?:{'|'.join(p)})') THEN '{b}'" for b, p in ck.CARD_BRANDS) + " END"


@query("chk_card_brand", f"SELECT p_partkey, d, {BRAND_SQL} AS brand FROM (SELECT p_partkey, lpad(CAST(p_partkey * 379 % 10000 AS VARCHAR), 4, '0') || '000011112222' AS d FROM part)")
def chk_card_brand(spark, sf):
    d = F.concat(F.lpad((F.col("p_partkey") * 379 % 10000).cast("string"), 4, "0"), F.lit("000011112222"))
    return read(spark, sf, "part").select("p_partkey", d.alias("d")).withColumn("brand", ck.card_brand(F.col("d")))


@query("chk_iban", "SELECT c_custkey, d, ok FROM (SELECT c_custkey, 'GB' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') || n AS d, (CAST(n || '1611' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS HUGEINT)) % 97 = 1 AS ok FROM (SELECT c_custkey, lpad(CAST(c_custkey * 104729 % 100000000000000 AS VARCHAR), 14, '0') AS n FROM customer))")
def chk_iban(spark, sf):
    n = F.lpad((F.col("c_custkey") * 104729 % 100000000000000).cast("string"), 14, "0")
    d = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), n)
    return read(spark, sf, "customer").select("c_custkey", d.alias("d")).withColumn("ok", ck.iban_check(F.col("d")))


RANGES = " OR ".join(f"CAST(d AS INT) BETWEEN {a} AND {b}" for a, b in ck.POSTCODE_RANGES)
_check("chk_postcode", "orders", "o_orderkey", 4, ck.valid_postcode, RANGES, 7)


@query("chk_passport", "SELECT c_custkey, d, substr(d, 1, 1) NOT IN ('E', 'O', 'I') AS ok FROM (SELECT c_custkey, chr(CAST(65 + c_custkey % 26 AS INT)) || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS d FROM customer)")
def chk_passport(spark, sf):
    d = F.concat(F.char((65 + F.col("c_custkey") % 26).cast("int")), F.lpad((F.col("c_custkey") * 7919 % 10000000).cast("string"), 7, "0"))
    return read(spark, sf, "customer").select("c_custkey", d.alias("d")).withColumn("ok", ck.is_passport(F.col("d")))


# ---- spans over documents and pages
def _spans_sql(table: str, key: str, text: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT {key}, CAST(s AS BIGINT) AS start_at, CAST(s + len(v) AS BIGINT) AS end_at, v AS value FROM (
  SELECT {key}, unnest([len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i - 1], '')) FOR i IN range(1, len(m) + 1)]) AS s, unnest(m) AS v
  FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS m, string_split_regex({text}, '{p}') AS g FROM {table} WHERE regexp_matches({text}, '{p}')))"""


def _span_query(name: str, table: str, key: str, text: str, pattern: str, gate: str | None = None):
    @query(name, _spans_sql(table, key, text, pattern))
    def run(spark, sf):
        s = read(spark, sf, table).select(key, F.explode(spans(F.col(text), pattern, gate=gate)).alias("s"))
        return s.select(key, F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.value").alias("value"))


_span_query("spans_email", "documents", "doc_id", "text", EMAIL, "@")
_span_query("spans_dotted_quad", "documents", "doc_id", "text", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", r"\d\.\d")
_span_query("spans_urls", "pages", "page_id", "html", r"https?://[A-Za-z0-9./?=_#-]+", "://")
_span_query("spans_key_values", "documents", "doc_id", "text", r"(?i)\b(?:api[_-]?key|apikey|token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_\-./+=]{8,}", "[:=]")
_span_query("spans_mac", "documents", "doc_id", "text", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[0-9A-Fa-f]{2}[:-]")


# ---- detectors on carried texts: (text, what must be found) made from a key
def _carried(name: str, table: str, key: str, text: Callable[[], Column], text_sql: str, category: str, value_sql: str, where_sql: str = "TRUE"):
    """One finding of ``category`` per row where ``where_sql`` holds, its value ``value_sql``."""

    @query(name, f"SELECT {key}, '{category}' AS category, value, CAST(instr(t, value) - 1 AS BIGINT) AS start_at FROM (SELECT *, {value_sql} AS value FROM (SELECT *, {text_sql} AS t FROM {table}) WHERE {where_sql})")
    def run(spark, sf):
        df = dealt(read(spark, sf, table).select(key)).withColumn("t", text())
        found = scan(df, key, "t", Policy(categories=frozenset((category,))))
        return found.select(key, "category", "value", F.col("start").cast("long").alias("start_at"))


nine, nine_sql = digits("c_custkey", 9)
six, six_sql = digits("c_custkey", 6)
eight, eight_sql = digits("c_custkey", 8)
W9 = lambda ws: " + ".join(f"CAST(substr({nine_sql}, {i}, 1) AS INT) * {w}" for i, w in enumerate(ws, 1))
_carried("det_tfn", "customer", "c_custkey", lambda: F.concat(F.lit("my number "), F.expr(nine), F.lit(" ok")), f"'my number ' || {nine_sql} || ' ok'", "tfn", nine_sql, f"({W9(ck.TFN_WEIGHTS)}) % 11 = 0")
_carried("det_bsb", "customer", "c_custkey", lambda: F.concat(F.lit("paid to BSB "), F.expr(six), F.lit(" today")), f"'paid to BSB ' || {six_sql} || ' today'", "bsb", six_sql, f"substr({six_sql}, 1, 2) NOT IN ('00', '97', '99')")
_carried("det_licence", "customer", "c_custkey", lambda: F.concat(F.lit("driver licence: "), F.expr(eight), F.lit(", renewed")), f"'driver licence: ' || {eight_sql} || ', renewed'", "drivers_licence", eight_sql)
_carried("det_award_like_passport", "customer", "c_custkey", lambda: F.concat(F.lit("passport N"), F.substring(F.expr(eight), 1, 7), F.lit(".")), f"'passport N' || substr({eight_sql}, 1, 7) || '.'", "passport", f"'N' || substr({eight_sql}, 1, 7)")
_carried("det_phone", "customer", "c_custkey", lambda: F.concat(F.lit("ring 04"), F.expr(eight), F.lit(" please")), f"'ring 04' || {eight_sql} || ' please'", "phone", f"'04' || {eight_sql}")
_carried("det_state_postcode", "orders", "o_orderkey", lambda: F.concat(F.lit("in VIC "), F.lpad((F.col("o_orderkey") * 7 % 10000).cast("string"), 4, "0")), "'in VIC ' || lpad(CAST(o_orderkey * 7 % 10000 AS VARCHAR), 4, '0')", "postcode", "'VIC ' || lpad(CAST(o_orderkey * 7 % 10000 AS VARCHAR), 4, '0')", "(" + RANGES.replace("CAST(d AS INT)", "o_orderkey * 7 % 10000") + ")")
_carried("det_street", "part", "p_partkey", lambda: F.concat(F.lit("meet at "), (F.col("p_partkey") % 900 + 1).cast("string"), F.lit(" Banksia Street tonight")), "'meet at ' || (p_partkey % 900 + 1) || ' Banksia Street tonight'", "street_address", "(p_partkey % 900 + 1) || ' Banksia Street'")


@query("det_date", """
SELECT o_orderkey, 'date_au' AS category, strftime(o_orderdate, '%d/%m/%Y') AS value, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders
UNION ALL SELECT o_orderkey, 'date_au', strftime(o_orderdate, '%-d %B %Y'), strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT o_orderkey, 'date_iso', strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d') FROM orders""")
def det_date(spark, sf):
    d = F.col("o_orderdate")
    t = F.concat(F.lit("on "), F.date_format(d, "dd/MM/yyyy"), F.lit(" or "), F.date_format(d, "d MMMM yyyy"), F.lit(" or "), F.date_format(d, "yyyy-MM-dd"), F.lit("."))
    found = scan(dealt(read(spark, sf, "orders").select("o_orderkey", "o_orderdate")).withColumn("t", t), "o_orderkey", "t", Policy(categories=frozenset(("date_au", "date_iso"))))
    return found.select("o_orderkey", "category", "value", F.col("metadata")["iso"].alias("iso"))


@query("parse_phone", "SELECT c_custkey, d, CASE WHEN substr(d, 1, 2) = '61' AND regexp_matches(d, '^61[42378][0-9]{8}$') THEN '+' || d WHEN regexp_matches(d, '^0[42378][0-9]{8}$') THEN d END AS phone FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '61' END || lpad(CAST(c_custkey * 7919 * 104729 % 1000000000 AS VARCHAR), 9, '0') AS d FROM customer)")
def parse_phone(spark, sf):
    d = F.concat(F.when(F.col("c_custkey") % 2 == 0, "0").otherwise("61"), F.lpad((F.col("c_custkey") * 7919 * 104729 % 1000000000).cast("string"), 9, "0"))
    return read(spark, sf, "customer").select("c_custkey", d.alias("d")).withColumn("phone", parse.parse_phone(F.col("d")))


# ---- normalisation
A, B = aligned_table()


@query("norm_aligned", f"SELECT doc_id, sha256(translate(text, '{A.replace(chr(39), chr(39) * 2)}', '{B.replace(chr(39), chr(39) * 2)}')) AS h, CAST(len(text) AS BIGINT) AS n FROM documents")
def norm_aligned(spark, sf):
    t = aligned(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("h"), F.length(t).cast("long").alias("n"))


@query("tokens", """
SELECT doc_id, CAST(len(m) AS BIGINT) AS n, sha256(array_to_string([regexp_replace(x, '[.\\-&''’]+$', '') FOR x IN m], ' ')) AS h
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''’&.\\-]*') AS m FROM documents)""")
def tokens_query(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", token_values(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


# ---- masking and generalising
SALT = b"a fixed salt for the check"


def _hmac_sql(v: str) -> str:
    key = SALT.ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in key).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({v}))))"


@query("masks", f"""
SELECT c_custkey, regexp_replace(c_name, '\\S', '*', 'g') AS full_, repeat('*', len(c_name) - 4) || right(c_name, 4) AS partial_, '' AS removed, '[CUSTOMER NAME]' AS label,
'[' || substr({_hmac_sql('c_name')}, 1, 12) || ']' AS hashed, 'name_' || substr({_hmac_sql("'name:' || c_name")}, 1, 8) AS token FROM customer""")
def masks(spark, sf):
    v = F.col("c_name")
    return read(spark, sf, "customer").select(
        "c_custkey", masking.full_mask(v).alias("full_"), masking.partial_mask(v).alias("partial_"), masking.masked("remove", F.lit("name"), v).alias("removed"),
        masking.category_label(F.lit("customer_name")).alias("label"), masking.stable_hash(v, SALT).alias("hashed"), masking.pseudonym(F.lit("name"), v, SALT).alias("token"),
    )


def _bands(n: str, bands, top: str | None, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} {op} {b} THEN '{name}'" for b, name in bands) + f" ELSE '{top}' END"


AGES = "CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in gen.AGE_BANDS) + " ELSE CAST(n AS VARCHAR) END"


@query("generalised", f"""
SELECT l_orderkey, l_linenumber, {AGES} AS age, {_bands('n', gen.TENURE_BANDS, gen.TENURE_TOP, '<')} AS tenure, {_bands('n', gen.TEAM_BANDS, gen.TEAM_TOP, '<=')} AS team, strftime(l_shipdate, '%Y') AS year_
FROM (SELECT *, CAST(l_quantity AS INT) * 3 AS n FROM lineitem)""")
def generalised(spark, sf):
    n = (F.col("l_quantity").cast("int") * 3).cast("string")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", gen.age(n).alias("age"), gen.tenure(F.concat(n, F.lit(" years of service"))).alias("tenure"), gen.team_size(F.concat(n, F.lit(" people"))).alias("team"),
        gen.date(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("year_"),
    )


# ---- rewriting of whole columns
LIVE = frozenset(("email", "credit_card", "url_credential", "mac"))


@query("redact_documents")
def redact_documents(spark, sf):
    out = redact(read(spark, sf, "documents").select("doc_id", "text"), "text", Policy(default_style="label"))
    return out.select("doc_id", "redacted", F.size("findings").alias("n"))


@query("findings_by_category")
def findings_by_category(spark, sf):
    return scan(read(spark, sf, "documents"), "doc_id", "text").groupBy("category", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


EMAILS = f"regexp_extract_all(text, '{EMAIL.replace(chr(39), chr(39) * 2)}')"


@query("emails_by_lang_source", f"SELECT lang, source, CAST(sum(len({EMAILS})) AS BIGINT) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def emails_by_lang_source(spark, sf):
    df = read(spark, sf, "documents")
    return df.select("lang", "source", F.size(spans(F.col("text"), EMAIL, gate="@")).alias("k")).rollup("lang", "source").agg(F.sum("k").cast("long").alias("n"))


@query("redact_emails", f"SELECT doc_id, regexp_replace(text, '{EMAIL.replace(chr(39), chr(39) * 2)}', '[EMAIL]', 'g') AS redacted FROM documents")
def redact_emails(spark, sf):
    return redact(read(spark, sf, "documents").select("doc_id", "text"), "text", Policy(categories=frozenset(("email",)), default_style="label")).select("doc_id", "redacted")


# ---- risk
def _risk_text() -> tuple[Callable[[], Column], str]:
    parts = (("c_custkey % 2 = 0", "I was bullied. "), ("c_custkey % 3 = 0", "Every shift they yelled. "), ("c_custkey % 5 = 0", "I am the only one. "), ("c_custkey % 7 = 0", "I am pregnant. "), ("c_custkey % 11 = 0", "It was last week. "), ("c_custkey % 13 = 0", "Please keep this confidential. "))
    col = lambda: F.concat(*[F.when(F.expr(w), t).otherwise("") for w, t in parts], F.lit("The roster and the tea room and the car park are all fine by me as they are now"))
    sql = " || ".join(f"CASE WHEN {w} THEN '{t}' ELSE '' END" for w, t in parts) + " || 'The roster and the tea room and the car park are all fine by me as they are now'"
    return col, sql


RT, RT_SQL = _risk_text()
SIGNAL_SUM = " + ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN {risk.WEIGHTS[n]} ELSE 0 END" for n, p in risk.TEXT_SIGNALS.items())


@query("risk_text_signals", f"SELECT c_custkey, round(least(1, s), 6) AS score, CASE WHEN round(s, 9) >= 0.75 THEN 'critical' WHEN round(s, 9) >= 0.5 THEN 'high' WHEN round(s, 9) >= 0.25 THEN 'moderate' ELSE 'low' END AS band FROM (SELECT c_custkey, CAST({SIGNAL_SUM} AS DOUBLE) AS s FROM (SELECT c_custkey, {RT_SQL} AS t FROM customer))")
def risk_text_signals(spark, sf):
    from ..functions.text import FINDINGS

    r = pinned(dealt(read(spark, sf, "customer").select("c_custkey")).select("c_custkey", RT().alias("t")), {"r": risk.assess(F.col("t"), F.array().cast(FINDINGS))})
    return r.select("c_custkey", F.round("r.score", 6).alias("score"), F.col("r.band").alias("band"))


FLAGS = ("job_title", "tenure", "employment_status", "health_detail", "age")
FOUND_SQL = " + ".join(f"CASE WHEN p_partkey % {k} = 0 THEN {risk.WEIGHTS[c] * (1.3 if c == 'job_title' else 1)} ELSE 0 END" for c, k in zip(FLAGS, (2, 3, 5, 7, 11)))
QUASI_SQL = " + ".join(f"CASE WHEN p_partkey % {k} = 0 THEN 1 ELSE 0 END" for k in (2, 3, 5, 7, 11))


@query("risk_audience", " UNION ALL ".join(f"SELECT p_partkey, '{a}' AS audience, round({f} * (s + CASE WHEN q >= 3 THEN least(0.3, 0.1 * (q - 2)) ELSE 0 END), 6) AS score FROM (SELECT p_partkey, CAST({FOUND_SQL} AS DOUBLE) AS s, {QUASI_SQL} AS q FROM part)" for a, f in risk.QUASI_FACTOR.items()))
def risk_audience(spark, sf):
    from ..functions.text import FINDING, FINDINGS

    def one(c, k):
        f = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(c).alias("category"), F.lit(c).alias("detector"), F.lit("deterministic").alias("stage"), F.lit(0.95).alias("confidence"), F.lit("x").alias("value"), F.create_map().cast("map<string,string>").alias("metadata")).cast(FINDING)
        return F.when(F.col("p_partkey") % k == 0, F.array(f)).otherwise(F.array().cast(FINDINGS))

    found = F.flatten(F.array(*[one(c, k) for c, k in zip(FLAGS, (2, 3, 5, 7, 11))]))
    text = F.lit("one two three four five six seven eight nine ten eleven twelve thirteen")
    base = read(spark, sf, "part").select("p_partkey", found.alias("f"))
    each = F.array(*[F.struct(F.lit(a).alias("audience"), F.round(risk.assess(text, F.col("f"), a)["score"], 6).alias("score")) for a in risk.QUASI_FACTOR])
    return base.select("p_partkey", F.explode(each).alias("x")).select("p_partkey", "x.*")


@query("needs_review", "SELECT p_partkey, band, band IN ('high', 'critical') AS review FROM (SELECT p_partkey, CASE WHEN p_size * 0.02 >= 0.75 THEN 'critical' WHEN p_size * 0.02 >= 0.5 THEN 'high' WHEN p_size * 0.02 >= 0.25 THEN 'moderate' ELSE 'low' END AS band FROM part)")
def needs_review(spark, sf):
    b = risk.band(F.round(F.col("p_size") * 0.02, 9))
    return read(spark, sf, "part").select("p_partkey", b.alias("band"), risk.needs_review(b).alias("review"))


# ---- residual: an age, a date, a reference, a story, each by its own modulus
def _residual_text() -> tuple[Callable[[], Column], str]:
    parts = (("o_orderkey % 2 = 0", "he is 44 years old "), ("o_orderkey % 3 = 0", "since 12/03/2019 "), ("o_orderkey % 5 = 0", "case AB-12345 "), ("o_orderkey % 7 = 0", "and was bullied "))
    return lambda: F.concat(*[F.when(F.expr(w), t).otherwise("") for w, t in parts], F.lit("end")), " || ".join(f"CASE WHEN {w} THEN '{t}' ELSE '' END" for w, t in parts) + " || 'end'"


ZT, ZT_SQL = _residual_text()
PRODUCT = "(CASE WHEN o_orderkey % 2 = 0 THEN 24.0 ELSE 1 END * CASE WHEN o_orderkey % 3 = 0 THEN 4.0 ELSE 1 END * CASE WHEN o_orderkey % 5 = 0 THEN 5000000.0 ELSE 1 END * CASE WHEN o_orderkey % 7 = 0 THEN 200.0 ELSE 1 END)"
CASES = f"SELECT o_orderkey, 1000.0 / {PRODUCT} AS cohort, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS some_, o_orderkey % 5 = 0 AS ref FROM orders"
ACTION = "CASE WHEN NOT some_ OR cohort >= 5 THEN 'pass' WHEN ref THEN 'generalise' ELSE 'suppress' END"


@query("residual_decide", f"SELECT o_orderkey, {ACTION} AS action, round(CAST(cohort AS DOUBLE), 6) AS cohort FROM ({CASES})")
def residual_decide(spark, sf):
    m = pinned(dealt(read(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", ZT().alias("t")), {"m": residual.measure(F.col("t"))})
    d = pinned(m, {"d": residual.decide(F.col("m"))})
    return d.select("o_orderkey", F.col("d.action").alias("action"), F.round("d.cohort", 6).alias("cohort"))


@query("residual_protect", f"SELECT o_orderkey, CASE {ACTION} WHEN 'pass' THEN t WHEN 'suppress' THEN '{residual.WITHHELD}' ELSE replace(t, 'AB-12345', '[ORGANISATION REDACTED]') END AS released FROM (SELECT o_orderkey, {ZT_SQL} AS t FROM orders) JOIN ({CASES}) USING (o_orderkey)")
def residual_protect(spark, sf):
    return residual.protect(dealt(read(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", ZT().alias("t")), "t").select("o_orderkey", "released")


@query("residual_summary", f"SELECT count(*) AS records, count(*) FILTER (a = 'pass') AS \"pass\", count(*) FILTER (a = 'generalise') AS generalise, count(*) FILTER (a = 'suppress') AS suppress, round(count(*) FILTER (a <> 'pass') / count(*), 4) AS escalation_rate, round(avg(cohort), 1) AS mean_cohort FROM (SELECT CAST(cohort AS DOUBLE) AS cohort, {ACTION} AS a FROM ({CASES}))")
def residual_summary(spark, sf):
    return residual.summarise(residual.protect(dealt(read(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", ZT().alias("t")), "t"))


# ---- lexicon: terms as they are, as a phrase over two tokens, one letter off
def _lex_text() -> tuple[Callable[[], Column], str]:
    w = "CASE c_custkey % 4 WHEN 0 THEN 'timesheet' WHEN 1 THEN 'time sheet' WHEN 2 THEN 'timeshete' ELSE 'payslip' END"
    return lambda: F.expr(f"concat('lost the ', {w}, ' x', c_custkey)"), w


LT, LT_SQL = _lex_text()


@query("lex_terms", f"SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS n, CASE c_custkey % 4 WHEN 0 THEN 'the timesheet' WHEN 1 THEN 'the time sheet' WHEN 2 THEN 'timeshete' END AS value, c_custkey % 4 = 2 AS fuzzy FROM (SELECT c_custkey, {LT_SQL} AS w FROM customer)")
def lex_terms(spark, sf):
    from ..operators.lexicon import Lexicon, matches

    m = dealt(read(spark, sf, "customer").select("c_custkey")).select("c_custkey", LT().alias("t")).select("c_custkey", matches(F.col("t"), Lexicon.load()).alias("m"))
    first = F.get("m", F.lit(0))
    return m.select("c_custkey", F.size("m").cast("long").alias("n"), first["value"].alias("value"), F.coalesce(first["metadata"]["fuzzy"] == "true", F.lit(False)).alias("fuzzy"))


@query("lex_joined", f"SELECT c_custkey, 'timesheet' AS term, CAST(c_custkey % 4 = 2 AS BIGINT) AS distance, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey % 4 < 3 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 4 < 2) GROUP BY ALL")
def lex_joined(spark, sf):
    from ..operators.lexicon import Lexicon, join_matches

    df = dealt(read(spark, sf, "customer").select("c_custkey")).select("c_custkey", LT().alias("t"))
    return join_matches(df, "c_custkey", "t", Lexicon.load()).groupBy(F.col("id").alias("c_custkey"), "term", F.col("distance").cast("long").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


# ---- survey detectors on carried sentences, one of each by key
SENTENCES = (
    ("job_title", "I am a registered nurse", "registered nurse"), ("tenure", "after 18 years of service I left", "18 years of service"), ("team_size", "our team of five does it all", "five"), ("employment_status", "I am casual here", "casual"),
    ("health_detail", "my anxiety grew", "anxiety"), ("organisation_name", "I was at Wirrin Pty Ltd then", "Wirrin Pty Ltd"), ("award", "under MA000077 we are paid", "MA000077"), ("implication", "no one else", "no one else"),
    ("implication", "I hold a security clearance", "I hold a security clearance"), ("implication", "pay grade 7 increment", "pay grade 7 increment"),
)
_PICK = lambda i: "CASE s_suppkey % 10 " + " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(SENTENCES)) + " END"


@query("survey_detectors", f"SELECT s_suppkey, {_PICK(0)} AS category, {_PICK(2)} AS value FROM supplier")
def survey_detectors(spark, sf):
    df = dealt(read(spark, sf, "supplier").select("s_suppkey")).select("s_suppkey", F.expr(_PICK(1)).alias("t"))
    return scan(df, "s_suppkey", "t", Policy(survey=True)).select("s_suppkey", "category", "value")


GAZ = (("name", "Name: Jane Smith, here", "Jane Smith"), ("location", "I am based in Hobart, mostly", "Hobart"), ("age", "she is 44 years old now", "44"), ("gender", "Sex: female", "female"))
_GAZ = lambda i: "CASE s_suppkey % 4 " + " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(GAZ)) + " END"


@query("gazetteer", f"SELECT s_suppkey, {_GAZ(0)} AS category, {_GAZ(2)} AS value FROM supplier")
def gazetteer(spark, sf):
    df = dealt(read(spark, sf, "supplier").select("s_suppkey")).select("s_suppkey", F.expr(_GAZ(1)).alias("t"))
    return scan(df, "s_suppkey", "t", Policy(nlp=True, categories=frozenset(("name", "location", "age", "gender")))).select("s_suppkey", "category", "value")


# ---- overlaps: the longest wins, a card over the phone-like digits within
@query("resolve_longest", f"SELECT c_custkey, 'street_address' AS category, value FROM (SELECT c_custkey, '12 ' || CASE c_custkey % 2 WHEN 0 THEN 'Wattle' ELSE 'Banksia Creek' END || ' Road' AS value FROM customer)")
def resolve_longest(spark, sf):
    t = F.expr("concat('at 12 ', CASE c_custkey % 2 WHEN 0 THEN 'Wattle' ELSE 'Banksia Creek' END, ' Road')")
    return scan(dealt(read(spark, sf, "customer").select("c_custkey")).withColumn("t", t), "c_custkey", "t").select("c_custkey", "category", "value")


# ---- survey, triage, evaluation, context
@query("redact_conversations_triage")
def redact_conversations_triage(spark, sf):
    from .api import redact_frame

    df = dealt(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return redact_frame(df, ["text"]).groupBy("role", "text_risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text_needs_review").cast("long")).alias("review"))


@query("events_windowed_triage", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM events GROUP BY ALL")
def events_windowed_triage(spark, sf):
    from ..streaming import triage_counts

    return triage_counts(read(spark, sf, "events"), "ts", risk.band(F.col("value") / 100))


@query("eval_recall_by_kind_form")
def eval_recall_by_kind_form(spark, sf):
    from .corpus import generate_for, outcomes, recall

    return recall(outcomes(generate_for(dealt(read(spark, sf, "customer").select("c_custkey")), "c_custkey")))  # a record a customer


@query("eval_overmasking")
def eval_overmasking(spark, sf):
    from .corpus import generate_for, over_masking

    return over_masking(generate_for(dealt(read(spark, sf, "customer").select("c_custkey")), "c_custkey"))


@query("ctx_rule_counts")
def ctx_rule_counts(spark, sf):
    from ..operators.context import context_findings, rule_counts

    return rule_counts(context_findings(read(spark, sf, "documents"), "doc_id", "text"))
