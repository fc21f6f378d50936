"""Secret scanning through an incremental ledger of blobs.  JVM only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed_join, table

SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` must not match the empty string.  A match counts if its group
    ``group`` has ``least`` characters; ``version`` changes with either."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),  # runs are maximal, so what is too short has no longer match in it
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Spans beyond the base kinds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", 1, r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", 1, r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<kind,start,end>> in code points, end exclusive.

    The parts between the matches give the places: match i starts after i + 1 parts
    and i matches.  One fold carries the running place, so a text costs its length.
    """
    p = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    each = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["whole"])
        hit = F.array(F.struct(F.lit(rule.kind).alias("kind"), a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(each, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def blob_of(text: Column) -> Column:
    """The content address of a version."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def unseen(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> DataFrame:
    """``blobs`` (a row a ``blob``) of which any rule version is not in the ledger, with ``todo``: which."""
    want = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    done = ledger.groupBy(F.col("blob").alias("b")).agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
    left = blobs.join(done, F.col("blob") == F.col("b"), "left").withColumn("todo", F.array_except(want, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("b", "done")


def scan(spark: SparkSession, versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger after this scan.

    Every version is addressed by the SHA-256 of its text.  Of the (blob, rule
    version) pairs only those that ``ledger`` (blob, kind, version, spans) lacks are
    scanned, each blob once however many paths hold it: the version with the least
    id brings the text.  Findings then join back to all versions.

    Returns ``(paths, ledger)``: ``paths`` is ``id_col, blob, spans`` per input row,
    spans of all rules by start, then rule order; ``ledger`` has one row per blob and
    rule version, old and new, to be written for the next scan.

    Null text counts as empty.  Null ids are a path like any other.  Rows that repeat
    an id and text give a row each.  Columns other than id and text are not read, so
    their names cannot clash.  A rule whose version changed is scanned anew and its
    former findings no longer count.
    """
    rows = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    blobs = cut(rows.groupBy("blob").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    first = unseen(blobs, rules, ledger)
    # the text of one version per open blob; a repeated row brings it twice, which the ledger drops
    src, f = rows.alias("s"), first.withColumnRenamed("blob", "b").alias("f")
    open_ = src.join(f, (F.col("s.blob") == F.col("f.b")) & F.col("s.id").eqNullSafe(F.col("f.first"))).select("blob", "text", "todo")
    per_rule = F.array(*[
        F.when(
            F.array_contains("todo", f"{r.kind}@{r.version}"),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ])
    new = cut(open_.select("blob", per_rule.alias("rules")).dropDuplicates(["blob"]))
    new_rows = new.select("blob", F.explode(F.filter("rules", lambda x: x.isNotNull())).alias("r")).select("blob", "r.*")
    book = ledger.select("blob", "kind", "version", "spans").unionByName(new_rows)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    live = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules]) & (F.size("spans") > 0)
    hits = book.where(live).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    hits = hits.where(F.size("spans") > 0).select("blob", F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    ).alias("spans"))
    # by blob, and those of very many paths by a broadcast within a bound
    weighed = hits.join(blobs.select("blob", "n"), "blob")
    paths = keyed_join(rows.select("id", "blob"), weighed, ["blob"], "n", "id").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return paths, book


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over every row of ``documents``, by two scans as a history has them: the
    first of an earlier state (half of the documents, by a hash of the id), whose ledger goes to
    the shared folder, the second of all, which scans only what that ledger lacks and takes
    the rest from it.  Rules for nulls, repeats and ties are those of :func:`scan`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ledger = table(scan(spark, earlier)[1])
    paths, _ = scan(spark, docs, ledger=ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return paths.select(
        "doc_id",
        *[F.size(F.expr(f"filter(spans, s -> s.kind = '{r.kind}')")).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same by RE2: split parts give the places, as lists per rule."""
    hits = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        hits.append(f"""
SELECT doc_id, '{r.kind}' AS kind, {i} AS o, s AS start_, s + len(w) AS end_ FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i - 1], '')))) AS s, unnest(m) AS w, unnest(v) AS v
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS v, string_split_regex(text, '{p}') AS g FROM t WHERE regexp_matches(text, '{p}')))
WHERE len(v) >= {r.least}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS ({" UNION ALL ".join(hits)}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, o) FILTER (o < {len(BASE)}) AS base,
  string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, o) AS spans FROM h GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""


OP2_SQL = _sql()
