"""Terms that narrow an employer: exact, phrase and one-letter-off matches.

Three physical forms of one look-up.  :func:`matches` is a column: up to WIDE forms and one
letter off they are sets and a map of literals; beyond that a Pandas UDF looks up in
dictionaries that go to the workers (:func:`by_dictionary`), up to BROADCAST forms.
:func:`join_matches` joins exploded n-grams and deletions with the forms, for lexicons of any
size; the forms are broadcast only if there are no more than BROADCAST of them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FINDINGS, TOKEN, finding, token_key, token_place, token_values
from . import seed
from .detectors import claimed_in_turn

WIDE = 64
BROADCAST = 1_000_000
FUZZY_LEAST = 6  # characters of a token that may be one letter off
KNOWN_WORDS = 200_000  # tokens that a task remembers; more are looked up anew
HALF = 6  # characters of a half of a key that are compared, at most
HALVED = 1_000_000  # deletions of which halves are made


@dataclass(frozen=True)
class Term:
    term: str
    category: str = "internal_term"
    label: str = ""
    aliases: tuple[str, ...] = ()
    exact_only: bool = False

    @property
    def forms(self) -> tuple[str, ...]:
        return (self.term, *self.aliases)


def key_of(form: str) -> str:
    """A form's letters and digits, case folded, as :func:`token_key` has tokens."""
    return "".join(c for c in form.lower() if c.isalnum())


def less(key: str, most: int = 1) -> dict[str, int]:
    """What is left of the key without up to ``most`` characters, and how many are gone."""
    out = {key: 0}
    last = [key]
    for gone in range(1, most + 1):
        last = [x for k in last for x in dict.fromkeys(k[:i] + k[i + 1 :] for i in range(len(k))) if x and x not in out]
        out |= dict.fromkeys(last, gone)
    return out


@dataclass(frozen=True)
class Lexicon:
    """Terms in order: where two share a form, the first has it."""

    terms: tuple[Term, ...] = ()
    max_distance: int = 1

    @staticmethod
    def from_json(text: str) -> Lexicon:
        d = json.loads(text)
        return Lexicon(tuple(Term(t["term"], t.get("category", "internal_term"), t.get("label") or t["term"], tuple(t.get("aliases") or ()), bool(t.get("exact_only"))) for t in d["terms"]), int(d.get("max_distance", 1)))

    @staticmethod
    def load(path: str | Path | None = None) -> Lexicon:
        """Of a JSON file, or the bundled terms."""
        text = json.dumps({"max_distance": 1, "terms": seed.entries()}) if path is None else Path(path).read_text(encoding="utf-8")
        return Lexicon.from_json(text)

    def merged(self, other: Lexicon) -> Lexicon:
        return Lexicon(self.terms + other.terms, max(self.max_distance, other.max_distance))

    def exact(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, t in enumerate(self.terms):
            for f in t.forms:
                out.setdefault(key_of(f), i)
        out.pop("", None)
        return out

    def fuzzy(self) -> dict[str, int]:
        """Deletions of the forms of one word, up to ``max_distance``."""
        out: dict[str, int] = {}
        if self.max_distance:
            for i, t in enumerate(self.terms):
                if not t.exact_only:
                    for f in t.forms:
                        if " " not in f:
                            for d in less(key_of(f), self.max_distance):
                                out.setdefault(d, i)
        return out

    def describe(self) -> list[dict]:
        """The terms as JSON has them."""
        return [{"term": t.term, "category": t.category, "label": t.label or t.term, "aliases": list(t.aliases), "exact_only": t.exact_only} for t in self.terms]

    @property
    def longest(self) -> int:
        return max((len(f.split()) for t in self.terms for f in t.forms), default=1)


def _deletions(key: Column) -> Column:
    n = F.length(key)
    return F.concat(F.array(key), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n))))


def matches(text: Column, lexicon: Lexicon) -> Column:
    """Findings: phrases of several tokens first, the longest first, then single tokens,
    exact before one letter off.  Keys leave out what is between tokens, so "time sheet"
    is "timesheet"."""
    exact, fuzzy = lexicon.exact(), lexicon.fuzzy()
    if not exact:
        return F.array().cast(FINDINGS)
    if len(exact) > WIDE or lexicon.max_distance > 1:
        return by_dictionary(text, lexicon)
    table = F.create_map(*[F.lit(x) for k, i in exact.items() for x in (k, i)])
    close = F.create_map(*[F.lit(x) for k, i in fuzzy.items() for x in (k, i)]) if fuzzy else None
    terms = lexicon.terms
    col = lambda values: F.array(*[F.lit(v) for v in values])
    names, labels, kinds = col([t.term for t in terms]), col([t.label or t.term for t in terms]), col([t.category for t in terms])
    lengths = col([len(key_of(t.term)) for t in terms])
    keys = F.transform(token_values(text), token_key)
    start, end = token_place(text)

    def hit(i, n, index, distance):
        y = F.struct(start(i).alias("start"), end(i + (n - 1)).alias("end"), F.lit("").alias("value"))
        base = [F.lit("canonical"), F.get(names, index), F.lit("label"), F.get(labels, index)]
        more = [F.lit("distance"), F.lit("1"), F.lit("fuzzy"), F.lit("true")] if distance else []
        return finding(y, F.get(kinds, index), "lexicon_term", 0.85 if distance else 1.0, F.create_map(*base, *more), text=text)

    # only what hits gets its place, and its finding
    def phrases(n):
        at = F.when(F.size(keys) >= n, F.sequence(F.lit(0), F.size(keys) - n)).otherwise(F.array().cast("array<int>"))
        key = lambda i: F.concat(*[F.get(keys, i + j) for j in range(n)])
        return F.transform(F.filter(at, lambda i: key(i).isin(*exact)), lambda i: hit(i, n, F.element_at(table, key(i)), 0))

    near = lambda k: F.filter(_deletions(k), lambda d: d.isin(*fuzzy))
    close_enough = lambda k: (F.length(k) >= FUZZY_LEAST) & (F.size(near(k)) > 0) if close is not None else F.lit(False)

    def best(k):
        ranked = F.sort_array(F.transform(near(k), lambda d: F.struct(F.when(d == k, 0).otherwise(1).alias("d"), (-F.get(lengths, F.element_at(close, d))).alias("n"), F.element_at(close, d).alias("i"))))
        return F.get(ranked, F.lit(0))["i"]

    def single(i):
        k = F.get(keys, i)
        one = F.when(k.isin(*exact), hit(i, 1, F.element_at(table, k), 0))
        return one.otherwise(hit(i, 1, best(k), 1)) if close is not None else one

    every = F.when(F.size(keys) > 0, F.sequence(F.lit(0), F.size(keys) - 1)).otherwise(F.array().cast("array<int>"))
    singles = F.transform(F.filter(every, lambda i: F.get(keys, i).isin(*exact) | close_enough(F.get(keys, i))), single)
    # tokens run on past the words of a form (hyphens, dots), so one more is tried
    found = [phrases(n) for n in range(lexicon.longest, 1, -1)]
    return claimed_in_turn([*found, singles])


def by_dictionary(text: Column, lexicon: Lexicon) -> Column:
    """What :func:`matches` finds, by look-ups in the workers: for lexicons whose literals would
    swell the plan, and for two letters off.  The forms go to each task, so more than
    BROADCAST are refused; join those."""
    return F.pandas_udf(looker(lexicon), FINDINGS)(text)


def halves(forms, least: int = FUZZY_LEAST) -> tuple[set[str], set[str]]:
    """The first and the last characters, as many as :func:`may_be_near` asks for, of the deletions of forms."""
    sizes = range(least // 2, HALF + 1)
    return {d[:h] for d in forms for h in sizes}, {d[-h:] for d in forms for h in sizes}


def may_be_near(key: str, heads: set[str], tails: set[str]) -> bool:
    """False only where no deletion of the key, of one character at most, is one of the forms': of its halves
    one is whole in each."""
    h = min(len(key) // 2, HALF)
    return key[:h] in heads or key[-h:] in tails


def looker(lexicon: Lexicon):
    """texts -> the findings of each.  A token is looked up once in a task, phrases are followed from the tokens
    that begin a form for as long as one goes on so, and places are made only of texts that have a finding."""
    exact, fuzzy, terms, longest, most = lexicon.exact(), lexicon.fuzzy(), lexicon.terms, lexicon.longest, lexicon.max_distance
    if len(exact) > BROADCAST or len(fuzzy) > 20 * BROADCAST:
        raise ValueError(f"{len(exact)} forms, {len(fuzzy)} with deletions: use join_matches")
    lengths = [len(key_of(t.term)) for t in terms]
    token = re.compile(TOKEN)
    heads, tails = halves(fuzzy) if most == 1 and len(fuzzy) <= HALVED else (None, None)

    def near(key):
        """(term, letters off) of the nearest term, of equal ones the longest, then the first."""
        if heads is not None and not may_be_near(key, heads, tails):
            return None
        best = None
        for variant, gone in less(key, most).items():
            i = fuzzy.get(variant)
            if i is not None and (best is None or (gone, -lengths[i], i) < best):
                best = (gone, -lengths[i], i)
        return None if best is None else best[2]

    ordered = sorted(exact)
    begun = {k[:n] for k in exact for n in range(1, HALF + 1)}  # what most that begins no form is told by
    words: dict[str, tuple] = {}  # of a task: token -> (length, key, exact, near, whether a form begins so, whether any of these)

    def begins(key):
        if key[:HALF] not in begun:
            return False
        at = bisect_left(ordered, key)
        return at < len(ordered) and ordered[at].startswith(key)

    def word(token):
        own = token.rstrip(".-&'’")
        key = own.lower()
        key = key if key.isalnum() else key_of(own)
        i = exact.get(key) if key else None
        close = near(key) if key and i is None and most and len(key) >= FUZZY_LEAST else None
        start = begins(key)
        w = (len(own), key, i, close, start, start or i is not None or close is not None)
        if len(words) < KNOWN_WORDS:
            words[token] = w
        return w

    def one(s):
        known = words.get
        found = [known(t) or word(t) for t in token.findall(s)]
        tries, singles = [], []
        for at, w in enumerate(found):
            if w[5]:
                if w[2] is not None or w[3] is not None:
                    singles.append(at)
                if w[4]:
                    key = w[1]
                    for n, more in enumerate(found[at + 1 : at + longest], 2):
                        key += more[1]
                        if not begins(key):
                            break
                        if (i := exact.get(key)) is not None:
                            tries.append((-n, at, i))
        if not tries and not singles:
            return []
        starts, taken, out = [m.start() for m in token.finditer(s)], [False] * len(found), []

        def claim(at, n, i, off):
            a, b = starts[at], starts[at + n - 1] + found[at + n - 1][0]
            taken[at : at + n] = [True] * n
            extra = {"distance": "1", "fuzzy": "true"} if off else {}
            out.append({"start": a, "end": b, "category": terms[i].category, "detector": "lexicon_term", "stage": "deterministic", "confidence": 0.85 if off else 1.0, "value": s[a:b], "metadata": {"canonical": terms[i].term, "label": terms[i].label or terms[i].term, **extra}})

        for n, at, i in sorted(tries):  # the longest first, then by place
            if not any(taken[at : at - n]):
                claim(at, -n, i, False)
        for at in singles:
            if not taken[at]:
                w = found[at]
                claim(at, 1, w[2] if w[2] is not None else w[3], w[2] is None)
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(s) if s else [] for s in texts])

    return run


def form_rows(spark: SparkSession, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(exact, deletions) as rows ``key, term, label, category, length, seq``."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("term", T.StringType()), T.StructField("label", T.StringType()), T.StructField("category", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("seq", T.IntegerType())])
    rows = lambda d: [(k, (t := lexicon.terms[i]).term, t.label or t.term, t.category, len(key_of(t.term)), i) for k, i in d.items()]
    return spark.createDataFrame(rows(lexicon.exact()), schema), spark.createDataFrame(rows(lexicon.fuzzy()), schema)


def join_matches(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """Candidate rows ``id, at, n, term, label, category, distance`` before claims (tokens
    ``at`` to ``at + n - 1``): exploded n-grams and deletions, equi-joined with the forms."""
    exact, fuzzy = form_rows(df.sparkSession, lexicon)
    if len(lexicon.exact()) <= BROADCAST:
        exact, fuzzy = F.broadcast(exact), F.broadcast(fuzzy)
    src = df.select(F.col(id_col).alias("id"), F.transform(token_values(F.col(text_col)), token_key).alias("k"))
    sizes = F.array(*[F.lit(n) for n in range(1, lexicon.longest + 1)])
    grams = src.select("id", "k", F.explode(sizes).alias("n")).where(F.size("k") >= F.col("n")).select("id", "k", "n", F.explode(F.sequence(F.lit(0), F.size("k") - F.col("n"))).alias("at"))
    every = grams.select("id", "at", "n", F.array_join(F.slice("k", F.col("at") + 1, F.col("n")), "").alias("key"))
    hits = every.join(exact, "key").select("id", "at", "n", "term", "label", "category", F.lit(0).alias("distance"))
    known = every.where((F.col("n") == 1) & (F.length("key") >= FUZZY_LEAST)).join(exact.select("key"), "key", "left_anti")
    near = known.select("id", "at", F.col("key").alias("own"), F.explode(_deletions(F.col("key"))).alias("key")).join(fuzzy, "key")
    best = near.groupBy("id", "at").agg(F.min(F.struct(F.when(F.col("key") == F.col("own"), 0).otherwise(1).alias("d"), (-F.col("length")).alias("l"), "seq", "term", "label", "category")).alias("b"))
    return hits.unionByName(best.select("id", "at", F.lit(1).alias("n"), "b.term", "b.label", "b.category", F.lit(1).alias("distance")))
