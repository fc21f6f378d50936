"""A trained back end for names and places: a structured perceptron, decoded by Viterbi.

Trained by Spark on a generated corpus whose spans are known: each round sends the weights to the
shards, each shard goes through its sentences once, and the shards' weights are averaged
(iterative parameter mixing).  Applied in the workers as the ``backend`` of
:func:`plans.api.redact`, where it takes the gazetteer's place.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("name", "location")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BITS = 15
OWN = (0, 2, 3, 4)  # columns of features() that tell the word itself
NOTHING = (1 << BITS) - 1  # a feature that is left out: no weight
SHARDS = 8
LONGEST = 200  # tokens that are decoded together
WORD = re.compile(r"[^\W\d_][\w'’-]*|\d+|[^\w\s]")
ENDS = frozenset(".!?")

# Parts of sentences, names and places of our own.  What is held out shares no sentence, name or
# place with what is for training.
OPEN = ("", "", "", "Today", "Last week", "On Monday", "In May", "Sadly", "But", "So", "After lunch", "This year", "Then", "Often", "When it rained", "In the end", "Every Friday")
CLOSE = ("", "", "", "again", "last night", "on Wednesday", "in October", "for weeks", "without a word", "at the Depot", "with the Manager", "before Christmas", "and nobody cared", "because of Payroll", "as usual")
CLAUSES = {
    "{N} {}": ("yelled at me", "left early", "said no", "was rude", "runs the shop", "never answers", "quit", "is a bully", "was the boss", "signed it", "sat there", "got angry", "helped a lot", "works nights", "told everyone", "laughed", "walks past us"),
    "{} {N}": ("I rang", "we asked", "they blame", "she thanked", "nobody told", "ask", "have they seen", "I reported it to", "my manager is", "do you know", "we wait for", "it was", "I sat with", "he wrote to", "people like", "the boss was"),
    "{} {N} and {M}": ("I saw", "we met", "it went to", "they moved", "she works with", "talk to"),
    "{N} and {M} {}": ("left", "argue", "drove home", "shout", "run the place", "were late"),
    "{} {L}": ("we moved to", "they live in", "I came from", "the office is in", "there is a shop near", "people at", "he flew to", "the job in", "it is far from", "a site outside", "we stayed in", "the team at", "trucks leave", "she was posted to"),
    "{} {L} was closed": ("the shop in", "the store outside", "our office at"),
    "{} {L} are tired": ("staff near", "nurses at", "our crew from", "drivers in"),
    "{N} {} {L}": ("moved to", "lives in", "drives to", "comes from", "was sent to", "hates"),
    "the {C} {}": ("was closed", "is a mess", "came late", "never works", "goes nowhere", "was on Saturday", "has a new form", "got lost"),
    "{} the {C}": ("I read", "we asked", "he lost", "they changed", "nobody reads", "send it to", "ask"),
}
COMMON = ("Safety Committee", "Annual Report", "Code of Conduct", "Team Leader", "Lunch Room", "Leave Form", "Roster", "Branch", "Union", "Head Office", "Area Manager", "Night Shift", "Staff Survey", "Review", "Claims Team", "Meeting", "Policy")
HELD_OUT = (
    "Yesterday {N} shouted at us.", "I complained to {N} twice.", "There is a depot outside {L}.", "{N} is the worst boss.", "We were sent to {L} in June.", "The Training Room was locked on Sunday.", "Have you met {N} yet?", "Staff in {L} were angry.",
    "Then {N} and {M} went home.", "The Incident Form goes to Payroll.", "Every Thursday {N} comes to {L}.", "Our Branch has a new Roster.",
)
NAMES = {
    False: (("Alice", "Brendan", "Chloe", "Damien", "Erin", "Farid", "Gemma", "Hamish", "Imogen", "Jarrod", "Keiko", "Liam", "Mei", "Nadia", "Owen", "Priya", "Rohan", "Sally", "Trent", "Wendy"), ("Abbott", "Baker", "Chen", "Dawson", "Evans", "Fletcher", "Gupta", "Hughes", "Ivanov", "Johnson", "Kelly", "Lawson", "Murphy", "Nguyen", "Patel", "Robinson")),
    True: (("Anita", "Boris", "Carmel", "Dougal", "Esther", "Fraser", "Greta", "Heath", "Ingrid", "Jasper", "Kirra", "Lachlan"), ("Armitage", "Bianchi", "Crawford", "Drummond", "Eastwood", "Fitzgerald", "Gallagher", "Hamilton")),
}
PLACES = {False: ("Albury", "Ballarat", "Cairns", "Dubbo", "Echuca", "Gosford", "Horsham", "Ipswich", "Kalgoorlie", "Launceston", "Mildura", "Orange", "Port Augusta", "Rockhampton", "Swan Hill", "Toowoomba"), True: ("Bathurst", "Broken Hill", "Darwin", "Geraldton", "Hervey Bay", "Lismore", "Tamworth", "Whyalla")}


def tagged_corpus(spark: SparkSession, n: int, held_out: bool = False, seed: int = 0) -> DataFrame:
    """``id, text, spans array<struct<start, end, category>>``; chosen by hashes of the row number, so
    the same however it is dealt."""
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64(F.col("id") + seed * 1_000_003, F.lit(salt)), F.lit(len(xs))).cast("int") + 1)
    first, last = NAMES[held_out]

    def name(salt):
        return F.when(F.pmod(F.xxhash64(F.col("id") + seed, F.lit(salt)), F.lit(2)) == 0, pick(first, salt + "f")).otherwise(F.concat_ws(" ", pick(first, salt + "f"), pick(last, salt + "l")))

    if held_out:
        sentence = pick(HELD_OUT, "t")
    else:
        clause = pick(tuple(CLAUSES), "c")
        words = F.element_at(F.create_map(*[x for k, v in CLAUSES.items() for x in (F.lit(k), pick(v, "w" + k))]), clause)
        made = F.replace(F.replace(clause, F.lit("{}"), words), F.lit("{C}"), pick(COMMON, "k"))
        body = F.concat_ws(" ", F.nullif(pick(OPEN, "o"), F.lit("")), made, F.nullif(pick(CLOSE, "e"), F.lit("")))
        sentence = F.concat(F.when(body.startswith("{"), body).otherwise(F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 1000))), pick((".", ".", "!", "?"), "."))
    df = spark.range(n).select("id", sentence.alias("t"), name("n").alias("N"), name("m").alias("M"), pick(PLACES[held_out], "p").alias("L"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,category:string>>").alias("spans"))
    parts = F.regexp_extract_all("t", F.lit(r"\{[NML]\}|[^{]+"), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        value = F.when(p == "{N}", F.col("N")).when(p == "{M}", F.col("M")).when(p == "{L}", F.col("L"))
        at = F.length(acc["text"])
        span = F.array(F.struct(at.alias("start"), (at + F.length(value)).alias("end"), F.when(p == "{L}", "location").otherwise("name").alias("category")))
        return F.struct(F.concat(acc["text"], F.coalesce(value, p)).alias("text"), F.when(value.isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"))

    return df.select("id", F.aggregate(parts, start, step).alias("x")).select("id", "x.text", "x.spans")


def shape(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", w))))


def features(words: Sequence[str]) -> np.ndarray:
    """Hashed features of each word: itself, its shape, prefixes and suffixes, and its neighbours."""
    low, shapes = ["<s>", "<s>", *(w.lower() for w in words), "</s>", "</s>"], ["", "", *map(shape, words), "", ""]
    out = []
    for i in range(2, len(words) + 2):
        w, s = low[i], shapes[i]
        found = (f"w{w}", f"s{s}", f"p{w[:3]}", f"f{w[-3:]}", f"f{w[-2:]}", f"-1{low[i - 1]}", f"+1{low[i + 1]}", f"-2{low[i - 2]}|{low[i - 1]}", f"-1{shapes[i - 1]}|{s}", f"+1{s}|{shapes[i + 1]}", f"-1{low[i - 1]}|{s}", f"+1{low[i + 1]}|{s}", f"{i == 2}{s}")
        out.append([zlib.crc32(x.encode()) % NOTHING for x in found])
    return np.array(out)


def sentences(text: str) -> list[list[tuple[int, int, str]]]:
    """Words with their places, cut at sentence ends and at LONGEST words."""
    out, last = [], []
    for m in WORD.finditer(text):
        last.append((m.start(), m.end(), m[0]))
        if m[0] in ENDS or len(last) >= LONGEST:
            out.append(last)
            last = []
    return [*out, last] if last else out


@dataclass
class Tagger:
    """A model: usable as ``backend`` of :func:`plans.api.redact`, :func:`plans.api.scan`."""

    weights: np.ndarray  # feature, tag
    steps: np.ndarray  # tag before (the last: none), tag

    @staticmethod
    def empty() -> Tagger:
        return Tagger(np.zeros((1 << BITS, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS))))

    def decode(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags, and by how much each leads the runner-up of its word."""
        emit = self.weights[feats].sum(axis=1)
        best, back = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        best[0] = emit[0] + self.steps[-1] + np.array([-1e9 if t.startswith("I") else 0 for t in TAGS])
        for i in range(1, len(emit)):
            s = best[i - 1][:, None] + self.steps[:-1] + BARRED
            back[i] = s.argmax(axis=0)
            best[i] = s.max(axis=0) + emit[i]
        tags = np.empty(len(emit), np.int64)
        tags[-1] = best[-1].argmax()
        for i in range(len(emit) - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        order = np.sort(emit, axis=1)
        return tags, np.where(emit[np.arange(len(tags)), tags] == order[:, -1], order[:, -1] - order[:, -2], 0.0)

    def learn(self, data: list[tuple[np.ndarray, np.ndarray]], seed: int = 0, dropped: float = 0.3) -> None:
        """One pass.  Some features are left out at random, and of half of the words all that tell
        the word itself, as the names to be found are mostly new ones."""
        g = np.random.default_rng(seed)
        for feats, gold in data:
            feats = np.where(g.random(feats.shape) < dropped, NOTHING, feats)
            feats[np.ix_(g.random(len(feats)) < 0.5, OWN)] = NOTHING
            tags, _ = self.decode(feats)
            for t, y, f, a, b in zip(tags, gold, feats, np.append(-1, tags[:-1]), np.append(-1, gold[:-1]), strict=True):
                if t != y:
                    f = f[f != NOTHING]
                    self.weights[f, y] += 1
                    self.weights[f, t] -= 1
                if t != y or a != b:
                    self.steps[b, y] += 1
                    self.steps[a, t] -= 1

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        out: list[tuple[int, int, str, float]] = []
        for words in sentences(text):
            tags, lead = self.decode(features([w for _, _, w in words]))
            for (a, b, _), t, m in zip(words, tags, lead, strict=True):
                if TAGS[t].startswith("B"):
                    out.append((a, b, TAGS[t][2:], round(float(1 / (1 + np.exp(-m / 8))), 4)))
                elif TAGS[t].startswith("I"):
                    s, _, kind, p = out[-1]
                    out[-1] = (s, b, kind, p)
        return out

    def __call__(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str, float]]]:
        return [self.find(t) if t else [] for t in texts]

    def save(self, spark: SparkSession, path: str) -> None:
        held = io.BytesIO()
        np.savez_compressed(held, weights=self.weights, steps=self.steps)
        spark.createDataFrame([(bytearray(held.getvalue()),)], "model binary").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tagger:
        d = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["model"])))
        return Tagger(d["weights"], d["steps"])


#: An inside follows only its own kind's begin or inside.
BARRED = np.array([[-1e9 if b.startswith("I") and not (a != "O" and a[2:] == b[2:]) else 0.0 for b in TAGS] for a in TAGS])


def gold_tags(words: list[tuple[int, int, str]], spans) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for s in spans:
        inside = [i for i, (a, b, _) in enumerate(words) if a < s["end"] and s["start"] < b]
        for j, i in enumerate(inside):
            out[i] = TAGS.index(("B-" if j == 0 else "I-") + s["category"])
    return out


def train(corpus: DataFrame, rounds: int = 6, shards: int = SHARDS) -> Tagger:
    """A tagger from ``text, spans``.  Sentences are dealt to ``shards`` by a hash of the text; a shard
    goes through its own in each round, in the order of their hashes, so the model depends on
    neither order nor dealing.  Per round and shard one set of weights (fixed size) comes
    back.  Texts without spans teach what is none; null texts are left out."""
    spark = corpus.sparkSession
    rows = corpus.where("text IS NOT NULL").select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), F.xxhash64("text").alias("h"), "text", "spans").persist()
    model, total = Tagger.empty(), Tagger.empty()
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def one(held: pd.DataFrame) -> pd.DataFrame:  # collected within the round
            mine = Tagger(sent.value.weights.copy(), sent.value.steps.copy())
            data = []
            for text, spans in held.sort_values(["h", "text"])[["text", "spans"]].itertuples(index=False):
                data += [(features([w for _, _, w in s]), gold_tags(s, spans)) for s in sentences(text)]
            mine.learn(data, turn)
            return pd.DataFrame({"w": [np.concatenate([mine.weights.ravel(), mine.steps.ravel()]).astype(np.float32).tobytes()]})

        got = [np.frombuffer(r["w"], np.float32).astype(float) for r in rows.groupBy("shard").applyInPandas(one, "w binary").collect()]
        sent.destroy()
        if not got:
            break
        mean, cut = np.mean(got, axis=0), model.weights.size
        model = Tagger(mean[:cut].reshape(model.weights.shape), mean[cut:].reshape(model.steps.shape))
        total.weights += model.weights
        total.steps += model.steps
    rows.unpersist()
    return total


def score(found: DataFrame, gold: DataFrame) -> DataFrame:
    """``category, gold, found, right, precision, recall, f1`` of exact spans, both as ``id, start, end,
    category``, with a row for all (null)."""
    g = gold.select("id", "start", "end", "category").distinct().withColumn("g", F.lit(1))
    f = found.select("id", "start", "end", "category").distinct().withColumn("f", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = g.join(f, ["id", "start", "end", "category"], "full").rollup("category").agg(n("g").alias("gold"), n("f").alias("found"), n(F.col("g") * F.col("f")).alias("right"))
    p, r = F.col("right") / F.nullif("found", F.lit(0)), F.col("right") / F.nullif("gold", F.lit(0))
    return out.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(2 * F.col("right") / F.nullif(F.col("gold") + F.col("found"), F.lit(0)), 4)})
