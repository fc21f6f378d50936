"""Toxicity: a convolutional classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, release, table
from .words import word_hashes

PREFIXES = (4, 5, 6, 7, 9)
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE = 4000  # labelled documents of each class at most that training takes
SAMPLE_BYTES = 128 << 20  # of text at most that training takes
PAD = max(WIDTHS) - 1


def held_out(doc_id: Column, fold: int = 5) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % fold == 0


def features(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks ``(first, ids, starts)``: bucket numbers of the words of consecutive
    texts, PAD empty words after each text and one in an empty text; bucket 0 is empty."""
    for first, count, h, ends in word_hashes(texts, True, PREFIXES):
        ids = np.where(h == 0, 0, 1 + h % np.uint64(BUCKETS - 1)).astype(np.int32)
        n = np.diff(np.concatenate([[0], ends]))
        room = np.maximum(n, 1) + PAD
        starts = np.cumsum(room) - room
        out = np.zeros((int(room.sum()), ids.shape[1]), np.int32)
        out[np.arange(len(ids)) + np.repeat(starts - (ends - n), n)] = ids
        yield first, out, np.concatenate([starts, [len(out)]])


@dataclass
class Model:
    emb: np.ndarray
    conv: dict[int, np.ndarray]  # width -> (width * DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool = False):
        """Max of each filter over each text, at least 0; with ``where`` also its place."""
        x = self.emb[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x += self.emb[ids[:, j]]
        pads = (starts[1:, None] - 1 - np.arange(PAD)).ravel()
        tops, places = [], []
        for w in WIDTHS:
            k = self.conv[w].reshape(w, DIM, FILTERS)
            c = x @ k[0]
            for j in range(1, w):
                c[:-j] += x[j:] @ k[j]
            c[pads] = -np.inf
            top = np.maximum.reduceat(c, starts[:-1], axis=0)
            tops.append(top + self.bias[w])
            if where:
                places.append(np.stack([starts[i] + np.argmax(c[starts[i] : starts[i + 1]], axis=0) for i in range(len(starts) - 1)]))
        return np.maximum(np.concatenate(tops, axis=1), 0), np.concatenate(places, axis=1) if where else None

    def logit(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(ids, starts)[0] @ self.out + self.out_bias

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.logit(ids, starts).astype(np.float64) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _docs(texts) -> list[np.ndarray]:
    out = []
    for _, ids, starts in features(texts):
        out += [ids[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
    return out


def _join(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def _prior(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of each bucket by documents, shrunk to 0 where few have it."""
    n = np.zeros((2, BUCKETS))
    for d, t in zip(docs, y, strict=True):
        n[int(t), np.unique(d)] += 1
    a, b = (n[1] + 0.5) / (y.sum() + 1), (n[0] + 0.5) / (len(y) - y.sum() + 1)
    return np.where(n.sum(0) >= 4, np.log(a / b), 0.0) * n.sum(0) / (n.sum(0) + 8)


def train(texts: list[str], toxic: list[int], langs: list[str | None], prior: float, steps: int = 500, seed: int = 7) -> Model:
    """A model from labelled texts; ``prior`` is the share of toxic ones in all labels.

    Texts go by number into three parts: log odds of buckets, which start the first
    embedding dimension, come from two; weights from two, one of them shared (Adam, weighted log loss
    through the places of the maxima); the logistic scale and each language's
    threshold (best F1) from the third.
    """
    rng = np.random.default_rng(seed)
    docs, y = _docs(texts), np.array(toxic, np.float64)
    part = rng.permutation(len(docs)) % 4
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    conv = {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    first = [i for i in range(len(docs)) if part[i] < 2]
    if first:
        emb[:, 0] = (_prior([docs[i] for i in first], y[first]) / 2).astype(np.float32)
        for w in WIDTHS:
            for f in range(FILTERS // 2):
                conv[w][np.arange(w) * DIM, f] = (1.0 - 0.4 * f / FILTERS) * (1 if f % 2 == 0 else -1) / w
    emb[0] = 0
    model = Model(emb, conv, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32))
    if not docs or not 0 < y.sum() < len(y):
        model.out[:] = 0
        model.out_bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return model
    fit = np.array([i for i in range(len(docs)) if part[i] in (1, 2)] or range(len(docs)))
    dense = {"out": model.out, **{f"c{w}": model.conv[w] for w in WIDTHS}, **{f"b{w}": model.bias[w] for w in WIDTHS}}
    m1, m2 = {k: np.zeros_like(v) for k, v in dense.items()}, {k: np.zeros_like(v) for k, v in dense.items()}
    step, rate, eg = 0, 0.01, np.full((BUCKETS, 1), 1e-3, np.float32)
    for _ in range(max(6, -(-steps * 32 // len(fit)))):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            ids, starts = _join([docs[i] for i in batch])
            pool, place = model.pooled(ids, starts, True)
            p = 1 / (1 + np.exp(-np.clip(pool @ model.out + model.out_bias, -30, 30)))
            g = ((p - y[batch]) / len(batch)).astype(np.float32)
            gp = np.where(pool > 0, g[:, None] * model.out[None, :], 0).astype(np.float32)
            grads = {"out": pool.T @ g + 1e-4 * model.out}
            model.out_bias -= 0.05 * float(g.sum())
            ge: list[tuple[np.ndarray, np.ndarray]] = []
            for n, w in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                at, gw = place[:, cols], gp[:, cols]
                grads[f"b{w}"] = gw.sum(0)
                gk = np.zeros((w, DIM, FILTERS), np.float32)
                k = model.conv[w].reshape(w, DIM, FILTERS)
                for j in range(w):
                    words = ids[np.minimum(at + j, len(ids) - 1)]  # texts, filters, features
                    x = model.emb[words].sum(2)
                    gk[j] = np.einsum("bfd,bf->df", x, gw)
                    gx = gw[:, :, None] * k[j].T[None]
                    ge.append((words.reshape(-1, words.shape[-1]), gx.reshape(-1, DIM)))
                grads[f"c{w}"] = gk.reshape(w * DIM, FILTERS)
            step += 1
            for name, v in dense.items():
                m1[name] = 0.9 * m1[name] + 0.1 * grads[name]
                m2[name] = 0.99 * m2[name] + 0.01 * grads[name] ** 2
                v -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)
            rows, change = np.concatenate([a for a, _ in ge]), np.concatenate([b for _, b in ge])
            flat = rows.ravel()
            full = np.repeat(change, rows.shape[1], axis=0)
            hit, where = np.unique(flat, return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, where, full)
            eg[hit] += (total**2).mean(1, keepdims=True)
            model.emb[hit] -= 0.02 * total / np.sqrt(eg[hit])
            model.emb[0] = 0
    test = [i for i in range(len(docs)) if part[i] == 3] or list(range(len(docs)))
    z = np.concatenate([model.logit(*_join([docs[i] for i in test[j : j + 64]])) for j in range(0, len(test), 64)]).astype(np.float64)
    t = y[test]
    weight = np.where(t == 1, prior / max(t.mean(), 1e-6), (1 - prior) / max(1 - t.mean(), 1e-6))
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic scale by damped gradient steps
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e = weight * (q - t)
        a = max(0.05, a - 0.2 * ((e * z).mean() / max(1.0, (z**2).mean()) + 1e-3 * (a - 1)))
        b -= 0.5 * e.mean()
    model.scale = (a, b)
    score = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    lang = np.array([langs[i] or "" for i in test])
    for one in np.unique(lang):
        s, u, wt = score[lang == one], t[lang == one], weight[lang == one]
        if u.sum() < 5:
            continue
        cand = np.linspace(0.1, 0.9, 81)
        f1 = [2 * (wt * u)[s >= c].sum() / max(wt[s >= c].sum() + (wt * u).sum(), 1e-9) for c in cand]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        model.thresholds[str(one)] = float(cand[best[np.argmin(abs(cand[best] - 0.5))]])
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on at most ``sample`` labelled documents of each class, chosen by a hash of
    their id among those where ``usable`` (over ``id``) holds, and of these, in the same
    order, on as many whole texts as ``sample_bytes`` hold.  The ids are chosen first, so
    only they are sent to the tasks, and only their texts to the one task that trains.

    The model does not depend on how rows are dealt: of rows that repeat an id the least
    (text, language) counts, of labels the larger.  Null ids and labels other than 0 and 1
    are left out, null texts are empty; without a document of either class the score is
    the share of toxic labels.  Other columns are not read.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & usable).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    pick = [known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    chosen = F.broadcast(pick[0].union(pick[1]))  # at most 2 * sample rows
    lang = F.col(lang_col) if lang_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.cast("string").alias("lang")).alias("d")).join(chosen, "id")
    one = rows.groupBy("id").agg(F.min("d").alias("d"), F.first("y").alias("y")).select("id", "y", "d.*")
    one = table(one)
    size = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = F.broadcast(one.select("id", size.alias("size")).where(F.col("size") <= sample_bytes).select("id"))  # ids alone go through one task
    texts = one.join(within, "id").orderBy(F.col("id").cast("string"))

    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: str(r["id"]))
        model = train([r["text"] for r in rows], [r["y"] for r in rows], [r["lang"] for r in rows], float(share))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task trains, as sample_bytes bounds what it reads; the driver gets the model alone
    got = texts.coalesce(1).mapInArrow(lean(run), "model binary").first()
    model = pickle.loads(got["model"]) if got else train([], [], [], float(share))  # no row, no task
    release(one)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``flagged`` (score at or over the threshold of
    the text's language, 0.5 for others) of every whole text.

    The score reads the text only.  Null counts as empty; an empty text has the score
    that the bias gives.  A null or unknown language has threshold 0.5.  Every row
    gives a row, repeated ids too.  Other columns are not read.  No shuffle; the model
    (a fixed size, about 2 MB) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            s = np.zeros(len(batch))
            for first, ids, starts in features(x.as_py() for x in batch.column(1)):
                s[first : first + len(starts) - 1] = m.score(ids, starts)
            limit = [m.thresholds.get(x.as_py() or "", 0.5) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= np.array(limit))], names=[batch.schema.names[0], "score", "flagged"])

    src = docs.select(F.col(id_col), F.col(text_col), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))
    return src.mapInArrow(lean(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double, flagged boolean")


def screen(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` does not flag, columns as they were.

    Null and empty texts are scored as empty ones, a null or unknown language has threshold
    0.5, repeated rows share their fate, null ids do not matter, and columns that the operator
    does not know, whatever their names, come through.  No rows, no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    flag, text_at = fresh(docs, "flagged"), docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col else None

    def run(batches):
        m = held.value
        for batch in batches:
            s = np.zeros(len(batch))
            for first, ids, starts in features(x.as_py() for x in batch.column(text_at)):
                s[first : first + len(starts) - 1] = m.score(ids, starts)
            limit = [m.thresholds.get(str(x.as_py() or ""), 0.5) for x in batch.column(lang_at)] if lang_at is not None else 0.5
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s >= np.array(limit))], names=[*batch.schema.names, flag])

    out = docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))
    return out.where(~F.col(flag)).drop(flag)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`toxicity` by a model of :func:`fit`, whose rules for nulls,
    repeated and empty rows hold; ``flagged`` by the language's threshold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out(F.col("id")))
    out = toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
