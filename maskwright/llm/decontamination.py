"""Benchmark decontamination: BM25 over the test items with block-max WAND."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, lean
from .words import word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the score that an item has against itself
OVERLAP = 0.5  # of a part's words that lie in runs shared with the passage
GRAM = 3
BLOCK = 64
ITEM_BYTES = 256 << 20  # of text in an index; more items go into several, which score as one


def _words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, count, h, ends in word_hashes(texts, True):
        at = 0
        for i in range(count):
            out.append(h[at : ends[i]])
            at = ends[i]
    return out


def question_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence; of one sentence, its last third."""
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    k = len(words) - len(words) // 3
    return " ".join(words[:k]), " ".join(words[k:])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)]
    return h


def coverage(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's words that lie in runs of GRAM words which the passage has."""
    if not len(part):
        return 1.0
    k = min(GRAM, len(part))
    hit = np.isin(_grams(part, k), _grams(passage, k))
    covered = np.zeros(len(part), bool)
    for j in range(k):
        covered[j : j + len(hit)] |= hit
    return float(covered.mean())


class Whole:
    """What BM25 needs to know of all items together, added up part by part."""

    def __init__(self):
        self.n, self.words, self.longest = 0, 0, 1
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0)

    def add(self, texts: list[str | None]) -> Whole:
        items = _words(texts)
        each = [np.unique(x) for x in items]
        terms = np.concatenate([self.terms, *each])
        df = np.concatenate([self.df, np.ones(len(terms) - len(self.terms))])
        self.terms, place = np.unique(terms, return_inverse=True)
        self.df = np.bincount(place, df, minlength=len(self.terms))
        self.n, self.words = self.n + len(items), self.words + sum(map(len, items))
        self.longest = max([self.longest, *map(len, items)])
        return self


class Index:
    """Postings of the test items with impacts relative to each item's own score.

    An impact is a term's BM25 share of the item's score against itself, so one
    threshold serves all items and an item of a passage that holds it whole scores 1.
    """

    def __init__(self, ids: list, texts: list[str | None], whole: Whole | None = None):
        items, whole = _words(texts), whole or Whole().add(texts)
        self.ids = ids
        parts = [question_answer(t or "") for t in texts]
        self.question, self.answer = _words([q for q, _ in parts]), _words([a for _, a in parts])
        self.longest = whole.longest
        self.window = max(16, self.longest)  # half a passage: any item lies whole in one passage
        self.terms = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        n, rows = whole.n, []
        mean = max(1.0, whole.words / max(1, n))
        sets = [np.unique(x, return_counts=True) for x in items]
        df = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        for i, (t, tf) in enumerate(sets):
            at = np.searchsorted(self.terms, t)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(items[i]) / mean))
            if len(t):
                rows.append(np.stack([at, np.full(len(at), i), w / w.sum()], axis=1))
        post = np.concatenate(rows) if rows else np.zeros((0, 3))
        post = post[np.lexsort((post[:, 1], post[:, 0]))]
        self.item, self.impact = post[:, 1].astype(np.int64), post[:, 2]
        self.start = np.searchsorted(post[:, 0], np.arange(len(self.terms) + 1))
        self.top = np.array([self.impact[a:b].max() for a, b in zip(self.start[:-1], self.start[1:], strict=True)]) if len(self.terms) else np.zeros(0)
        self.blocks = [[(int(self.item[min(j + BLOCK, b) - 1]), float(self.impact[j : min(j + BLOCK, b)].max())) for j in range(a, b, BLOCK)] for a, b in zip(self.start[:-1], self.start[1:], strict=True)]
        # terms of few items; what all other terms of an item can give it together
        self.rare = df <= max(5, n * 0.02)
        self.rest = np.bincount(self.item, np.where(self.rare[post[:, 0].astype(np.int64)], 0.0, self.impact), minlength=len(items)) if len(post) else np.zeros(len(items))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def search(self, query: list[int], threshold: float) -> dict[int, float]:
        """Block-max WAND: every item whose score reaches the threshold, with the score.

        Lists stand in order of their current item.  The pivot is the first list at
        which the lists' best impacts add up to the threshold; no item before it can
        reach it.  If the current blocks' best impacts can't either, all lists skip to
        where the first of these blocks ends.
        """
        item, impact, blocks, top = self.item, self.impact, self.blocks, self.top
        lists = [[int(item[self.start[t]]), int(self.start[t]), t] for t in query]
        found, end, eps = {}, 1 << 60, 1e-9

        def skip(x, to):
            a, b = x[1], int(self.start[x[2] + 1])
            at = a + int(np.searchsorted(item[a:b], to))
            x[1], x[0] = at, int(item[at]) if at < b else end

        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                if x[0] == end:
                    break
                total += top[x[2]]
                if total >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                return found
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            bound, until = 0.0, end
            for x in lists[: pivot + 1]:
                for last, best in blocks[x[2]]:
                    if last >= at:
                        bound += best
                        until = min(until, last + 1)
                        break
            if bound < threshold - eps:
                nxt = lists[pivot + 1][0] if pivot + 1 < len(lists) else end
                to = max(at + 1, min(until, nxt))
                for x in lists[: pivot + 1]:
                    if x[0] < to:
                        skip(x, to)
            elif lists[0][0] == at:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += float(impact[x[1]])
                    skip(x, at + 1)
                if score >= threshold - eps:
                    found[at] = score
            else:
                for x in lists[:pivot]:
                    if x[0] < at:
                        skip(x, at)
            lists = [x for x in lists if x[0] != end]
        return found

    def passages(self, h: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(start, end) in words of every passage of a text that may reach the threshold.

        Passages are two windows long and start at every window.  An item that reaches
        it gets what its common terms can't give from its rare ones; those are summed
        for all windows at once; a term of both windows counts twice, which only raises the
        bound.
        """
        term = self.lookup(h)
        at = np.flatnonzero((term >= 0) & self.rare[term])
        half_of, t = np.divmod(np.unique(at // self.window * len(self.terms) + term[at]), len(self.terms))
        n = self.start[t + 1] - self.start[t]
        total, m = int(n.sum()), len(self.ids)
        need = threshold - 1e-9 - self.rest
        last = max(0, -(-len(h) // self.window) - 2)
        if (need <= 0).any():
            wanted = np.arange(last + 1)
        else:
            post = np.repeat(self.start[t] - (np.cumsum(n) - n), n) + np.arange(total)
            half = np.repeat(half_of, n)
            code = np.concatenate([half * m + self.item[post], np.maximum(half - 1, 0) * m + self.item[post]])
            value = np.concatenate([self.impact[post], np.where(half > 0, self.impact[post], 0.0)])
            pair, where = np.unique(code, return_inverse=True)
            s = np.bincount(where, value, minlength=len(pair))
            wanted = np.unique(np.minimum(pair[s >= need[pair % m]] // m, last)) if len(pair) else pair
        for p in wanted.tolist():
            yield p * self.window, min(len(h), (p + 2) * self.window)

    def leaks(self, h: np.ndarray, threshold: float, overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """item -> (score, question overlap, answer overlap, first word) of a text's words."""
        out: dict[int, tuple[float, float, float, int]] = {}
        if not len(self.terms):
            return out
        for a, b in self.passages(h, threshold):
            words = h[a:b]
            terms = np.unique(self.lookup(words))
            for i, score in self.search(terms[terms >= 0].tolist(), threshold).items():
                q, r = coverage(self.question[i], words), coverage(self.answer[i], words)
                if q >= overlap and r >= overlap and (i not in out or score > out[i][0] + 1e-12):
                    out[i] = (score, q, r, a)
        return out


def build_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> list[Index]:
    """Indexes of all test items, each of about ``item_bytes`` of text, made one after the other
    on the driver.  All have the counts of all items (:class:`Whole`), so an item scores the
    same whichever index has it.  Null texts have no words, ids may be null or repeat."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // item_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))

    def items(k):
        return sorted(rows.where(part == k).collect(), key=lambda r: (r["i"] is None, r["i"], r["t"] or ""))

    whole = Whole()
    if parts == 1:
        got = items(0)
        return [Index([r["i"] for r in got], [r["t"] for r in got], whole.add([r["t"] for r in got]))]
    for k in range(parts):
        whole.add([r["t"] for r in items(k)])
    return [Index([r["i"] for r in got], [r["t"] for r in got], whole) for got in map(items, range(parts))]


def _texts(batch: pa.RecordBatch, column: int, index: Index, threshold: float, overlap: float):
    for row, h in enumerate(_words([x.as_py() for x in batch.column(column)])):
        yield row, index.leaks(h, threshold, overlap) if len(h) else {}


def find_leaks(docs: DataFrame, index: list[Index], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, item_type: T.DataType = T.LongType()) -> DataFrame:
    """Every (document, test item) of which a passage holds the item.

    Every passage of every whole text queries the index; items that reach
    ``threshold`` of their own score are verified: at least ``overlap`` of the words of
    both the question and the answer lie in three-word runs that the passage has.

    Returns ``id_col, item_id, score, question_overlap, answer_overlap, word_at`` (where
    the passage starts), a pair once, by its best passage.

    Words are runs of letters and digits, A-Z lower-cased.  Null, empty texts and empty
    items match nothing.  Rows that repeat an id give their own rows, as do items that
    repeat; ``item_id`` has the type of the items' ids.  Other columns are not read.  No
    shuffle; the indexes are broadcast, each of the size that :func:`build_index` sets.
    """
    out = [_leaks_of(docs, docs.sparkSession.sparkContext.broadcast(one), id_col, text_col, threshold, overlap, item_type) for one in index]
    return reduce(DataFrame.unionByName, out)


def _leaks_of(docs: DataFrame, held, id_col: str, text_col: str, threshold: float, overlap: float, item_type: T.DataType) -> DataFrame:
    def run(batches):
        ix = held.value
        for batch in batches:
            of, cols = [], [[] for _ in range(5)]
            for row, found in _texts(batch, 1, ix, threshold, overlap):
                for i, x in sorted(found.items()):
                    of.append(row)
                    for c, v in zip(cols, (ix.ids[i], *x), strict=True):
                        c.append(v)
            kinds = (to_arrow_type(item_type), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[batch.schema.names[0], "item_id", "score", "question_overlap", "answer_overlap", "word_at"])

    src = docs.select(F.col(id_col), F.col(text_col))
    return src.mapInArrow(lean(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, item_id {item_type.simpleString()}, score double, question_overlap double, answer_overlap double, word_at long")


def decontaminate(docs: DataFrame, index: list[Index], text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, columns as they were.

    Null and empty texts stay, as do all rows where there are no items; repeated rows share
    their fate, null ids do not matter, and columns that the operator does not know, whatever
    their names, come through."""
    for one in index:
        docs = _without_leaks(docs, docs.sparkSession.sparkContext.broadcast(one), text_col, threshold, overlap)
    return docs


def _without_leaks(docs: DataFrame, held, text_col: str, threshold: float, overlap: float) -> DataFrame:
    flag, at = fresh(docs, "leaked"), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            leaked = [bool(found) for _, found in _texts(batch, at, held.value, threshold, overlap)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaked, pa.bool_())], names=[*batch.schema.names, flag])

    out = docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))
    return out.where(~F.col(flag)).drop(flag)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of :func:`find_leaks`, whose rules for nulls, ties and repeated rows hold."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), build_index(items), item_type=items.schema["item_id"].dataType)
