"""Interpolated modified Kneser-Ney model of order two or three in memory-mapped sorted arrays."""

from __future__ import annotations

import gc
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path
from .words import word_hashes

END = np.uint64(0x8C5B3F2E9D41A6C7)  # the token that ends every text
BUFFER = 2_000_000  # tokens that a task works on at a time
VOCAB_PART = 1 << 18  # words in a vocabulary file, about
PAIR_PART = 1 << 20  # training tokens for each file of pairs
STAT_PART = 1 << 16  # words in a file of continuation statistics
ORDER = 3  # of the query's model
ODDS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MAPPED = 4096
RUN = 16  # pairs for each stored place in a file of triples
LOW = np.uint64(0xFFFFFFFF)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the values of an even number of bits in which all bits matter: keys in
    its order are even over their range, whatever words or contexts are frequent."""
    half, last = np.uint64(bits // 2), np.uint64((1 << bits) - 1)
    for odd in ODDS:
        x = ((x ^ (x >> half)) * np.uint64(odd)) & last
    return x ^ (x >> half)


def unscramble(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of :func:`scramble`."""
    half, last = np.uint64(bits // 2), np.uint64((1 << bits) - 1)
    for odd in reversed(ODDS):
        x = ((x ^ (x >> half)) * np.uint64(pow(odd, -1, 1 << 64))) & last
    return x ^ (x >> half)


def token_buffers(texts: Iterator[str | None], most: int = BUFFER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, ends): word hashes with END after each text, and the texts' ends in them."""
    held, ends, size = [], [], 0
    for _, count, h, e in word_hashes(texts):
        t = np.full(len(h) + count, END, np.uint64)
        t[np.arange(len(h)) + np.repeat(np.arange(count), np.diff(np.concatenate([[0], e])))] = h
        held.append(t)
        ends.append(e + np.arange(1, count + 1) + size)
        size += len(t)
        if size >= most:
            yield np.concatenate(held), np.concatenate(ends)
            held, ends, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(ends)


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_array(at: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other in a file of the shared folder; a task that runs again
    puts the same bytes in its place."""
    f, path = _fs(at)
    f.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with f.open_output_stream(tmp) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    f.move(tmp, f"{path}/{name}")


@lru_cache(MAPPED)
def map_array(at: str, name: str, kind) -> np.ndarray:
    """A file of the shared folder, memory-mapped; from a store that can't be mapped, by
    way of an unlinked local copy, which only this process reads.  A worker keeps its last
    MAPPED files mapped, so it opens each once for all texts that it scores."""
    f, path = _fs(at)
    full = f"{path}/{name}"
    if f.type_name != "local":
        import tempfile

        with f.open_input_stream(full) as src, tempfile.NamedTemporaryFile() as tmp:
            while chunk := src.read(1 << 24):
                tmp.write(chunk)
            tmp.flush()
            return np.memmap(tmp.name, kind, "r") if os.path.getsize(tmp.name) else np.zeros(0, kind)
    return np.memmap(full, kind, "r") if os.path.getsize(full) else np.zeros(0, kind)


def write_counts(at: str, name: str, c: np.ndarray) -> None:
    """A byte each, and the places and values of those from 255 in a second file."""
    big = np.flatnonzero(c >= 255)
    write_array(at, name, np.minimum(c, 255).astype(np.uint8))
    write_array(at, name + "x", big.astype(np.uint64), c[big].astype(np.uint64))


def read_counts(at: str, name: str, places: np.ndarray) -> np.ndarray:
    c = map_array(at, name, np.uint8)[places].astype(np.int64)
    big = np.flatnonzero(c == 255)
    if len(big):
        x = map_array(at, name + "x", np.uint64)
        n = len(x) // 2
        c[big] = x[n:][np.searchsorted(x[:n], places[big].astype(np.uint64))]
    return c


def squeeze(ascending: np.ndarray) -> bytes:
    """Differences, their bytes by place, deflated."""
    d = np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def expand(packed: bytes) -> np.ndarray:
    d = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).view(np.uint64).ravel(), dtype=np.uint64)


def bisect(a: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of x in the ascending a[low:high], or -1, for each of many ranges."""
    lo, hi = low.astype(np.int64), high.astype(np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        less = a[mid] < x[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    out = np.full(len(x), -1, np.int64)
    inner = np.flatnonzero(lo < high)
    ok = inner[a[lo[inner]] == x[inner]]
    out[ok] = lo[ok]
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times.

    Each is above 0, so every context leaves something to words that it was not seen with
    and no probability is 0: where the estimate is none (too few counts of counts) or not
    above 0, the usual value stands.
    """
    n1, n2, n3, n4 = n[:4]
    usual = (0.5, 0.75, 0.9)
    if not (n1 and n2):
        return usual
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return tuple(min(x, k) if x > 0 else u for x, k, u in zip(d, (1, 2, 3), usual, strict=True))


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)], 0.0)


@dataclass
class Model:
    """Where the arrays are and the few numbers beside them.  All probabilities come from
    counts in the arrays: nothing here grows with the corpus but a number per file."""

    at: str
    tokens: int = 0  # N
    vocab: int = 0  # V
    texts: int = 0
    vbits: int = 0
    base: list[int] = field(default_factory=list)  # first word number of each vocabulary file
    pbits: int = 0
    wbits: int = 1  # of a word number
    d2: tuple[float, float, float] = (0.5, 0.75, 0.9)
    d1: tuple[float, float, float] = (0.5, 0.75, 0.9)
    pairs: int = 0  # distinct pairs: the continuation counts' total
    rest1: float = 1.0  # what is left to the uniform distribution
    order: int = 2
    pbase: list[int] = field(default_factory=list)  # first pair number of each file of pairs
    step: int = 1  # pair numbers, as contexts, in a file of triples
    tfiles: frozenset[int] = frozenset()  # those that hold any
    d3: tuple[float, float, float] = (0.5, 0.75, 0.9)

    def words(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct words."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        part = (sorted_hashes >> np.uint64(64 - self.vbits)).astype(np.int64) if self.vbits else np.zeros(len(sorted_hashes), np.int64)
        edge = np.searchsorted(part, np.arange((1 << self.vbits) + 1))
        for p in range(1 << self.vbits):
            a, b = edge[p], edge[p + 1]
            n = self.base[p + 1] - self.base[p]
            if a == b or not n:
                continue
            raw = map_array(self.at, f"v{p}", np.uint64)
            h, c = raw[:n], raw[n:]
            at = np.minimum(np.searchsorted(h, sorted_hashes[a:b]), n - 1)
            ok = h[at] == sorted_hashes[a:b]
            ids[a:b] = np.where(ok, at + self.base[p], -1)
            counts[a:b] = np.where(ok, c[at], 0)
        return ids, counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """n1, n2, n3+ of a word as context, its continuation count and, of order three, the
        continuation counts' sum after it; known ids ascend."""
        wide = self.order + 2
        out = np.zeros((len(ids), wide), np.uint32)
        known = np.flatnonzero(ids >= 0)
        k = ids[known]
        part = k // STAT_PART
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + 1])
            out[known[a:b]] = map_array(self.at, f"g{p}", np.uint32).reshape(-1, wide)[k[a:b] - p * STAT_PART]
        return out

    def pair_keys(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return scramble(u.astype(np.uint64) << np.uint64(self.wbits) | w.astype(np.uint64), 2 * self.wbits)

    @property
    def rest(self) -> int:
        """Bits of a key that a file of pairs stores."""
        return 2 * self.wbits - self.pbits

    def pair_parts(self, k: np.ndarray) -> np.ndarray:
        """File number of each key."""
        return (k >> np.uint64(self.rest)).astype(np.int64)

    def pair_file(self, p: int) -> np.ndarray:
        return map_array(self.at, f"p{p}", np.uint32 if self.rest <= 32 else np.uint64)

    def write_pairs(self, p: int, k: np.ndarray) -> None:
        low = k - np.uint64(p << self.rest)
        write_array(self.at, f"p{p}", low.astype(np.uint32) if self.rest <= 32 else low)

    def pair_words(self, p: int, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, second word) of the pairs a to b of a file."""
        uw = unscramble(self.pair_file(p)[a:b].astype(np.uint64) + np.uint64(p << self.rest), 2 * self.wbits)
        return (uw >> np.uint64(self.wbits)).astype(np.int64), (uw & np.uint64((1 << self.wbits) - 1)).astype(np.int64)

    def pair_places(self, k: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(file, from, to, places in it, whether it has them) for ascending keys."""
        part = self.pair_parts(k)
        edge = np.searchsorted(part, np.arange((1 << self.pbits) + 1))
        for p in range(1 << self.pbits):
            a, b = edge[p], edge[p + 1]
            if a == b or self.pbase[p] == self.pbase[p + 1]:
                continue
            h = self.pair_file(p)
            low = (k[a:b] - np.uint64(p << self.rest)).astype(h.dtype)
            at = np.minimum(np.searchsorted(h, low), len(h) - 1)
            yield p, a, b, at, h[at] == low

    def pair_numbers(self, k: np.ndarray) -> np.ndarray:
        """Number or -1 of ascending pair keys."""
        out = np.full(len(k), -1, np.int64)
        for p, a, b, at, ok in self.pair_places(k):
            out[a:b] = np.where(ok, at + self.pbase[p], -1)
        return out

    def pair_counts(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, continuation count) of ascending pair keys; of order two
        the last is the count."""
        num, got, cont = np.full(len(k), -1, np.int64), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for p, a, b, at, ok in self.pair_places(k):
            at, ok = at[ok], a + np.flatnonzero(ok)
            num[ok] = at + self.pbase[p]
            got[ok] = read_counts(self.at, f"c{p}", at)
            cont[ok] = read_counts(self.at, f"a{p}", at) if self.order > 2 else got[ok]
        return num, got, cont

    def triples(self, ctx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of word w after the pair, what the pair leaves of its count) for
        ascending pair numbers."""
        c3, left = np.zeros(len(ctx), np.int64), np.zeros(len(ctx))
        part = ctx // self.step
        for t in np.unique(part):
            if int(t) not in self.tfiles:
                continue
            a, b = np.searchsorted(part, [t, t + 1])
            local = ctx[a:b] - t * self.step
            lo, hi = self.ranges(int(t), local)
            at = bisect(map_array(self.at, f"t{t}", np.uint32), lo, hi, w[a:b])
            ok = np.flatnonzero(at >= 0)
            c3[a + ok] = read_counts(self.at, f"k{t}", at[ok])
            n1, n2 = (read_counts(self.at, f"{x}{t}", local) for x in "mn")
            left[a:b] = self.d3[0] * n1 + self.d3[1] * n2 + self.d3[2] * (hi - lo - n1 - n2)
        return c3, left

    def ranges(self, t: int, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of the triples that begin with a pair, for pairs of a file.

        The file has how many each pair has, a byte each, and the place of every RUNth."""
        c, run = map_array(self.at, f"o{t}", np.uint8), local // RUN
        inside = np.minimum(run[:, None] * RUN + np.arange(RUN), len(c) - 1)
        before = np.where(np.arange(RUN) < (local % RUN)[:, None], c[inside], 0).sum(1, dtype=np.int64)
        x = map_array(self.at, f"o{t}x", np.uint64)  # what those from 255 have beyond it
        n = len(x) // 2
        more = np.concatenate([[0], np.cumsum(x[n:].astype(np.int64) - 255)])
        upto = lambda i: more[np.searchsorted(x[:n], i.astype(np.uint64))]
        lo = map_array(self.at, f"q{t}", np.uint32)[run].astype(np.int64) + before + upto(local) - upto(run * RUN)
        return lo, lo + read_counts(self.at, f"o{t}", local)

    def score(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, model's log10 probability) of each text."""
        uniq, inv = np.unique(tokens, return_inverse=True)
        ids, counts = self.words(uniq)
        st = self.stats(ids)
        uniform = 1.0 / (self.vocab + 1)
        p1 = (_less(st[:, 3], self.d1) / self.pairs if self.pairs else np.zeros(len(ids))) + self.rest1 * uniform
        seen = counts if self.order == 2 else st[:, 4].astype(np.int64)
        back = (st[:, :3] @ np.array(self.d2)) / np.maximum(seen, 1)
        back[(seen == 0) | (st[:, :3].sum(1) == 0)] = 1.0  # nothing was seen after it
        starts = np.concatenate([[0], ends[:-1]])
        prev = np.concatenate([[0], inv[:-1]])
        ctx_id, ctx_n, ctx_back = ids[prev], seen[prev], back[prev]
        bos = self.stats(np.array([self.vocab]))[0] if self.texts else np.zeros(4)
        ctx_id[starts], ctx_n[starts] = (self.vocab, self.texts) if self.texts else (-1, 0)
        ctx_back[starts] = float(bos[:3] @ np.array(self.d2)) / self.texts if self.texts else 1.0
        w = ids[inv]
        both = np.flatnonzero((w >= 0) & (ctx_id >= 0))
        keys, place = np.unique(self.pair_keys(ctx_id[both], w[both]), return_inverse=True)
        num, raw, cont = self.pair_counts(keys)
        c2 = np.zeros(len(tokens), np.int64)
        c2[both] = cont[place]
        p = _less(c2, self.d2) / np.maximum(ctx_n, 1) + ctx_back * p1[inv]
        if self.order > 2:
            first = np.zeros(len(tokens), bool)
            first[starts] = True
            pair = np.full(len(tokens), -1, np.int64)  # place in keys of the pair that ends here
            pair[both] = np.where(num[place] >= 0, place, -1)
            ctx = np.concatenate([[-1], pair[:-1]])
            ctx[first] = -1
            has = np.flatnonzero(ctx >= 0)
            has = has[np.argsort(ctx[has], kind="stable")]
            # a word that training did not have is no word number
            c3, left = self.triples(num[ctx[has]], np.where(w[has] >= 0, w[has], LOW.astype(np.int64)).astype(np.uint32))
            n3 = raw[ctx[has]]
            some = left > 0  # else nothing was seen after the pair
            has, c3, left, n3 = has[some], c3[some], left[some], n3[some]
            p[has] = _less(c3, self.d3) / n3 + left / n3 * p[has]
        base = np.log10((counts[inv] + 1) / (self.tokens + self.vocab + 1))
        known = np.add.reduceat((counts[inv] > 0).astype(np.int64), starts)
        return known, np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def _sum_by(keys: np.ndarray, *values: np.ndarray):
    u, inv = np.unique(keys, return_inverse=True)
    return u, [np.bincount(inv, v, minlength=len(u)).astype(np.int64) for v in values]


def _free(spark) -> None:
    """Has Spark delete shuffle files that no frame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Counts all texts and writes the model's arrays to the shared folder.

    1. Words: counted per task, then summed; files of sorted hashes with counts, cut by
       the hash's leading bits, number the words.
    2. Pairs (previous word or start, word), keyed by a bijection of their
       numbers, so even a pair or a context that a third of all tokens have is spread
       over files by the key; summed within tasks first, then per file.
    3. Each file of pairs gives how many distinct words follow each context once, twice,
       more often, and how many contexts precede each word; summed per range of words.

    Of order three also:

    4. Triples (number of the pair before, word), where a pair's number is its place in
       the files of pairs.  Pairs are in the order of their mixed keys, so ranges of
       pair numbers are even; a file has, for each pair, the words after it in order,
       their counts, and how many followed once and twice.
    5. How many words precede each pair, summed per file of pairs.  These are the counts
       that the second order discounts; a pair at the start of a text, which nothing
       precedes, keeps its count.

    Null and empty texts teach the end alone, repeated rows teach as often as they are there,
    ids are not read, and without rows every word is unknown.
    A word number has 32 bits; more distinct words are refused, and so are more pairs
    than 64 bits hold together with a word.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order}: two or three")
    spark = docs.sparkSession
    at = shared_path(spark, "lm")
    src = docs.select(F.col(text_col).alias("text"))

    def texts_of(batches):
        for batch in batches:
            for x in batch.column(0):
                yield x.as_py()

    def words(batches):
        held_k, held_c, size = [], [], 0

        def out():
            u, (c,) = _sum_by(np.concatenate(held_k), np.concatenate(held_c))
            return u, c

        for tokens, _ in token_buffers(texts_of(batches)):
            u, c = np.unique(tokens, return_counts=True)
            held_k.append(u)
            held_c.append(c)
            size += len(u)
            if size > 2 * BUFFER:
                u, c = out()
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])
                held_k, held_c, size = [], [], 0
        if held_k:
            u, c = out()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    counted = cut(src.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    v, n, texts = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))), F.lit(0))).first()
    if v >= (1 << 32) - 1:
        raise ValueError(f"{v} distinct words; a word number has 32 bits")
    model = Model(at, n, v, texts, max(0, math.ceil(math.log2(max(1, v / VOCAB_PART)))), order=order)

    def put_words(batches):
        part, held = None, []

        def flush():
            t = np.concatenate(held, axis=1)
            o = np.argsort(t[0].view(np.uint64))
            write_array(at, f"v{part}", t[0][o], t[1][o])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(o)], pa.int64())], names=["part", "n"])

        for batch in batches:
            p = np.asarray(batch.column(0))
            for one in np.unique(p):
                if part is not None and one != part:
                    yield flush()
                    held = []
                part = int(one)
                a, b = np.searchsorted(p, [one, one + 1])
                held.append(np.stack([np.asarray(batch.column(1))[a:b], np.asarray(batch.column(2))[a:b]]))
        if held:
            yield flush()

    vpart = F.shiftrightunsigned("h", 64 - model.vbits).cast("int") if model.vbits else F.lit(0)
    sizes = dict(counted.select(vpart.alias("part"), "h", "c").repartition(1 << model.vbits, "part").sortWithinPartitions("part").mapInArrow(put_words, "part int, n long").collect())
    model.base = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(1 << model.vbits)])]).astype(int).tolist()
    model.wbits = max(1, int(v).bit_length())
    model.pbits = min(max(0, math.ceil(math.log2(max(1, n / PAIR_PART)))), 2 * model.wbits)
    if 32 < model.rest <= 34:  # up to four times as many files where a key then takes half the bytes
        model.pbits += model.rest - 32
    shared = spark.sparkContext.broadcast(model)

    def pairs(batches):
        m = shared.value
        held: list[np.ndarray] = []
        size = 0

        def out():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(m.pair_parts(k), np.arange((1 << m.pbits) + 1))
            rows = [(p, squeeze(k[edge[p] : edge[p + 1]]), zlib.compress(c[edge[p] : edge[p + 1]].astype(np.uint32).tobytes(), 1)) for p in range(1 << m.pbits) if edge[p] < edge[p + 1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

        for tokens, ends in token_buffers(texts_of(batches)):
            uniq, inv = np.unique(tokens, return_inverse=True)
            w = m.words(uniq)[0][inv].astype(np.uint64)
            u = np.concatenate([[np.uint64(m.vocab)], w[:-1]])
            u[ends[:-1]] = m.vocab
            held.append(m.pair_keys(u, w))
            size += len(w)
            if size > 2 * BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def sums(part, ids, values):
        """Rows per STAT_PART words: numbers within and the values, compressed."""
        p = ids // STAT_PART
        for one in np.unique(p):
            a, b = np.searchsorted(p, [one, one + 1])
            yield int(one), part, zlib.compress(np.stack([ids[a:b] - one * STAT_PART, *[x[a:b] for x in values]]).astype(np.uint32).tobytes(), 1)

    def put_pairs(batches):
        m = shared.value
        part, keys, counts = None, [], []

        def flush():
            k, (c,) = _sum_by(np.concatenate(keys), np.concatenate(counts))
            m.write_pairs(part, k)
            write_counts(at, f"c{part}", c)
            first, second = m.pair_words(part)
            w, (before,) = _sum_by(second, np.ones(len(k)))
            rows = list(sums(1, w, [before]))
            if order == 2:
                u, after = _sum_by(first, c == 1, c == 2, c > 2)
                rows += sums(0, u, after)
            rows.append((part, 2, np.array([*[(c == i).sum() for i in (1, 2, 3, 4)], len(k)], np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])

        for batch in batches:
            for p, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part is not None and p != part:
                    yield flush()
                    keys, counts = [], []
                part = p
                keys.append(expand(k.as_py()))
                counts.append(np.frombuffer(zlib.decompress(c.as_py()), np.uint32))
        if keys:
            yield flush()

    packed = src.mapInArrow(pairs, "part int, keys binary, counts binary").repartition(1 << model.pbits, "part").sortWithinPartitions("part")
    found = cut(packed.mapInArrow(put_pairs, "part int, kind int, data binary"))
    del packed, counted
    _free(spark)
    seen = {r[0]: np.frombuffer(bytes(r[1]), np.int64) for r in found.where("kind = 2").select("part", "data").collect()}
    total = np.sum(list(seen.values()), axis=0) if seen else np.zeros(5, np.int64)
    model.d2, model.pairs = discounts(total[:4].tolist()), int(total[4])
    model.pbase = np.concatenate([[0], np.cumsum([seen[p][4] if p in seen else 0 for p in range(1 << model.pbits)])]).astype(int).tolist()
    parts = [found.where("kind < 2")]
    if order > 2 and model.pairs:
        parts.append(_train_triples(src, texts_of, sums, model))

    def put_stats(batches):
        part, dense = None, None

        def flush():
            write_array(at, f"g{part}", dense)
            c = dense[:, 3]
            return pa.RecordBatch.from_arrays([pa.array([[int((c == i).sum()) for i in (1, 2, 3, 4)] + [int((c > 2).sum())]], pa.list_(pa.int64()))], names=["n"])

        for batch in batches:
            for p, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    if part is not None:
                        yield flush()
                    part, dense = p, np.zeros((STAT_PART, order + 2), np.uint32)
                x = np.frombuffer(zlib.decompress(data.as_py()), np.uint32).reshape(2 if kind else order + 2, -1)
                if kind:
                    dense[x[0], 3] += x[1]
                else:
                    dense[x[0], :3] += x[1:4].T
                    dense[x[0], 4:] += x[4:].T
        if part is not None:
            yield flush()

    stat_parts = v // STAT_PART + 1
    rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).repartition(min(stat_parts, 4096), "part").sortWithinPartitions("part").mapInArrow(put_stats, "n array<long>").collect()
    n1 = np.sum([r[0] for r in rows], axis=0).tolist() if rows else [0] * 5
    model.d1 = discounts(n1)
    if model.pairs:
        model.rest1 = (model.d1[0] * n1[0] + model.d1[1] * n1[1] + model.d1[2] * n1[4]) / model.pairs
    del found, parts
    _free(spark)
    return model


def _train_triples(src: DataFrame, texts_of, sums, model: Model) -> DataFrame:
    """Writes the files of triples and of continuation counts, sets the model's discounts
    and gives the statistics of words as contexts (part, kind, data)."""
    spark, at, v = src.sparkSession, model.at, model.vocab
    if model.pairs * v >= 1 << 64:
        raise ValueError(f"{model.pairs} pairs, {v} words: a triple's key has 64 bits")
    files = max(1, math.ceil(model.tokens / PAIR_PART))
    model.step = math.ceil(model.pairs / files)
    held_model = spark.sparkContext.broadcast(model)

    def count(batches):
        m = held_model.value
        held: list[np.ndarray] = []
        size = 0

        def out():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            part = (k // np.uint64(v * m.step)).astype(np.int64)
            rows = []
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                rows.append((int(p), squeeze(k[a:b]), zlib.compress(c[a:b].astype(np.uint32).tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

        for tokens, ends in token_buffers(texts_of(batches), BUFFER // 2):
            uniq, inv = np.unique(tokens, return_inverse=True)
            w = m.words(uniq)[0][inv].astype(np.uint64)
            u = np.concatenate([[np.uint64(v)], w[:-1]])
            u[ends[:-1]] = v
            keys, inv = np.unique(m.pair_keys(u, w), return_inverse=True)
            pair = m.pair_numbers(keys)[inv].astype(np.uint64)
            later = np.ones(len(w), bool)
            later[0] = False
            later[ends[:-1]] = False
            i = np.flatnonzero(later)
            held.append(pair[i - 1] * np.uint64(v) + w[i])
            size += len(i)
            if size > 2 * BUFFER:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def put(batches):
        m = held_model.value
        part, keys, counts = None, [], []

        def flush():
            k, (c,) = _sum_by(np.concatenate(keys), np.concatenate(counts))
            ctx, w = (k // np.uint64(v)).astype(np.int64), k % np.uint64(v)
            first = part * m.step
            n = min(m.step, m.pairs - first)
            each = np.bincount(ctx - first, minlength=n)
            write_counts(at, f"o{part}", each)
            write_array(at, f"q{part}", (np.cumsum(each) - each)[::RUN].astype(np.uint32))
            write_array(at, f"t{part}", w.astype(np.uint32))
            write_counts(at, f"k{part}", c)
            for name, times in (("m", 1), ("n", 2)):
                write_counts(at, f"{name}{part}", np.bincount(ctx[c == times] - first, minlength=n))
            middle = np.empty(n, np.int64)  # the second word of each pair of this file
            for p in range(1 << m.pbits):
                a, b = max(first, m.pbase[p]), min(first + n, m.pbase[p + 1])
                if a < b:
                    middle[a - first : b - first] = m.pair_words(p, a - m.pbase[p], b - m.pbase[p])[1]
            ends, times = np.unique(m.pair_keys(middle[ctx - first], w), return_counts=True)
            rows = [(-1, 2, np.array([*[(c == i).sum() for i in (1, 2, 3, 4)], part], np.int64).tobytes(), b"")]
            for p, a, b, place, _ in m.pair_places(ends):
                rows.append((p, 0, squeeze(place), zlib.compress(times[a:b].astype(np.uint32).tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["part", "kind", "data", "counts"])

        for batch in batches:
            for p, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part is not None and p != part:
                    yield flush()
                    keys, counts = [], []
                part = p
                keys.append(expand(k.as_py()))
                counts.append(np.frombuffer(zlib.decompress(c.as_py()), np.uint32))
        if keys:
            yield flush()

    packed = src.mapInArrow(count, "part int, keys binary, counts binary").repartition(files, "part").sortWithinPartitions("part")
    found = cut(packed.mapInArrow(put, "part int, kind int, data binary, counts binary"))
    del packed
    _free(spark)
    seen = [np.frombuffer(bytes(r[0]), np.int64) for r in found.where("kind = 2").select("data").collect()]
    model.tfiles = frozenset(int(x[4]) for x in seen)
    model.d3 = discounts(np.sum([x[:4] for x in seen], axis=0).tolist() if seen else [0] * 4)

    def adjust(batches):
        m = held_model.value
        part, cont = None, None

        def flush():
            u, _ = m.pair_words(part)
            start = np.flatnonzero(u == v)
            cont[start] = read_counts(at, f"c{part}", start)
            write_counts(at, f"a{part}", cont)
            rows = list(sums(0, *_sum_by(u, cont == 1, cont == 2, cont > 2, cont)))
            rows.append((-1, 2, np.array([(cont == i).sum() for i in (1, 2, 3, 4)], np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])

        for batch in batches:
            for p, places, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if p != part:
                    if part is not None:
                        yield flush()
                    part, cont = p, np.zeros(m.pbase[p + 1] - m.pbase[p], np.int64)
                if len(places.as_py()):
                    cont[expand(places.as_py()).astype(np.int64)] += np.frombuffer(zlib.decompress(times.as_py()), np.uint32)
        if part is not None:
            yield flush()

    every = spark.createDataFrame([(p, b"", b"") for p in range(1 << model.pbits) if model.pbase[p] < model.pbase[p + 1]], "part int, data binary, counts binary")
    suffixes = found.where("kind = 0").select("part", "data", "counts").unionByName(every)
    stats = cut(suffixes.repartition(1 << model.pbits, "part").sortWithinPartitions("part").mapInArrow(adjust, "part int, kind int, data binary"))
    model.d2 = discounts(np.sum([np.frombuffer(bytes(r[0]), np.int64) for r in stats.where("kind = 2").select("data").collect()], axis=0).tolist())
    del found, suffixes
    _free(spark)
    return stats.where("kind = 0")


def perplexity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, base_score, score, perplexity`` of every whole text.

    ``score`` is the model's log10 probability of the words and the end, ``base_score``
    that of the add-one unigram model.  Workers map the model's files and look words,
    pairs and triples up in sorted batches.  Null and empty texts have the end alone.  Words that
    training did not have share the uniform remainder.  Every row gives a row, repeated
    ids too; other columns are not read.  No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            n, cols = [], [[], [], []]
            for tokens, ends in token_buffers((x.as_py() for x in batch.column(1)), BUFFER if m.order == 2 else BUFFER // 2):
                for c, x in zip(cols, m.score(tokens, ends), strict=True):
                    c.append(x)
                n.append(np.diff(np.concatenate([[0], ends])))
            if not n:
                continue
            n, known, base, score = (np.concatenate(x) for x in (n, *cols))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300.0))], names=[batch.schema.names[0], "n_tokens", "n_known", "base_score", "score", "perplexity"])

    src = docs.select(F.col(id_col), F.col(text_col))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column, fold: int = 7, which: int = 2) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % fold == which


def op6_ngram_lm(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`perplexity` over every row of ``documents``, by a model of order
    ORDER from those that are not held out.  A null id is held out or not as the empty text is;
    null and empty texts have the end alone; repeated rows teach and are scored each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))), order=ORDER)
    out = perplexity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
