"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MEMO = 500_000  # words in each of a worker's two generations
OPEN_BINS = 64


class WordEncoder:
    """Ids of a word-end BPE, word by word from a memo.

    The vocabulary drops white space and encodes nothing across it.  Texts of characters
    below U+0250 without rare controls need no normalising beyond lower case.  So there
    the ids of what stands between white space, joined, are the ids of the text.  Any
    other text goes through the library whole.
    """

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(file)
        # for pieces already lower-cased and split: nothing left to normalise or to split but spaces
        self.bare = Tokenizer.from_file(file)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.model._resize_cache(0)  # every word it sees is new
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = re.compile(r"[\t\n\r -~\xa0-\u012f\u0131-\u024f]*")
        self.special = "<|"

    def learn(self, new: set[str]) -> None:
        """Puts what the memo lacks into it.  Pieces new to it too are encoded in one call:
        they stand between spaces, so each is a word of its own there."""
        if len(self.memo) >= MEMO:  # what was used since the last turn stays
            self.old, self.memo = self.memo, {}
        memo, old, find = self.memo, self.old, self.pieces.findall
        unknown, odd = [], []
        for w in new:
            got = old.get(w)
            if got is not None:
                memo[w] = got
            elif w.isalpha():
                unknown.append(w)
            else:
                odd.append((w, find(w)))
        if odd:
            unknown += {p for _, x in odd for p in x if p not in memo and p not in old}.difference(unknown)
        if unknown:
            got = self.bare.encode(" ".join(unknown), add_special_tokens=False)
            raw = np.array(got.ids, "<u4").tobytes()
            edge = (np.searchsorted(np.array(got.word_ids), np.arange(len(unknown) + 1)) * 4).tolist()
            for w, x, y in zip(unknown, edge, edge[1:]):
                memo[w] = raw[x:y]
        for w, parts in odd:
            memo[w] = b"".join([memo[p] if p in memo else old[p] for p in parts])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special in text or not self.plain.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        out = list(map(self.memo.get, words))
        if None in out:
            lack = [i for i, x in enumerate(out) if x is None]
            new = {words[i] for i in lack}
            self.learn(new)
            memo = self.memo
            for i in lack:
                out[i] = memo[words[i]]
            for w in new:
                if len(w) > 64:  # rare, and would fill the memory
                    del memo[w]
        return b"".join(out)


@lru_cache(1)
def _encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


class BestFit:
    """A fixed number of open bins in a bitset keyed by free space.

    Bit f is set while some open bin has f places free.  A piece goes to the open bin
    with the least free space that holds it; with none, a bin opens, and if that makes
    too many, the fullest open bin closes.
    """

    def __init__(self, size: int, bins: int):
        self.size, self.most = size, bins
        self.bits, self.open, self.n, self.next = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.open[free]
        b = stack.pop()
        if not stack:
            del self.open[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return b

    def _put(self, b: int, free: int) -> None:
        if free:
            self.open.setdefault(free, []).append(b)
            self.bits |= 1 << free
            self.n += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` places."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            if self.n >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free, self.next = self.next, self.size, self.next + 1
        self._put(b, free - length)
        return b, self.size - free


def pack_documents(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs the token ids of all texts into sequences of at most ``size`` tokens.

    A document is its ids and then ``end_id``; only one longer than ``size`` is cut,
    into full pieces and a rest.  Each task packs the pieces of its rows in the order
    they come, with ``open_bins`` open bins (:class:`BestFit`), so memory doesn't grow
    with the rows, nothing is shuffled, and a task that runs again gives the same
    rows.  Sequences are numbered by task, then bin.

    Returns per piece: ``id_col, piece, start, length, ids`` (little-endian unsigned
    32-bit), ``sequence_id, offset``.

    Null and empty texts are documents of the end id alone.  Every row is a document,
    whatever its id, repeated ones too.  Other columns are not read.
    """
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins, task = _encoder(file), BestFit(size, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids_of = batch.column(0)
            of, cols, held = [], [[] for _ in fields], 0

            def out():
                return pa.RecordBatch.from_arrays([ids_of.take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]], schema=pa.schema([batch.schema.field(0), *[pa.field(*f) for f in fields]]))  # noqa: B023

            for i, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, size)):
                    k = min(size, n - start)
                    b, offset = bins.place(k)
                    of.append(i)
                    for c, v in zip(cols, (piece, start, k, ids[4 * start : 4 * (start + k)], task + b, offset), strict=True):
                        c.append(v)
                held += len(ids)
                if held > 8_000_000:
                    yield out()
                    of, cols, held = [], [[] for _ in fields], 0
            yield out()

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(lean(run), f"`{id_col}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: every row of ``documents`` packed by :func:`pack_documents` and its pieces'
    digests by :func:`with_digest`; null and empty texts are one piece of the end token, repeated
    ids are packed each."""
    import public_tokenizers

    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return with_digest(out).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
