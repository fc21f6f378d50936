"""Exact token counts at every prefix, by dynamic programming over byte-level BPE."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split of the byte-level vocabulary, white space spelt out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Runs of whole pieces of SPLIT that depend on nothing around them: a word with the space
#: before it, or white space.
UNIT = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
MEMO = 500_000  # units in each of a worker's two generations


class PrefixBpe:
    """Prefix counts of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        spec = json.loads(self.library.to_str())
        # the byte alphabet: printable bytes stand for themselves, the rest follow from 256
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in keep)}
        byte = {c: b for b, c in char.items()}
        raw = lambda s: bytes(byte[c] for c in s)
        number = {bytes([b]): b for b in range(256)}  # tokens by age: bytes, then merges in order
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[int, int] = {}
        for m in spec["model"]["merges"]:
            x, y = map(raw, m if isinstance(m, list) else m.split(" "))
            new = len(self.halves)
            self.joined.setdefault(number[x] << 20 | number[y], new)
            number.setdefault(x + y, new)
            self.halves.append((number[x], number[y]))
        specials = {t["content"] for t in spec["added_tokens"]}
        # every token that BPE makes of its own bytes, as a trie: byte -> node, -1 -> token
        self.trie: dict[int, dict] = {}
        for t in {raw(t) for t in spec["model"]["vocab"] if t not in specials}:
            if t in number and (len(t) == 1 or self.meets(*self.halves[number[t]], number[t])):
                node = self.trie
                for c in t:
                    node = node.setdefault(c, {})
                node[-1] = number[t]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split, self.unit = regex.compile(SPLIT), re.compile(UNIT)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.runs = regex.compile(rf"[{SPACE}]{{2,}}(?=[^{SPACE}])")
        self.plain = regex.compile(r"[\x00-\u024f]*")

    def meets(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Whether BPE leaves token a followed by token b, both made before ``limit``.

        Back in time: of the two at the seam the younger is taken apart, so that its
        half at the seam stands there.  If the pair at the seam has a token older than
        what was just taken apart, BPE would have made that one first.  On equal age the
        pair further left goes first.
        """
        joined, halves = self.joined, self.halves
        while True:
            c = joined.get(a << 20 | b)
            if c is not None and c < limit:
                return False
            if a > b and a > 255:
                limit, a = a, halves[a][1]
            elif b > 255:
                limit, b = b + 1, halves[b][0]
            elif a > 255:
                limit, a = a, halves[a][1]
            else:
                return True

    def counts(self, word: bytes) -> list[int]:
        """Tokens of every prefix of a pretoken, by bytes, from 0 bytes on.

        The encoding of a prefix is that of a shorter one and one last token: the
        token that ends there and that BPE keeps apart from the last one before it.
        There is exactly one such token, so counts follow in one pass.
        """
        size, root, meets = len(word), self.trie, self.meets
        n, last = [0] * (size + 1), [-1] * (size + 1)
        for i in range(size):
            before, node = last[i], root
            for j in range(i, size):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and last[j + 1] < 0 and (i == 0 or meets(before, t)):
                    last[j + 1], n[j + 1] = t, n[i] + 1
        return n

    def size(self, piece: str) -> int:
        return sum(np.frombuffer(self.deltas(piece), np.int8).tolist())

    def deltas(self, unit: str) -> bytes:
        """int8 per code point: by how much the count changes with it."""
        got = self.memo.get(unit)
        if got is not None:
            return got
        got = self.old.get(unit)
        if got is None:
            pieces = self.split.findall(unit)
            got = self.piece(unit) if len(pieces) == 1 else b"".join([self.deltas(p) for p in pieces])
            if not self.plain.fullmatch(unit):
                got = self.agreed(unit, got)
        if len(unit) <= 64:
            if len(self.memo) >= MEMO:  # what was used since the last turn stays
                self.old, self.memo = self.memo, {}
            self.memo[unit] = got
        return got

    def of_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def agreed(self, unit: str, got: bytes) -> bytes:
        """``got`` if the library counts the unit alike; else of the pieces that the library
        splits it into, as it may class letters of other scripts in another way.  Only
        a unit that still differs is encoded prefix by prefix."""
        want = self.of_library(unit)
        if len(got) == len(unit) and int(np.frombuffer(got, np.int8).sum(dtype=np.int64)) == want:
            return got
        ends = [b for _, (_, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        got = b"".join(self.piece(unit[a:b]) for a, b in zip([0, *ends], ends) if a < b)
        if len(got) == len(unit) and int(np.frombuffer(got, np.int8).sum(dtype=np.int64)) == want:
            return got
        return np.diff(np.array([0, *(self.of_library(unit[:i]) for i in range(1, len(unit) + 1))])).astype(np.int8).tobytes()

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        c = [1, 2, self.counts(raw)[-1]] if piece in ("'re", "'ve", "'ll") else self.counts(raw)[1:]
        if len(raw) > len(piece) and len(c) == len(raw):  # counts at whole code points only
            c = [c[i] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
        return bytes([(y - x) & 255 for x, y in zip([0, *c], c)])

    def segment(self, text: str) -> np.ndarray:
        """Changes of the count over text without special tokens."""
        units, make = self.unit.findall(text), self.deltas
        found = list(map(self.memo.get, units))
        if None in found:
            found = [x or make(u) for u, x in zip(units, found, strict=True)]
        out = b"".join(found)
        d = np.frombuffer(out, np.int8)
        for m in self.runs.finditer(text):
            # a text that ends with this run has it as one piece, not as two
            run = m[0]
            e = self.size(run) - self.size(run[:-1]) - self.size(run[-1:])
            if e:
                if not d.flags.writeable:
                    d = d.copy()
                d[m.end() - 1] += e
                d[m.end()] -= e
        return d

    def prefix(self, text: str) -> np.ndarray:
        """int8 changes per code point; their running sum is the count of each prefix."""
        if not text:
            return np.zeros(0, np.int8)
        if not self.special or not self.special.search(text):
            d = self.segment(text)
        else:
            parts, at = [], 0
            for m in self.special.finditer(text):
                d = self.segment(text[at : m.end()]).copy()  # until its last character a special token is text
                k = m.start() - at
                whole = int(self.segment(text[at : m.start()]).sum(dtype=np.int64)) + 1 if k else 1
                d[-1] = whole - int(d[:-1].sum(dtype=np.int64))
                parts.append(d)
                at = m.end()
            parts.append(self.segment(text[at:]))
            d = np.concatenate(parts)
        return d


@lru_cache(1)
def _bpe(file: str) -> PrefixBpe:
    return PrefixBpe(file)


def pack(changes: np.ndarray) -> bytes:
    return zlib.compress(changes.tobytes(), 1)


def prefix_counts(packed: bytes) -> np.ndarray:
    """Count at every prefix, the empty one first, from a stored row."""
    d = np.frombuffer(zlib.decompress(packed), np.int8).astype(np.int32)
    return np.concatenate([[0], np.cumsum(d)]).astype(np.int32)


def fits(packed: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(packed) <= budget)[-1])


def token_counts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), store: bool = True) -> DataFrame:
    """Exact token counts of every prefix of every text.

    Returns per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``fit_<b>`` per
    budget (code points of the longest prefix of at most b tokens) and, with
    ``store``, ``prefix``: the changes of the count per code point, compressed;
    :func:`prefix_counts` and :func:`fits` answer any truncation or budget question
    from it without encoding again.

    Counts are those of ``tokenizers`` without added tokens; a special token's string
    is that token.  Null counts as empty: 0 tokens.  Every row gives a row, whatever
    its id.  Long texts cost time and memory in proportion.  Other columns are not
    read.  There is no shuffle.
    """
    fields = [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), *[pa.field(f"fit_{b}", pa.int64()) for b in budgets], *([pa.field("prefix", pa.binary())] if store else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(file)
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                text = text.as_py() or ""
                d = bpe.prefix(text)
                row = [len(text.encode()), int(d.sum(dtype=np.int64))]
                if budgets:
                    c = np.concatenate([[0], np.cumsum(d, dtype=np.int32)])
                    row += [int(np.flatnonzero(c <= b)[-1]) for b in budgets]
                if store:
                    row.append(pack(d))
                for to, x in zip(cols, row, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)]], schema=pa.schema([batch.schema.field(0), *fields]))

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[0].dataType.simpleString()
    ddl = [f"`{id_col}` {kind}", "n_bytes long", "n_tokens long", *[f"fit_{b} long" for b in budgets], *(["prefix binary"] if store else [])]
    return src.mapInArrow(run, ", ".join(ddl))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`token_counts`, whose rules for nulls, repeated rows and
    long texts hold, then ``fit_512`` and the stored counts of every prefix."""
    import public_tokenizers

    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), budgets=(512,))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_512", F.base64("prefix").alias("prefix"))
