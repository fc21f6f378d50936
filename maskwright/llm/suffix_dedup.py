"""Removal of repeated byte strings by hash-compared suffix sorts.

A string of ``size`` bytes that starts at two places has the same least hash of its GRAM-byte
grams at both, at the same distance, so every such window has an *owner*: the place of that
gram (its *anchor*).  A run of windows with one owner is a *context*: its bytes lie around the
anchor, and equal windows lie in contexts of equal anchors at equal distances.  Only a key and
a digest of a context move (one in some 85 bytes); where an anchor has several contexts, their
bytes come too, and the suffixes that start at the anchors, and the reversed prefixes that end
there, are sorted.  In both orders the strings that agree for a length stand together, so the
windows that begin ``o`` bytes before the anchors are equal where the prefixes agree for ``o``
bytes and the suffixes for ``size - o``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, lean, release, table
from .words import _power, mix

SIZE = 200
GRAM = 32
CHUNK = 1 << 20  # bytes that are hashed at once
BLOCK = 4096  # contexts that are sorted at once, and those of one anchor more
MANY = 8192  # contexts of an anchor beyond which it is dealt anew
PARTS = 4  # by so many parts of its windows
OWNER = (1 << 24) - 1


def digests(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of each part's BLAKE2b."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def owners(raw: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(owner of the window at each byte, anchor hash at each byte) of one buffer."""
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1])
    w = size - gram + 1
    n = len(grams) - w + 1
    key = np.full(-(-len(grams) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    key[: len(grams)] = (grams & ~np.uint64(OWNER)) | np.arange(len(grams), dtype=np.uint64)
    ahead = np.minimum.accumulate(key.reshape(-1, w), axis=1).ravel()
    behind = np.minimum.accumulate(key.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(OWNER)).astype(np.int64), grams


def _buffers(texts, size: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """About CHUNK bytes at a time: (bytes, [(text, place in it, bytes)]).  A longer text comes
    in pieces that overlap by a window less a byte, so each window is in one of them."""
    held, what, total = [], [], 0
    for i, b in enumerate(texts):
        at = 0
        while len(b) - at >= size:
            piece = b[at : at + CHUNK + size - 1]
            held.append(piece)
            what.append((i, at, len(piece)))
            total += len(piece)
            at += CHUNK
            if total >= CHUNK:
                yield b"".join(held), what
                held, what, total = [], [], 0
    if held:
        yield b"".join(held), what


def _contexts(size: int, gram: int):
    """mapInArrow: (id, t, text) to a row a context."""

    def run(batches):
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("b"))
            for data, what in _buffers(texts, size):
                who, at, long = (np.array(x, np.int64) for x in zip(*what, strict=True))
                ends = np.cumsum(long)
                owner, grams = owners(np.frombuffer(data, np.uint8), size, gram)
                piece = np.repeat(np.arange(len(who)), long)[: len(owner)]
                begin = np.flatnonzero(np.arange(len(owner)) + size <= ends[piece])
                cut = np.flatnonzero((np.diff(owner[begin], prepend=-1) != 0) | (np.diff(piece[begin], prepend=-1) != 0))
                first, wins = begin[cut], np.diff(np.append(cut, len(begin)))
                c = digests([data[a : a + w - 1 + size] for a, w in zip(first.tolist(), wins.tolist(), strict=True)])
                p = owner[first]
                place = piece[first]
                rows = pa.array(who[place])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows), batch.column("t").take(rows),
                        pa.array((first - (ends - long)[place] + at[place]).astype(np.int32)), pa.array(wins.astype(np.int32)), pa.array((p - first).astype(np.int32)),
                        pa.array(grams[p].view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()),
                    ],
                    names=["id", "t", "start", "wins", "back", "a", "c1", "c2"],
                )

    return run


# ---- sorting


def _power_of(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    p = np.full(n, np.uint64(int(g.integers(1 << 62)) * 2 + 1))
    p[0] = 1
    return g.integers(1, 1 << 62, 256).astype(np.uint64), np.multiply.accumulate(p)


def prefix_hashes(chars: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hash of every prefix of every row."""
    code, up = _power_of(seed, chars.shape[1])
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    np.cumsum(code[chars] * up, axis=1, out=out[:, 1:])
    return out


def extension(hashes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far rows a and b agree: a binary search over their prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    flat, wide = hashes.ravel(), hashes.shape[1]
    a, b = a * wide, b * wide
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = flat[a + mid] == flat[b + mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def less(chars: np.ndarray, hashes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a stands before row b: by the byte behind what they share; an end comes first."""
    at = extension(hashes, size, a, b)
    last = chars.shape[1] - 1
    x = np.where(at < size[a], chars[a, np.minimum(at, last)].astype(np.int16), -1)
    y = np.where(at < size[b], chars[b, np.minimum(at, last)].astype(np.int16), -1)
    return x < y


def merge_sort(chars: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Order of the rows: runs of doubling length, each row's place in the other run by a binary
    search whose every step compares two rows by their hashes."""
    m = len(chars)
    order, hashes = np.arange(m), prefix_hashes(chars, seed)
    width, place = 1, np.arange(m)
    while width < m:
        run = place // width
        low = (run ^ 1) * width  # the other run
        base, high = np.minimum(low, m), np.minimum(low + width, m)
        lo = base.copy()
        left = (run & 1) == 0
        for _ in range(width.bit_length()):
            todo = np.flatnonzero(lo < high)
            if not len(todo):
                break
            mid = (lo[todo] + high[todo]) >> 1
            other, mine, is_left = order[mid], order[todo], left[todo]
            # a row of the left run stands before equal ones of the right run
            before = less(chars, hashes, size, np.where(is_left, other, mine), np.where(is_left, mine, other))
            before = np.where(is_left, before, ~before)
            lo[todo] = np.where(before, mid + 1, lo[todo])
            high[todo] = np.where(before, high[todo], mid)
        new = np.where(left, place, place - width) + (lo - base)
        merged = np.empty(m, np.int64)
        merged[new] = order
        order, width = merged, width * 2
    return order


def sorted_suffixes(chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, how far each row agrees with the one before).  The order is verified by the bytes of
    neighbours; if hashes collided, it is made again with others, and at last without any."""
    m = len(chars)
    for seed in (1, 2, 3, None):
        order = merge_sort(chars, size, seed) if seed else np.array(sorted(range(m), key=lambda i: chars[i, : size[i]].tobytes()), np.int64)
        a, b = order[:-1], order[1:]
        both = np.minimum(size[a], size[b])
        differ = (chars[a] != chars[b]) | (np.arange(chars.shape[1]) >= both[:, None])
        agree = np.where(differ.any(axis=1), differ.argmax(axis=1), chars.shape[1]) if m > 1 else both
        last = chars.shape[1] - 1
        x = np.where(agree < size[a], chars[a, np.minimum(agree, last)].astype(np.int16), -1)
        y = np.where(agree < size[b], chars[b, np.minimum(agree, last)].astype(np.int16), -1)
        if (x <= y).all():
            break
    return order, np.concatenate([[0], agree]).astype(np.int64)


def _matrix(parts: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    out = np.zeros((len(parts), max(1, wide)), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return out, size


def repeated(texts: list[bytes], back: np.ndarray, wins: np.ndarray, size: int = SIZE) -> np.ndarray:
    """[context, o]: whether another context has the window that begins o bytes before its anchor.
    A context owns the windows that begin ``back`` to ``back - wins + 1`` bytes before its anchor."""
    m = len(texts)
    heads = [t[:b][::-1] for t, b in zip(texts, back.tolist(), strict=True)]
    tails = [t[b:] for t, b in zip(texts, back.tolist(), strict=True)]
    right, right_size = _matrix(tails, size)
    left, left_size = _matrix(heads, size)
    by_right, right_agree = sorted_suffixes(right, right_size)
    by_left, left_agree = sorted_suffixes(left, left_size)
    out = np.zeros((m, size), bool)
    kind_r, kind_l = np.empty(m, np.int64), np.empty(m, np.int64)
    # how far each agrees with a neighbour in the order: no one agrees further
    far_r, far_l = np.zeros(m, np.int64), np.zeros(m, np.int64)
    far_r[by_right] = np.maximum(right_agree, np.append(right_agree[1:], 0))
    far_l[by_left] = np.maximum(left_agree, np.append(left_agree[1:], 0))
    for o in range(size):
        own = np.flatnonzero((o <= back) & (o > back - wins) & (far_r >= size - o) & (far_l >= o))
        if len(own) < 2:
            continue
        kind_r[by_right] = np.cumsum(right_agree < size - o)
        kind_l[by_left] = np.cumsum(left_agree < o)
        key = kind_r[own] * (m + 1) + kind_l[own]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own, o] = count[which] > 1
    return out


def _sorted(size: int):
    """mapInArrow over rows that are sorted by anchor: the repeated runs of contexts that are there
    once."""

    def found(rows: pa.Table):
        back, wins, start = (np.asarray(rows.column(c)).astype(np.int64) for c in ("back", "wins", "start"))
        hits = repeated([x.as_py() for x in rows.column("x")], back, wins, size)
        hits &= (np.asarray(rows.column("n")) == 1)[:, None]
        # o bytes before the anchor: runs of falling o are runs of places
        hits = np.pad(hits[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)
        row, first = np.nonzero(np.diff(hits, axis=1) == 1)
        _, last = np.nonzero(np.diff(hits, axis=1) == -1)
        begin = start[row] + back[row] - (size - 1 - first)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [rows.column("id").combine_chunks().take(at), rows.column("t").combine_chunks().take(at), pa.array(begin.astype(np.int32)), pa.array((last - first).astype(np.int32))],
            names=["id", "t", "start", "wins"],
        )

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            a = np.asarray(rows.column("a"))
            whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if whole:
                yield found(rows.slice(0, whole))
            rest = rows.slice(whole)
            held, count = rest.combine_chunks().to_batches(), rest.num_rows
        if count:
            yield found(pa.Table.from_batches(held))

    return run


def _cut_out(size: int):
    """mapInArrow: a document's text and the places of contexts in it, to the contexts' bytes."""

    def run(batches):
        for batch in batches:
            needs = batch.column("need")
            places = np.asarray(needs.offsets).astype(np.int64)
            flat = needs.values
            start, wins = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "wins"))
            for i in range(batch.num_rows):
                data = memoryview(batch.column("b")[i].as_buffer())
                for a in range(places[i], places[i + 1], BLOCK):
                    b = min(a + BLOCK, places[i + 1])
                    part = flat.slice(a, b - a)
                    row = pa.array(np.full(b - a, i))
                    x = pa.array([bytes(data[s : s + w - 1 + size]) for s, w in zip(start[a:b].tolist(), wins[a:b].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(row), batch.column("t").take(row), *[part.field(c) for c in ("start", "wins", "back", "a", "n", "d")], x],
                        names=["id", "t", "start", "wins", "back", "a", "n", "d", "x"],
                    )

    return run


def _parted(size: int, width: int):
    """mapInArrow: contexts of an anchor that has very many, as narrower ones: their windows that
    begin ``g`` to ``g + width - 1`` bytes before the anchor.  Those share a core of bytes, which
    becomes the anchor; with a width of one the core is the window itself."""

    def run(batches):
        for batch in batches:
            start, wins, back, a = (np.asarray(batch.column(c)).astype(np.int64) for c in ("start", "wins", "back", "a"))
            rows, places, texts, cores, marks = [], [], [], [], []
            for i, x in enumerate(batch.column("x")):
                x, o2, least = x.as_py(), int(back[i]), int(back[i] - wins[i] + 1)
                while o2 >= least:
                    g = o2 // width * width
                    o1, skip = max(least, g), int(back[i]) - o2
                    part = x[skip : skip + o2 - o1 + size]
                    rows.append(i)
                    places.append((int(start[i]) + skip, o2 - o1 + 1, o2))
                    texts.append(part)
                    cores.append(b"%d %d %d " % (int(a[i]), g, width) + part[o2 - g : o2 - g + size - width + 1])
                    marks.append(b"%d %d %d %d " % (int(a[i]), g, width, o2) + part)
                    o2 = o1 - 1
            if not rows:
                continue
            at, place, core, mark = pa.array(rows), np.array(places, np.int32), digests(cores), digests(marks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("t").take(at), *[pa.array(place[:, j].copy()) for j in range(3)], pa.array(core[:, 0].copy()), batch.column("n").take(at), pa.array(texts, pa.binary()), pa.array(mark[:, 0].copy()), pa.array(mark[:, 1].copy())],
                names=["id", "t", "start", "wins", "back", "a", "n", "x", "c1", "c2"],
            )

    return run


def _kept(size: int, names: list[str]):
    """mapInArrow: a text and its repeated runs of windows, to its spans and what is left of it."""

    def run(batches):
        for batch in batches:
            lists = batch.column("found")
            ends = np.asarray(lists.offsets).astype(np.int64)
            first = np.asarray(lists.values.field("start")).astype(np.int64)
            last = first + np.asarray(lists.values.field("wins")) - 1 + size
            held, spans = [], []
            for i, b in enumerate(batch.column("b")):
                data = b.as_buffer() if b.is_valid else b""
                data, at, order = memoryview(data), 0, slice(ends[i], ends[i + 1])
                a, z = first[order], last[order]
                sort = np.argsort(a, kind="stable")
                a, z = a[sort], np.maximum.accumulate(z[sort])
                new = np.flatnonzero(np.append(True, a[1:] > z[:-1])) if len(a) else np.zeros(0, np.int64)
                merged = list(zip(a[new].tolist(), z[np.append(new[1:] - 1, len(a) - 1)].tolist() if len(a) else [], strict=True))
                parts = []
                for s, e in merged:
                    parts.append(data[at:s])
                    at = e
                held.append(b"".join([*parts, data[at:]]))
                spans.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(b.as_buffer()) if b.is_valid else 0 for b in batch.column("b")], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(held, pa.binary())], names=names)

    return run


def _by_anchor(contexts: DataFrame) -> DataFrame:
    """Contexts (distinct ones) of anchors that have several, of which one is there only once;
    ``d``: how many.  The others have nothing to learn from a sort."""
    open_ = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("m")).where("d > 1 AND m = 1").drop("m")
    return keyed_join(contexts, open_, ["a"], "d", "c1").where("d IS NOT NULL")


def repeated_runs(texts: DataFrame, size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, list[DataFrame]]:
    """(runs, what to release): ``id, t, start, wins`` of windows that start anywhere else too."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, t long, start int, wins int"
    places = table(texts.mapInArrow(lean(_contexts(size, gram)), f"{schema}, back int, a long, c1 long, c2 long"))
    first = F.min(F.struct("id", "t", "start", "wins", "back")).alias("p")
    counts = table(places.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), first).select("c1", "c2", "n", "a", "p.*"))
    spans = [keyed_join(places, counts.where("n > 1").select("c1", "c2", "n"), ["c1", "c2"], "n", "start").where("n IS NOT NULL").select("id", "t", "start", "wins")]
    need = _by_anchor(counts).groupBy(F.col("id").alias("of"), F.col("t").alias("to")).agg(F.collect_list(F.struct("start", "wins", "back", "a", "n", "d")).alias("need"))
    bytes_of = texts.join(need, texts["id"].eqNullSafe(need["of"]) & (texts["t"] == need["to"])).select("id", "t", "b", "need")
    held = table(bytes_of.mapInArrow(lean(_cut_out(size)), f"{schema}, back int, a long, n long, d long, x binary"))
    release(counts)
    tables, width = [places], max(1, size // 3)
    while True:
        tables.append(held)
        some = held.where(F.col("d") <= MANY).drop("d").repartition("a").sortWithinPartitions("a")
        spans.append(some.mapInArrow(lean(_sorted(size)), schema))
        hot = held.where(F.col("d") > MANY)
        if not width or hot.isEmpty():
            break
        parts = table(hot.mapInArrow(lean(_parted(size, width)), f"{schema}, back int, a long, n long, x binary, c1 long, c2 long"))
        tables.append(parts)
        one = parts.groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.min(F.struct("id", "t", "start", "wins", "back", "x")).alias("p"))
        one = table(one.select("c1", "c2", "n", "a", "p.*"))
        tables.append(one)
        spans.append(keyed_join(parts.where("n = 1").drop("n", "x"), one.where("n > 1").select("c1", "c2", "n"), ["c1", "c2"], "n", "start").where("n IS NOT NULL").select("id", "t", "start", "wins"))
        held = table(_by_anchor(one).select("id", "t", "start", "wins", "back", "a", "n", "d", "x"))
        width = max(1, width // PARTS) if width > 1 else 0
    runs = spans[0]
    for s in spans[1:]:
        runs = runs.unionByName(s)
    return runs, tables


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Removes every byte that lies in a string of ``size`` bytes which starts at two or more places.

    Texts count as UTF-8 bytes, matches never cross texts, and all strings are judged on the input.
    Contexts (see the module) that occur twice in full settle all their windows by a digest of 128
    bits; of the others, those whose anchor has several contexts are sorted, BLOCK at a time: a
    mergesort of the suffixes at the anchors, and one of the reversed prefixes, in which two rows
    are compared by a binary search over hashes of their prefixes, with the bytes of neighbours
    verified.  The contexts of one anchor meet in a task up to MANY; beyond that they are dealt
    anew as parts of their windows by the bytes that a part's windows share, ever narrower, until
    a part is one window, so that no group is cut off and none is unbounded.

    Returns ``id_col``, ``n_bytes``, ``spans`` (maximal removed runs, byte offsets, end exclusive) and
    ``kept`` (the remaining bytes, which may end within a character).  Null counts as empty; texts
    of fewer bytes are kept as they are.  Rows that repeat an id are texts of their own; rows that
    repeat id and text are repeats of each other and go alike.  A null id stays.  Other columns
    are not read.
    """
    b = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), b.alias("b"))
    runs, tables = repeated_runs(texts.where(F.octet_length("b") >= size), size, gram)
    found = table(runs.groupBy(F.col("id").alias("of"), F.col("t").alias("to")).agg(F.collect_list(F.struct("start", "wins")).alias("found")))
    for t in tables:
        release(t)
    out = texts.join(found, texts["id"].eqNullSafe(found["of"]) & (texts["t"] == found["to"]), "left")
    out = out.select("id", "b", F.coalesce("found", F.array().cast("array<struct<start:int,wins:int>>")).alias("found"))
    names = [id_col, "n_bytes", "spans", "kept"]
    return out.mapInArrow(lean(_kept(size, names)), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`suffix_dedup`, whose rules for nulls, ties, repeated, empty
    and long rows hold."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 400) AS k FROM (SELECT doc_id, x, unnest(range(0, CAST(len(x) // 2 - 199 AS BIGINT))) AS s FROM t WHERE len(x) >= 400)),
h AS (SELECT doc_id, s, md5(k) AS k FROM w),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN s > p + 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
    FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM d)),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string([substr(x, 2 * (CASE WHEN i = 1 THEN 0 ELSE stops[i - 1] END) + 1,
        2 * ((CASE WHEN i > len(starts) THEN len(x) // 2 ELSE starts[i] END) - (CASE WHEN i = 1 THEN 0 ELSE stops[i - 1] END))) FOR i IN range(1, len(starts) + 2)], '') END)) AS kept_sha256
FROM t LEFT JOIN o USING (doc_id)
"""
