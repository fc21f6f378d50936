"""N-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, lean, release, table
from .components import components
from .sketch import encode, summed, total
from .words import mix, shingles, word_hashes

BUCKETS = 1 << 20
FRAGMENTS = 4
FEW = 500_000  # pairs up to which they are broadcast, so that only the segments they need move
U32 = np.uint64(32)
WORDS_OF_BITS = 8  # 64-bit words of a set's parity bits
COPIES = 1 << 17  # sets that a task remembers to leave out copies early
BATCH = 1 << 19  # values after which a batch is handed on


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in order) of every text of a batch."""
    texts = (x.as_py() for x in batch.column(1))
    for first, count, h, ends in word_hashes(texts):
        runs = shingles(h, k)  # of the whole block; those across two texts are left out
        at = 0
        for i in range(count):
            end = int(ends[i])
            s = runs[at : end - k + 1] if end - at >= k else shingles(h[at:end], k)
            at = end
            yield first + i, np.unique(s)


def _node(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit digests of a set, which copies of it share: sums over its hashes."""
    a = np.add.reduce(s ^ (s >> np.uint64(29 + seed)))
    b = np.add.reduce(s * s)
    return tuple(mix(np.array([a, b], np.uint64) + np.uint64(len(s))).view(np.int64).tolist())


def _parity(s: np.ndarray) -> np.ndarray:
    """Whether each of 64 * WORDS_OF_BITS buckets has an odd number of the set's hashes.
    Two sets differ in as many hashes at least as in bits."""
    odd = np.bincount((s % np.uint64(64 * WORDS_OF_BITS)).astype(np.int64), minlength=64 * WORDS_OF_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Order:
    """The global order of the n-grams: by how often their bucket occurs, then by hash.

    Any order that all tasks share gives exact results; rare ones first keeps the
    lists short.  ``pivots`` cut it into fragments of about the same mass.
    """

    def __init__(self, counts: np.ndarray, fragments: int):
        self.counts = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
        level = np.sort(self.counts[self.counts > 0]).astype(np.float64)
        mass = np.cumsum(level)
        pivots = []
        for v in range(1, fragments):
            want = mass[-1] * v / fragments if len(mass) else 0.0
            i = int(np.searchsorted(mass, want)) if len(mass) else 0
            f = level[i] if len(level) else 0.0
            lo, hi = (np.searchsorted(level, f), np.searchsorted(level, f, "right")) if len(level) else (0, 1)
            base = mass[lo - 1] if lo else 0.0
            share = (want - base) / max(1.0, f * (hi - lo))  # within a level by hash
            pivots.append((int(f) << 32) + int(min(max(share, 0.0), 1.0) * ((1 << 32) - 1)))
        self.pivots = np.array(sorted(pivots), np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        return (self.counts[(s % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64) << U32) | (s >> U32)


def prefix_length(n: int, percent: int) -> tuple[int, int]:
    """(length of the prefix, n-grams that two prefixes share at least).

    Two sets that reach ``percent`` share at least least = ceil(percent n / 100)
    n-grams, so the n - least + l rarest of either share l.  l grows with n, which
    leaves out pairs that share a chance n-gram only.
    """
    least = -(-percent * n // 100)
    l = min(least, 1 + n // 20)
    return n - least + l, l


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """Classes of documents whose word-shingle sets reach a Jaccard similarity.

    1. Every text becomes a set of shingle hashes and a node, the digest of the set;
       copies are one node from there on.
    2. Bucket counts over all shingles give one global order, rare ones first.
    3. The rarest shingles of each set are dealt by shingle; those of one set only
       end there.
    4. Candidate pairs are verified by vertical partitioning: the order is cut into
       ``fragments``, each set into a segment per fragment; the overlap of a pair is
       counted segment by segment and summed.
    5. Pairs come in rounds.  A round pairs each node with one centre per shingle, first
       the one that shares most with others (of near copies, the text they come
       from), so a large group of near copies costs a pair a node.  The last round takes
       the pairs of different classes that were not verified yet: of each shingle the
       rows that are not of its largest class meet all its rows, and a pair is made only
       where the first shingle they share stands early enough in both and the parity
       bits of their sets (:func:`_parity`) leave room for the similarity.  Both tests
       are lossless.  So no link between different classes is missed, and pairs
       within a class are not made.

    Returns ``id_col, n_shingles, component_id`` per input row: the least id reachable
    by links, itself included.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  With fewer than ``words``
    words the whole sequence is one shingle.  Null, empty and blank texts have no
    shingles and link with nothing.  Rows that repeat an id are one document; the links
    of any of its texts count.  A null id links with nothing and has a null component.
    No other column is read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def nodes_of(seed):
        """A row per text, and rows of this task's bucket counts."""

        def run(batches):
            total = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                n, a, b, odd = [], [], [], []
                for _, s in _sets(batch, words):
                    x = _node(s, seed)
                    odd.append(_parity(s))
                    n.append(len(s))
                    a.append(x[0])
                    b.append(x[1])
                    np.add.at(total, (s % np.uint64(BUCKETS)).astype(np.int64), 1)
                yield _frame(batch.column(0), n, a, b, [None] * len(n), np.array(odd, np.int64).reshape(len(n), WORDS_OF_BITS).T)
            if total.any():
                parts = encode(total)
                none = [None] * len(parts)
                yield _frame(none, [i for i, _ in parts], none, none, [x for _, x in parts], [none] * WORDS_OF_BITS)

        def _frame(i, n, a, b, c, odd):
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()) if isinstance(i, list) else i, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), *[pa.array(x, pa.int64()) for x in odd]], names=["id", "n", "node", "check", "counts", *bits_of])

        return src.mapInArrow(lean(run), "id long, n long, node long, check long, counts binary" + "".join(f", {c} long" for c in bits_of))

    bits_of = [f"p{i}" for i in range(WORDS_OF_BITS)]

    seed = 0
    while True:  # a digest that two different sets share is found by the other one; another seed parts them
        first = table(nodes_of(seed))
        rows = first.where("counts is null").select("id", "n", "node", "check")
        if rows.where("n > 0").groupBy("node").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").isEmpty():
            break
        release(first)
        seed += 1
    counts = total(first.where("counts is not null").select(F.col("n").cast("int").alias("part"), "counts"), BUCKETS)
    order = docs.sparkSession.sparkContext.broadcast(Order(counts, fragments))

    def prefixes(batches):
        o = order.value

        def rows_of(cols):
            return pa.RecordBatch.from_arrays([_long(np.concatenate(cols[0])), *[pa.array(np.concatenate(c)) for c in cols[1:]]], names=["gram", "node", "n", "pos"])

        sent: set[int] = set()  # copies within a task are one row a shingle
        for batch in batches:
            cols, size = [[], [], [], []], 0
            for _, s in _sets(batch, words):
                node = _node(s, seed)[0]
                if len(s) and node not in sent:
                    if len(sent) >= COPIES:
                        sent.clear()
                    sent.add(node)
                    p, _l = prefix_length(len(s), percent)
                    key = o.keys(s)
                    mine = np.argsort(key, kind="stable")[:p]  # by key, then hash, which is how s stands
                    cols[0].append(s[mine])
                    cols[1].append(np.full(p, node, np.int64))
                    cols[2].append(np.full(p, len(s), np.int32))
                    cols[3].append(np.arange(p, dtype=np.int32))
                    size += p
                    if size > BATCH:
                        yield rows_of(cols)
                        cols, size = [[], [], [], []], 0
            if size:
                yield rows_of(cols)

    def shared(batches):
        """Of rows sorted by gram and node, one per pair of them, of grams that several nodes have."""
        last = None  # the last row, and whether it was sent
        for batch in batches:
            g, node, n, pos = (np.asarray(c) for c in batch.columns)
            if not len(g):
                continue
            if last is not None:
                g, node, n, pos = (np.concatenate([[x], y]) for x, y in zip(last[:4], (g, node, n, pos), strict=True))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
            g, node, n, pos = g[new], node[new], n[new], pos[new]
            again = np.zeros(len(g), bool)
            again[1:] = g[1:] == g[:-1]
            again[:-1] |= again[1:].copy()
            sent = bool(again[-1]) or (len(g) == 1 and last is not None and last[4])
            if last is not None and last[4]:
                again[0] = False
            last = (g[-1], node[-1], n[-1], pos[-1], sent)
            yield pa.RecordBatch.from_arrays([pa.array(g[again]), pa.array(node[again]), pa.array(n[again].astype(np.int32)), pa.array(pos[again].astype(np.int32))], names=["gram", "node", "n", "pos"])

    share = lambda n: F.least(F.ceil(n * percent / 100), 1 + F.floor(n / 20))  # noqa: E731  of prefix_length
    kinds = "gram long, node long, n int, pos int"
    dealt = src.mapInArrow(lean(prefixes), kinds).repartition("gram").sortWithinPartitions("gram", "node")
    some = table(dealt.mapInArrow(lean(shared), kinds))
    # a node that links with any shares at least so many of its rare shingles
    enough = some.groupBy("node").agg(F.count(F.lit(1)).alias("g"), F.first("n").alias("n")).where(F.col("g") >= share(F.ceil(F.col("n") * percent / 100)))
    posts = table(some.join(enough.select("node"), "node", "left_semi").select("gram", "node", "n", "pos"))
    release(some)

    least = F.least
    reach = lambda n: n * percent / (100 + percent)  # noqa: E731  what sets of n shingles together must share
    # a link's sets are close in size, and its first shared shingles stand early enough in both
    # that what comes after can still make up the overlap it needs
    need = reach(F.col("na") + F.col("nb"))
    close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (least(share(F.col("na")), share(F.col("nb"))) - 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need - 1e-6)

    wanted = posts.select("node").distinct()
    bits = 1 << min(27, max(16, (8 * wanted.count()).bit_length()))  # a filter of at most 16 MB, without false absences
    spot = lambda x: (mix(np.asarray(x, np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)
    filt = docs.sparkSession.sparkContext.broadcast(np.packbits(summed(wanted, lambda batch: iter([spot(batch.column(0))]), bits) > 0))

    def segments(batches):
        o, f = order.value, filt.value

        def rows_of(cols):
            off = np.cumsum([0, *map(len, cols[2])])
            seg = pa.ListArray.from_arrays(pa.array(off, pa.int32()), _long(np.concatenate(cols[2])))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), seg], names=["node", "frag", "seg"])

        for batch in batches:
            cols, size = [[], [], []], 0
            for _, s in _sets(batch, words):
                if not len(s):
                    continue
                node = _node(s, seed)[0]
                at = int(spot(np.array([node]))[0])
                if not f[at >> 3] >> (7 - (at & 7)) & 1:
                    continue
                part = np.searchsorted(o.pivots, o.keys(s), "right")
                for v in range(len(o.pivots) + 1):
                    seg = s[part == v]
                    if len(seg):
                        for c, x in zip(cols, (node, v, seg), strict=True):
                            c.append(x)
                size += len(s)
                if size > BATCH:
                    yield rows_of(cols)
                    cols, size = [[], [], []], 0
            if size:
                yield rows_of(cols)

    kept = src.mapInArrow(lean(segments), "node long, frag int, seg array<long>").groupBy("node", "frag").agg(F.first("seg").alias("seg"))
    segs = table(kept)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, na, nb) those that reach the similarity."""

        few = pairs.count() <= FEW
        hint = F.broadcast if few else lambda x: x
        sa = segs.toDF("a", "frag", "sa").join(hint(pairs), "a")
        sb = segs.toDF("b", "frag", "sb").join(hint(pairs.select("b").distinct()), "b", "left_semi")
        parts = sa.join(sb, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
        total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
        return total.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")

    def star(rows: DataFrame, centres) -> DataFrame:
        """Each node with the centres of a gram, where they meet at a few grams at least."""
        mid = rows.groupBy("gram").agg(F.array_distinct(F.array(*centres)).alias("c"))
        meet = rows.join(mid, "gram").select("node", "n", "pos", F.explode("c").alias("c")).where("node <> c.node")
        low = F.col("node") < F.col("c.node")
        two = lambda f, a, b: [F.when(low, F.col(f)).otherwise(F.col(f"c.{f}")).alias(a), F.when(low, F.col(f"c.{f}")).otherwise(F.col(f)).alias(b)]
        pair = meet.select(*two("node", "a", "b"), *two("n", "na", "nb"), *two("pos", "pa", "pb"))
        return pair.where(close).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") * 4 >= least(share(F.col("na")), share(F.col("nb")))).drop("g")

    def labels(links: DataFrame) -> DataFrame:
        """(node, class): the least of each linked node's neighbours' neighbours.  Nodes of a
        class are linked; those of a star have one class, longer chains may have several."""
        both = table(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        hop = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        out = table(both.join(hop.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("low").alias("class")).withColumnRenamed("a", "node"))
        release(both)
        return out

    def open_rows(rows: DataFrame, cls: DataFrame) -> DataFrame:
        """Rows of the grams that nodes of several classes have."""
        named = rows.drop("class").join(cls, "node", "left").select("gram", "node", "n", "pos", "rank", F.coalesce("class", "node").alias("class"))
        several = named.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("gram")
        return table(named.join(several, "gram", "left_semi").select("gram", "node", "n", "pos", "rank", "class"))

    # rows that repeat an id tie their nodes together
    same_id = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    links = rows.join(same_id, "id").where("n > 0 and node <> a").select("a", F.col("node").alias("b"))

    size = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    rank = posts.join(size, "gram").groupBy("node").agg((F.sum("m") / F.first("n")).alias("rank"))
    left = table(posts.join(rank, "node"))
    tested = None
    by = lambda x: F.max(F.struct(x.alias("x"), "node", "n", "pos"))
    for centres in ([by(F.col("rank").cast("double"))], [by(F.xxhash64("node").cast("double")), by(F.xxhash64("node", F.lit(1)).cast("double"))]):
        pairs = star(left, centres)
        pairs = table(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            links = table(links.union(verified(pairs)))
        cls = labels(links)
        left, old = open_rows(left, cls), left
        release(old)
    tested = tested if tested is not None else posts.selectExpr("node as a", "node as b").limit(0)
    # of l shared shingles the first stands where all that a link needs can still follow
    head = left.where(F.col("n") - F.col("pos") >= F.ceil(F.col("n") * percent / 100)).drop("rank")
    most = head.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("m")).groupBy("gram").agg(F.max_by("class", F.struct("m", "class")).alias("most"))
    odd = first.where("n > 0 and counts is null").select("node", *bits_of).dropDuplicates(["node"])
    head = table(head.join(most, "gram").join(odd, "node"))
    named = lambda s: [F.col("gram"), *[F.col(c).alias(f"{d}{s}") for c, d in (("node", ""), ("n", "n"), ("pos", "p"), ("class", "c"), *((c, f"{c}_") for c in bits_of))]]
    x, y = head.where("class <> most").select(*named("a")), head.select(*named("b"), (F.col("class") == F.col("most")).alias("large")).withColumnRenamed("gram", "gram_b")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits_of), F.lit(0))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need - 1e-6) & (differ <= F.col("na") + F.col("nb") - 2 * need + 1e-6)
    met = x.join(y, (F.col("gram") == F.col("gram_b")) & (F.col("ca") != F.col("cb")) & (F.col("large") | (F.col("a") < F.col("b"))) & near)
    flip = F.col("a") > F.col("b")
    rest = met.select(*[F.when(flip, F.col(v)).otherwise(F.col(u)).alias(u) for u, v in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]).distinct()
    rest = table(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
    if not rest.isEmpty():
        links = table(links.union(verified(rest)))
        cls = labels(links)
    side = lambda s: cls.toDF(s, f"class_{s}")
    chains = table(links.join(side("a"), "a").join(side("b"), "b").where("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct())
    if not chains.isEmpty():
        whole = components(chains).toDF("class", "least")
        cls = table(cls.join(whole, "class", "left").select("node", F.coalesce("least", "class").alias("class")))
    for done in (head, left, posts, segs):
        release(done)
    named = rows.join(cls, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("class", "node")).alias("class"))
    low = named.where("class is not null").groupBy("class").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    out = keyed_join(named, low, ["class"], "m", "id").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))
    return out


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`jaccard_join` over every row of ``documents``, whose rules for
    nulls, short and empty texts, ties and repeated ids hold."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_sql(table: str = "documents", p: str = "") -> str:
    """CTEs up to ``{p}comp(doc_id, n, component_id)``: brute force over shared shingles."""
    return f"""
{p}w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
{p}s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM {p}w WHERE len(w) > 0)),
{p}n AS (SELECT doc_id, count(*) AS n FROM {p}s GROUP BY doc_id),
{p}k AS (SELECT s, count(*) AS f FROM {p}s GROUP BY s HAVING count(*) > 1),
{p}r AS (SELECT s.doc_id, s.s FROM {p}s s JOIN {p}k USING (s)),
{p}o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM {p}r x JOIN {p}r y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
{p}e AS (SELECT a, b FROM {p}o JOIN {p}n na ON na.doc_id = a JOIN {p}n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
{p}e2 AS (SELECT a, b FROM {p}e UNION ALL SELECT b, a FROM {p}e),
{p}reach AS (SELECT a AS doc_id, a AS r FROM {p}e2 UNION SELECT e.b, c.r FROM {p}reach c JOIN {p}e2 e ON e.a = c.doc_id),
{p}comp AS (SELECT d.doc_id, coalesce(n.n, 0) AS n, coalesce(m.low, d.doc_id) AS component_id FROM {table} d LEFT JOIN {p}n n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS low FROM {p}reach GROUP BY doc_id) m USING (doc_id))"""


OP5_SQL = f"WITH RECURSIVE {jaccard_sql()}\nSELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM comp"
