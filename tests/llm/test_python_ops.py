"""Token counts, packing, Jaccard join, language model, HTML, decontamination, toxicity."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from maskwright.llm import decontamination as D
from maskwright.llm import html_text as H
from maskwright.llm import jaccard_join as J
from maskwright.llm import ngram_lm as L
from maskwright.llm import packing as P
from maskwright.llm import token_counts as T
from maskwright.llm import toxicity as X
from pyspark.sql.types import StringType
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'", "s", "ve", "1", "23", "!", "?é", "ß", "日本", "😀", "\x85", "\x1c", "\xa0", " ", "<|endoftext|>", "<|end", "don't", "ing", "Σ", "İ", "À", "²", "½", "­", "_"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "u", 1, 2) for i, t in rows], "doc_id long, text string, node string, url string, ids int, score int")


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_every_prefix_count_is_the_librarys():
    bpe, lib = T.PrefixBpe(BYTE), Tokenizer.from_file(BYTE)
    for x in random_texts(300):
        want = [len(lib.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        packed = T.pack(bpe.prefix(x))
        assert T.prefix_counts(packed).tolist() == want, x
        assert T.fits(packed, 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_other_scripts_count_as_the_library_does():
    bpe, lib = T.PrefixBpe(BYTE), Tokenizer.from_file(BYTE)
    r = random.Random(8)
    letters = "中文字한글ไทย०१२اب𝒜😀👍🏽\u200d\u2003\u3000 \t'sab1²Ⅷ\ua7c2\U0001e2c0"
    for x in ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(300)]:
        want = [len(lib.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        assert T.prefix_counts(T.pack(bpe.prefix(x))).tolist() == want, x
    long = "中文" * 20_000 + " " + "한 " * 20_000
    assert int(bpe.prefix(long).sum(dtype=np.int64)) == len(lib.encode(long, add_special_tokens=False).ids)


def test_token_counts_rows(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "a b"), (1, "Hello  world"), (5, "ab " * 30_000)]
    out = T.token_counts(frame(spark, rows), BYTE, budgets=(2,)).collect()
    lib = Tokenizer.from_file(BYTE)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in out] == [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert T.token_counts(frame(spark, []), BYTE).count() == 0


def test_word_ids_are_the_librarys():
    enc, lib = P.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for x in random_texts(500, 2) + ["x" * 300 + " y"]:
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("bins", [1, 4, 64])
def test_best_fit_against_plain_lists(bins):
    r, fit, free, home = random.Random(bins), P.BestFit(50, bins), {}, {}
    for k in range(2000):
        n = r.randint(1, 50)
        open_ = {b: f for b, f in free.items() if f}
        b, at = fit.place(n)
        good = [f for f in open_.values() if f >= n]
        if good:
            assert open_[b] == min(good)
        else:
            assert b not in free
            if len(open_) >= bins:
                full = min(open_.values())
                closed = [x for x in open_ if open_[x] == full and x not in {y for v in fit.open.values() for y in v}]
                assert len(closed) == 1
                del free[closed[0]]
            free[b] = 50
        assert at == 50 - free[b]
        free[b] -= n
        home[k] = (b, at, n)
    for b in {x[0] for x in home.values()}:
        places = sorted((a, n) for x, a, n in home.values() if x == b)
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()


def test_packing_round_trip(spark):
    rows = [(i, " ".join(f"w{j * i % 97}" for j in range(i * 53 % 900))) for i in range(60)] + [(100, "long text " * 6000), (101, None), (102, ""), (None, "x"), (101, None)]
    out = P.with_digest(P.pack_documents(frame(spark, rows), WORD)).collect()
    lib, got = Tokenizer.from_file(WORD), defaultdict(list)
    for r in sorted(out, key=lambda r: (r.piece)):
        got[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 <= 4096
    for i, t in rows[:-1]:
        pieces = got[i][: 1 if i == 101 else None]
        ids = [x for r in pieces for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert ids == [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == list(range(0, len(ids), 4096))
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and sum(n for _, n in b) <= 4096
    assert P.pack_documents(frame(spark, []), WORD).count() == 0


def jaccard_brute(rows):
    def sets(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    s = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and None not in (i, j) and 100 * len(x & y) >= 80 * len(x | y):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(x), None if i is None else root(i)) for i, x in s)


def test_jaccard_join_brute_force(spark):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    rows, i = [], 0
    passage = [r.choice(vocab) for _ in range(40)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(3, 150))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w).upper() if r.random() < 0.2 else "\t".join(w)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE  two"), (905, "one"), (906, rows[0][1]), (906, rows[0][1]), (None, "one two"), (907, passage[0] + " x" * 20_000)]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_join(frame(spark, rows)).collect())
    assert got == jaccard_brute(rows)


def test_jaccard_join_family_below_threshold(spark):
    """Copies of one text with so many words changed that most pairs are below the similarity."""
    r = random.Random(9)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(260):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 10**6)}" if r.random() < 0.7 else f"m{r.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_join(frame(spark, rows)).collect())
    assert got == jaccard_brute(rows)


def test_parity_bits_bound_the_difference():
    r = random.Random(4)
    for _ in range(50):
        x, y = (np.array([r.getrandbits(64) for _ in range(r.randint(0, 300))], np.uint64) for _ in range(2))
        bits = int(np.bitwise_count(J._parity(x).view(np.uint64) ^ J._parity(y).view(np.uint64)).sum())
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_jaccard_join_empty(spark):
    assert J.jaccard_join(frame(spark, [])).collect() == []
    assert [tuple(x) for x in J.jaccard_join(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_kneser_ney_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["the", "The", "of", "a", *[f"w{int(r.expovariate(0.05))}" for _ in range(3)]]) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(200, None), (201, "é É unseen"), (3, "again")]
    docs = frame(spark, rows)
    model = L.train(docs.where(~L.held_out(docs.doc_id)))
    got = Counter((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in L.perplexity(docs, model).collect())
    tok = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    b = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    ctx, cont = Counter(), Counter(w for _, w in b)
    for (u, _), k in b.items():
        ctx[u] += k
    d2, d1 = (L.discounts([sum(1 for k in x.values() if k == i) for i in (1, 2, 3, 4)]) for x in (b, cont))
    less = lambda k, d: max(k - d[min(k, 3) - 1], 0) if k else 0
    n, v, t2 = sum(c.values()), len(c), len(b)
    rest, lam = sum(d1[min(k, 3) - 1] for k in cont.values()) / t2, defaultdict(float)
    for (u, _), k in b.items():
        lam[u] += d2[min(k, 3) - 1] / ctx[u]

    def p(u, w):
        low = less(cont[w], d1) / t2 + rest / (v + 1)
        return (less(b[u, w], d2) / ctx[u] if ctx[u] else 0) + (lam[u] if u in lam else 1) * low

    assert sum(p("the", w) for w in c) + p("the", "@") == pytest.approx(1)
    want = Counter()
    for i, t in rows:
        w = tok(t)
        want[i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w)), 6)] += 1
    assert got == want
    assert (model.tokens, model.vocab) == (n, v)


def test_kneser_ney_of_order_three_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_PART", 700)  # several files
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["the", "of", "a", *[f"w{int(r.expovariate(0.1))}" for _ in range(3)]]) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(200, None), (201, "é unseen the of the"), (3, "again"), (204, "the of " * 900)]
    docs = frame(spark, rows)
    model = L.train(docs.where(~L.held_out(docs.doc_id)), order=3)
    got = Counter((x.doc_id, round(x.score, 6)) for x in L.perplexity(docs, model).collect())
    tok = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c3, c2 = (Counter(g for t in train for g in zip(*[t[j:] for j in range(n)])) for n in (3, 2))
    a2 = Counter((v, w) for _, v, w in c3) + Counter({g: k for g, k in c2.items() if g[0] == "<s>"})
    a1 = Counter(w for _, w in c2)
    d3, d2, d1 = (L.discounts([sum(1 for k in x.values() if k == i) for i in (1, 2, 3, 4)]) for x in (c3, a2, a1))
    less = lambda k, d: max(k - d[min(k, 3) - 1], 0) if k else 0
    rest = lambda counts, d: sum(d[min(k, 3) - 1] for k in counts)
    vocab, after2, after3 = len({w for t in train for w in t[1:]}), defaultdict(dict), defaultdict(dict)
    for (v, w), k in a2.items():
        after2[v][w] = k
    for (u, v, w), k in c3.items():
        after3[u, v][w] = k

    def p(context, w):
        low = (less(a1[w], d1) + rest(a1.values(), d1) / (vocab + 1)) / len(c2)
        for table, d in ((after2[context[-1]], d2), (after3[context] if len(context) == 2 else {}, d3)):
            if table:
                low = (less(table.get(w, 0), d) + rest(table.values(), d) * low) / sum(table.values())
        return low

    assert sum(p(("the", "of"), w) for w in [*a1, "@"]) == pytest.approx(1)
    assert got == Counter((i, round(sum(math.log10(p(tuple(tok(t)[max(0, j - 2) : j]), tok(t)[j])) for j in range(1, len(tok(t)))), 6)) for i, t in rows)
    assert max(c3.values()) > 255 and len(model.tfiles) > 1
    empty = L.train(frame(spark, []), order=3)
    assert L.perplexity(frame(spark, [(1, "a b")]), empty).first().score == 0.0
    ends = L.train(frame(spark, [(1, ""), (2, None)]), order=3)  # pairs, and no triple
    assert L.perplexity(frame(spark, [(1, "a b"), (2, "")]), ends).count() == 2


def test_scramble_is_a_bijection():
    for bits in (2, 8, 12):
        x = np.arange(1 << bits, dtype=np.uint64)
        y = L.scramble(x, bits)
        assert len(np.unique(y)) == len(x) and y.max() < len(x) and (L.unscramble(y, bits) == x).all()
    x = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (L.unscramble(L.scramble(x, 64), 64) == x).all()


@pytest.mark.parametrize("order", [2, 3])
def test_no_probability_is_zero(spark, order):
    """Counts of counts of which no discount comes, and contexts that were seen twice or more only."""
    docs = frame(spark, [(i, t) for i, t in enumerate(["a b c d e f g h"] * 3 + ["x y"] * 2 + ["q"])])
    model = L.train(docs, order=order)
    got = L.perplexity(frame(spark, [(1, "x z"), (2, "y a"), (3, "x a"), (None, "a b"), (4, "b z q h a")]), model).collect()
    assert len(got) == 5 and all(-100 < r.score < 0 for r in got)
    assert min(*L.discounts([1, 1, 9, 9]), *L.discounts([5, 1, 0, 0]), *L.discounts([3, 9, 1, 9]), *L.discounts([0, 0, 0, 0])) > 0


def test_kneser_ney_without_training(spark):
    model = L.train(frame(spark, []))
    row = L.perplexity(frame(spark, [(1, "a b")]), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</ul></nav>
<div class="sidebar">side</div>{}<div id="comments"><p>reader</p></div><footer>foot</footer></body>"""


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain  text", ["plain text"]),
    (PAGE.format("<article class='post no-sidebar'><h1>A &amp; B</h1><p>one<br>two <b>three<p>four</article>"), ["A & B", "one two three", "four"]),
    (PAGE.format("<p class=notice>n<p>1 < 2 &nbsp;x&#33;</p><form>f<input></form>"), ["1 < 2 x!"]),
    ("<main><p>m</p><aside>x</aside></main><p>out</p>", ["m"]),
    ("<p>a<style>p{}</style>b<!-- c > d --></p><p hidden>h</p>", ["a b"]),
])
def test_blocks(page, want):
    found = H.blocks(page)
    assert [t for (t, _, _), kept in zip(found, H.main_blocks(found)[0], strict=True) if kept] == want


def test_lcs_of_thousands_of_lines_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(3)
    a = r.permutation(12_000).astype(np.int64)
    b = a.copy()
    at = np.sort(r.choice(12_000, 3_000, replace=False))
    b[at] = -1 - np.arange(3_000)  # a quarter is of its own, so the rest is the longest
    tracemalloc.start()
    gone = H.lcs(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gone.sum() == 9_000 and not gone[at].any() and most < 60 << 20  # the whole table: 324 MB


def test_lcs_is_longest():
    r = random.Random(2)
    for _ in range(300):
        a, b = (np.array([r.randint(0, 5) for _ in range(r.randint(0, 12))]) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        gone = H.lcs(a, b)
        assert gone.sum() == d[-1, -1]
        it = iter(b.tolist())
        assert all(x in it for x in a[gone].tolist())


def test_nearest_pages_lose_shared_lines(spark):
    bar = "<p>Welcome to the site</p>"
    page = lambda k: f"<body>{bar}<p>" + f"story {k} " * 20 + f"</p><p>more of {k}</p></body>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(8)] + [(20, "http://o.example/a/1", f"<body>{bar}<p>alone</p></body>"), (21, None, None), (22, "http://h.example/a/3?x", page(3)), (23, "http://h.example/b", "<article>" + bar + "<p>own</p></article>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(pages).collect()}
    for i in range(8):
        want = ("story %d " % i * 20).strip() + f"\n\nmore of {i}"
        assert got[i] == (want, len(want))
    assert got[20][0] == "Welcome to the site\n\nalone" and got[21] == ("", 0) and got[22] == got[3] and got[23][0] == "Welcome to the site\n\nown"
    assert H.extract(pages.limit(0)).count() == 0


def test_short_articles_lose_a_long_shared_block(spark):
    terms = "".join(f"<p>{'terms of the site ' * 4}{k}</p>" for k in range(4))
    page = lambda k: f"<body>{terms}<p>" + f"story {k} " * 15 + "</p></body>"
    got = {r.page_id: r.text for r in H.extract(frame_of_pages(spark, [(k, f"http://h.example/{k}", page(k)) for k in range(6)])).collect()}
    assert got == {k: ("story %d " % k * 15).strip() for k in range(6)}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_runs_of_copies_lose_what_distinct_pages_share(spark, parts):
    bar = "<p>Welcome to the site</p>"
    page = lambda k, end="": f"<body>{bar}<p>" + f"story {k} " * 40 + f"</p>{end}</body>"
    rows = [(0, "http://h.example/a", page(0)), *[(i, f"http://h.example/b/{i}", page(1)) for i in range(1, 10)], *[(i, f"http://h.example/c/{i}", page(2, f"<p>on {i}</p>")) for i in range(10, 16)]]
    rows += [(i, f"http://o.example/{i}", page(3)) for i in range(20, 24)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in H.extract(frame_of_pages(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    story = lambda k: ("story %d " % k * 40).strip()
    want = {0: story(0), **{i: story(1) for i in range(1, 10)}, **{i: f"{story(2)}\n\non {i}" for i in range(10, 16)}}
    assert got == want | {i: "Welcome to the site\n\n" + story(3) for i in range(20, 24)}  # nothing but copies


def pages_brute(rows):
    """(text, lines shared) by id, of pages of ``<p>`` lines without containers, one host each."""

    def common(a, b):  # which of a's lines are in a longest common subsequence with b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    def copies(a, b):
        return sum(map(len, a)) - sum(len(x) for x in a if x in b) <= 0.1 * sum(map(len, a))

    pages = sorted((u.split("/")[2], "/" + u.split("/", 3)[3], i, h.replace("</p>", "").split("<p>")[1:]) for i, u, h in rows)
    out = {}
    for at, (host, path, i, lines) in enumerate(pages):
        near = []
        for step in (-1, 1):
            j, mine = at + step, lines
            while 0 <= j < len(pages) and pages[j][0] == host and copies(mine, pages[j][3]):
                mine, j = pages[j][3], j + step
            if 0 <= j < len(pages) and pages[j][0] == host:
                near.append(pages[j])
        near.sort(key=lambda x: -len(os.path.commonprefix([path, x[1]])))
        other = next((x[3] for x in near if not copies(lines, x[3])), [])
        left = [x for x in lines if x not in other]
        assert common(lines, other) == len(lines) - len(left)  # shared lines stand in one order here
        out[i] = ("\n\n".join(left), len(lines) - len(left))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_and_deletion_brute_force(spark, parts):
    r = random.Random(7)
    rows, i = [], 0
    for host in ("a.example", "b.example"):
        menus = [[f"{host} menu {k} {j}" for j in range(r.randint(1, 3))] for k in range(3)]
        for _ in range(25):
            body = [f"line {r.random()}" for _ in range(r.randint(3, 5))]
            page = [*r.choice(menus), *body, f"{host} foot"]
            for _ in range(r.choice([1, 1, 1, 3])):
                rows.append((i, f"http://{host}/{r.choice('xyz')}/{r.randint(0, 9)}/{i:03d}", "".join(f"<p>{x}</p>" for x in page)))
                i += 1
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x.page_id: (x.text, x.n_shared) for x in H.extract(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = pages_brute(rows)
    assert got == want and sum(n for _, n in want.values()) > 50


def test_differencing_takes_menus_before_the_rules(spark):
    page = lambda k: f"<nav><ul><li>home<li>shop</ul></nav><article><p>quoted by all</p><p>story {k}</p></article><div>foot</div><div>seen {k} times</div>"
    got = H.extract(frame_of_pages(spark, [(k, f"http://h.example/{k}", page(k)) for k in range(5)])).collect()
    assert {(x.page_id, x.text, x.n_shared, x.n_ruled) for x in got} == {(k, f"quoted by all\n\nstory {k}", 3, 1) for k in range(5)}


def frame_of_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_block_max_wand_brute_force(spark):
    r = random.Random(4)
    vocab = ["the", "of", "a", *[f"w{i}" for i in range(300)]]
    items = [(i, " ".join(r.choice(vocab[: 3 + 10 * (i % 30)]) for _ in range(r.randint(15, 50))) + ". So the answer is w%d" % i) for i in range(60)] + [(60, None), (61, "")]
    index = D.Index([i for i, _ in items], [t for _, t in items])
    found = 0
    for _ in range(300):
        words = [r.choice(vocab) for _ in range(60)]
        if r.random() < 0.5:
            words[10:40] = items[r.randrange(60)][1].split()[:30]
        h = D._words([" ".join(words)])[0]
        terms = sorted(set(index.lookup(h).tolist()) - {-1})
        score = np.zeros(len(items))
        for t in terms:
            a, b = index.start[t], index.start[t + 1]
            score[index.item[a:b]] += index.impact[a:b]
        for limit in (0.2, 0.5):
            got = index.search(terms, limit)
            assert set(got) == set(np.flatnonzero(score >= limit - 1e-9).tolist())
            assert all(abs(score[i] - s) < 1e-9 for i, s in got.items())
            found += len(got)
    assert found > 50
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = [(1, "x " * 500 + items[7][1].upper() + " y" * 300), (2, None), (3, ""), (4, "clean words only"), (None, items[9][1]), (6, " ".join(items[3][1].split()[:12]))]
    leaks = {(x.doc_id, x.item_id) for x in D.find_leaks(frame(spark, rows), D.build_index(bench)).collect()}
    assert leaks == {(1, 7), (None, 9)}
    kept = D.decontaminate(frame(spark, rows), D.build_index(bench))
    assert kept.columns == frame(spark, []).columns and {x.doc_id for x in kept.collect()} == {2, 3, 4, 6}
    assert D.find_leaks(frame(spark, rows), D.build_index(bench.limit(0))).count() == 0
    parts = D.build_index(bench, item_bytes=3000)
    assert len(parts) > 3 and sum(len(x.ids) for x in parts) == len(items)
    rows += [(10 + k, " ".join(items[k][1].split()[: 12 + k])) for k in range(0, 60, 3)]
    one, several = ({tuple(x) for x in D.find_leaks(frame(spark, rows), ix, threshold=0.3, overlap=0.2).collect()} for ix in (D.build_index(bench), parts))
    rounded = lambda found: {(*x[:2], *(round(v, 9) for v in x[2:])) for x in found}
    assert rounded(one) == rounded(several) and len(one) > 5
    assert {x.doc_id for x in D.decontaminate(frame(spark, rows), parts).collect()} == {x.doc_id for x in D.decontaminate(frame(spark, rows), D.build_index(bench)).collect()}
    named = D.build_index(spark.createDataFrame([("a-7", items[7][1]), (None, "z")], "item_id string, text string"))
    assert [(x.doc_id, x.item_id) for x in D.find_leaks(frame(spark, rows), named, item_type=StringType()).collect()] == [(1, "a-7")]


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(6)
    words = {"en": [f"w{i}" for i in range(500)], "de": [f"ö{i}x" for i in range(500)]}
    bad = {"en": ["idiot", "scum"], "de": ["loweia", "loweibe", "loweiz"]}
    rows, labels = [], []
    for i in range(1500):
        lang, toxic = ("en", "de")[i % 2], int(r.random() < 0.25)
        w = [r.choice(words[lang]) for _ in range(r.randint(20, 120))]
        for _ in range(3 * toxic):
            w[r.randrange(len(w))] = r.choice(bad[lang]) + r.choice(["", ",", "."])
        rows.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    rows += [(5000, None, None), (5001, "", "en"), (5002, "w1", "xx")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, flagged int")
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = X.fit(docs, known, ~X.held_out(F.col("id")), sample=600)
    got = {x.doc_id: x for x in X.toxicity(docs, model).collect()}
    held = [(got[i].score, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == len(rows)
    kept = X.screen(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not x.flagged for x in got.values())
    assert X.toxicity(docs.limit(0), model).count() == 0
    none = X.fit(docs.limit(0), known, F.lit(True))
    assert X.toxicity(docs, none).count() == len(rows)


def test_toxicity_forward_pass_brute_force():
    rng = np.random.default_rng(3)
    m = X.Model(rng.normal(size=(X.BUCKETS, X.DIM)).astype(np.float32), {w: rng.normal(size=(w * X.DIM, X.FILTERS)).astype(np.float32) for w in X.WIDTHS}, {w: rng.normal(size=X.FILTERS).astype(np.float32) for w in X.WIDTHS}, rng.normal(size=X.FILTERS * len(X.WIDTHS)).astype(np.float32), 0.3, (0.7, -0.2))
    m.emb[0] = 0
    texts = ["one two three four, five", "", None, "lonely", "a b " * 40]
    for _, ids, starts in X.features(texts):
        got = m.score(ids, starts)
        for i in range(len(starts) - 1):
            words = [sum(m.emb[b] for b in row) for row in ids[starts[i] : starts[i + 1]]]
            pooled = []
            for w in X.WIDTHS:
                k = m.conv[w].reshape(w, X.DIM, X.FILTERS)
                places = range(len(words) - X.PAD)
                for f in range(X.FILTERS):
                    pooled.append(max(0.0, max(sum(float(words[t + j] @ k[j][:, f]) for j in range(w)) for t in places) + float(m.bias[w][f])))
            z = (float(np.dot(pooled, m.out)) + m.out_bias) * m.scale[0] + m.scale[1]
            assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_of_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = [(i % 40, f"word{i % 40} " + ("scum " if i % 4 == 0 else "fine ") + f"x{i}", "en") for i in range(120)] + [(None, "scum", None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    schema = "doc_id long, text string, lang string"
    a, b = (X.fit(spark.createDataFrame(x, schema).repartition(n), labels, ~X.held_out(F.col("id"))) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert (a.emb == b.emb).all() and (a.out == b.out).all() and a.thresholds == b.thresholds
    got = X.toxicity(spark.createDataFrame(rows, schema), a).withColumn("held", X.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(r.held is not None for r in got)
    few = X.fit(spark.createDataFrame(rows, schema), labels, F.lit(True), sample_bytes=200)
    assert X.toxicity(spark.createDataFrame(rows, schema), few).count() == len(rows)
