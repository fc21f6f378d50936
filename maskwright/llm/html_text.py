"""Main text of web pages: nearest-URL page differencing, then markup rules for the rest."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LISTS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}
#: Elements, and words of class, id or role, that are not of an article.
OTHER = frozenset("aside button dialog footer form head header menu nav".split())
WORDS = frozenset(
    "ad ads adslot advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog discussion disclaimer disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion reactions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NEGATED = frozenset(("no", "with", "has", "without", "open"))
CHUNK = 1 << 22  # characters after which parsed pages are handed on
LEFT = 0.1  # a page of which at most this share of the main characters is left is a copy


def _other(tag: str, attrs: str) -> bool:
    if tag in OTHER:
        return True
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = re.split(r"[^a-z0-9]+", one)
                if not NEGATED.intersection(parts) and WORDS.intersection(parts):
                    return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, kept, container) of every block in page order.

    ``kept`` is False in elements that are not of an article; ``container`` is 2 inside
    ``article``, 1 inside ``main``, else 0.  A ``br`` is white space.  Scripts, styles
    and the like have no blocks.
    """
    page = page or ""
    stack: list[tuple[str, bool, int]] = []
    out: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    other, inside, at, low = False, 0, 0, None

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, not other, inside))

    def pop(i):
        nonlocal other, inside
        del stack[i:]
        other, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if tag not in ("svg", "math") or not m[3].endswith("/"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{tag}", at) if len(low) == n else -1
                if len(low) != n:  # lower-casing changed the length: look as it stands
                    found = re.compile(f"</{tag}", re.I).search(page, at)
                    end = found.start() if found else -1
                stop = page.find(">", end) if end >= 0 else -1
                at = stop + 1 if stop >= 0 else n
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in VOID:
            continue
        if block:  # end tags that may be left out
            ends, stops = ({"p"}, BLOCK) if tag not in LISTS else ({tag, "p"} | ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th", "tr") else set()), LISTS[tag])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    if tag not in LISTS:
                        break
                elif stack[i][0] in stops:
                    break
        if m[3].endswith("/") and not block:
            continue
        other = other or _other(tag, m[3])
        inside = max(inside, 2 if tag == "article" else 1 if tag == "main" else 0)
        stack.append((tag, other, inside))
    flush()
    return out


def main_blocks(found: list[tuple[str, bool, int]]) -> tuple[list[bool], list[bool]]:
    """(kept, protected) for every block: kept those of ``article`` if it has any, else of
    ``main``, else all; protected those of either container."""
    best = max((c for _, kept, c in found if kept), default=0)
    kept = [k and c >= best for _, k, c in found]
    return kept, [k and c > 0 for k, (_, _, c) in zip(kept, found, strict=True)]


def lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence with b."""
    gone = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        gone[lo] = True
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
        gone[x] = True
    both = np.intersect1d(a[lo:x], b[lo:y])  # lines of one page only are in no subsequence
    ia, ib = lo + np.flatnonzero(np.isin(a[lo:x], both)), lo + np.flatnonzero(np.isin(b[lo:y], both))
    p, q = a[ia], b[ib]
    if not len(p) or not len(q):
        return gone

    def after(row: np.ndarray, line) -> np.ndarray:
        out = np.zeros_like(row)
        out[1:] = np.maximum.accumulate(np.maximum(np.where(q == line, row[:-1] + 1, row[1:]), row[1:]))
        return out

    # every so many rows of the table are kept, and those between made again on the way back:
    # the memory of two pages with tens of thousands of lines in common is some tens of MB
    every = max(64, math.isqrt(len(p)))
    row = np.zeros(len(q) + 1, np.int32)
    marks = [row]
    for i in range(len(p)):
        row = after(row, p[i])
        if (i + 1) % every == 0:
            marks.append(row)
    i, j = len(p), len(q)
    for start in range((len(p) - 1) // every * every, -1, -every):
        block = [marks[start // every]]
        for line in p[start : start + every]:
            block.append(after(block[-1], line))
        while i > start and j:
            here, above = block[i - start], block[i - 1 - start]
            if p[i - 1] == q[j - 1] and here[j] == above[j - 1] + 1:
                gone[ia[i - 1]] = True
                i, j = i - 1, j - 1
            elif above[j] >= here[j - 1]:
                i -= 1
            else:
                j -= 1
    return gone


def _line_hashes(texts: list[str]) -> bytes:
    import hashlib

    return b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _left(page: tuple, gone: np.ndarray) -> bool:
    """Whether more is left of the page's main lines than a copy of the other page has."""
    size = page[3][page[4]]
    return size[~gone].sum() > LEFT * size.sum()


def is_copy(page: tuple, other: tuple | None) -> bool:
    """Whether the page has all or nearly all of its main lines from a page of its host."""
    if other is None or page[0] != other[0]:
        return False
    own = page[2][page[4]]
    if _left(page, np.isin(own, other[2])):  # the subsequence has no more than these
        return False
    return not _left(page, lcs(own, other[2]))


def shared_lines(page: tuple, neighbours: list[tuple | None]) -> list[int]:
    """Numbers of the page's lines that its nearest neighbour has too, without protected ones.

    page and neighbours: (host, path, hashes of all lines, their characters, which are main
    lines, which are protected).  The nearest is the one of the same host with the longest
    common path; one that leaves nearly nothing of the page's main lines is a copy of it, of
    which nothing can be learnt, and the next is taken.  How much is shared does not
    matter as long as something is left.
    """
    host, path, every, _, main, safe = page
    near = sorted((x for x in neighbours if x is not None and x[0] == host), key=lambda x: -_common(path, x[1]))
    for x in near:
        gone = lcs(every, x[2])
        if _left(page, gone[main]):
            return np.flatnonzero(gone & ~safe).tolist()
    return []


def neighbours_of(pages: Iterator[tuple], before: tuple | None, outer: tuple | None, after: tuple | None, beyond: tuple | None) -> Iterator[tuple]:
    """(key, page, [nearest page before, nearest after]) of (key, page) in order, over runs
    of copies in both directions: the neighbour of a copy of the page beside it is the
    neighbour of that page.

    before and outer: the page before the first and that page's own neighbour before;
    after and beyond: the same behind the last.  Pages wait while they are copies of
    the page behind them.
    """
    waiting: list[tuple] = []
    last, link = before, outer
    for key, page in pages:
        link = link if is_copy(page, last) else last
        if waiting and not is_copy(waiting[-1][1], page):
            yield from ((k, x, [b, page]) for k, x, b in waiting)
            waiting = []
        waiting.append((key, page, link))
        last = page
    if waiting:
        end = beyond if is_copy(waiting[-1][1], after) else after
        yield from ((k, x, [b, end]) for k, x, b in waiting)


def beside(edges: dict[int, dict[int, tuple]]) -> dict[int, tuple]:
    """(before, outer, after, beyond) for each partition, see :func:`neighbours_of`.

    edges: partition -> {0: first page, 1: last page, 2: the nearest page before the last
    and 3: behind the first that the partition itself has for them}.
    """
    parts = sorted(edges)
    sides: list[list[tuple]] = []
    for order, near, far, inner in ((parts, 0, 1, 2), (parts[::-1], 1, 0, 3)):
        got, page, link = [], None, None
        for p in order:
            got.append((page, link))
            e = edges[p]
            link = e[inner] if inner in e else link if is_copy(e[near], page) else page
            page = e[far]
        sides.append(got)
    return {p: (*x, *y) for p, x, y in zip(parts, sides[0], sides[1][::-1], strict=True)}


SMALL = 200_000  # pages with deleted lines up to which their list is broadcast


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    1. Each page is parsed once into blocks (:func:`blocks`), which are written with what
       the markup says of them.
    2. Pages are paired by URL path within each host: sorted by (host, path), each with
       the nearer of the pages before and after it, past any run of copies of it
       (:func:`neighbours_of`).  Their lines, menus and all, are aligned by longest common
       subsequence, and what both have is deleted, but for lines inside an explicit
       ``article`` or ``main``: those are content even where two pages share them
       (quoted passages, licence lines).
    3. Of the lines that are left, which no neighbour gave away, the markup rules
       (:func:`main_blocks`) drop those outside the article.

    Only line hashes are sorted and sent; a host that has a third of all pages is
    spread over tasks by path.  The first and last page of each sorted partition and
    their neighbours in it (four rows of hashes at most) go through the driver, so the
    pairs don't depend on how the pages are dealt.  Deleted lines join back to the blocks:
    broadcast up to SMALL pages with any, else by a shuffle.

    Returns ``id_col, url_col, text, n_chars, n_shared, n_ruled`` per row, the last two being
    the lines that steps 2 and 3 took.  Null html is empty: text "".  A null or relative
    URL has host "".  Rows that repeat an id: each is parsed; lines are deleted in all rows
    with the same id, URL and html.  Other columns are not read.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(url_col, html_col).alias("tag"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), F.lit(""))
    kind = src.schema["id"].dataType

    def lines(batches):
        def rows(batch, cols):
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.list_(pa.bool_())), *[pa.array(x, pa.binary()) for x in cols[2:]]], names=names)

        for batch in batches:
            cols, at, size = [[] for _ in range(6)], 0, 0
            for i, page in enumerate(batch.column(5)):
                found = blocks(page.as_py())
                texts = [t for t, _, _ in found]
                kept, safe = main_blocks(found)
                for c, x in zip(cols, (texts, kept, _line_hashes(texts), np.array([*map(len, texts)], np.int32).tobytes(), bytes(kept), bytes(safe)), strict=True):
                    c.append(x)
                size += sum(map(len, texts))
                if size > CHUNK or i + 1 == len(batch):
                    yield rows(batch.slice(at, i + 1 - at), cols)
                    cols, at, size = [[] for _ in range(6)], i + 1, 0

    names = ["id", "url", "tag", "host", "path", "texts", "kept", "every", "size", "main", "safe"]
    kinds = [kind, T.StringType(), T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.StringType()), T.ArrayType(T.BooleanType()), *[T.BinaryType()] * 4]
    parsed = table(src.select("id", "url", "tag", host.alias("host"), path.alias("path"), "html").mapInArrow(lines, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])))
    slim = ("id", "tag", "host", "path", "every", "size", "main", "safe")
    ordered = cut(parsed.select(*slim).repartitionByRange("host", "path", "id", "tag").sortWithinPartitions("host", "path", "id", "tag"))

    def of_row(v):
        return (v[0], v[1], np.frombuffer(v[2], np.uint64), np.frombuffer(v[3], np.int32), np.frombuffer(v[4], np.uint8).astype(bool), np.frombuffer(v[5], np.uint8).astype(bool))

    def facts(batch, i):
        return of_row([batch.column(c)[i].as_py() for c in range(2, 8)])

    def ends(batches):
        rows: dict[int, pa.RecordBatch] = {}
        first = last = link = None  # link: the row of the last page's neighbour before
        run = False  # all pages so far are copies of the page behind them
        for batch in batches:
            for i in range(len(batch)):
                page, row = facts(batch, i), batch.slice(i, 1)
                if first is None:
                    first, run, rows[0] = page, True, row
                else:
                    link = link if is_copy(page, last) else rows[1]
                    if run and not is_copy(last, page):
                        run, rows[3] = False, row
                last, rows[1] = page, row
        if first is not None:
            if link is not None:
                rows[2] = link
            p = TaskContext.get().partitionId()
            t = pa.Table.from_batches(list(rows.values()))
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int32()), pa.array(list(rows), pa.int32()), *[t.column(c).combine_chunks() for c in range(2, 8)]], names=["part", "place", *slim[2:]])

    found_ends: dict[int, dict[int, tuple]] = {}
    for r in ordered.mapInArrow(ends, "part int, place int, host string, path string, every binary, size binary, main binary, safe binary").collect():
        found_ends.setdefault(r[0], {})[r[1]] = of_row([bytes(x) if isinstance(x, bytearray) else x for x in tuple(r)[2:]])
    edges = pages.sparkSession.sparkContext.broadcast(beside(found_ends))

    def differ(batches):
        def each():
            for batch in batches:
                for i in range(len(batch)):
                    yield (batch.column(0)[i], batch.column(1)[i]), facts(batch, i)

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([k[0].as_py() for k, _ in found], found[0][0][0].type), pa.array([k[1].as_py() for k, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int32()))], names=["id", "tag", "gone"])

        found = []
        for key, page, near in neighbours_of(each(), *edges.value.get(TaskContext.get().partitionId(), (None,) * 4)):
            if gone := shared_lines(page, near):
                found.append((key, gone))
            if len(found) == 10_000:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    gone = cut(ordered.mapInArrow(differ, T.StructType([T.StructField("id", kind), T.StructField("tag", T.LongType()), T.StructField("gone", T.ArrayType(T.IntegerType()))])).dropDuplicates(["id", "tag"]))
    few = gone.count() <= SMALL
    g = gone.toDF("gid", "gtag", "gone")
    joined = parsed.select("id", "url", "tag", "texts", "kept").join(F.broadcast(g) if few else g, F.col("id").eqNullSafe(F.col("gid")) & F.col("tag").eqNullSafe(F.col("gtag")), "left")
    lost = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.filter("texts", lambda x, i: F.get("kept", i) & ~F.array_contains(lost, i))
    text = F.array_join(left, "\n\n")
    out = joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.size(lost).cast("long").alias("n_shared"), (F.size("texts") - F.size(lost) - F.size(left)).cast("long").alias("n_ruled"))
    return out.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_ruled")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over every row of ``pages``, and what differencing and rules took; null and
    empty pages have an empty text, and repeated rows give a row each."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
