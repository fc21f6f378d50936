"""Text as Spark expressions: aligned normalisation, spans of a pattern, tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A finding.  ``metadata`` maps names to text.
FINDING = "struct<start:int,end:int,category:string,detector:string,stage:string,confidence:double,value:string,metadata:map<string,string>>"
FINDINGS = f"array<{FINDING}>"

# Punctuation that keyboards insert, one character each.
QUOTES = "‘’‛ʼ′＇`´"
DOUBLE_QUOTES = "“”‟″＂"
DASHES = "–—―−"
SPACES = "   ⁠"


@lru_cache(1)
def aligned_table() -> tuple[str, str]:
    """From and to characters of the length-preserving fold: punctuation, then the
    compatibility form where it is one character, else the base of a decomposition
    where that is one."""
    table = {c: to for cs, to in ((QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-"), (SPACES, " ")) for c in cs}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if c in table:
            continue
        to = unicodedata.normalize("NFKC", c)
        if len(to) != 1:
            base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")]
            to = base[0] if len(base) == 1 else c
        if to != c and code < 0x10000 and ord(to) < 0x10000:
            table[c] = to
    return "".join(table), "".join(table.values())


def aligned(text: Column) -> Column:
    """One character for each character, so places in it are places in ``text``."""
    a, b = aligned_table()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, a, b)).when(text.contains("`"), F.translate(text, "`", "'")).otherwise(text)


def normalise(text: Column) -> Column:
    """The fold for comparing, which may change the length: separators become spaces."""
    t = F.regexp_replace(aligned(text), "…", "...")
    return F.trim(F.regexp_replace(t, r"(?U)[\s_/\\|]+", " "))


def quoted(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(text: Column | str) -> Column:
    return F.col(f"`{text}`") if isinstance(text, str) else text


# ---- where a match may start
_CLASS = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " \t\n\x0b\f\r", "CATEGORY_WORD": "".join(c for c in map(chr, range(128)) if c.isalnum() or c == "_")}


def _both(c: int, caseless: bool) -> set[str]:
    return {chr(c), *((chr(c).lower(), chr(c).upper()) if caseless and c < 128 else ())}


def _starts(parsed, caseless: bool) -> tuple[set[str], bool, bool]:
    """(characters that a match of a parsed pattern may start with, whether it may be empty, whether it
    begins with one character or class, which needs no help).  ValueError where that is unknown."""
    out: set[str] = set()
    plain = True
    for op, arg in parsed:
        kind, empty = str(op), False
        if kind in ("AT", "ASSERT", "ASSERT_NOT"):
            plain = False
            continue
        if kind == "LITERAL":
            more = _both(arg, caseless)
        elif kind == "IN":
            more = set()
            for what, x in arg:
                if str(what) == "LITERAL":
                    more |= _both(x, caseless)
                elif str(what) == "RANGE" and x[1] < 0x3000:
                    for c in range(x[0], x[1] + 1):
                        more |= _both(c, caseless)
                elif str(what) == "CATEGORY" and str(x) in _CLASS:
                    more |= set(_CLASS[str(x)])
                else:
                    raise ValueError
        elif kind == "BRANCH":
            each = [_starts(branch, caseless) for branch in arg[1]]
            more, empty, plain = set().union(*(x[0] for x in each)), any(x[1] for x in each), False
        elif kind == "SUBPATTERN":
            more, empty, inner = _starts(arg[3], bool((caseless or arg[1] & re.I) and not arg[2] & re.I))
            plain = plain and inner
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            more, empty, inner = _starts(arg[2], caseless)
            empty, plain = empty or arg[0] == 0, plain and inner
        else:
            raise ValueError
        out |= more
        if not empty:
            return out, False, plain
        plain = False
    return out, True, plain


@lru_cache(4096)
def headed(pattern: str) -> str:
    """The pattern behind a look at its first character: the same matches, but alternatives are only
    tried where one of them may begin.  Patterns that begin with a character or class, may be empty, or
    aren't understood (or differ between Java, which matches, and Python, which parses) stay as they are."""
    if re.search(r"&&|\\v|\(\?[a-zA-Z]*[ux]|\[[^\]]*(?<!\\)\[", pattern):
        return pattern
    try:
        tree = re._parser.parse(pattern)
        chars, empty, plain = _starts(tree, bool(tree.state.flags & re.I))
    except (ValueError, re.error, AttributeError, RecursionError):
        return pattern
    if empty or plain or not chars or len(chars) > 100:
        return pattern
    return f"(?=[{''.join(f'\\x{{{ord(c):x}}}' for c in sorted(chars))}])(?:{pattern})"


def _tree(words: tuple[str, ...], shortest: bool = True) -> str:
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    ends = "".join(h for h, rest in heads.items() if "" in rest and (shortest or len(rest) == 1))
    more = {h: tuple(x for x in rest if x) for h, rest in heads.items() if h not in ends}
    each = [f"{h}{rest[0] if len(rest) == 1 else _tree(rest, shortest)}" if "" not in heads[h] else f"{h}{_tree(rest, shortest)}?" for h, rest in more.items()]
    return f"(?:{'|'.join([*each, *([f'[{ends}]'] if ends else [])])})"


@lru_cache(256)
def beginnings(words: tuple[str, ...]) -> str:
    """A pattern of any of these words (letters, digits, spaces and hyphens) where a word begins, in either case.
    A tree of their letters, so that few are tried at a place; of words that begin alike the shortest counts."""
    return rf"(?i)\b{_tree(tuple(sorted(words)))}"


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern, groups left as they are."""
    out, depth, inside, at, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise ValueError("a group that was not opened")
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those of groups that are a whole one among them."""
    each = _split(pattern)
    if len(each) > 1:
        return [y for x in each for y in _alternatives(x)]
    if pattern.startswith("(?:") and pattern.endswith(")") and not pattern.endswith("\\)"):
        try:
            return _alternatives(pattern[3:-1])
        except ValueError:  # two groups in turn
            pass
    return each


@lru_cache(4096)
def treed(gate: str) -> str:
    """A gate that holds of the same texts, its plain words in a tree: of dozens of them few are tried at a
    place.  ``(?i)`` or what is before and after the words may stand around them."""
    m = re.fullmatch(r"((?:\(\?i\))?(?:\\s|\\b)?)(\(\?:.*\)|[^\\(].*?)((?:\\s|\\b)?)", gate, re.S)
    if not m or (m[1] not in ("", "(?i)") or m[3]) and len(_split(m[2])) > 1:
        return gate  # what stands around belongs to the first and the last of the alternatives
    each = _alternatives(m[2])
    plain = [x for x in each if re.fullmatch("[A-Za-z][A-Za-z ]*", x)]
    if len(plain) < 4:
        return gate
    # before a word's end the longer of two that begin alike may be the one that holds
    tree = _tree(tuple(sorted({x.lower() if "(?i)" in m[1] else x for x in plain})), not m[3])
    return f"{m[1]}(?:{'|'.join([tree, *(x for x in each if x not in plain)])}){m[3]}"


def spans_sql(name: str, pattern: str, group: int = 0, gate: str | None = None, test: str = "") -> str:
    """What :func:`spans` makes of a column, said in one SQL text: a policy asks for dozens, and
    each call from here to the JVM counts.  ``test``: what is asked before the gate, with its AND."""
    t, p, g = f"`{name}`", quoted(headed(pattern)), quoted(headed(treed(gate) if gate else pattern))
    a = "acc.at + length(x.gap)"
    s = f"{a} + length(x.before)" if group else a
    none = "CAST(array() AS array<struct<start:int,end:int,value:string,whole:string>>)"
    each = f"zip_with(slice(split({t}, {p}, -1), 1, size(m)), m, (g, w) -> named_struct('gap', g, 'whole', w, 'value', w))"
    if group:
        parts = f"zip_with(regexp_extract_all({t}, {p}, 1), regexp_extract_all({t}, {p}, 2), (b, v) -> named_struct('before', b, 'value', v))"
        each = f"zip_with({each}, {parts}, (x, y) -> named_struct('gap', x.gap, 'whole', x.whole, 'before', y.before, 'value', y.value))"
    step = f"(acc, x) -> named_struct('at', {a} + length(x.whole), 'out', concat(acc.out, array(named_struct('start', {s}, 'end', {s} + length(x.value), 'value', x.value, 'whole', x.whole))))"
    found = f"aggregate({each}, named_struct('at', 0, 'out', {none}), {step}, acc -> acc.out)"
    # the matches are made once, and only if there are any, their places
    # a gate of plain characters needs no pattern
    held = f"contains({t}, {g})" if gate and re.fullmatch("[@A-Za-z0-9 ]+", gate) else f"{t} RLIKE {g}"
    return f"CASE WHEN {test}{held} THEN transform(array(regexp_extract_all({t}, {p}, 0)), m -> CASE WHEN size(m) > 0 THEN {found} ELSE {none} END)[0] ELSE {none} END"


def spans(text: Column | str, pattern: str, group: int = 0, gate: str | None = None, test: str = "") -> Column:
    """array<struct<start,end,value,whole>> of every match, in code points.

    With ``group`` the pattern must read (before)(value)(after) from its start, all
    inside the match, and the span is that of the second group.  The parts
    between matches carry the place, in one fold.  ``text`` may be a column's name; only then is
    ``test`` asked.
    """
    if isinstance(text, str):
        return F.expr(spans_sql(text, pattern, group, gate, test))
    p = F.lit(headed(pattern))
    kind = "array<struct<start:int,end:int,value:string,whole:string>>"
    none = F.array().cast(kind)

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        s = a + F.length(x["before"]) if group else a
        hit = F.struct(s.alias("start"), (s + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["whole"].alias("whole"))
        return F.struct((a + F.length(x["whole"])).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    def placed(whole):
        before = F.regexp_extract_all(text, p, F.lit(1)) if group else whole
        value = F.regexp_extract_all(text, p, F.lit(2)) if group else whole
        gaps = F.slice(F.split(text, headed(pattern), -1), F.lit(1), F.size(whole))
        each = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), before.alias("before"), value.alias("value"))
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(whole) > 0, F.aggregate(each, first, step, lambda acc: acc["out"])).otherwise(none)

    return F.when(text.rlike(headed(gate or pattern)), let(F.regexp_extract_all(text, p, F.lit(0)), placed)).otherwise(none)


def finding(x: Column, category, detector: str, confidence, metadata: Column | None = None, stage: str = "deterministic", text: Column | None = None) -> Column:
    """The finding of a span; its value is the original text there."""
    value = F.substring(text, x["start"] + 1, x["end"] - x["start"]) if text is not None else x["value"]
    lit = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), lit(category, "string").alias("category"), F.lit(detector).alias("detector"),
        F.lit(stage).alias("stage"), lit(confidence, "double").alias("confidence"), value.alias("value"), meta.cast("map<string,string>").alias("metadata"),
    ).cast(FINDING)


def meta(**pairs: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


TOKEN = r"[A-Za-z0-9][A-Za-z0-9'’&.\-]*"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_values(text: Column) -> Column:
    """The tokens, trailing ``. - & '`` trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _trimmed)


def _trimmed(v: Column) -> Column:
    return F.rtrim(v, F.lit(".-&'’"))


def token_place(text: Column):
    """index -> (start of the token, end of it), each in one pass over what is before it:
    for the few tokens that matter out of many."""
    whole = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)

    def start(i):
        return F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(whole, F.lit(1), i), ""))

    return start, lambda i: start(i) + F.length(_trimmed(F.get(whole, i)))


def token_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each computed once a row.

    A projection is merged into those above it, and one that they name several times, or within a
    lambda, is then computed as often; plans grow with every merge.  What a generator makes stays
    where it is, and filters on it stay above: here one row for each, by ``inline_outer`` of one
    element (of the inner one the optimiser infers a filter, which computes it once more).
    Shuffles nothing, runs in streams too.  A column of the same name is replaced.
    """
    gone = {c.lower() for c in columns}
    made = F.inline_outer(F.array(F.struct(*[v.alias(c) for c, v in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone], made)


def total_overlap(found: Column) -> Column:
    """Characters that spans (``start``, ``end``) take together."""
    return F.aggregate(found, F.lit(0), lambda acc, x: acc + (x["end"] - x["start"]))


# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
FOLDED = "struct<text:string,source:array<int>>"


HANGUL = "[\uac00-\ud7a3]"  # syllables: taken apart by arithmetic, 11,172 of them
JAMO = tuple("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def fold_char(c: str) -> str:
    """A character's letters and digits, decomposed, without marks and case."""
    return "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.category(x).startswith("M") and x.isalnum())


def char_class(codes: list[tuple[int, int]], wide: int = 8) -> str:
    """A class of ranges.  Java tries the ranges of a class in turn, so they are put into blocks of blocks, each
    behind its own range: a character is compared with some dozens of the hundreds."""
    each = [(a, z, f"\\x{{{a:x}}}-\\x{{{z:x}}}") for a, z in codes]
    while len(each) > wide:
        blocks = [each[i : i + wide] for i in range(0, len(each), wide)]
        each = [(x[0][0], x[-1][1], f"[\\x{{{x[0][0]:x}}}-\\x{{{x[-1][1]:x}}}&&[{''.join(y[2] for y in x)}]]") for x in blocks]
    return f"[{''.join(x[2] for x in each)}]"


@lru_cache(1)
def fold_tables() -> tuple[str, str, dict[str, str], str]:
    """(from, to, expansions, pattern of those that go) of :func:`fold_char` beyond ASCII.  Hangul
    syllables and what stays as it is are left out."""
    one, more, gone = [], {}, []
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x40000)):  # beyond: no letters
        c = chr(code)
        to = fold_char(c)
        if len(to) > 1:
            more[c] = to
        elif not to:
            if gone and gone[-1][1] == code - 1:
                gone[-1][1] = code
            else:
                gone.append([code, code])
        elif to != c:
            one.append((c, to))
    return "".join(c for c, _ in one), "".join(to for _, to in one), more, char_class([*gone, (0x40000, 0x10FFFF)])


def fold(text: Column, leet: bool = True) -> Column:
    """struct(text, source): letters and digits only, without marks and case, and for each the
    place in the text that it came from.

    All expressions, over the whole text where every character becomes one or none: what goes is blanked, so that
    places stay, and the rest translated.  Only a text with a character that becomes several (``ß``,
    looked up) or a Hangul syllable (taken apart by arithmetic) is made of a piece a character.
    A null text has both null.
    """
    a, b, more, gone = fold_tables()
    capitals = "".join(map(chr, range(65, 91)))
    wide = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in more.items())), F.lit("\u0001"), F.lit("\u0002"))
    several = char_class([(ord(c), ord(c)) for c in sorted(more)])
    marks = f"[\\x00-/:-@\\[-`{{-\\x7f{gone}]"
    if leet:
        text = F.translate(text, "".join(LEET), "".join(LEET.values()))
    made = lambda folded, source: F.struct(folded.alias("text"), source.alias("source"))
    places = lambda chars, keep: F.array_remove(F.transform(chars, lambda c, i: F.when(keep(c), i).otherwise(-1)), -1)

    def syllable(c: Column) -> Column:
        s = F.ascii(c) - 0xAC00
        at = (F.floor(s / 588), F.floor(s % 588 / 28), s % 28 - 1)
        return F.concat(*[F.when(i >= 0, F.substring(F.lit(j), i.cast("int") + 1, F.lit(1))).otherwise("") for i, j in zip(at, JAMO, strict=True)])

    def piece(c: Column) -> Column:  # of a blanked text, as beyond
        return F.when(c == " ", "").when(c < "\x80", F.lower(c)).when(c.between("\uac00", "\ud7a3"), syllable(c)).when(c.rlike(several), F.element_at(wide, c)).otherwise(F.translate(c, a, b))

    def pieced(ps: Column) -> Column:
        return made(F.array_join(ps, ""), F.flatten(F.transform(ps, lambda p, i: F.array_repeat(i, F.length(p)))))

    def plain(t: Column) -> Column:
        return made(F.regexp_replace(t, "[^a-z0-9]+", ""), places(F.split(t, ""), lambda c: c.between("a", "z") | c.between("0", "9")))

    def blanked(t: Column) -> Column:
        one = made(F.translate(F.replace(t, F.lit(" "), F.lit("")), capitals + a, capitals.lower() + b), places(F.split(t, ""), lambda c: c != " "))
        return F.when(t.rlike(f"[{HANGUL}{several}]"), let(F.transform(F.split(t, ""), piece), pieced)).otherwise(one)

    none = made(F.lit(None).cast("string"), F.lit(None).cast("array<int>"))
    other = let(F.regexp_replace(text, marks, " "), blanked)
    return F.when(text.isNull(), none).when(text.rlike(r"[^\x00-\x7f]"), other).otherwise(let(F.lower(text), plain))


def fold_needle(needle: str, leet: bool = True) -> str:
    """What :func:`fold` makes of a text, on the driver."""
    return "".join(fold_char(LEET.get(c, c) if leet else c) for c in needle)


def folded_span(folded: Column, needle: str, leet: bool = True) -> Column:
    """struct(start, end) in the text of the first place where its :func:`fold` has the needle's; null
    where it has not, and for a needle without letters and digits."""
    want = fold_needle(needle, leet)
    at = F.instr(folded["text"], want) - 1
    return F.when(F.lit(want != "") & (at >= 0), original_span(folded, at, at + len(want)))


def folded_contains(folded: Column, needle: str, leet: bool = True) -> Column:
    """Whether the text holds the needle, both folded."""
    return F.lit(fold_needle(needle, leet) != "") & folded["text"].contains(fold_needle(needle, leet))


def original_span(folded: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the text of a span of its :func:`fold`."""
    part = F.slice(folded["source"], start + 1, end - start)
    whole = (start < end) & (F.size(folded["source"]) > 0)
    return F.struct(F.when(whole, F.array_min(part)).otherwise(start).alias("start"), F.when(whole, F.array_max(part) + 1).otherwise(end).alias("end"))
