"""Words of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but letters, digits and bytes of characters beyond ASCII end a word.
_MARKS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(raw: np.ndarray, gap: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of one buffer; with ``prefixes`` a column each for
    the first so many bytes, 0 where the word has no more."""
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    at, back = total[start], down[start]
    h = mix((total[end] - at) * back + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if not prefixes:
        return h, start
    out = np.empty((len(h), 1 + len(prefixes)), np.uint64)
    out[:, 0] = h
    for i, k in enumerate(prefixes, 1):
        p = mix((total[np.minimum(start + k, end)] - at) * back + np.uint64(k))
        out[:, i] = np.where(end - start > k, p, np.uint64(0))
    return out, start


def word_hashes(texts: Iterable[str | None], marks: bool = False, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first, count, hashes, ends)`` of consecutive texts, A-Z lower-cased.

    ``ends[i]`` is the number of hashes up to the end of text ``first + i``.  Words end
    at white space (0x20, 0x09-0x0D), or with ``marks`` at any ASCII character that is
    no letter or digit.  Texts are taken in blocks of about CHUNK bytes; a longer text
    is hashed in parts that are cut between words, so memory stays bounded.
    """
    gap_of = _MARKS if marks else _SPACE
    held: list[bytes] = []
    size, first = 0, 0

    def flush():
        raw = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in held])
        out, firsts, at = [], [], 0
        while at < len(raw):
            to = min(len(raw), at + 4 * CHUNK)
            if to < len(raw):
                gaps = np.flatnonzero(gap_of[raw[at:to]])
                to = at + int(gaps[-1]) + 1 if len(gaps) else at + len(raw[at:]) if not gap_of[raw[to:]].any() else to + int(np.argmax(gap_of[raw[to:]])) + 1
            part = raw[at:to]
            h, s = _hash(part, gap_of[part], prefixes)
            out.append(h)
            firsts.append(s + at)
            at = to
        starts = np.concatenate(firsts)
        return first, len(held), np.concatenate(out), np.searchsorted(starts, ends)

    for text in texts:
        b = (text or "").encode().lower()
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            yield flush()
            first, held, size = first + len(held), [], 0
    if held:
        yield flush()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; with fewer words (but some) of the whole run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _BASE + words[j : j + n]
    return mix(h)
