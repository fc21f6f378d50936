"""Suffix dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import suffix_dedup as sd

ROW = "doc_id long, text string, start string, b string"


def brute(rows, size):
    """{(id, text): (spans, kept)} by counting every window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + size] for _, b in data for s in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s + 1 : s + 1 + size] = True
        edge = np.diff(gone.astype(np.int8))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((str(i), len(b), spans, bytes(b[k] for k in range(len(b)) if not gone[k + 1])))
    return sorted(out)


def got(df, size, gram):
    return sorted((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in sd.suffix_dedup(df, size=size, gram=gram).collect())


def corpus(seed=0):
    g = np.random.default_rng(seed)
    word = lambda: "".join(g.choice(list("abcdeé"), int(g.integers(1, 5))))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12) for _ in range(4)]
    rows = [(i, text(int(g.integers(3, 15))) + " " + shared[int(g.integers(4))] + " " + text(int(g.integers(0, 9)))) for i in range(60)]
    family = text(60).split()  # near copies: a word here and there differs
    for i in range(100, 160):
        mine = list(family)
        for k in g.integers(0, len(mine), 3):
            mine[k] = word()
        rows.append((i, " ".join(mine)))
    rows += [(200 + i, "x" * n) for i, n in enumerate((11, 12, 13, 40))]  # repeats within one text
    rows += [(300, "one two three four " * 9), (301, rows[3][1]), (302, rows[3][1]), (303, None), (304, ""), (305, "short"), (306, text(2000))]
    return rows + [(400, rows[5][1]), (400, rows[6][1]), (401, rows[7][1]), (401, rows[7][1]), (None, rows[8][1]), (None, "of its own, and long enough to matter")]


@pytest.mark.parametrize("small", ["", "blocks", "hot"])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(sd, "CHUNK", 300)
        monkeypatch.setattr(sd, "BLOCK", 10)
    if small == "hot":
        monkeypatch.setattr(sd, "MANY", 3)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], ROW).repartition(3)
    assert got(df, 12, 4) == brute(rows, 12)


def test_suffix_dedup_at_full_size(spark):
    g = np.random.default_rng(4)
    rows = [(i, "".join(chr(int(c)) for c in g.integers(97, 123, 3000))) for i in range(6)]
    rows += [(10, rows[0][1][500:700] + "!" + rows[1][1][100:299]), (11, rows[2][1][7:1500] + "?" + rows[2][1][1501:])]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], ROW)
    assert got(df, sd.SIZE, sd.GRAM) == brute(rows, sd.SIZE)


def test_suffix_dedup_of_nothing(spark):
    df = spark.createDataFrame([], ROW)
    assert sd.suffix_dedup(df).count() == 0


def test_merge_sort_orders_and_verifies(monkeypatch):
    g = np.random.default_rng(6)
    parts = [bytes(g.integers(97, 99, int(n)).astype(np.uint8)) for n in g.integers(0, 20, 700)]
    chars, size = sd._matrix(parts, 20)
    order, agree = sd.sorted_suffixes(chars, size)
    assert [parts[i] for i in order] == sorted(parts)
    for i in range(1, len(order)):
        a, b = parts[order[i - 1]], parts[order[i]]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert n == agree[i]
    # hashes that always collide: verified by bytes, and made without them at last
    monkeypatch.setattr(sd, "prefix_hashes", lambda c, seed: np.zeros((c.shape[0], c.shape[1] + 1), np.uint64))
    again, same = sd.sorted_suffixes(chars, size)
    assert [parts[i] for i in again] == sorted(parts) and same.tolist() == agree.tolist()


def test_owner_is_a_matter_of_the_window_alone():
    g = np.random.default_rng(8)
    window = g.integers(97, 99, 40).astype(np.uint8)
    at = []
    for n in (0, 5, 17):
        raw = np.concatenate([g.integers(97, 99, n).astype(np.uint8), window, g.integers(97, 99, 9).astype(np.uint8)])
        at.append(int(sd.owners(raw, 40, 4)[0][n]) - n)
    assert len(set(at)) == 1


def test_digest_is_of_the_bytes():
    assert sd.digests([b"a"]).tobytes() == hashlib.blake2b(b"a", digest_size=16).digest()
