"""The lexicon's look-up in the workers, against a plain one."""

import random
import re

from pyspark.sql import functions as F

from maskwright.operators.lexicon import Lexicon, Term, by_dictionary, key_of, less


def test_a_word_is_looked_up_once(spark, monkeypatch):
    """Against a plain scan of every gram; and the nearest term of a repeated word is sought once."""
    lex = Lexicon((Term("time sheet"), Term("night roster board"), Term("Karrabee", aliases=("kb-one",)), Term("board")), 1)
    rng = random.Random(4)
    words = ["time", "sheet", "timesheet", "night", "roster", "board", "karrabee", "karabee", "boards", "kb-one", "--", "tim", "esheet", "x."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r["i"]: [(f["start"], f["end"], f["metadata"]["canonical"]) for f in r["f"]] for r in df.select("i", by_dictionary(F.col("t"), lex).alias("f")).collect()}
    exact, fuzzy = lex.exact(), lex.fuzzy()
    for i, s in enumerate(texts):
        toks = [(m.start(), m.start() + len(re.sub(r"[.\-&'’]+$", "", m[0]))) for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9'’&.\-]*", s)]
        keys, taken, want = [key_of(s[a:b]) for a, b in toks], set(), []
        for n in range(lex.longest, 0, -1):
            for at in range(len(toks) - n + 1):
                at_all = set(range(at, at + n))
                t = exact.get("".join(keys[at : at + n])) if not at_all & taken else None
                if t is None and n == 1 and not at_all & taken and len(keys[at]) >= 6:
                    near = [(gone, -len(key_of(lex.terms[fuzzy[v]].term)), fuzzy[v]) for v, gone in less(keys[at], 1).items() if v in fuzzy]
                    t = min(near)[2] if near else None
                if t is not None:
                    taken |= at_all
                    want.append((toks[at][0], toks[at + n - 1][1], lex.terms[t].term))
        assert got[i] == want, s
    import maskwright.operators.lexicon as module

    asked = []
    monkeypatch.setattr(module, "less", lambda k, most=1: asked.append(k) or less(k, most))
    import pandas as pd

    module.looker(lex)(pd.Series(["karabee karabee", "karabee"]))
    assert asked.count("karabee") == 1


def test_only_words_that_may_be_near_are_tried(monkeypatch):
    """A word neither of whose halves a form has is told from all forms without its deletions; no near one is lost."""
    import pandas as pd

    import maskwright.operators.lexicon as module

    lex = Lexicon.load()
    asked = []
    monkeypatch.setattr(module, "less", lambda k, most=1: asked.append(k) or less(k, most))
    looked = module.looker(lex)
    asked.clear()
    assert list(looked(pd.Series(["zzqxjvwq xqzjvkwy 77310442 zzqxjvwq"]))) == [[]] and asked == []
    fuzzy, rng = lex.fuzzy(), random.Random(11)
    heads, tails = module.halves(fuzzy)
    forms = sorted({key_of(f) for t in lex.terms for f in t.forms if " " not in f and not t.exact_only})
    n = 0
    for _ in range(20000):
        k = rng.choice(forms)
        for _ in range(rng.randint(0, 2)):  # letters dropped, changed, added
            i = rng.randrange(len(k) + 1)
            k = k[:i] + rng.choice(["", "x", "e", k[i : i + 1] + "s"]) + k[i + 1 :]
        if len(k) >= 6 and any(v in fuzzy for v in less(k, 1)):
            n += 1
            assert module.may_be_near(k, heads, tails), k
    assert n > 2000
