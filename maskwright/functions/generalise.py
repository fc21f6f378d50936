"""Values widened to bands.  A value that is a band already stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The bands.
AGE_BANDS = ((0, 17, "under 18"), (18, 24, "18-24"), (25, 34, "25-34"), (35, 44, "35-44"), (45, 54, "45-54"), (55, 64, "55-64"), (65, 74, "65-74"), (75, 120, "75+"))
TENURE_BANDS = ((2, "under 2 years"), (5, "2-4 years"), (10, "5-9 years"), (20, "10-19 years"), (30, "20-29 years"), (40, "30-39 years"))
TENURE_TOP = "40+ years"
TEAM_BANDS = ((1, "1 person"), (5, "2-5 people"), (10, "6-10 people"), (20, "11-20 people"), (50, "21-50 people"))
TEAM_TOP = "50+ people"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
TENS = {"thirty": 30, "forty": 40, "fifty": 50}
NUMBER = r"-?\d+(?:\.\d+)?"
BAND = r"^(?:under\s+\d+|\d+\+|\d+\s*-\s*\d+|\d+\+?\s+years?|\d+\+?\s+people?)$"
UNIT = r"(?i)^\s*\+?\s*(?:years?|yrs?|months?|people|staff|workers|employees|members)\b"

WORDS = {w: i for i, w in enumerate(NUMBER_WORDS, 1)} | TENS
WORD = rf"(?i)\b({'|'.join(WORDS)})\b"


def is_banded(v: Column) -> Column:
    t = F.trim(v)
    return F.split(F.split(t, ",", 2)[0], " ", 2)[0].rlike(BAND)


def parse_number(v: Column) -> Column:
    word = F.lower(F.regexp_extract(v, WORD, 1))
    table = F.create_map(*[F.lit(x) for k, n in WORDS.items() for x in (k, float(n))])
    return F.when(v.rlike(NUMBER), F.regexp_extract(v, NUMBER, 0).cast("double")).when(word != "", F.element_at(table, word))


def _open(v: Column) -> Column:
    """Starts with a number and is no band."""
    first = F.split(F.trim(v), r"\s+", 2)[0]
    return ~is_banded(v) & (F.trim(v) != "") & parse_number(first).isNotNull()


def _with_rest(v: Column, band: Column) -> Column:
    found = F.when(v.rlike(NUMBER), F.regexp_extract(v, rf"(?s)^.*?{NUMBER}(.*)$", 1)).otherwise(F.regexp_extract(v, rf"(?is)^.*?\b(?:{'|'.join(WORDS)})\b(.*)$", 1))
    return F.concat(band, F.when(found.rlike(UNIT), "").otherwise(found))


def _band(n: Column, bands, top: Column) -> Column:
    """The first band whose test ``n`` passes; bands: (test, name)."""
    out = top
    for test, name in reversed(bands):
        out = F.when(test(n), name).otherwise(out)
    return out


def age(v: Column) -> Column:
    bands = [(lambda n, lo=lo, hi=hi: n.between(lo, hi), band) for lo, hi, band in reversed(AGE_BANDS)]
    return F.when(_open(v), let(parse_number(v).cast("int"), lambda n: _band(n, bands, v))).otherwise(v)


def tenure(v: Column) -> Column:
    bands = [(lambda n, top=top: n.cast("int") < top, name) for top, name in TENURE_BANDS]

    def banded(n):
        year = n.between(1900, 2099) & v.rlike(r"^\s*(?:19|20)\d{2}\s*$")
        return F.when(year, F.trim(v)).otherwise(_with_rest(v, _band(n, bands, F.lit(TENURE_TOP))))

    return F.when(_open(v), let(parse_number(v), banded)).otherwise(v)


def team_size(v: Column) -> Column:
    bands = [(lambda n, top=top: n <= top, name) for top, name in TEAM_BANDS]
    return F.when(_open(v), _with_rest(v, let(parse_number(v).cast("int"), lambda n: _band(n, bands, F.lit(TEAM_TOP))))).otherwise(v)


def date(v: Column) -> Column:
    year = F.regexp_extract(v, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(year != "", year).otherwise(v)


GENERALISERS = {"age": age, "tenure": tenure, "team_size": team_size, "date_au": date, "date_iso": date, "date": date}


def generalise(category: str, v: Column) -> Column:
    """A category without bands stays as it is."""
    return GENERALISERS.get(category, lambda x: x)(v)
