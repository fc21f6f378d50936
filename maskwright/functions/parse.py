"""Dates and phone numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAYS = "mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
PIVOT = 69
DATE_NUMERIC = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
DATE_NAMED = rf"(?i)\b(?:\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|\d{{1,2}}\s+(?:{MONTHS})|(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|(?:{DAYS})\s+\d{{1,2}}\s+(?:of\s+)?(?:{MONTHS})\s+\d{{4}})\b"
LANDLINE_AREAS = "2378"


def _month(name: Column) -> Column:
    """By the place of its first three letters; a place is 1, 4, 7 ..."""
    at = F.instr(F.lit("".join(MONTH_NAMES)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, ((at + 2) / 3).cast("int"))


def parse_date(v: Column) -> Column:
    """struct(iso, order, has_year) of a matched date, null if there's no such day.

    February has 29 days in any year; two-digit years pivot at 69; years are 1900-2099.
    """
    part = lambda p, i: F.nullif(F.regexp_extract(v, p, i), F.lit(""))
    dmy, ymd = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    named = rf"(?i)^(?:(?:{DAYS})\s+)?(\d{{1,2}})\s+(?:of\s+)?({MONTHS})(?:\s+(\d{{4}}))?$"
    first = rf"(?i)^({MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$"
    s = lambda d, m, y, order: F.struct(d.cast("int").alias("d"), m.cast("int").alias("m"), y.cast("int").alias("y"), F.lit(order).alias("order"))
    parts = (
        F.when(v.rlike(dmy), s(part(dmy, 1), part(dmy, 2), part(dmy, 3), "day_first"))
        .when(v.rlike(ymd), s(part(ymd, 3), part(ymd, 2), part(ymd, 1), "iso"))
        .when(v.rlike(first), s(part(first, 2), _month(part(first, 1)), part(first, 3), "month_first"))
        .when(v.rlike(named), s(part(named, 1), _month(part(named, 2)), part(named, 3), "day_first"))
    )

    def full(p):
        year = F.when(p["y"] < 100, p["y"] + F.when(p["y"] <= PIVOT, 2000).otherwise(1900)).otherwise(p["y"])
        return F.struct(p["d"].alias("d"), p["m"].alias("m"), year.alias("y"), p["order"].alias("order"))

    def done(p):
        most = F.get(F.array(*[F.lit(n) for n in MONTH_DAYS]), F.when(p["m"].between(1, 12), p["m"]).otherwise(1) - 1)
        ok = p["m"].between(1, 12) & p["d"].between(1, most) & (p["y"].isNull() | p["y"].between(1900, 2099))
        text = F.when(p["y"].isNull(), F.format_string("%02d-%02d", p["m"], p["d"])).otherwise(F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]))
        return F.when(ok, F.struct(text.alias("iso"), p["order"].alias("order"), p["y"].isNotNull().alias("has_year")))

    return let(let(parts, full), done)


def parse_phone(v: Column) -> Column:
    """The canonical number, null where the numbering plan has none."""
    d = F.regexp_replace(v, "[^0-9]", "")
    body = F.substring(d, 3, 100)
    return (
        F.when(d.startswith("61"), F.when(body.rlike(rf"^[4{LANDLINE_AREAS}][0-9]{{8}}$"), F.concat(F.lit("+61"), body)))
        .when(d.rlike("^(?:1300|1800)[0-9]{6}$"), F.concat(F.lit("0"), d))
        .when(d.rlike(rf"^0[4{LANDLINE_AREAS}][0-9]{{8}}$"), d)
    )
