"""How a found value is rewritten, as expressions.  Keys stay on the driver as literals."""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a rewritten value looks like.
LABEL = r"\[[A-Z][A-Z ]*\]"
PSEUDONYM = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*_[0-9a-f]{8}"
PLACEHOLDER = rf"{LABEL}|\b{PSEUDONYM}\b"
STYLES = ("mask", "remove", "partial", "label", "hash", "token")


def full_mask(v: Column, char: str = "*") -> Column:
    return F.regexp_replace(v, r"(?U)\S", char.replace("\\", "\\\\").replace("$", "\\$"))


def partial_mask(v: Column, char: str = "*", prefix: int = 0, suffix: int = 4) -> Column:
    n = F.length(v)
    middle = F.repeat(F.lit(char), n - prefix - suffix)
    end = F.substring(v, n - suffix + 1, F.lit(suffix)) if suffix else F.lit("")
    return F.when(n <= prefix + suffix, full_mask(v, char)).otherwise(F.concat(F.substring(v, 1, prefix), middle, end))


def hmac_sha256(key: bytes, v: Column) -> Column:
    """Lower-case hex: two nested digests with the padded key, on the JVM."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(v, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


@lru_cache(1)
def session_salt() -> bytes:
    """Made once on the driver, so every executor gives a value the same pseudonym."""
    return secrets.token_bytes(32)


def stable_hash(v: Column, salt: bytes | None = None, length: int = 12) -> Column:
    """``[hex]``: keyed with a salt, plain SHA-256 without (guessable: give a salt)."""
    return F.concat(F.lit("["), F.substring(hmac_sha256(salt, v) if salt else F.sha2(v, 256), 1, length), F.lit("]"))


def pseudonym(category: Column, v: Column, salt: bytes | None = None) -> Column:
    return F.concat(category, F.lit("_"), F.substring(hmac_sha256(salt or session_salt(), F.concat(category, F.lit(":"), v)), 1, 8))


def category_label(category: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.translate(category, "_", " ")), F.lit("]"))


def is_placeholder(v: Column) -> Column:
    return v.rlike(rf"^(?:{LABEL}|{PSEUDONYM})$")


def masked(style: str, category: Column, v: Column, salt: bytes | None = None, char: str = "*", prefix: int = 0, suffix: int = 4) -> Column:
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")
    return {
        "mask": lambda: full_mask(v, char),
        "remove": lambda: F.lit(""),
        "partial": lambda: partial_mask(v, char, prefix, suffix),
        "label": lambda: category_label(category),
        "hash": lambda: stable_hash(v, salt),
        "token": lambda: pseudonym(category, v, salt),
    }[style]()
