"""Text functions: identifiers, locators, tokens; native columns where they can be,
Arrow-fed Python where characters must be walked in order."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KEY_SHAPE = "^[a-z][a-z0-9]*(_[a-z0-9]+)+$"
CONSTANT_REF = r"\b([A-Z][A-Za-z0-9_]*)\.([A-Z][A-Z0-9_]{2,})\b"
KEY_TOKEN = "[A-Za-z][A-Za-z0-9_]+"
MOST_CONSTANT_REFS = 300


def locator(text: Column) -> Column:
    """struct(field, form, entry, level) of ``f``, ``form.f``, ``form.entry.f`` or
    ``form.entry.sub.f``; two segments leave the level open."""
    parts = F.split(text, r"\.")
    n = F.size(parts)
    return F.struct(
        F.element_at(parts, -1).alias("field"),
        F.when(n >= 2, parts[0]).alias("form"),
        F.when(n >= 3, F.element_at(parts, -2)).alias("entry"),
        F.when(n == 3, "entry").when(n == 4, "subentry").alias("level"),
    )


def operation_locator(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.struct(F.element_at(parts, -1).alias("op"), F.when(F.size(parts) == 2, parts[0]).alias("form"))


def last_segment(name: Column) -> Column:
    """Simple name of a qualified or inner class."""
    return F.regexp_extract(name, r"([^.$]+)$", 1)


def first_prefix(key: Column) -> Column:
    return F.substring_index(key, "_", 1)


def package_prefixes(name: Column) -> Column:
    """a, a.b, a.b.c of a dotted name."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def simple_type(name: Column, depth: int = 6) -> Column:
    """Name of a type without generics, arrays and package; null if none is left.
    Generic arguments are removed from the inside, ``depth`` levels of them."""
    out = name
    for _ in range(depth):
        out = F.regexp_replace(out, r"<[^<>]*>", "")
    out = F.trim(F.regexp_replace(out, r"\[\s*\]|\.\.\.|\?|@\w+\s+", ""))
    out = F.substring_index(out, ".", -1)
    return F.when(out.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), out)


def constant_refs(text: Column) -> Column:
    """Array of ``Class.CONSTANT`` references in order, at most MOST_CONSTANT_REFS."""
    return F.slice(F.regexp_extract_all(text, F.lit(CONSTANT_REF), F.lit(0)), 1, MOST_CONSTANT_REFS)


def key_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(KEY_TOKEN), F.lit(0)))


def is_access_idiom(before: Column) -> Column:
    """Whether the text before a token ends in a get or set call."""
    return F.substring(before, -24, 24).rlike(r"(getValue|setValue|\.get|\.set)\s*\(\s*([A-Za-z_][\w.]*\.)?\"?$")


def clipped(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n"))


def fold(text: str | None) -> str | None:
    """Lower case without diacritics."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def search_tokens(text: Column) -> Column:
    """Tokens of a folded text: runs of letters and digits. Plain ASCII is folded natively;
    only texts with other characters go to Python."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    low = F.when(plain, F.lower(text)).otherwise(folded(F.when(~plain, text)))
    return F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")


