"""Full-text and pattern search over small documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fold, search_tokens

#: Rows of a search and of a class look-up.
SEARCH_LIMIT, CLASS_LIMIT, TOUCH_LIMIT = 50, 100, 300


def query_tokens(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[^\W_]+", fold(query))))


def inverted_index(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, key): each distinct folded token of each row."""
    return rows.select(key, F.explode(F.array_distinct(search_tokens(text))).alias("token")).select("token", key)


def match_all(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys whose rows hold every token of the query: the posting lists of the query's
    tokens alone are read and counted."""
    tokens = query_tokens(query)
    if not tokens:
        return index.select(key).limit(0)
    hits = index.where(F.col("token").isin(tokens)).groupBy(key).agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(tokens)).select(key)


def like_any_case(column: Column, needle: str) -> Column:
    """``%`` and ``_`` in the needle are wildcards."""
    return column.ilike(f"%{needle}%")


def known_tokens(texts: DataFrame, tokens: Column, keys: DataFrame, key: str) -> DataFrame:
    """Occurrences of known keys: one row for each text row and known token in it."""
    found = texts.withColumn(key, F.explode(tokens))
    return found.join(keys.select(key).distinct(), key)
