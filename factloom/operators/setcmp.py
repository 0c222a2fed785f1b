"""Comparisons of key sets: coverage, cross-checks of two scans, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, rounded to four places; null if there is no whole."""
    return F.round(F.try_divide(part, whole), 4)


def coverage(universe: DataFrame, group: str, key: str, touched: dict[str, DataFrame]) -> DataFrame:
    """For each group of ``universe``: its distinct keys (``total``) and how many of
    them each of the named sets has. The sets have the columns ``group`` and ``key``,
    or ``key`` alone. Every set is reduced to its distinct keys before the join, so the
    join is one-to-many and the final aggregation needs no distinct counts."""
    rows = universe.select(group, key).where(F.col(key).isNotNull()).distinct()
    for name, found in touched.items():
        on = [c for c in (group, key) if c in found.columns]
        rows = rows.join(found.select(*on).distinct().withColumn(name, F.lit(1)), on, "left")
    sums = [F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in touched]
    return rows.groupBy(group).agg(F.count("*").alias("total"), *sums)


def trust(*rates: tuple[Column, float, float]) -> Column:
    """``good`` if every rate reaches its upper bound, ``ok`` if every one reaches its
    lower bound, else ``low``; a rate that is null decides nothing."""

    def all_reach(i: int) -> Column:
        out = F.lit(True)
        for value, *bounds in rates:
            out = out & (value.isNull() | (value >= bounds[i]))
        return out

    return F.when(all_reach(0), "good").when(all_reach(1), "ok").otherwise("low")


def compare_scans(universe: DataFrame, key: str, high: DataFrame, coarse: DataFrame) -> DataFrame:
    """Each key with its bucket: both, coarse_only, high_only or neither."""
    flagged = (
        universe.select(key)
        .distinct()
        .join(high.select(key).distinct().withColumn("h", F.lit(True)), key, "left")
        .join(coarse.select(key).distinct().withColumn("c", F.lit(True)), key, "left")
    )
    h, c = F.coalesce("h", F.lit(False)), F.coalesce("c", F.lit(False))
    bucket = F.when(h & c, "both").when(c, "coarse_only").when(h, "high_only").otherwise("neither")
    return flagged.select(key, bucket.alias("bucket"))


def blind_spots(coarse: DataFrame, high: DataFrame, key: str, at: list[str], excluded: DataFrame | None, examples: int) -> DataFrame:
    """Coarse hits at places where the precise scan has none: per key their number and
    the first ``examples`` places. ``excluded`` has ``at[0]`` values that don't count."""
    left = coarse.join(high.select(key, *at).distinct(), [key, *at], "left_anti")
    if excluded is not None:
        left = left.join(excluded.select(at[0]).distinct(), at[0], "left_anti")
    return capped_places(left.select(key, *at).distinct(), key, at, examples)


def capped_places(rows: DataFrame, key: str, at: list[str], examples: int) -> DataFrame:
    """Number of places of each key, and the first few, as text."""
    from factloom.operators.rank import top_per_group

    counts = rows.groupBy(key).agg(F.count("*").alias("total"))
    place = F.concat_ws(":", *(F.col(c).cast("string") for c in at))
    first = top_per_group(rows, [key], [F.col(c) for c in at], examples)
    listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", place.alias("p")))), lambda x: x["p"]), "|").alias("places"))
    return counts.join(listed, key)


def orphans(declared: DataFrame, key: str, bound: DataFrame) -> DataFrame:
    """Declared rows whose key nothing is bound to."""
    return declared.join(bound.select(F.col(key)).distinct(), key, "left_anti")


def unique_reverse(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Reverse index: the one value of a key, or null if it has several."""
    return rows.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))
