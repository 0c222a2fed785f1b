"""Grouped reports over access facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.rank import top_per_group


def breakdown(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by each value of each column: (facet, value, n), null values included.
    One pass with grouping sets instead of a scan for each column."""
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    top = len(columns) - 1
    full = (1 << len(columns)) - 1
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("g") == full - (1 << (top - i))
        facet = F.when(here, c).otherwise(facet)
        value = F.when(here, F.col(c).cast("string")).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def coordinates(rows: DataFrame, coordinate: list[str], is_write: Column, located: Column) -> DataFrame:
    """Writers and readers of each coordinate (nulls are one), located ones first, then
    by falling number of writers (``position``)."""
    found = rows.groupBy(*coordinate).agg(
        F.count(F.when(is_write, 1)).alias("writers"),
        F.count(F.when(~is_write, 1)).alias("readers"),
        F.max(located).alias("located"),
    )
    return found


def hot(rows: DataFrame, key: str, user: str, persisting: Column, k: int) -> DataFrame:
    """The ``k`` keys with the most distinct users, with how many rows persist."""
    found = rows.groupBy(key).agg(F.count_distinct(user).alias("users"), F.count(F.when(persisting, 1)).alias("persisting"))
    return found.orderBy(F.desc("users"), key).limit(k)


def touches(rows: DataFrame, key: str, user: str, users: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """What touches each key, in one aggregation: distinct users for which a condition holds,
    and rows for which one does, by name."""
    distinct = [F.count_distinct(F.when(c, F.col(user))).alias(n) for n, c in users.items()]
    return rows.groupBy(key).agg(*distinct, *(F.count(F.when(c, 1)).alias(n) for n, c in (counts or {}).items()))


def merge_sites(rows: DataFrame, group: list[str], order: list[Column], site: Column, cap: int) -> DataFrame:
    """Per group: the first ``cap`` sites as text, the true total and how many are left out."""
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    first = top_per_group(rows, group, order, cap)
    listed = first.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", site.alias("s")))), lambda x: x["s"]), "|").alias("sites")
    )
    return totals.join(listed, group).withColumn("capped", F.greatest(F.col("total") - cap, F.lit(0).cast("long")))


def two_level(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Per outer key: rows, distinct inner keys, and ``inner=n`` pairs by falling n."""
    counts = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    pair = F.struct((-F.col("n")).alias("neg"), F.col(inner).cast("string").alias("name"))
    return counts.groupBy(outer).agg(
        F.sum("n").alias("total"),
        F.count("*").alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat_ws("=", x["name"], (-x["neg"]).cast("string"))), "|").alias("detail"),
    )


def dominant(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group: rows, the most frequent value (the smaller on ties) and its share."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v")))
    return counts.groupBy(*group).agg(F.sum("n").alias("total"), best.alias("dominant"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


def flags_in_order(value: Column, order: list[str]) -> Column:
    """An aggregate: those of the listed values that occur in the group, in list order."""
    found = F.collect_set(value)
    return F.array_join(F.filter(F.array(*(F.lit(x) for x in order)), lambda x: F.array_contains(found, x)), ",")


def worklist(rows: DataFrame, group: list[str], is_write: Column, cause: str, causes: list[str], anchor: list[str], anchors: int) -> DataFrame:
    """Places that write dynamically: per group rows, writes, causes in fixed order and
    the first few anchors."""
    summary = rows.groupBy(*group).agg(
        F.count("*").alias("total"), F.count(F.when(is_write, 1)).alias("writes"), flags_in_order(F.col(cause), causes).alias("causes")
    )
    at = F.concat_ws(":", *(F.col(c).cast("string") for c in anchor))
    first = top_per_group(rows.select(*group, *anchor).distinct(), group, [F.col(c) for c in anchor], anchors)
    listed = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", at.alias("s")))), lambda x: x["s"]), "|").alias("anchors"))
    return summary.join(listed, group)


def exclusive_owner(bound: DataFrame, owner: str, mark: str) -> DataFrame:
    """Marks that exactly one owner has, with that owner."""
    return bound.groupBy(mark).agg(F.min(owner).alias("low"), F.max(owner).alias("high")).where("low = high").select(mark, F.col("low").alias(owner))


def owner_by_longest_prefix(bound: DataFrame, orphans: DataFrame, prefixes: str, owner: str, orphan: str) -> DataFrame:
    """Each orphan with the owner of its longest prefix that is exclusive to one owner, or
    null. ``prefixes`` is an array column of both inputs."""
    exclusive = exclusive_owner(bound.select(owner, F.explode(prefixes).alias("prefix")).distinct(), owner, "prefix")
    tried = orphans.select(orphan, F.explode_outer(prefixes).alias("prefix")).join(exclusive, "prefix", "left")
    size = F.when(F.col(owner).isNotNull(), F.char_length("prefix"))
    return tried.groupBy(orphan).agg(F.max_by(owner, size).alias(owner))


def consistency(votes: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: its most frequent value and the share of rows that have it."""
    return dominant(votes, [group], value)
