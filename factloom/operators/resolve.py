"""Resolution of references in tiers; what cannot be decided keeps its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed confidences of the tiers.
LINK_CONFIDENCE = {"linked": 1.0, "linked_by_name": 0.6, "ambiguous": 0.2, "missing": 0.0}
CONSTANT_CONFIDENCE = {"class": 0.95, "unique_name": 0.85, "ambiguous": 0.3, "unknown": 0.0}


def tiered_link(refs: DataFrame, full: str, simple: str, targets: DataFrame, external: Column) -> DataFrame:
    """Link references to declared classes: external rules first, then the exact name,
    then the simple name if it is unique; several are ambiguous, none is missing.

    ``targets`` has (full, simple). Adds status, confidence, target and candidates.
    """
    names = targets.select(full).distinct().withColumn("exact", F.lit(True))
    by_simple = targets.select(full, simple).distinct().groupBy(simple).agg(F.min(full).alias("named"), F.count("*").alias("candidates"))
    joined = refs.join(names, full, "left").join(by_simple, simple, "left")
    n = F.coalesce("candidates", F.lit(0).cast("long"))
    status = (
        F.when(external, "external")
        .when(F.col("exact"), "linked")
        .when(n == 1, "linked_by_name")
        .when(n > 1, "ambiguous")
        .otherwise("missing")
    )
    target = F.when(status == "linked", F.col(full)).when(status == "linked_by_name", F.col("named"))
    return joined.select(*refs.columns, status.alias("status"), target.alias("target"), n.alias("candidates")).withColumn(
        "confidence", _by_status(F.col("status"), LINK_CONFIDENCE)
    )


def _by_status(status: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def external_rules(name: Column, source: Column, prefixes: tuple[str, ...] = ("kd.", "kd_"), inner: str = ".kd.bos.") -> Column:
    """Confidence that a class is the platform's own, or null if no rule says so."""
    last = F.element_at(F.split(name, r"\."), -1)
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | name.startswith(p)
    return (
        F.when(name.isNull() | (name == ""), 0.8)
        .when(starts, 1.0)
        .when(name.contains(inner), 0.9)
        .when(~last.rlike("[A-Z]"), 0.9)
        .when(source == "platform", 0.8)
    )


def resolve_constants(refs: DataFrame, definitions: DataFrame, cls: str, name: str, value: str) -> DataFrame:
    """Values of constant references (cls may be null): by class and name, else by a name
    with one value; several values are ambiguous (value null, number in ``candidates``)."""
    in_class = definitions.groupBy(cls, name).agg(F.min(value).alias("c_value"), F.count_distinct(value).alias("c_n"))
    by_name = definitions.groupBy(name).agg(F.min(value).alias("n_value"), F.count_distinct(value).alias("n_n"))
    joined = refs.join(in_class, [cls, name], "left").join(by_name, name, "left")
    tier = (
        F.when(F.col("c_n") == 1, "class")
        .when(F.col("c_n") > 1, "ambiguous")
        .when(F.col("n_n") == 1, "unique_name")
        .when(F.col("n_n") > 1, "ambiguous")
        .otherwise("unknown")
    )
    found = F.when(tier == "class", F.col("c_value")).when(tier == "unique_name", F.col("n_value"))
    n = F.coalesce("c_n", "n_n", F.lit(0).cast("long"))
    return joined.select(*refs.columns, tier.alias("resolution"), found.alias("value"), n.alias("candidates")).withColumn(
        "confidence", _by_status(F.col("resolution"), CONSTANT_CONFIDENCE)
    )


def unique_match(rows: DataFrame, sites: DataFrame, on: list[str], column: str) -> DataFrame:
    """Join each row to the only site with its keys, or to that of several which also has
    its ``column``; otherwise to none."""
    counted = sites.groupBy(*on).agg(F.count("*").alias("sites"))
    single = sites.join(counted.where("sites = 1"), on).drop("sites", column)
    several = sites.join(counted.where("sites > 1"), on).drop("sites").dropDuplicates([*on, column])
    extra = [c for c in sites.columns if c not in (*on, column)]
    renamed = several.select(*on, column, *(F.col(c).alias(f"{c}__2") for c in extra))
    joined = rows.join(single, on, "left").join(renamed, [*on, column], "left")
    return joined.select(*rows.columns, *(F.coalesce(c, f"{c}__2").alias(c) for c in extra))


def only_candidate(candidates: DataFrame, group: list[str], member: str, evidence: str) -> DataFrame:
    """Intersection of candidate sets: members that every evidence of the group has; kept
    only if exactly one is left. Counting per member replaces a fold of sets."""
    rows = candidates.select(*group, evidence, member).distinct()
    needed = rows.select(*group, evidence).distinct().groupBy(*group).agg(F.count("*").alias("needed"))
    shared = rows.groupBy(*group, member).agg(F.count("*").alias("has")).join(needed, group).where("has = needed")
    return shared.groupBy(*group).agg(F.count("*").alias("n"), F.min(member).alias(member)).where("n = 1").drop("n")


def merge_by_priority(sides: list[DataFrame], key: list[str]) -> DataFrame:
    """One row per key; the side named first wins. Adds ``side`` (its number from 0)."""
    from factloom.operators.rank import first_per_group

    rows = sides[0].withColumn("side", F.lit(0))
    for i, side in enumerate(sides[1:], 1):
        rows = rows.unionByName(side.withColumn("side", F.lit(i)))
    return first_per_group(rows, key, [F.col("side"), *(F.col(c) for c in sides[0].columns if c not in key)])


def complete_from_template(own: DataFrame, template: DataFrame, group: list[str], key: str) -> DataFrame:
    """Own rows and those of the group's template whose key is not among them."""
    missing = template.join(own.select(*group, key).distinct(), [*group, key], "left_anti")
    return own.withColumn("origin", F.lit("own")).unionByName(missing.withColumn("origin", F.lit("template")))


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Whole-row replacement: rows of ``old`` whose key is not new, and all new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def combine_signals(signals: dict[str, DataFrame], key: str, first: str) -> DataFrame:
    """Candidates from several signals, each (key, hits): their hits side by side, in the
    order: those of signal ``first``, then by all hits, then by key (``position``)."""
    rows = None
    for name, signal in signals.items():
        part = signal.select(key, F.lit(name).alias("signal"), F.col("hits").cast("long").alias("hits"))
        rows = part if rows is None else rows.unionByName(part)
    sums = [F.coalesce(F.sum(F.when(F.col("signal") == n, F.col("hits"))), F.lit(0).cast("long")).alias(n) for n in signals]
    found = rows.groupBy(key).agg(*sums, F.sum("hits").alias("hits"))
    return found.withColumn("leads", F.col(first) > 0)
