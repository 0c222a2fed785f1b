"""Keep-first deduplication with merged grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_grade(symbol: Column, heuristic: Column) -> Column:
    """Grade of a path from what its edges rest on."""
    return F.when(symbol & heuristic, "mixed").when(symbol, "symbol").when(heuristic, "heuristic").otherwise("local")


def keep_first(rows: DataFrame, key: list[str], order: list[str], symbol: Column, heuristic: Column) -> DataFrame:
    """The first row of each key, with the union of all its rows' grades in ``edge_source``.
    A minimum over a struct keeps the first row, so nothing is sorted or windowed."""
    rest = [c for c in rows.columns if c not in key]
    ordered = [*order, *(c for c in rest if c not in order)]
    return (
        rows.groupBy(*key)
        .agg(F.min(F.struct(*ordered)).alias("kept"), F.max(symbol).alias("has_symbol"), F.max(heuristic).alias("has_heuristic"))
        .select(*key, *(F.col("kept")[c].alias(c) for c in rest), edge_grade(F.col("has_symbol"), F.col("has_heuristic")).alias("edge_source"))
    )
