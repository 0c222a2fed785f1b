"""Order, top-k, first-of-group, paging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed order of accesses and of persistence verdicts.
ACCESS_ORDER = ["write", "read"]
PERSIST_ORDER = ["yes", "unknown", "no", "na"]


def place_in(column: Column, order: list[str]) -> Column:
    """Position of a value in a fixed list; unknown values last."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(column == value, i).otherwise(out)
    return out


def access_order(access: str, persists: str, confidence: str, plugin: str) -> list[Column]:
    """Writes first, then by persistence, falling confidence and plugin."""
    return [
        place_in(F.col(access), ACCESS_ORDER),
        place_in(F.col(persists), PERSIST_ORDER),
        F.desc(confidence),
        F.col(plugin).asc_nulls_first(),
    ]


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``rank`` from 1 on. Spark prunes each
    partition to ``n`` rows of a group before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(rows, group, order, 1).drop("rank")


def with_totals(top: DataFrame, rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """Add the group's true ``total`` and how many rows the cap left out (``capped``).
    Counting is a separate partial aggregation, so the cap stays cheap."""
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    return top.join(totals, group).withColumn("capped", F.greatest(F.col("total") - n, F.lit(0).cast("long")))


def top_k(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of all (a top-k plan, no global sort)."""
    return rows.orderBy(*order).limit(k)


def majority(rows: DataFrame, group: list[str], value: str, ties: list[Column]) -> DataFrame:
    """The most frequent value of each group, with ``votes``; ties by the given order."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("votes"))
    return first_per_group(counts, group, [F.desc("votes"), *ties])


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size in the given total order, numbered in ``position``."""
    first = rows.orderBy(*order).limit(offset + size)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("position") > offset)


def pagination(total: int, offset: int, size: int, section: str) -> dict:
    """Whether a page is the last one, and the cursor of the next."""
    following = offset + size
    complete = following >= total
    return {"complete": complete, "next_cursor": None if complete else f"{section}@{following}", "pending": max(0, total - following)}


def parse_cursor(cursor: str | None) -> tuple[str, int]:
    """``section@offset``; an offset that is no number is 0."""
    section, _, offset = (cursor or "").partition("@")
    return section, int(offset) if offset.isdigit() else 0


def strict_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    section, at, offset = cursor.partition("@")
    if not at or not section or not offset.isdigit():
        raise ValueError(f"not a cursor: {cursor!r}")
    return int(offset)


def pages_by_budget(sizes: list[int], budget: int) -> list[int]:
    """Page number of each item: pages are filled in order while their sum stays within
    the budget; an item over the budget has a page of its own."""
    pages, number, used = [], 0, 0
    for size in sizes:
        if used and used + size > budget:
            number, used = number + 1, 0
        pages.append(number)
        used += size
    return pages


def budget_pages(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """``page`` of each row within its group, filled greedily by ``size``. The running
    fill depends on all rows before, so a group is walked in order; rows stream past, and
    only the current page's number and fill are kept."""
    schema = T.StructType([*rows.schema.fields, T.StructField("page", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, used = None, 0, 0
        for batch in batches:
            keys = zip(*(batch.column(g).to_pylist() for g in group), strict=True)
            pages = []
            for key, more in zip(keys, batch.column(size).to_pylist(), strict=True):
                if key != current:
                    current, number, used = key, 0, 0
                if used and used + more > budget:
                    number, used = number + 1, 0
                pages.append(number)
                used += more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int32())], names=[*batch.schema.names, "page"])

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(walk, schema)
