"""Connected components of links between ids, by contraction and alternating stars.

Workers contract their links to spanning forests, in blocks of ``BLOCK`` links.
While more than one block is left, rounds of two grouped minima and joins
(large-star, then small-star) bring every id closer to its component's smallest;
a node with very many links is pre-aggregated and its join can be split. The
last block, of bounded size, is contracted at once. Rounds are written to the
shared folder; nothing of the graph reaches the driver but the number of edges
and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, written

#: Edges that a worker contracts at once.
BLOCK = 200_000


def merge_labels(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the sets of x[i] and y[i]; ``parent`` maps every index to its set's smallest."""
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return parent
        px, py = px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition, fewer but joining the same ids: each id to its block's smallest."""

    def contract(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = merge_labels(np.arange(len(ids)), at[: len(a)], at[len(a) :])
        linked = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= BLOCK:
            yield contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield contract(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame, count: int | None = None) -> DataFrame:
    """From links (a, b) of long ids: id and component, the smallest id it reaches.
    ``count`` bounds their number, where it is known.

    Ids without a link to another are absent. Nulls and loops are ignored. Up to ``BLOCK``
    links left, one task ends the work instead of more rounds; the result is the same.
    """
    spark = links.sparkSession
    clean = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    if count is not None:
        clean = clean.coalesce(max(1, -(-count // BLOCK)))
    edges = written(clean.mapInArrow(_forest, "a long, b long"), "links")
    state = _state(edges)
    while state[0] > BLOCK:
        rows = 2 * state[0]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: both sides of the join are then plain
        # exchanges, and the links of a node that has very many can be split among tasks
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", rows)
        large = both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each id's smaller neighbours, joined to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        after = written(small.select("e.a", F.col("e.m").alias("b")).where("a > b").distinct(), "links", rows)
        discard(spark, edges, least)
        edges, before = after, state
        state = _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            last = written(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "links")
            discard(spark, edges)
            edges = last
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
