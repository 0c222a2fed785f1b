"""Helpers that several operators share; where written tables go is told in ``factloom.storage``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom import storage
from factloom.storage import new_path, shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and nothing needs any more."""
    for df in frames:
        storage.discard(df)


#: Bytes of an Arrow batch that the queries ask for, and of a piece that a worker takes at once.
BATCH_BYTES, PIECE_BYTES = 4_000_000, 4_000_000


def arrow_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of at most ``BATCH_BYTES``, for a session that has not set
    fewer. Only registered queries and pipeline stages call it: their frames are executed
    after they return, so it stays set. Operators do not rely on it, see ``pieces``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``most`` bytes, one row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096, most: int = 8 * PIECE_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which equal keys are neighbours; each of
    about ``rows`` rows or ``most`` bytes, or a single group."""
    held: list[pa.RecordBatch] = []

    def changes(table: pa.Table) -> np.ndarray:
        parts = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        return np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            table = pa.Table.from_batches(held)
            if len(cuts := changes(table)):
                yield table.slice(0, cuts[-1])
                held = table.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


__all__ = ["arrow_batches", "discard", "groups_of", "new_path", "pieces", "shared_dir", "table", "written"]
