"""Keeping facts fresh: changed files arrive as a stream and replace their own facts.

State is keyed by file, so a batch that is run again gives the same tables; what
depends on all files (bindings, closures, fix points) is built anew from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rank import first_per_group
from factloom.operators.resolve import replace_by_key
from factloom.sources.javasource import parse_files
from factloom.storage import new_path

CHANGES = "relpath string, text string, deleted boolean, seq long"


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change records as JSON files: the newest by ``seq`` counts."""
    return spark.readStream.schema(CHANGES).json(folder)


class ParsedTable:
    """Parsed facts of the newest version of each file, in versioned folders."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, None

    def current(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self.path else None

    def apply(self, batch: DataFrame, _batch_id: int = 0) -> None:
        """For ``foreachBatch``: whole files are parsed again and replace their rows."""
        newest = first_per_group(batch, ["relpath"], [F.desc("seq"), F.col("deleted"), F.col("text")])
        parsed = parse_files(newest.where("not coalesce(deleted, false)"))
        old = self.current()
        if old is not None:
            gone = newest.where("deleted").select("relpath")
            parsed = replace_by_key(old.join(gone, "relpath", "left_anti"), parsed, ["relpath"])
        path = new_path(self.spark, "stream")
        parsed.write.parquet(path)
        self.path = path


def refresh(spark: SparkSession, folder: str, checkpoint: str, table: ParsedTable):
    """Process what has come so far and stop."""
    stream = read_changes(spark, folder).writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = stream.start()
    query.awaitTermination()
    return table.current()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; those later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "value")
    )
