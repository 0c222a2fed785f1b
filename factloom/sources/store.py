"""The knowledge base as Parquet tables in a folder.

A build writes all tables into a new version folder and the meta table last; a
pointer file then names that version. A reader follows the pointer, so it never
sees half a build, and a build of another schema version counts as absent.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schema import KB_VERSION, TABLES

POINTER = "current"


class KnowledgeBase:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def meta(self) -> dict:
        return {r["key"]: json.loads(r["value"]) for r in self.table("kb_meta").collect()}

    def views(self) -> None:
        """Register every table as a temporary view ``kb_<name>``."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(f"kb_{name}")


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))


def write_kb(spark: SparkSession, folder: str, tables: dict[str, DataFrame], meta: dict) -> KnowledgeBase:
    """Rebuild the knowledge base. Building twice gives the same tables."""
    version = f"{folder}/v-{uuid.uuid4().hex}"
    for name in TABLES:
        if name == "kb_meta":
            continue
        df = tables.get(name)
        conformed(df if df is not None else spark.createDataFrame([], TABLES[name]), name).write.parquet(f"{version}/{name}")
    counts = {name: spark.read.schema(TABLES[name]).parquet(f"{version}/{name}").count() for name in TABLES if name != "kb_meta"}
    rows = {"schema_version": KB_VERSION, "counts": counts, **meta}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], TABLES["kb_meta"]).coalesce(1).write.parquet(f"{version}/kb_meta")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{folder}/{POINTER}")
    return KnowledgeBase(spark, version)


def open_kb(spark: SparkSession, folder: str) -> KnowledgeBase | None:
    """The current build, or None if there is none of this schema version."""
    path, system = _path(spark, f"{folder}/{POINTER}/_SUCCESS")
    if not system.exists(path):
        return None
    kb = KnowledgeBase(spark, spark.read.text(f"{folder}/{POINTER}").first()[0])
    return kb if kb.meta().get("schema_version") == KB_VERSION else None


def meta_value(spark: SparkSession, folder: str, key: str):
    """One meta value of any build, also of an older schema version; None if unreadable."""
    try:
        version = spark.read.text(f"{folder}/{POINTER}").first()[0]
        row = spark.read.parquet(f"{version}/kb_meta").where(F.col("key") == key).first()
        return json.loads(row["value"]) if row else None
    except Exception:
        return None


def find_kb(flag: str | None = None, build_root: str | None = None, start: str | None = None, name: str = ".factloom-kb") -> str:
    """Where the knowledge base is: flag, then environment, then the build's root, then
    the nearest parent folder that has one, then the working folder."""
    if flag:
        return flag
    if os.environ.get("FACTLOOM_KB"):
        return os.environ["FACTLOOM_KB"]
    if build_root:
        return os.path.join(build_root, name)
    here = os.path.abspath(start or os.getcwd())
    while True:
        if os.path.isdir(os.path.join(here, name)):
            return os.path.join(here, name)
        if os.path.dirname(here) == here:
            return os.path.join(os.path.abspath(start or os.getcwd()), name)
        here = os.path.dirname(here)
