"""Metadata kept in a database: read-only access through Spark's JDBC source."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that write, names of drivers.
_WRITES = re.compile(
    r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|exec|execute|into|lock|vacuum|copy|replace)\b", re.IGNORECASE
)
DRIVERS = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
}
ALIASES = {"pg": "postgres", "postgresql": "postgres", "ora": "oracle"}
PASSWORD = "FACTLOOM_DB_PASSWORD"


def guard_read_only(sql: str) -> str:
    """The statement itself if it only reads; raises otherwise. Words in quoted strings
    and comments do not count."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    plain = re.sub(r"'(?:[^']|'')*'", "''", plain)
    plain = re.sub(r'"[^"]*"', '""', plain)
    if not re.match(r"\s*\(*\s*(select|with)\b", plain, re.IGNORECASE):
        raise ValueError("only SELECT or WITH statements are allowed")
    if ";" in plain.strip().rstrip(";") or plain.strip().endswith(";"):
        raise ValueError("only one statement is allowed, without ';'")
    if found := _WRITES.search(plain):
        raise ValueError(f"the statement contains {found[0]!r}")
    return sql


@dataclass
class Config:
    driver: str = "postgres"
    host: str = "localhost"
    port: int | None = None
    database: str = ""
    user: str = ""
    password: str = ""
    schema: str | None = None

    def url(self) -> str:
        name = driver_name(self.driver)
        return DRIVERS[name][1].format(host=self.host, port=self.port or DRIVERS[name][2], database=self.database)


def driver_name(name: str) -> str:
    found = ALIASES.get(name.lower(), name.lower())
    if found not in DRIVERS:
        raise ValueError(f"unknown driver {name!r}; known: {', '.join(sorted([*DRIVERS, *ALIASES]))}")
    return found


def register_driver(name: str, java_class: str, url: str, port: int) -> None:
    DRIVERS[name] = (java_class, url, port)


def load_config(path: str) -> Config:
    """JSON with ``//`` comment lines; unknown keys are refused, the password may come from
    the environment."""
    with open(path, encoding="utf-8") as file:
        text = "\n".join(x for x in file.read().split("\n") if not x.lstrip().startswith("//"))
    values = json.loads(text)
    unknown = set(values) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    if os.environ.get(PASSWORD):
        values["password"] = os.environ[PASSWORD]
    return Config(**values)


def query(spark: SparkSession, config: Config, sql: str) -> DataFrame:
    options = {"url": config.url(), "driver": DRIVERS[driver_name(config.driver)][0], "user": config.user, "password": config.password}
    return spark.read.format("jdbc").options(**options).option("query", guard_read_only(sql)).load()


def non_empty(column: Column) -> Column:
    """Not null and not empty; some databases know no difference, others do."""
    return column.isNotNull() & (F.trim(column.cast("string")) != "")


def masters(design: DataFrame, numbers: DataFrame) -> DataFrame:
    """Design rows of the wanted numbers (column ``number``), each with the data of its
    master row where it has one."""
    wanted = design.join(numbers.select(F.col("number").alias("fnumber")).distinct(), "fnumber", "left_semi").alias("own")
    master = design.select(F.col("fid").alias("m_id"), F.col("fnumber").alias("m_number"), F.col("fdata").alias("m_data")).alias("m")
    return wanted.join(master, F.col("own.fmasterid") == F.col("m.m_id"), "left").select("own.*", "m_number", "m_data")


def counts_by_isv(design: DataFrame) -> DataFrame:
    return design.where(non_empty(F.col("fisv"))).groupBy("fisv").agg(F.count("*").alias("n"))


def changed_keys(form_design: DataFrame, entity_design: DataFrame, isv: str, since: str | None = None) -> DataFrame:
    """Distinct numbers of an ISV's own metadata, optionally changed after a time."""

    def own(design: DataFrame) -> DataFrame:
        rows = design.where(F.col("fisv") == isv)
        return (rows.where(F.col("fmodifydate") > F.lit(since).cast("timestamp")) if since else rows).select("fnumber")

    return own(form_design).unionByName(own(entity_design)).where(non_empty(F.col("fnumber"))).distinct()


def choose_isv(explicit: str | None, candidates: dict[str, int], local_prefixes: list[str]) -> str:
    """Whose metadata are one's own: as told, else the only candidate, else the only one
    that is a prefix of local keys; anything else is for the user to decide."""
    if explicit:
        return explicit
    if len(candidates) == 1:
        return next(iter(candidates))
    local = [c for c in candidates if c in local_prefixes]
    if len(local) == 1:
        return local[0]
    raise ValueError(f"several ISVs: {', '.join(sorted(candidates))}; name one")


def reassemble(form_design: DataFrame, entity_design: DataFrame) -> DataFrame:
    """Both halves of a form's metadata side by side; either may be missing."""
    forms = form_design.select("fnumber", F.col("fdata").alias("form_data"), F.col("fisv").alias("form_isv"))
    entities = entity_design.select("fnumber", F.col("fdata").alias("entity_data"), F.col("fisv").alias("entity_isv"))
    return forms.join(entities, "fnumber", "full_outer").select("fnumber", "form_data", "entity_data", F.coalesce("form_isv", "entity_isv").alias("isv"))
