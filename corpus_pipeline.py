"""A training corpus from ``documents``: language ID, near-duplicates,
decontamination, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``.

Defined cases, of all stages: extra columns are carried along, also those named
like a column that an operator adds (they are set aside while it runs); an empty
table stays empty. Null and empty texts, and others without a letter, leave in
the first stage; later stages given such rows keep them, as texts without words
that are like nothing. Rows with a null id are judged by their texts: they link
with no other row, so near-duplicates of them stay. Rows that repeat an id and
its text are one; rows that repeat an id with other texts are judged each. Of
near-duplicates that are equally good the smallest id stays. Texts of any length
are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, langid, neardup, queries, spm
from factloom.llm.common import arrow_batches, table, written
from factloom.storage import scratch


#: The columns that stages read; all others are set aside under numbers while an operator runs.
READ = ("doc_id", "text", "lang")


def _set_aside(docs: DataFrame) -> DataFrame:
    return docs.toDF(*(c if c in READ else f"aside__{i}" for i, c in enumerate(docs.columns)))


def _brought_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(c if c in READ else f"aside__{i}").alias(c) for i, c in enumerate(docs.columns)))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null texts, and those without a letter) go."""
    arrow_batches(spark)
    found = langid.identify(_set_aside(docs), prefix="langid__")
    return _brought_back(found.where(F.col("langid__lang_pred") != langid.UNKNOWN), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    arrow_batches(spark)
    return _brought_back(neardup.one_of_each(_set_aside(docs)), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are."""
    arrow_batches(spark)
    found = decontaminate.judged(decontaminate.with_spans(_set_aside(docs), table(spark, sf_dir, "benchmark")))
    return _brought_back(found.where(~F.col("contaminated")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids (little-endian uint32), ids_sha256."""
    arrow_batches(spark)
    found = spm.with_tokens(docs.select("doc_id", "text"), spm.read_model(queries.MODEL_PATH))
    return found.select("doc_id", *(F.col(spm.TOKENS)[x].alias(x) for x in ("n_tokens", "ids", "ids_sha256")))


STAGES = [
    ("language id", known_language),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]

#: No stage but decontamination and near-duplicates can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as only:
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                only.append(docs)
        kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
