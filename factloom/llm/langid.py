"""Language identification by rank-order profiles (out-of-place distance).

A profile is the ``TOP`` most frequent character n-grams (1 to 3 letters, ``_``
at word borders) of a language, in order of frequency. A document's own most
frequent n-grams are compared to each profile: an n-gram costs the difference
of its two ranks, one that the profile lacks costs ``TOP``. The language with
the smallest sum wins, the smaller name on ties.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing was learned. Rows without language are not learned
from. Null ids are neither learned from nor held out. Repeated rows count as
often as they occur. Columns that already have an added name are replaced, all
others are kept. Texts are used whole. The score is one minus the distance
over the greatest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n-grams in a profile, of languages and of documents alike.
TOP = 300
#: The profiles of so many languages at most go to the workers (TOP entries each).
MOST_LANGUAGES = 10_000
UNKNOWN = "und"


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of other characters become one 0,
    as do the text's ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.empty(0, np.int64)
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint64)
    known = [p for p in seen.tolist() if chr(p).isalpha()]
    table[known] = known
    row = np.zeros(len(points) + 2, np.uint64)
    row[1:-1] = table[points]
    return row[np.concatenate(([True], (row[1:] != 0) | (row[:-1] != 0)))]


def grams_of(row: np.ndarray) -> np.ndarray:
    """Codes of all n-grams: 21 bits for each letter, sorted."""
    bits = np.uint64(21)
    pairs = (row[:-1] << bits) | row[1:]
    triples = (pairs[:-1] << bits) | row[2:]
    middle = row[1:-1] != 0
    tag = np.uint64(1 << 42)
    found = np.concatenate((row[row != 0], pairs | tag, triples[middle] | np.uint64(1 << 63)))
    found.sort()
    return found


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def most_frequent(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """At most ``top`` codes by falling count, then code."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        chosen = counts >= least
        codes, counts = codes[chosen], counts[chosen]
    return codes[np.argsort(-counts, kind="stable")[:top]]


@dataclass
class Profiles:
    """``ranks[i, l]`` is the rank of n-gram ``codes[i]`` in language ``l``, or TOP."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, ordered: dict[str, np.ndarray]) -> Profiles:
        languages = sorted(ordered)
        codes = np.unique(np.concatenate([ordered[x] for x in languages])) if languages else np.empty(0, np.uint64)
        ranks = np.full((len(codes), len(languages)), TOP, np.int32)
        for i, x in enumerate(languages):
            ranks[np.searchsorted(codes, ordered[x]), i] = np.arange(len(ordered[x]))
        return cls(languages, codes, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages:
            return UNKNOWN, 0.0
        row = letters_of(text)
        if not row.any():
            return UNKNOWN, 0.0
        own = most_frequent(*counted(grams_of(row)), TOP)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], TOP)
        apart = np.where(ranks < TOP, np.abs(ranks - np.arange(len(own))[:, None]), TOP).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (TOP * len(own))


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language in one partition."""
    pending: dict[str, list] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge(language: str) -> None:
        held = [*pending.pop(language, []), *([totals[language]] if language in totals else [])]
        codes = np.concatenate([c for c, _ in held])
        counts = np.concatenate([n for _, n in held])
        distinct, at = np.unique(codes, return_inverse=True)
        totals[language] = distinct, np.bincount(at, counts).astype(np.int64)

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pending.setdefault(language, []).append(counted(grams_of(letters_of(text))))
            if len(pending[language]) == 200:
                merge(language)
    for language in list(pending):
        merge(language)
    for language, (codes, counts) in totals.items():
        for i in range(0, len(codes), 50_000):
            part = codes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[i : i + 50_000])],
                names=["lang", "code", "n"],
            )


def train(labelled: DataFrame) -> Profiles:
    """Learn profiles from all rows of ``lang`` and ``text`` that have both."""
    rows = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_partition, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # As signed numbers codes would sort with the triples first; 'code < 0' puts them last as in most_frequent.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code")
    chosen = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    found = chosen.select("lang", "place", "code").limit(TOP * MOST_LANGUAGES + 1).collect()
    if len(found) > TOP * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    ordered: dict[str, list] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["place"])):
        ordered.setdefault(row["lang"], []).append(row["code"])
    return Profiles.of({k: np.array(v, np.int64).view(np.uint64) for k, v in ordered.items()})


def predictor(profiles: Profiles):
    """A column function: text to (lang, score)."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([profiles.predict(x) for x in batch], columns=["lang", "score"])

    return predict


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score`` (each with the prefix) to documents,
    after learning from those that are not held out."""
    profiles = train(docs.where(fold_of(F.col("doc_id")) != 2))
    mark = f"{prefix}langid__"
    return (
        docs.withColumn(mark, predictor(profiles)(F.col("text").cast("string")))
        .withColumns(
            {
                f"{prefix}held_out": F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)),
                f"{prefix}lang_pred": F.col(mark)["lang"],
                f"{prefix}score": F.col(mark)["score"],
            }
        )
        .drop(mark)
    )
