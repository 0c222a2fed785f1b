"""Benchmark decontamination with an FM-index per training shard.

Words are runs of digits, letters a-z and all characters beyond ASCII, after
A-Z are lower-cased. Each benchmark item gives its windows of ``WINDOW``
consecutive words (a shorter item is one window).

Each worker cuts its documents into shards. A shard's index text holds the
document words as numbers of the benchmark's vocabulary; words outside it can
be in no window, so they and runs shorter than the shortest window shrink to a
separator. The index is the Burrows-Wheeler transform of that text in a wavelet
matrix, with suffix positions sampled; windows are found by backward search,
located by walking to the next sample, and merged into removal spans.

The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` of text, as
broadcast arrays; each block is one more pass over the documents, so its size is not
limited. A worker holds documents of one shard, at most ``SHARD_TOKENS`` index
tokens, ``SHARD_DOCS`` documents or ``SHARD_BYTES`` of rows, or a single longer one.

Defined cases: a null text has no words; items without words, or with a null
id, have no windows; repeated items count once for each id; repeated documents
are judged each; spans are merged where they overlap or touch; texts of any
length are searched whole; without documents, or without a benchmark, nothing is
hit. All columns are kept; those named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import pieces

WINDOW = 13
#: A document is contaminated if hits are at least one in PART words.
PART = 20
BLOCK_BYTES = 8_000_000
#: A shard ends at so many index tokens, documents or bytes of held rows.
SHARD_TOKENS, SHARD_DOCS, SHARD_BYTES = 1_000_000, 5_000, 32_000_000
#: Every so many positions of a run the suffix position is kept.
SAMPLE = 16

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, word after the last)."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, done = [], 0
    for lo, hi in spans:
        kept.append(text[done : places[lo][0]])
        done = places[hi - 1][1]
    return "".join([*kept, text[done:]])


class Windows:
    """Distinct windows as rows of word numbers (0 pads on the left), with the items that have them."""

    def __init__(self, rows: Iterable[tuple[str, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        known: dict[str, int] = {}
        windows, owners = [np.empty((0, WINDOW), np.int32)], [np.empty(0, np.int32)]
        for item, text in rows:
            words = words_of(text)
            if not words:
                continue
            own = known.setdefault(item, len(known))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            if len(numbers) < WINDOW:
                numbers = np.concatenate((np.zeros(WINDOW - len(numbers), np.int32), numbers))
            found = np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)
            windows.append(found.copy())
            owners.append(np.full(len(found), own, np.int32))
        self.names = list(known)
        self.patterns, at = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        pairs = np.unique(at.reshape(-1).astype(np.int64) * max(1, len(self.names)) + np.concatenate(owners))
        window, self.owners = np.divmod(pairs, max(1, len(self.names)))
        self.starts = np.searchsorted(window, np.arange(len(self.patterns) + 1))

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.starts[window] : self.starts[window + 1]].tolist()]


class RankBits:
    """A bit vector with ranks by words of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Access and ranks over a sequence of small numbers."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        self.levels: list[tuple[int, RankBits, int]] = []
        for bit in reversed(range(max(1, most.bit_length()))):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, RankBits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ((symbols >> bit) & 1).astype(bool)
            a, b = ones.rank(start), ones.rank(i)
            start, i = np.where(up, zeros + a, start - a), np.where(up, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = ones.get(i)
            found |= up << bit
            a = ones.rank(i)
            i = np.where(up == 1, zeros + a, i - a)
        return found


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of suffixes, each 0 unlike any other and smaller than all words:
    prefix doubling over the suffixes that are still tied."""
    n = len(tokens)
    gaps = np.flatnonzero(tokens == 0)
    rank = tokens + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    order = np.argsort(rank, kind="stable")
    step = 1
    tied = np.arange(n)  # places in order that are not settled
    keys = rank[order]
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        settled = first & np.append(first[1:], True)
        tied = tied[~settled]
        if not len(tied):
            return order
        own = order[tied]
        # a tied suffix is inside a run, whose separator lies beyond own + step
        keys = rank[own] * (n + 1) + rank[np.minimum(own + step, n - 1)]
        by = np.argsort(keys, kind="stable")
        order[tied], keys = own[by], keys[by]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(first, tied, 0))
        step *= 2


class FmIndex:
    """Counts and positions of word sequences in a token text (0 separates runs)."""

    def __init__(self, tokens: np.ndarray, most: int) -> None:
        order = suffix_array(tokens)
        self.size = len(tokens)
        self.bwt = WaveletMatrix(tokens[order - 1], most)
        counts = np.bincount(tokens, minlength=most + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        starts = np.concatenate(([True], tokens[:-1] == 0))
        since = np.arange(self.size) - np.maximum.accumulate(np.where(starts, np.arange(self.size), 0))
        sampled = (since % SAMPLE == 0)[order]
        self.marks, self.samples = RankBits(sampled), order[sampled]

    def step(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.bwt.rank(symbols, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows that begin with each pattern; patterns are padded with 0 on the left."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        for column in patterns.T[::-1]:
            live = np.flatnonzero((column > 0) & (lo < hi))
            lo[live], hi[live] = self.step(column[live], lo[live]), self.step(column[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found = np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        walked = 0
        while len(open_):
            at = rows[open_]
            hit = self.marks.get(at) == 1
            found[open_[hit]] = self.samples[self.marks.rank(at[hit])] + walked
            open_, at = open_[~hit], at[~hit]
            rows[open_] = self.step(self.bwt.access(at), at)
            walked += 1
        return found


class Shard:
    """Documents of one worker, gathered until there are enough for an index."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        lengths = (windows.patterns > 0).sum(axis=1)
        self.lengths, self.shortest = lengths, int(lengths.min()) if len(lengths) else 0
        self.docs = self.tokens = self.bytes = 0
        self.runs: list[tuple[int, int, np.ndarray]] = []

    def add(self, words: list[bytes]) -> None:
        doc, self.docs = self.docs, self.docs + 1
        if len(words) < self.shortest or not self.shortest:
            return
        numbers = np.fromiter(map(self.windows.vocabulary.get, words, repeat(0)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0]))))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= self.shortest:
                self.runs.append((doc, lo, numbers[lo:hi]))
                self.tokens += hi - lo + 1

    def solve(self) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document: its removal spans in words, and the items found."""
        found: list[tuple[list, set]] = [([], set()) for _ in range(self.docs)]
        if not self.runs:
            return found
        text = np.zeros(self.tokens, np.int64)
        starts = np.cumsum([0, *(len(r) + 1 for _, _, r in self.runs[:-1])])
        for at, (_, _, run) in zip(starts.tolist(), self.runs, strict=True):
            text[at : at + len(run)] = run
        index = FmIndex(text, len(self.windows.vocabulary))
        lo, hi = index.search(self.windows.patterns)
        window = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
        if not len(window):
            return found
        skipped = np.concatenate(([0], np.cumsum(np.maximum(hi - lo, 0))[:-1]))
        place = index.locate(lo[window] + np.arange(len(window)) - skipped[window])
        run = np.searchsorted(starts, place, "right") - 1
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + self.lengths[window], -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover[:-1]) > 0, [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            r = int(np.searchsorted(starts, a, "right")) - 1
            doc, first, _ = self.runs[r]
            found[doc][0].append((first + a - int(starts[r]), first + b - int(starts[r])))
        docs = np.array([doc for doc, _, _ in self.runs])[run]
        for key in np.unique(docs * len(self.lengths) + window).tolist():
            doc, w = divmod(key, len(self.lengths))
            found[doc][1].update(self.windows.items(w))
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
N_WORDS, SPANS, ITEMS = "decontam__n_words", "decontam__spans", "decontam__items"
_ARROW = {
    N_WORDS: pa.int64(),
    SPANS: pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])),
    ITEMS: pa.list_(pa.string()),
}


def _searcher(shipped: Broadcast[Windows], text_column: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        counts: list[int] = []
        shard = Shard(shipped.value)

        def flush() -> Iterator[pa.RecordBatch]:
            found, done = shard.solve(), 0
            for batch in held:
                part = found[done : done + batch.num_rows]
                before = zip(batch.column(SPANS).to_pylist(), batch.column(ITEMS).to_pylist(), strict=True)
                merged = [
                    (_merged([*spans, *((s["lo"], s["hi"]) for s in old)]), sorted({*items, *known}))
                    for (spans, items), (old, known) in zip(part, before, strict=True)
                ]
                values = {
                    N_WORDS: counts[done : done + batch.num_rows],
                    SPANS: [[{"lo": lo, "hi": hi} for lo, hi in spans] for spans, _ in merged],
                    ITEMS: [items for _, items in merged],
                }
                done += batch.num_rows
                columns = [pa.array(values[n], _ARROW[n]) if n in values else batch.column(n) for n in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        for batch in pieces(batches):
            held.append(batch)
            shard.bytes += batch.nbytes
            for text in batch.column(text_column):
                words = words_of(text.as_py())
                counts.append(len(words))
                shard.add(words)
            if shard.tokens >= SHARD_TOKENS or shard.docs >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                yield from flush()
                held, counts, shard = [], [], Shard(shipped.value)
        if held:
            yield from flush()

    return search


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark's windows, in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        yield Windows((r["item"], r["text"]) for r in part.toLocalIterator())


def with_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with N_WORDS, SPANS (in words, merged) and ITEMS."""
    empty = F.array().cast(SPAN)
    found = docs.withColumns({N_WORDS: F.lit(0).cast("long"), SPANS: empty, ITEMS: F.array().cast("array<string>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.schema])
    for windows in benchmark_blocks(benchmark):
        found = found.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(windows), "text"), schema)
    return found


def judged(found: DataFrame) -> DataFrame:
    """Add n_hit, contaminated and the digest of the items to ``with_spans``."""
    hit = F.aggregate(SPANS, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return found.withColumn("n_hit", hit).withColumns(
        {
            "n_items": F.size(ITEMS).cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * PART >= F.col(N_WORDS)),
        }
    )


def remove_spans(found: DataFrame) -> DataFrame:
    """Cut the removal spans out of the texts of ``with_spans``; other texts stay as they are."""

    @F.udf("string")
    def cut(text, spans):
        return cut_spans(text, [(s["lo"], s["hi"]) for s in spans]) if spans else text

    return found.withColumn("text", cut("text", SPANS))
