"""Near-duplicate detection: a chosen-path set-similarity join on word shingles.

A document is the set of its distinct five-word shingles, as 64-bit hashes. A
link joins two documents whose sets have a Jaccard similarity of at least 3/4.
Two shingles of one pair of documents share a hash with a probability of about
n * n / 2^64 (5e-8 for two texts of a million words), and only where that turns
the comparison does it show; equal sets are told by 128-bit digests of all hashes.

1. Equal sets are one node each (a grouped minimum), so copies cost nothing more.
2. Each set is summarised by ``WIDTH`` minwise tokens. ``TREES`` independent
   trees branch the sets by a minwise token. A node of at most ``SMALL`` sets is
   compared exhaustively on the summaries. A larger one is compared to one of
   its sets, the hub; those at the hub are done, the others branch again, each
   following ``BRANCHES`` tokens that the node's path selects, down to
   ``DEPTH``; what is still large there is taken as one candidate group. A child
   of sets that were all linked to the same hub is joined already and is left out.
   Both give candidate groups that may be too large, never too small.
3. Candidate groups are cut into blocks of bounded size which are solved on the
   full sets, together with a few hubs of their group. Where a group has several
   blocks, those outside its largest confirmed component are then compared to
   all of the group, again in blocks. Groups close candidate links before these are
   confirmed, so sets that are half alike in a long chain are one group: its work
   grows with the number of its sets that end outside its largest component.

A pair at the threshold is missed by all trees with a probability of about
1e-5 (``TREES`` roots at 0.75 each, and 0.89 for each further descent); pairs
that are more alike, much more rarely, and a missed link only matters if no
other path joins the two documents.

Texts of groups are taken from the documents once: by a broadcast of the groups'
ids up to ``BROADCAST_IDS`` of them, so that other texts don't move, by a join beyond.

Defined cases: a null text, or one without words, has no set and no links; a
text of fewer than five words is one shingle; rows with a null id link with
nothing (their component is null and they are kept); rows that repeat an id
are judged by their own texts; of equal sets and of a component the smallest id
stands for all; texts of any length are taken whole, in pieces of ``PIECE`` bytes;
an empty table gives an empty result. ``label_documents`` reads doc_id and text
only; ``one_of_each`` keeps all columns, also those named like its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.llm.common import groups_of, pieces, written
from factloom.storage import written_counted
from factloom.llm.components import components, merge_labels

WORDS = 5
#: Links: PART * union <= WHOLE * intersection.
PART, WHOLE = 75, 100
WIDTH, TREES, BRANCHES, DEPTH, SMALL = 64, 10, 2, 4, 128
#: Candidates agree in so many of the WIDTH minwise tokens (4.6 deviations below 0.75).
AGREE = 32
#: In a large node: from here on linked to its hub, from here on at it and not branched further.
AT_HUB = 52
NEAR_HUB = AT_HUB + AGREE - WIDTH
#: Bounds of a block of full sets, and hubs of a group.
BLOCK_SETS, BLOCK_SHINGLES, HUBS = 128, 1_000_000, 4
#: Ids of groups that are broadcast to pick their texts, and bytes of a text that are hashed at once.
BROADCAST_IDS, PIECE = 1_000_000, 1 << 20
#: Rows of a task that compares summaries, and texts of one that compares full sets.
TASK_ROWS, TASK_TEXTS = 50_000, 1_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_ODD = _rng.integers(0, 2**64, WIDTH, np.uint64, endpoint=False) | np.uint64(1)
_SPACE = re.compile("[ \t-\r]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_runs(text: str) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; each begins with the last words of the one before."""
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        # a word may be longer than a piece
        gap = _SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        words = text[at:end].encode("utf-8", "replace").lower().split()
        at = end
        if words:
            run = carry + words
            carry = run[1 - WORDS :] if len(run) >= WORDS else run
            yield run


class Shingler:
    """Shingle hashes by prefix sums of a polynomial, for texts of any length."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << max(16, n.bit_length())
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Of all shingles of a run of words."""
        data = np.frombuffer(b" ".join(words), np.uint8)
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=sums[1:])
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.append(gaps, len(data))
        k = min(WORDS, len(words)) - 1
        starts, ends = starts[: len(starts) - k], ends[k:]
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes, sorted."""
        parts, before = [], 0
        for words in word_runs(text or ""):
            if 0 < before < WORDS:
                parts.clear()  # what came before was no whole shingle
            parts.append(self.hashes(words))
            before = len(words)
        if not parts:
            return np.empty(0, np.uint64)
        found = np.concatenate(parts)
        found.sort()
        return found[np.concatenate(([True], found[1:] != found[:-1]))]


def summary(shingles: np.ndarray) -> np.ndarray:
    """WIDTH minwise tokens of a set."""
    least = np.full(WIDTH, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[i : i + 4096, None] * _ODD).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


SETS = "doc_id long, text_key long, n_shingles long, print binary, tokens binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in pieces(batches):
        sizes, prints, tokens = [], [], []
        for text in batch.column(2):
            found = shingler(text.as_py())
            sizes.append(len(found))
            prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            tokens.append(summary(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "print", "tokens"],
        )


def document_sets(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(_sets, SETS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _keys(nodes: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    width = nodes.shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.reshape(-1).view(np.int64)), pa.array(np.repeat(ids.to_numpy(), width))], names=["node", "id"]
    )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to the root's child in each tree."""
    for batch in batches:
        tokens = _matrix(batch.column(1))[:, :TREES].astype(np.uint64)
        yield _keys(mixed(tokens + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40))), batch.column(0))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large nodes (node, id, hub, tokens, hub_tokens) to the children that the
    node's path selects, and to links with the hub (node is null).

    Who is very like the hub leaves the node: what agrees with it in AGREE tokens
    agrees with the hub in NEAR_HUB, since each place where it differs from the
    hub is one where it differs from that set or that set from the hub. So it is
    linked to the hub, and only pairs that AGREE leaves out are lost here. ``far``
    are those without such a link.
    """
    for batch in batches:
        nodes = batch.column(0).to_numpy().view(np.uint64)
        ids, hubs = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        tokens = _matrix(batch.column(3))
        agree = (tokens == _matrix(batch.column(4))).sum(axis=1)
        near, stays = (agree >= NEAR_HUB) & (ids != hubs), (agree < AT_HUB)
        nodes, tokens = nodes[stays], tokens[stays]
        children = []
        for k in range(BRANCHES):
            path = mixed(nodes + np.uint64(0xD1B54A32D192ED03 * (k + 1) % 2**64))
            place = (path % np.uint64(WIDTH - TREES)).astype(np.int64) + TREES
            children.append(mixed(path ^ mixed(tokens[np.arange(len(tokens)), place].astype(np.uint64))))
        child = np.stack(children, axis=1).reshape(-1).view(np.int64)
        node = pa.concat_arrays([pa.array(child), pa.nulls(int(near.sum()), pa.int64())])
        added = [np.concatenate((np.repeat(x[stays], BRANCHES), x[near])) for x in (ids, hubs, ~near)]
        yield pa.RecordBatch.from_arrays([node, *map(pa.array, added)], names=["node", "id", "hub", "far"])


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each node all pairs, but those already joined: links that span the alike."""
    for table in groups_of(batches, ["node"]):
        node = table.column("node").combine_chunks().to_numpy()
        ids, at = np.unique(table.column("id").combine_chunks().to_numpy(), return_inverse=True)
        tokens = _matrix(table.column("tokens").combine_chunks())
        parent = np.arange(len(ids))
        for step in range(1, SMALL):
            i = np.flatnonzero(node[step:] == node[:-step])
            if not len(i):
                break
            i = i[parent[at[i]] != parent[at[i + step]]]
            alike = (tokens[i] == tokens[i + step]).sum(axis=1) >= AGREE
            parent = merge_labels(parent, at[i[alike]], at[i[alike] + step])
        linked = parent != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[parent[linked]])], names=["a", "b"])


def candidate_links(nodes: DataFrame) -> DataFrame:
    """From distinct sets (id, tokens): links that join all that may be alike."""
    return counted_links(nodes, nodes.count())[0]


def counted_links(nodes: DataFrame, count: int) -> tuple[DataFrame, int]:
    """``candidate_links`` of ``count`` sets, and their number."""
    keys, rows = nodes.select("id", "tokens").mapInArrow(_roots, "node long, id long").withColumn("far", F.lit(True)), TREES * count
    links, small = [], []
    for depth in range(1, DEPTH + 1):
        # written before the join: both its sides are then plain exchanges, and a node that
        # holds a large share of the rows can be split among tasks
        # what is all linked to one hub has nothing left to compare
        found = keys.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("hub"), F.max("far").alias("far")).where("size > 1 and far")
        sizes = written(found.drop("far"), "sizes", rows // 2)
        many = Observation()
        members = written(keys.drop("far").join(sizes, "node").observe(many, F.count_if(F.col("size") > SMALL).alias("n")), "members", rows)
        small.append(members.where(F.col("size") <= SMALL).select("node", "id"))
        large = members.where(F.col("size") > SMALL)
        if not many.get["n"]:
            break
        if depth == DEPTH:
            links.append(large.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
        else:
            tokens = nodes.select("id", "tokens")
            hubs = large.select("node", "hub").distinct().join(tokens.withColumnRenamed("id", "hub"), "hub")
            full = large.select("node", "id").join(tokens, "id").join(hubs.withColumnRenamed("tokens", "hub_tokens"), "node")
            full = full.select("node", "id", "hub", "tokens", "hub_tokens")
            branched, rows = written_counted(full.mapInArrow(_branches, "node long, id long, hub long, far boolean"), "branched", BRANCHES * many.get["n"])
            links.append(branched.where("node is null").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
            keys = branched.where("node is not null").select("node", "id", "far")
    pairs = small[0]
    for more in small[1:]:
        pairs = pairs.union(more)
    pairs = pairs.join(nodes.select("id", "tokens"), "id").repartition("node").sortWithinPartitions("node")
    pairs = pairs.coalesce(max(1, -(-TREES * count // TASK_ROWS)))
    found, total = written_counted(pairs.mapInArrow(_compare_small, "a long, b long"), "candidates")
    for more in links:
        # apart from the others: each is then a stage of even tasks
        some, n = written_counted(more, "hubs", 2 * TREES * count)
        found, total = found.union(some), total + n
    return found, total


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if WHOLE * min(len(a), len(b)) < PART * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return WHOLE * shared >= PART * (len(both) - shared)


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, block, id, hub, known, text, print), a block's together: confirmed links.

    ``known`` is a component found before: its members are not compared again.
    Sets from the largest block on are compared first to hubs, then to all.
    """
    shingler = Shingler()
    for table in groups_of(batches, ["grp", "block"], rows=512):
        columns = {k: table.column(k).to_pylist() for k in ("grp", "block", "id", "hub", "known", "side", "print")}
        texts = table.column("text")
        edges: tuple[list, list] = ([], [])
        ends = [i for i in range(1, len(texts)) if (columns["grp"][i], columns["block"][i]) != (columns["grp"][i - 1], columns["block"][i - 1])]
        for lo, hi in zip([0, *ends], [*ends, len(texts)], strict=True):
            order = sorted(range(lo, hi), key=lambda i: (not columns["hub"][i], columns["id"][i]))
            sets = [shingler(texts[i].as_py()) for i in order]
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == columns["print"][i] for s, i in zip(sets, order, strict=True)]
            order, sets = ([x for x, ok in zip(y, right, strict=True) if ok] for y in (order, sets))
            tokens = np.stack([summary(s) for s in sets]) if sets else np.empty((0, WIDTH), np.uint32)
            names: dict[int, int] = {}
            label = np.array([names.setdefault(columns["known"][i], len(names)) for i in order], np.int64)
            side = np.array([columns["side"][i] for i in order], np.int64)
            for x in range(len(order)):
                near = (tokens[x + 1 :] == tokens[x]).sum(axis=1) >= AGREE
                near &= (side[x + 1 :] != 0) | (side[x] != 0)
                for y in (np.flatnonzero(near) + x + 1).tolist():
                    if label[x] != label[y] and alike(sets[x], sets[y]):
                        label[label == label[y]] = label[x]
                        edges[0].append(columns["id"][order[x]])
                        edges[1].append(columns["id"][order[y]])
        yield pa.RecordBatch.from_arrays([pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64())], names=["a", "b"])


def texts_of(ids: DataFrame, count: int, docs: DataFrame) -> DataFrame:
    """(id, text) of the rows of ``docs`` with one of ``count`` distinct ids, written."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return written(texts.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "id", "left_semi"), "texts")


def _confirmed(rows: DataFrame, count: int, texts: DataFrame) -> DataFrame:
    """Solve blocks: about ``count`` rows (grp, block, id, hub, known, side, print) with their texts."""
    return (
        rows.join(texts, "id")
        .select("grp", "block", "id", "hub", "known", "side", "print", "text")
        .repartition("grp", "block")
        .sortWithinPartitions("grp", "block")
        .coalesce(max(1, -(-count // TASK_TEXTS)))
        .mapInArrow(_solve_blocks, "a long, b long")
    )


def confirmed_links(candidates: DataFrame, count: int, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """From ``count`` candidate links: links confirmed on full sets that join all that are alike."""
    groups = components(candidates, count).withColumnRenamed("component", "grp").join(nodes.select("id", "n_shingles", "print"), "id")
    picks = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"hub{k}") for k in range(HUBS)]
    sizes = groups.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("weight"), *picks)
    sizes = sizes.withColumn(
        "blocks", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("long")
    )
    sizes = written(sizes, "sizes", count)
    groups, count = written_counted(groups.join(sizes.select("grp", "blocks"), "grp"), "groups", 2 * count)
    texts = texts_of(groups.select("id"), count, docs)
    prints = groups.select("id", "print")
    hubs = sizes.where("blocks > 1").select(
        "grp", "blocks", F.explode(F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)]))).alias("id")
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    rows = groups.select("grp", block, "id", F.lit(False).alias("hub")).union(
        hubs.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", F.lit(True))
    )
    rows = rows.groupBy("grp", "block", "id").agg(F.max("hub").alias("hub"))
    first = written(_confirmed(rows.withColumns({"known": F.col("id"), "side": F.lit(1)}).join(prints, "id"), count, texts), "confirmed")

    several = groups.where("blocks > 1")
    if several.isEmpty():
        return first
    # Large groups: what lies outside their largest component against all of the group, block by block.
    labels = components(first, HUBS * count).withColumnRenamed("component", "known")
    known = several.join(labels, "id", "left").withColumn("known", F.coalesce("known", "id"))
    parts = known.groupBy("grp", "known").agg(F.count("*").alias("n"))
    main = written(parts.groupBy("grp").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.sum("n").alias("sets")), "main", count)
    known = written(known.join(main, "grp"), "known", count)
    rest = known.where("known <> main")
    if rest.isEmpty():
        return first
    left = written(rest.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("parts")), "left", count)
    rest_part = F.pmod(F.xxhash64("id", F.lit("rest")), F.col("parts"))
    # block = part of the rest * blocks + block of all
    queries = rest.join(left, "grp").select(
        "grp", F.explode(F.sequence(rest_part * F.col("blocks"), (rest_part + 1) * F.col("blocks") - 1)).alias("block"), "id", "known", F.lit(1).alias("side")
    )
    everything = known.join(left, "grp").select(
        "grp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p * F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("blocks")))).alias("block"),
        "id",
        "known",
        F.lit(0).alias("side"),
    )
    rows = queries.union(everything).groupBy("grp", "block", "id").agg(F.max("known").alias("known"), F.max("side").alias("side"))
    rows, count = written_counted(rows, "rows", (BLOCK_SETS + 1) * count)
    second = written(_confirmed(rows.withColumn("hub", F.lit(False)).join(prints, "id"), count, texts), "confirmed")
    return first.union(second)


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    sets, count = written_counted(document_sets(docs), "sets")
    nodes, count = written_counted(
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")),
        "nodes",
        4 * count,  # summaries make these rows four times the usual size
    )
    links = confirmed_links(*counted_links(nodes, count), nodes, docs)
    joined = components(links)
    classes = nodes.select("print", "id").join(joined, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    return (
        sets.drop("tokens")
        .join(classes, "print", "left")
        .select(
            "doc_id",
            "text_key",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; rows that repeat an id and its text are one. The
    rows to drop are found by id and text; up to ``BROADCAST_IDS`` of them are broadcast, so
    that no text moves, but those of repeated rows."""
    key = "neardup__key"
    while key in docs.columns:
        key += "_"
    keys = [F.col("doc_id").alias(f"{key}_id"), F.col("text_key").alias(f"{key}_text")]
    labels = label_documents(docs).groupBy(*keys).agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    odd, count = written_counted(labels.where("not kept or rows > 1"), "dropped")
    some = F.broadcast if count <= BROADCAST_IDS else lambda df: df
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_text"))
    kept = keyed.join(some(odd), same, "left_anti")
    twice = odd.where("kept and rows > 1")
    if not twice.isEmpty():
        kept = kept.union(keyed.join(some(twice), same, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.drop(key)
