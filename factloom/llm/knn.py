"""Exact top-k search by inner product: a Voronoi join.

Vectors become whole numbers, ``floor(SCALE * x)``. Pivots, the centres of a
bounded sample, cut the space into cells; each vector knows its cell and its
distance to that cell's pivot.

1. Summaries: the data vectors nearest to every pivot. Each query scores all of
   them; its Kth best score there is one that its answer reaches.
2. Bounds: for a cell C of queries with pivot c and radius r, and a data vector x
   of a cell with pivot p, the score of any query q of C is at most
   ``c.x + max((q - c).p) + r * |x - p|``. The maxima, one for each pair of a
   query cell and a pivot, and the least score that a query of C must reach are
   gathered in one pass over the queries.
3. Groups: a data vector goes to the cells of queries whose bound it reaches.
   Cells are merged while sending what they share once costs less than comparing
   all queries of both to all that either needs, estimated on a bounded sample;
   the merge changes the work, never the result. Where nothing can be pruned all
   cells become few groups; where data are clustered each stays alone.
4. A group's queries are held by a task, at most ``GROUP_QUERIES``; its data
   stream past them in chunks of at most ``CHUNK_ROWS`` rows. A query goes to as
   many chunks as its own group has. The bests of chunks are merged by rank.

Equal data vectors cannot crowd a task: chunks are dealt by id.

Defined cases: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; vectors of different lengths are not compared;
rows that repeat an id compete each as data, but are one query (that with the
smallest vector); equal scores go by the smaller id; components and scores beyond
64 bits are cut to them; a table without queries or data gives no rows; columns
other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import pieces, written

K = 10
SCALE = 1024
#: Bounds: pivots and their bytes, queries of a group, and data rows of a chunk (fewer while there are idle cores).
MOST_PIVOTS, PIVOT_BYTES, GROUP_QUERIES, CHUNK_ROWS, LEAST_CHUNK = 512, 16_000_000, 32_768, 1_000_000, 8_192
#: Vectors that the merge of cells is estimated on; comparing a pair of vectors costs so much of sending one.
ESTIMATE_ROWS, PAIR_COST = 4096, 0.01
_EXACT = 2.0**53


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, dim, vec (array of long) of the rows that take part."""
    values = F.col("embedding")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.where(F.col("vec_id").isNotNull() & values.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size(values).alias("dim"),
        F.transform(values, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec"),
    )


def by_length(dims: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = dims.to_numpy()
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, rows, vectors.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots of a sample: far apart at first, then moved to the means of their cells."""
    chosen, apart = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < wanted and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(4):
        cell = ((pivots**2).sum(1) - 2 * sample @ pivots.T).argmin(axis=1)
        counts = np.bincount(cell, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return np.unique(pivots, axis=0)


@dataclass
class Pivots:
    """Pivots by vector length; a length without any has the zero vector."""

    by_dim: dict[int, np.ndarray]

    def of(self, dim: int) -> np.ndarray:
        return self.by_dim.get(dim, np.zeros((1, dim)))

    def nearest(self, dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots, x = self.of(dim), vectors.astype(np.float64)
        cell = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(axis=1)
        # from the difference itself: small distances don't survive the expanded form
        return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def choose_pivots(vectors: DataFrame, count: int) -> Pivots:
    wanted = min(MOST_PIVOTS, math.ceil(math.sqrt(count)))
    found: dict[int, list[np.ndarray]] = {}
    size = 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(4 * wanted)
    for row in sample.toLocalIterator():
        vector = np.array(row["vec"], np.float64)
        size += vector.nbytes
        if size <= PIVOT_BYTES:
            found.setdefault(row["dim"], []).append(vector)
    return Pivots({dim: centres(np.stack(x), wanted) for dim, x in found.items()})


def assigned(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """vec_id, dim, vec, and the cell and the distance to its pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cell, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, rows, matrix in by_length(batch.column(1), batch.column(2)):
                cell[rows], apart[rows] = pivots.nearest(dim, matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], names=["vec_id", "dim", "vec", "cell", "apart"])

    return vectors.mapInArrow(assign, "vec_id long, dim int, vec array<long>, cell int, apart double")


def summaries(data: DataFrame, queried: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length with queries: ids and vectors of the K + 1 data vectors nearest to every pivot."""
    place = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("apart", "vec_id"))
    rows = data.join(F.broadcast(queried.select("dim").distinct()), "dim", "left_semi").withColumn("place", place).where(F.col("place") <= K + 1)
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in rows.select("dim", "vec_id", "vec").toLocalIterator():
        found.setdefault(row["dim"], {})[row["vec_id"]] = np.array(row["vec"], np.float64)
    return {dim: (np.array(list(x)), np.stack(list(x.values()))) for dim, x in found.items()}


@dataclass
class Cells:
    """The cells of one length that hold queries, and what data must reach for them."""

    dim: int
    cells: np.ndarray
    queries: np.ndarray
    radii: np.ndarray
    reach: np.ndarray
    towards: np.ndarray
    """``towards[i, p]``: the greatest product of a query's difference from its pivot with pivot p."""
    group: np.ndarray

    def needed(self, pivots: np.ndarray, x: np.ndarray, cell: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """needed[i, c]: whether row i may be in the answer of a query of cell c."""
        own = pivots[self.cells]
        bound = x @ own.T + self.towards[:, cell].T + apart[:, None] * self.radii
        size = np.sqrt((x**2).sum(1))[:, None] + np.sqrt((pivots[cell] ** 2).sum(1))[:, None]
        slack = 1e-9 * (size * (np.sqrt((own**2).sum(1)) + self.radii) + 1)
        return bound + slack >= self.reach


BOUNDS = "dim int, cell int, n long, radius double, reach double, towards array<double>"


def query_bounds(queries: DataFrame, pivots: Pivots, near: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """BOUNDS of each cell with queries, one row of bounded size for each."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in pieces(batches):
            ids, cells, aparts = (batch.column(k).to_numpy() for k in ("vec_id", "cell", "apart"))
            for dim, rows, matrix in by_length(batch.column("dim"), batch.column("vec")):
                x, points = matrix.astype(np.float64), pivots.of(dim)
                names, summary = near[dim]
                reach = np.full(len(x), -np.inf)
                if len(names) > K:
                    scores = x @ summary.T
                    # rounding in the products must not raise what has to be reached
                    scores -= 1e-9 * (np.sqrt((x**2).sum(1))[:, None] * np.sqrt((summary**2).sum(1)) + 1)
                    scores[names == ids[rows][:, None]] = -np.inf
                    reach = np.partition(scores, -K, axis=1)[:, -K]
                own = cells[rows]
                towards = (x - points[own]) @ points.T
                for c in np.unique(own).tolist():
                    at = np.flatnonzero(own == c)
                    _widen(found, (dim, c), [len(at), aparts[rows][at].max(), reach[at].min(), towards[at].max(axis=0)])
        yield _bounds_batch(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in pieces(batches):
            for row in batch.to_pylist():
                _widen(found, (row["dim"], row["cell"]), [row["n"], row["radius"], row["reach"], np.array(row["towards"])])
        yield _bounds_batch(found)

    # every task has bounds of its own; those of a cell meet before they go to the driver
    return queries.mapInArrow(bounds, BOUNDS).repartition("dim", "cell").mapInArrow(merged, BOUNDS)


def _widen(found: dict[tuple[int, int], list], key: tuple[int, int], part: list) -> None:
    if old := found.get(key):
        part = [old[0] + part[0], max(old[1], part[1]), min(old[2], part[2]), np.maximum(old[3], part[3])]
    found[key] = part


def _bounds_batch(found: dict[tuple[int, int], list]) -> pa.RecordBatch:
    rows = [{"dim": d, "cell": c, "n": v[0], "radius": v[1], "reach": v[2], "towards": v[3].tolist()} for (d, c), v in found.items()]
    kinds = [("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("reach", pa.float64()), ("towards", pa.list_(pa.float64()))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def cells_of(bounds: DataFrame) -> dict[int, Cells]:
    found: dict[int, dict[int, list]] = {}
    for row in bounds.toLocalIterator():
        found.setdefault(row["dim"], {})[row["cell"]] = [row["n"], row["radius"], row["reach"], np.array(row["towards"])]
    out = {}
    for dim, mine in found.items():
        order = sorted(mine)
        columns = [np.array([mine[c][i] for c in order]) for i in range(4)]
        out[dim] = Cells(dim, np.array(order), columns[0], columns[1], columns[2], columns[3].reshape(len(order), -1), np.arange(len(order)))
    return out


def merge_cells(needed: np.ndarray, queries: np.ndarray, rows: float) -> np.ndarray:
    """Group number of each cell. ``needed`` tells which of a sample's vectors each cell
    needs, ``rows`` how many vectors each of the sample stands for."""
    group = np.arange(len(queries))
    live = group.tolist()
    need, asked = needed.T.astype(np.float32), queries.astype(np.float64)
    sent = need.sum(axis=1) * rows
    while len(live) > 1:
        at = np.array(live)
        both = (need[at] @ need[at].T) * rows
        union = sent[at][:, None] + sent[at] - both
        total = asked[at][:, None] + asked[at]
        alone = sent[at] * (1 + PAIR_COST * asked[at])
        gain = alone[:, None] + alone - union * (1 + PAIR_COST * total)
        gain[total > GROUP_QUERIES] = -np.inf
        np.fill_diagonal(gain, -np.inf)
        # every cell's best partner; pairs that share none are merged at once
        used: set[int] = set()
        order = np.argsort(-gain.max(axis=1), kind="stable")
        for i in order.tolist():
            j = int(gain[i].argmax())
            if gain[i, j] >= 0 and i not in used and j not in used:
                a, b = sorted((live[i], live[j]))
                group[group == b] = a
                need[a] = np.maximum(need[a], need[b])
                asked[a] += asked[b]
                sent[a] = need[a].sum() * rows
                used |= {i, j}
        if not used:
            break
        live = sorted(set(group.tolist()))
    return np.unique(group, return_inverse=True)[1]


@dataclass
class Plan:
    """What is sent where: pivots, cells by vector length, and the data rows of each group."""

    data: DataFrame
    queries: DataFrame
    pivots: Pivots
    cells: dict[int, Cells]

    def groups(self) -> list[tuple[int, int]]:
        """(dim, group) of every group; a group's number is its place here."""
        return [(dim, g) for dim, c in sorted(self.cells.items()) for g in range(int(c.group.max()) + 1)]

    def sent(self) -> DataFrame:
        """grp, vec_id, vec: each data vector once for each group that may need it."""
        pivots, cells, number = self.pivots, self.cells, {g: i for i, g in enumerate(self.groups())}

        def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                cell, apart = batch.column("cell").to_numpy(), batch.column("apart").to_numpy()
                for dim, rows, matrix in by_length(batch.column("dim"), batch.column("vec")):
                    if dim not in cells:
                        continue
                    mine = cells[dim]
                    needed = mine.needed(pivots.of(dim), matrix.astype(np.float64), cell[rows], apart[rows])
                    for g in range(int(mine.group.max()) + 1):
                        chosen = pa.array(rows[needed[:, mine.group == g].any(axis=1)])
                        if n := len(chosen):
                            columns = [batch.column("vec_id").take(chosen), batch.column("vec").take(chosen)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number[dim, g], np.int32)), *columns], names=["grp", "vec_id", "vec"])

        return self.data.mapInArrow(replicate, "grp int, vec_id long, vec array<long>")

    def replication(self) -> float:
        """Data rows sent over all data rows."""
        return self.sent().count() / max(1, self.data.count())


def plan(table: DataFrame, queries_every: int = 100) -> Plan:
    vectors = whole_vectors(table)
    count = vectors.count()
    pivots = choose_pivots(vectors, count)
    data = written(assigned(vectors, pivots), "assigned")
    queries = data.where(F.col("vec_id") % queries_every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "dim", "cell", "apart")).alias("v"))
    queries = written(queries.select("vec_id", "v.vec", "v.dim", "v.cell", "v.apart"), "queries")
    cells = cells_of(query_bounds(queries, pivots, summaries(data, queries)))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ESTIMATE_ROWS).select("dim", "vec", "cell", "apart").collect() if cells else []
    for dim, mine in cells.items():
        rows = [r for r in sample if r["dim"] == dim]
        if rows:
            x, cell, apart = (np.array([r[k] for r in rows]) for k in ("vec", "cell", "apart"))
            mine.group = merge_cells(mine.needed(pivots.of(dim), x.astype(np.float64).reshape(len(rows), dim), cell, apart), mine.queries, count / len(sample))
    return Plan(data, queries, pivots, cells)


class Best:
    """The K best of a group's queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.floats = ids, vectors, vectors.astype(np.float64)
        self.most = float(np.abs(self.floats).max(initial=0))
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, names: np.ndarray, data: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(self.ids)))
        for at in range(0, len(names), step):
            part, scores = names[at : at + step], self.scores(data[at : at + step])
            query, row = np.nonzero((scores >= self.least[:, None]) & (part != self.ids[:, None]))
            self.held.append((query, part[row], scores[query, row]))
            self.size += len(query)
            if self.size > 2 * K * len(self.ids) + 100_000:
                self.shrink()

    def scores(self, data: np.ndarray) -> np.ndarray:
        """``products`` with the queries, whose floats are made once."""
        floats = data.astype(np.float64)
        if data.shape[1] * self.most * float(np.abs(floats).max(initial=0)) < _EXACT:
            return (self.floats @ floats.T).astype(np.int64)
        return products(self.vectors, data)

    def shrink(self) -> None:
        query, names, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((names, ~scores, query))  # ~ turns the order without overflow
        query, names, scores = query[order], names[order], scores[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        self.least[query[place == K - 1]] = scores[place == K - 1]
        kept = place < K
        self.held = [(query[kept], names[kept], scores[kept])]
        self.size = int(kept.sum())

    def rows(self) -> pa.RecordBatch:
        if self.held:
            self.shrink()
        query, names, scores = self.held[0] if self.held else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(names), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, part, chunk, data, vec_id, vec) in order: a group's queries, then its data."""
    key, best, asked = None, None, []
    for batch in pieces(batches):
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("grp", "part", "chunk", "data")], axis=1)
        ids, vectors = batch.column("vec_id").to_numpy(), batch.column("vec")
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own, is_data = tuple(keys[lo, :3].tolist()), keys[lo, 3]
            if own != key:
                if best is not None:
                    yield best.rows()
                key, best, asked = own, None, []
            part = vectors.slice(lo, hi - lo)
            matrix = part.flatten().to_numpy().reshape(hi - lo, -1)
            if not is_data:
                asked.append((ids[lo:hi], matrix))
                continue
            if best is None and asked:
                best = Best(*(np.concatenate(x) for x in zip(*asked, strict=True)))
            if best is not None:
                best.offer(ids[lo:hi], matrix)
    if best is not None:
        yield best.rows()


def top_k(table: DataFrame, queries_every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``queries_every``."""
    spark = table.sparkSession
    found = plan(table, queries_every)
    number = {g: i for i, g in enumerate(found.groups())}
    sent = written(found.sent(), "sent")
    sizes = {r["grp"]: r["count"] for r in sent.groupBy("grp").count().collect()}
    rows = min(CHUNK_ROWS, max(LEAST_CHUNK, sum(sizes.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    homes, works = [], []
    for dim, mine in found.cells.items():
        for g in range(int(mine.group.max()) + 1):
            n = number[dim, g]
            # one cell may hold more queries than a group: parts of it are solved apart
            work = n, max(1, -(-int(mine.queries[mine.group == g].sum()) // GROUP_QUERIES)), max(1, -(-sizes.get(n, 0) // rows))
            works.append(work)
            homes += [(dim, int(c), *work) for c in mine.cells[mine.group == g]]
    homes = spark.createDataFrame(homes, "dim int, cell int, grp int, parts int, chunks int")
    works = spark.createDataFrame(works, "grp int, parts int, chunks int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = found.queries.join(F.broadcast(homes), ["dim", "cell"]).select(
        "grp", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), upto("chunks").alias("chunk"), F.lit(False).alias("data"), "vec_id", "vec"
    )
    offered = sent.join(F.broadcast(works), "grp").select(
        "grp", upto("parts").alias("part"), F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.lit(True).alias("data"), "vec_id", "vec"
    )
    local = (
        asked.union(offered)
        .repartition("grp", "part", "chunk")
        .sortWithinPartitions("grp", "part", "chunk", "data")
        .mapInArrow(_solve, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
