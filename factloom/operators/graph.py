"""Traversals of call and trigger graphs, level by level.

Edges are written once to the shared folder, and so is every level, so plans stay
short and survive lost executors. Only counts reach the driver, and for the search
of entry chains, whose nodes are capped, its nodes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.storage import written, written_counted

#: Order of chain ends: what proves an entry comes first.
TERMINALS = ["entry", "plugin_boundary", "no_static_caller", "depth_capped", "callers_all_visited"]
MAX_DEPTH, MAX_NODES, MAX_CHAINS = 10, 400, 6


def representative_edges(edges: DataFrame, caller: list[str], target: list[str], confidence: str, tie: list[str]) -> DataFrame:
    """One edge per caller and target: the most confident, then the first by ``tie``;
    with the number of call sites. Edges of a node to itself do not count."""
    own = F.lit(True)
    for c, t in zip(caller, target, strict=True):
        own = own & F.col(c).eqNullSafe(F.col(t))
    rest = [c for c in edges.columns if c not in (*caller, *target, confidence)]
    best = F.min(F.struct((-F.col(confidence)).alias("neg"), *tie, *(c for c in rest if c not in tie))).alias("best")
    return (
        edges.where(~own)
        .groupBy(*caller, *target)
        .agg(best, F.count("*").alias("sites"))
        .select(*caller, *target, (-F.col("best.neg")).alias(confidence), *(F.col("best")[c].alias(c) for c in rest), "sites")
    )


def reachable(edges: DataFrame, src: str, dst: str, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth): nodes within ``max_depth`` steps of each start along src -> dst,
    with the least number of steps. ``starts`` has ``start`` (also a node)."""
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("node is not null and to is not null and node <> to").distinct()
    steps = written(steps, "steps")
    seen = frontier = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    for depth in range(1, max_depth + 1):
        new = (
            frontier.join(steps, "node")
            .select("start", F.col("to").alias("node"))
            .distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier, n = written_counted(new, "level")
        if not n:
            break
        seen = seen.union(frontier)
    return seen


def walks(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth, path, symbol, heuristic): ``reachable`` with a shortest path to each
    node (the first by the nodes' names), and whether any of its steps is a symbol's or a
    guess. ``edges`` has (a, b, symbol, heuristic); of equal steps the surest counts."""
    steps = edges.where("a is not null and b is not null and a <> b").groupBy(F.col("a").alias("node"), F.col("b").alias("to"))
    steps = written(steps.agg(F.min(F.struct("heuristic", "symbol")).alias("how")), "steps")
    first = starts.select("start", F.col("start").alias("node")).distinct()
    no = F.lit(False)
    frontier = written(first.withColumns({"depth": F.lit(0), "path": F.array("start"), "symbol": no, "heuristic": no}), "level")
    seen = frontier
    for depth in range(1, max_depth + 1):
        further = frontier.join(steps, "node").join(seen.select("start", F.col("node").alias("to")), ["start", "to"], "left_anti")
        best = F.min(F.struct("path", F.col("symbol") | F.col("how.symbol"), F.col("heuristic") | F.col("how.heuristic"))).alias("best")
        new = further.groupBy("start", "to").agg(best).select(
            "start", F.col("to").alias("node"), F.lit(depth).alias("depth"), F.array_append("best.path", F.col("to")).alias("path"),
            F.col("best")["col2"].alias("symbol"), F.col("best")["col3"].alias("heuristic"),
        )
        frontier, n = written_counted(new, "level")
        if not n:
            break
        seen = seen.union(frontier)
    return seen


def callers_of(edges: DataFrame, caller: str, target: str, start: str, max_depth: int) -> DataFrame:
    """(node, depth) of everything that calls ``start``, directly or not."""
    first = edges.sparkSession.createDataFrame([(start,)], "start string")
    return reachable(edges, target, caller, first, max_depth).select("node", "depth")


def closure_to_bases(parents: DataFrame, child: str, parent: str, bases: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, base, depth): the nearest base above each node, itself excluded; a direct
    base wins over farther ones, the smaller name on ties. Without ``max_depth``, to the end.

    A round doubles the distance: a node without a base so far takes the nearest one of its
    ancestors at exactly that distance. Whoever is above a node that is found later is found
    in between, so a round without a find is the last, and cycles end too.
    """
    steps = parents.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("up is not null and node <> up").distinct()
    steps = written(steps, "steps")
    known = bases.select(F.col("base").alias("up")).distinct()
    found = written(steps.join(known, "up").groupBy("node").agg(F.min("up").alias("base")).withColumn("depth", F.lit(1)), "closure")
    reach, distance = written(steps.join(found.select("node"), "node", "left_anti"), "reach"), 1
    while max_depth is None or distance < max_depth:
        above = found.select(F.col("node").alias("up"), "base", (F.col("depth") + distance).alias("depth"))
        best = reach.join(above, "up").groupBy("node").agg(F.min(F.struct("depth", "base")).alias("b")).select("node", "b.base", "b.depth")
        new, n = written_counted(best if max_depth is None else best.where(F.col("depth") <= max_depth), "closure")
        if not n:
            break
        # from nodes that are still open, over any that were when the round began
        further = reach.select(F.col("node").alias("up"), F.col("up").alias("to"))
        still = reach.join(new.select("node"), "node", "left_anti").join(further, "up")
        reach = written(still.select("node", F.col("to").alias("up")).distinct(), "reach")
        found = found.union(new)
        distance *= 2
    return found


def agree_fixpoint(edges: DataFrame, caller: str, target: str, seeds: DataFrame) -> DataFrame:
    """(node, value, depth): a node without a seed takes its callers' value if **all** of
    its call sites have one and the same; unknown or differing callers give none.

    Every open node keeps its number of call sites, of those with a value, and the least and
    greatest value; a round adds what the nodes settled in the round before bring, until a
    round settles none.
    """
    sites = written(edges.select(F.col(caller).alias("from"), F.col(target).alias("node")).where("node is not null"), "sites")
    known = written(seeds.select("node", "value", F.lit(0).alias("depth")), "fixpoint")
    none = F.lit(None)
    state = sites.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.count("*").alias("sites"))
    kind = known.schema["value"].dataType
    state = state.withColumns({"valued": F.lit(0).cast("long"), "low": none.cast(kind), "high": none.cast(kind), "depth": F.lit(0), "settled": none.cast("int")})
    fresh = known
    for turn in count(1):
        brought = sites.join(fresh.select(F.col("node").alias("from"), "value", "depth"), "from").groupBy("node").agg(
            F.count("value").alias("more"), F.min("value").alias("least"), F.max("value").alias("most"), F.max("depth").alias("deep")
        )
        joined = state.join(brought, "node", "left").select(
            "node", "sites", (F.col("valued") + F.coalesce("more", F.lit(0))).alias("valued"), F.least("low", "least").alias("low"),
            F.greatest("high", "most").alias("high"), F.greatest("depth", F.col("deep") + 1).alias("depth"), "settled",
        )
        agree = F.col("settled").isNull() & (F.col("valued") == F.col("sites")) & (F.col("low") == F.col("high"))
        found = Observation()
        now = joined.withColumn("settled", F.when(agree, F.lit(turn)).otherwise(F.col("settled")))
        state = written(now.observe(found, F.count_if(F.col("settled") == turn).alias("n")), "fixpoint")
        if not found.get["n"]:
            break
        fresh = state.where(F.col("settled") == turn).select("node", F.col("low").alias("value"), "depth")
    return known.union(state.where("settled is not null").select("node", F.col("low").alias("value"), "depth"))


def entry_chains(
    edges: DataFrame,
    start: str,
    entries: DataFrame,
    boundaries: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_nodes: int = MAX_NODES,
) -> tuple[DataFrame, bool]:
    """Upward search from ``start`` to entry methods.

    ``edges`` has (caller, target, confidence, heuristic, line), one row for each pair;
    ``entries`` and ``boundaries`` have ``node``. Returns (node, depth, child, heuristic,
    terminal) — terminal is null where the search went on — and whether the node cap cut it.

    In each level a new caller belongs to the first of its nodes in search order; nodes
    are ordered by their child's order, falling confidence and name. Entries end a branch.
    The search has at most ``max_nodes`` nodes, which the driver keeps; of the callers of a
    level, however many, it gets the first that there is room for.
    """
    spark: SparkSession = edges.sparkSession
    up = written(edges.select("caller", "target", "confidence", "heuristic").where("caller is not null and caller <> target"), "edges")
    marks, bounds = (written(x.select("node").distinct(), "marks") for x in (entries, boundaries))

    def among(df: DataFrame, column: str, names: list[str]) -> set[str]:
        return {r[0] for r in df.where(F.col(column).isin(names)).select(column).distinct().collect()} if names else set()

    level: list[tuple[str, str | None, bool]] = [(start, None, False)]
    seen, ended, truncated = {start}, [], False
    for depth in range(max_depth + 1):
        names = [n for n, _, _ in level]
        at_entry = among(marks, "node", names) if depth else set()
        going = [n for n in names if n not in at_entry] if depth < max_depth else []
        called = among(up, "target", going)
        alone = among(bounds, "node", [n for n in going if n not in called])
        chosen, room = [], max_nodes - len(seen)
        feeds: set[str] = set()
        if called:
            places = spark.createDataFrame([(n, i) for i, n in enumerate(names) if n in called], "target string, place int")
            fresh = up.join(F.broadcast(places), "target").where(~F.col("caller").isin(list(seen)))
            first = fresh.groupBy("caller").agg(F.min(F.struct("place", (-F.col("confidence")).alias("unsure"), "heuristic", "target")).alias("f"))
            chosen = first.select("caller", "f.*").orderBy("place", "unsure", "caller").limit(room + 1).collect()
            feeds = {r["target"] for r in chosen}
            if len(chosen) > room:
                truncated = True
                feeds = {r[0] for r in first.select("f.target").distinct().collect()}
        for name, child, guess in level:
            if name in at_entry:
                terminal = "entry"
            elif depth >= max_depth:
                terminal = "depth_capped"
            elif name not in called:
                terminal = "plugin_boundary" if name in alone else "no_static_caller"
            else:
                terminal = None if name in feeds else "callers_all_visited"
            ended.append((name, depth, child, guess, terminal))
        guesses = {n: g for n, _, g in level}
        level = [(r["caller"], r["target"], guesses[r["target"]] or r["heuristic"]) for r in chosen[:room]]
        if not level:
            break
        seen |= {n for n, _, _ in level}
    return spark.createDataFrame(ended, "node string, depth int, child string, heuristic boolean, terminal string"), truncated


def chain_confidence(terminal: Column, heuristic: Column) -> Column:
    """Confirmed if an entry is reached over resolved calls only, likely if any call is a
    guess or the end is a plugin class, else unknown."""
    return F.when(terminal == "entry", F.when(heuristic, "likely").otherwise("confirmed")).when(terminal == "plugin_boundary", "likely").otherwise("unknown")


def chain_hops(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(terminal node, hops): the nodes from each end down to the start. The paths are at
    most MAX_DEPTH long, so they are followed by as many joins."""
    rows = ends.select("node", F.array("node").alias("hops"), F.col("child").alias("next"))
    below = found.select(F.col("node").alias("next"), F.col("child").alias("after"))
    for _ in range(MAX_DEPTH):
        rows = rows.join(below, "next", "left").select(
            "node",
            F.when(F.col("next").isNotNull(), F.array_append("hops", F.col("next"))).otherwise(F.col("hops")).alias("hops"),
            F.col("after").alias("next"),
        )
    return rows.select("node", "hops")


def registration_status(classes: DataFrame, cls: str, bindings: DataFrame, enabled: str) -> DataFrame:
    """Per class: any binding enabled, all disabled, some unknown, or none at all.
    ``enabled`` is true, false or null (unknown), and null is not false."""
    flags = bindings.groupBy(cls).agg(
        F.count("*").alias("n"),
        F.max(F.coalesce(F.col(enabled), F.lit(False))).alias("any_on"),
        F.min(F.coalesce(~F.col(enabled), F.lit(False))).alias("all_off"),
    )
    status = (
        F.when(F.col("n").isNull(), "no_registration")
        .when(F.col("any_on"), "registered_enabled")
        .when(F.col("all_off"), "registered_disabled")
        .otherwise("registered_enabled_unknown")
    )
    return classes.select(cls).distinct().join(flags, cls, "left").select(cls, status.alias("status"))
