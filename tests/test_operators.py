import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.functions import classify, text
from factloom.operators import aggregate, dedup, graph, rank, resolve, setcmp


def random_edges(seed, nodes=40, n=90):
    random.seed(seed)
    return sorted({(f"n{random.randrange(nodes)}", f"n{random.randrange(nodes)}") for _ in range(n)})


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_has_least_depths(spark, seed):
    edges = random_edges(seed)
    found = graph.reachable(spark.createDataFrame(edges, "a string, b string"), "a", "b", spark.createDataFrame([("n0",), ("n1",)], "start string"), 4).collect()
    want = {}
    for start in ("n0", "n1"):
        depth, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for a, b in edges:
                if a == x and b not in depth and depth[x] < 4:
                    depth[b] = depth[x] + 1
                    queue.append(b)
        want |= {(start, n): d for n, d in depth.items()}
    assert {(r["start"], r["node"]): r["depth"] for r in found} == want and len(found) == len(want)


def brute_chains(edges, start, entries, bounds, max_depth, max_nodes):
    """The search, one node at a time in queue order."""
    up = {}
    for caller, target, confidence in edges:
        if caller != target:
            up.setdefault(target, []).append((-confidence, caller))
    depth, child, ended, queue, cut = {start: 0}, {}, {}, deque([start]), False
    while queue:
        x = queue.popleft()
        if x != start and x in entries:
            ended[x] = "entry"
        elif depth[x] >= max_depth:
            ended[x] = "depth_capped"
        elif not up.get(x):
            ended[x] = "plugin_boundary" if x in bounds else "no_static_caller"
        else:
            fresh = [c for _, c in sorted(up[x]) if c not in depth]
            if not fresh:
                ended[x] = "callers_all_visited"
            for c in fresh:
                if len(depth) >= max_nodes:
                    cut = True
                    break
                depth[c], child[c] = depth[x] + 1, x
                queue.append(c)
    return ended, child, cut


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_entry_chains_equal_the_queue(spark, seed):
    pairs = random_edges(seed, 30, 70)
    edges = [(a, b, random.choice([0.6, 0.95, 1.0])) for a, b in pairs]
    entries, bounds = {"n3", "n7", "n9"}, {"n1", "n2", "n4", "n8"}
    df = spark.createDataFrame([(a, b, c, c < 0.9) for a, b, c in edges], "caller string, target string, confidence double, heuristic boolean")
    one = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "node string")
    found, cut = graph.entry_chains(df, "n0", one(entries), one(bounds), max_depth=4, max_nodes=400)
    ended, child, was_cut = brute_chains(edges, "n0", entries, bounds, 4, 400)
    rows = found.collect()
    assert {r["node"]: r["terminal"] for r in rows if r["terminal"]} == ended and cut == was_cut
    assert {r["node"]: r["child"] for r in rows if r["child"]} == child
    ends = found.where("terminal = 'entry'")
    for r in graph.chain_hops(found, ends).collect():
        hops, x = [r["node"]], r["node"]
        while x in child:
            x = child[x]
            hops.append(x)
        assert r["hops"] == hops


def test_entry_chains_stop_at_the_node_cap(spark):
    df = spark.createDataFrame([(f"c{i:03}", "n0", 1.0, False) for i in range(30)], "caller string, target string, confidence double, heuristic boolean")
    none = spark.createDataFrame([], "node string")
    found, cut = graph.entry_chains(df, "n0", none, none, max_nodes=10)
    assert cut and found.count() == 10 and {r["node"] for r in found.collect()} == {"n0", *(f"c{i:03}" for i in range(9))}


def test_fixpoint_needs_all_callers_to_agree(spark):
    edges = [("s1", "a"), ("s1", "b"), ("s2", "b"), ("a", "c"), ("?", "d"), ("a", "d"), ("c", "e"), ("e", "f"), ("f", "e")]
    seeds = [("s1", "x"), ("s2", "y")]
    found = graph.agree_fixpoint(spark.createDataFrame(edges, "p string, q string"), "p", "q", spark.createDataFrame(seeds, "node string, value string"))
    assert {r["node"]: (r["value"], r["depth"]) for r in found.collect()} == {"s1": ("x", 0), "s2": ("y", 0), "a": ("x", 1), "c": ("x", 2)}


def test_closure_prefers_near_bases_and_ends_on_cycles(spark):
    parents = [("A", "B"), ("B", "Base1"), ("A", "Base2"), ("C", "D"), ("D", "C"), ("E", "A"), ("F", None)]
    found = graph.closure_to_bases(spark.createDataFrame(parents, "c string, p string"), "c", "p", spark.createDataFrame([("Base1",), ("Base2",)], "base string"), 12)
    assert {r["node"]: (r["base"], r["depth"]) for r in found.collect()} == {"A": ("Base2", 1), "B": ("Base1", 1), "E": ("Base2", 2)}


def test_registration_is_tri_state(spark):
    rows = [("a", True), ("a", False), ("b", False), ("b", False), ("c", None), ("c", False)]
    found = graph.registration_status(spark.createDataFrame([(x,) for x in "abcd"], "k string"), "k", spark.createDataFrame(rows, "k string, on boolean"), "on")
    assert {r["k"]: r["status"] for r in found.collect()} == {"a": "registered_enabled", "b": "registered_disabled", "c": "registered_enabled_unknown", "d": "no_registration"}


def test_coverage_counts_null_safe(spark):
    universe = spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "b"), ("g", "c"), ("g", None), (None, "z")], "form string, key string")
    touched = spark.createDataFrame([("f", "a"), ("f", "a"), ("x", "c")], "form string, key string")
    found = {r["form"]: (r["total"], r["t"]) for r in setcmp.coverage(universe, "form", "key", {"t": touched}).collect()}
    assert found == {"f": (2, 1), "g": (1, 0), None: (1, 0)}


def test_scan_buckets_partition_the_universe(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "k int")
    found = setcmp.compare_scans(ids(range(20)), "k", ids([1, 2, 2, 99]), ids([2, 3])).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in found} == {"both": 1, "high_only": 1, "coarse_only": 1, "neither": 17}


def test_links_and_constants(spark):
    targets = spark.createDataFrame([("a.X", "X"), ("b.Y", "Y"), ("c.Y", "Y")], "full string, simple string")
    refs = spark.createDataFrame([("a.X", "X"), ("q.X", "X"), ("q.Y", "Y"), ("q.Z", "Z"), ("kd.bos.T", "T"), (None, None)], "full string, simple string")
    found = resolve.tiered_link(refs, "full", "simple", targets, resolve.external_rules(F.col("full"), F.lit("project")).isNotNull())
    assert {r["full"]: (r["status"], r["target"]) for r in found.collect()} == {
        "a.X": ("linked", "a.X"), "q.X": ("linked_by_name", "a.X"), "q.Y": ("ambiguous", None), "q.Z": ("missing", None), "kd.bos.T": ("external", None), None: ("external", None)
    }
    defs = spark.createDataFrame([("A", "K", "1"), ("B", "K", "2"), ("A", "L", "3"), ("C", "M", "4"), ("C", "M", "5")], "c string, n string, v string")
    asked = spark.createDataFrame([("A", "K"), (None, "K"), ("Z", "L"), ("C", "M"), ("A", "Q")], "c string, n string")
    got = {(r["c"], r["n"]): (r["resolution"], r["value"], r["confidence"]) for r in resolve.resolve_constants(asked, defs, "c", "n", "v").collect()}
    assert got == {("A", "K"): ("class", "1", 0.95), (None, "K"): ("ambiguous", None, 0.3), ("Z", "L"): ("unique_name", "3", 0.85), ("C", "M"): ("ambiguous", None, 0.3), ("A", "Q"): ("unknown", None, 0.0)}


def test_unique_match_uses_the_column_only_for_ties(spark):
    rows = spark.createDataFrame([("f", 1, 5), ("f", 2, 5), ("f", 2, 9), ("f", 3, 1)], "p string, line int, col int")
    sites = spark.createDataFrame([("f", 1, 7, "one"), ("f", 2, 5, "left"), ("f", 2, 8, "right")], "p string, line int, col int, s string")
    found = {(r["line"], r["col"]): r["s"] for r in resolve.unique_match(rows, sites, ["p", "line"], "col").collect()}
    assert found == {(1, 5): "one", (2, 5): "left", (2, 9): None, (3, 1): None}


def test_dedup_merges_grades(spark):
    rows = spark.createDataFrame([("k", 2, "b", "s"), ("k", 1, "a", "h"), ("m", 1, "c", "l")], "key string, o int, v string, g string")
    found = dedup.keep_first(rows, ["key"], ["o"], F.col("g") == "s", F.col("g") == "h").collect()
    assert {(r["key"], r["v"], r["edge_source"]) for r in found} == {("k", "a", "mixed"), ("m", "c", "local")}


def test_caps_report_what_they_leave_out(spark):
    rows = spark.range(25).select((F.col("id") % 2).alias("g"), "id")
    top = rank.with_totals(rank.top_per_group(rows, ["g"], [F.col("id")], 5), rows, ["g"], 5)
    assert {(r["g"], r["total"], r["capped"]) for r in top.collect()} == {(0, 13, 8), (1, 12, 7)} and top.count() == 10
    merged = aggregate.merge_sites(rows, ["g"], [F.col("id")], F.col("id").cast("string"), 2).collect()
    assert {(r["g"], r["sites"], r["capped"]) for r in merged} == {(0, "0|2", 11), (1, "1|3", 10)}


def test_budget_pages():
    assert rank.pages_by_budget([3, 3, 3, 10, 1], 6) == [0, 0, 1, 2, 3]
    assert rank.parse_cursor("a@12") == ("a", 12) and rank.parse_cursor("a@x") == ("a", 0) and rank.parse_cursor(None) == ("", 0)
    with pytest.raises(ValueError):
        rank.strict_cursor("a@x")


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert tuple(get(text.locator(lit("f.e.s.k")))) == ("k", "f", "s", "subentry") and tuple(get(text.locator(lit("k")))) == ("k", None, None, None)
    assert get(text.simple_type(lit("java.util.Map<String, List<a.B>>[]"))) == "Map" and get(text.simple_type(lit("? "))) is None
    assert get(text.package_prefixes(lit("a.b.c"))) == ["a", "a.b", "a.b.c"] and get(text.last_segment(lit("a.b.C$D"))) == "D"
    assert get(text.constant_refs(lit("A.KEY b.x C.LONG_KEY"))) == ["A.KEY", "C.LONG_KEY"] and get(text.line_of(lit("a\nb\nc"), lit(4))) == 3
    assert get(text.clipped(lit("abcdef"), 3)) == "abc…" and get(text.search_tokens(lit("Él_gato-9"))) == ["el", "gato", "9"]
    assert get(text.is_access_idiom(lit('this.getModel().setValue(Keys.'))) is True and get(text.is_access_idiom(lit("foo("))) is False


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((True, "memory", None, False), ("yes", 0.85)), ((False, "transaction", "save", True), ("yes", 0.9)), ((False, "transaction", "donothing", False), ("no", 0.7)),
        ((False, "transaction", "donothing", True), ("unknown", 0.3)), ((False, "transaction", None, False), ("unknown", 0.4)), ((None, "build", None, True), ("yes", 0.6)),
        ((False, "memory", None, False), ("no", 0.7)), ((False, "validate", None, False), ("no", 0.6)), ((False, "none", None, True), ("unknown", 0.3)), ((False, "x", None, False), ("unknown", 0.3)),
    ],
)
def test_persistence_table(spark, args, want):
    kinds = ("boolean", "string", "string", "boolean")
    columns = [F.lit(a).cast(k) for a, k in zip(args, kinds, strict=True)]
    assert tuple(spark.range(1).select(classify.persistence(*columns).alias("v")).first()["v"]) == want


def test_small_classifiers(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [get(classify.tri_state(lit(v))) for v in (" TRUE", "0", "maybe")] == [True, False, None]
    assert get(classify.orphan_role(lit(False), lit("a.consts.K"))) == "constant" and get(classify.orphan_role(lit(False), lit("a.MyConst"))) == "constant"
    assert [get(classify.level_by_arguments(lit("write"), lit(n))) for n in (2, 3, 4, 5)] == ["header", "entry", "subentry", "unknown"]
    assert get(classify.module_health(lit(None).cast("double"), lit(0))) == "warn" and get(classify.bridge_trust(lit(0.9), lit(1), lit(0))) == "ok"
    assert get(classify.field_kind(lit("TextField"), lit(False), lit(True), lit(None).cast("string"), lit("c"), lit("bill"))) == "inherited"


def test_majority_and_intersection(spark):
    rows = spark.createDataFrame([("f", "m2"), ("f", "m1"), ("f", "m2"), ("g", "b"), ("g", "a")], "g string, v string")
    assert {(r["g"], r["v"], r["votes"]) for r in rank.majority(rows, ["g"], "v", [F.col("v")]).collect()} == {("f", "m2", 2), ("g", "a", 1)}
    cand = spark.createDataFrame([("r", "k1", "A"), ("r", "k1", "B"), ("r", "k2", "B"), ("s", "k1", "A"), ("s", "k1", "B")], "g string, k string, c string")
    assert [tuple(r) for r in resolve.only_candidate(cand, ["g"], "c", "k").collect()] == [("r", "B")]


def test_closure_follows_long_and_cyclic_chains_to_the_end(spark):
    parents = [("c0", "Base"), *((f"c{i}", f"c{i - 1}") for i in range(1, 16)), ("c3", "c9"), ("x", "y"), ("y", "x")]
    found = graph.closure_to_bases(spark.createDataFrame(parents, "c string, p string"), "c", "p", spark.createDataFrame([("Base",)], "base string"))
    assert {(r["node"], r["base"], r["depth"]) for r in found.collect()} == {(f"c{i}", "Base", i + 1) for i in range(16)}
