"""Engine operators applied to the driver's tables, with DuckDB equivalents.

The tables are not code and metadata, so each query maps columns of theirs onto
the roles of an operator; the operators are those that the knowledge-base plans
use, and every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify, text
from factloom.operators import aggregate, dedup, fts, graph, rank, resolve, setcmp

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Register a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# coverage and comparison


@query("""
SELECT c_nationkey, count(DISTINCT c_custkey) AS total, count(DISTINCT CASE WHEN o_custkey IS NOT NULL THEN c_custkey END) AS touched
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey""")
def coverage_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms are nations, fields customers, accesses orders."""
    touched = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return setcmp.coverage(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", {"touched": touched})


@query("""
WITH n AS (SELECT n_regionkey, c_custkey, max(CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 0 END) AS t
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT r_name, count(*) AS total, CAST(sum(t) AS BIGINT) AS touched FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)
SELECT *, round(touched / total, 4) AS rate, CASE WHEN touched / total >= 0.9 THEN 'good' WHEN touched / total >= 0.6 THEN 'ok' ELSE 'low' END AS verdict FROM r""")
def coverage_rollup_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms rolled up to modules (regions), with rate and verdict."""
    forms = coverage_by_form(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = forms.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    found = up.groupBy("r_name").agg(F.sum("total").alias("total"), F.sum("touched").alias("touched"))
    found = found.withColumn("rate", setcmp.rate(F.col("touched"), F.col("total")))
    return found.withColumn("verdict", setcmp.trust((F.col("touched") / F.col("total"), 0.9, 0.6)))


@query("""
SELECT p_brand, count(*) AS total, CAST(sum(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END) AS BIGINT) AS written,
  CAST(sum(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 1 ELSE 0 END) AS BIGINT) AS was_read
FROM part GROUP BY p_brand""")
def access_side_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields (parts) that are written or read, by entity (brand)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    sides = {"written": lines.where("l_returnflag = 'R'"), "was_read": lines.where("l_returnflag = 'A'")}
    return setcmp.coverage(table(spark, sf_dir, "part"), "p_brand", "p_partkey", sides)


@query("""
SELECT * FROM (SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', nullif(o_orderpriority, '1-URGENT'), count(*) FROM orders GROUP BY 2)""")
def quality_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return aggregate.breakdown(orders, "o_orderstatus", "o_orderpriority")


@query("""
WITH c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity <= 5), h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08)
SELECT CASE WHEN c.l_partkey IS NOT NULL AND h.l_partkey IS NOT NULL THEN 'both' WHEN c.l_partkey IS NOT NULL THEN 'coarse_only'
  WHEN h.l_partkey IS NOT NULL THEN 'high_only' ELSE 'neither' END AS bucket, count(*) AS keys
FROM part LEFT JOIN c ON c.l_partkey = p_partkey LEFT JOIN h ON h.l_partkey = p_partkey GROUP BY 1""")
def scan_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    found = setcmp.compare_scans(table(spark, sf_dir, "part"), "p_partkey", lines.where("l_discount > 0.08"), lines.where("l_quantity <= 5"))
    return found.groupBy("bucket").agg(F.count("*").alias("keys"))


@query("""
WITH l AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_quantity <= 5),
h AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_discount > 0.08),
open_ AS (SELECT * FROM l WHERE (l_partkey, l_suppkey, l_orderkey) NOT IN (SELECT l_partkey, l_suppkey, l_orderkey FROM h)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS total FROM open_)
SELECT l_partkey, total, string_agg(l_suppkey || ':' || l_orderkey, '|' ORDER BY k) AS places FROM r WHERE k <= 3 GROUP BY l_partkey, total""")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse hits without a precise one at the same place, constant classes excluded."""
    lines = table(spark, sf_dir, "lineitem")
    excluded = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return setcmp.blind_spots(
        lines.where("l_quantity <= 5"), lines.where("l_discount > 0.08"), "l_partkey", ["l_suppkey", "l_orderkey"], excluded, 3
    )


@query("""
SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = setcmp.orphans(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.095").withColumnRenamed("l_suppkey", "s_suppkey")
    suppliers = setcmp.orphans(table(spark, sf_dir, "supplier"), "s_suppkey", used)
    return customers.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).union(
        suppliers.select("s_suppkey", F.lit("supplier"))
    )


@query("""
SELECT p_partkey, p_name, brand FROM part JOIN
(SELECT p_name, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS brand FROM part GROUP BY p_name) USING (p_name)""")
def oid_reverse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference by name resolves only if the name has one brand."""
    part = table(spark, sf_dir, "part")
    one = setcmp.unique_reverse(part, "p_name", "p_brand").withColumnRenamed("p_brand", "brand")
    return part.select("p_partkey", "p_name").join(one, "p_name")


# resolution


@query("""
WITH cls AS (SELECT p_brand, p_name, min(p_type) AS v, count(DISTINCT p_type) AS n FROM part GROUP BY ALL),
nam AS (SELECT p_name, min(p_type) AS v, count(DISTINCT p_type) AS n FROM part GROUP BY ALL),
refs AS (SELECT DISTINCT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'NoClass' END AS p_brand,
  CASE WHEN p_partkey % 7 = 0 THEN p_name || '_x' ELSE p_name END AS p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))
SELECT p_partkey, CASE WHEN cls.n = 1 THEN 'class' WHEN cls.n > 1 THEN 'ambiguous' WHEN nam.n = 1 THEN 'unique_name' WHEN nam.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS resolution,
  CASE WHEN cls.n = 1 THEN cls.v WHEN cls.n IS NULL AND nam.n = 1 THEN nam.v END AS value, coalesce(cls.n, nam.n, 0) AS candidates,
  CASE WHEN cls.n = 1 THEN 0.95 WHEN cls.n > 1 THEN 0.3 WHEN nam.n = 1 THEN 0.85 WHEN nam.n > 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence
FROM refs LEFT JOIN cls USING (p_brand, p_name) LEFT JOIN nam USING (p_name)""")
def const_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants are (brand, name) = type; parts that were shipped refer to them."""
    part = table(spark, sf_dir, "part")
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    cls = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "NoClass")
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("_x"))).otherwise(F.col("p_name"))
    refs = part.join(shipped, "p_partkey", "left_semi").select("p_partkey", cls.alias("p_brand"), name.alias("p_name"))
    return resolve.resolve_constants(refs, part, "p_brand", "p_name", "p_type").drop("p_brand", "p_name")


@query("""
WITH t AS (SELECT DISTINCT p_partkey, p_name FROM part WHERE p_partkey % 4 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)),
s AS (SELECT p_name, min(p_partkey) AS named, count(*) AS n FROM t GROUP BY p_name),
r AS (SELECT p.p_partkey, p.p_type LIKE 'PROMO%' AS ext, t.p_partkey IS NOT NULL AS exact, s.named, coalesce(s.n, 0) AS candidates
  FROM part p LEFT JOIN t ON t.p_partkey = p.p_partkey LEFT JOIN s ON s.p_name = p.p_name),
q AS (SELECT *, CASE WHEN ext THEN 'external' WHEN exact THEN 'linked' WHEN candidates = 1 THEN 'linked_by_name' WHEN candidates > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM r)
SELECT p_partkey, status, CASE status WHEN 'linked' THEN p_partkey WHEN 'linked_by_name' THEN named END AS target, candidates,
  CASE status WHEN 'linked' THEN 1.0 WHEN 'linked_by_name' THEN 0.6 WHEN 'ambiguous' THEN 0.2 WHEN 'missing' THEN 0.0 END::DOUBLE AS confidence FROM q""")
def bridge_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    targets = part.where("p_partkey % 4 <> 0").join(used, "p_partkey", "left_semi")
    refs = part.select("p_partkey", "p_name", "p_type")
    return resolve.tiered_link(refs, "p_partkey", "p_name", targets, F.col("p_type").startswith("PROMO")).drop("p_name", "p_type")


@query("""
WITH k AS (SELECT o_orderkey, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
c AS (SELECT DISTINCT o_orderkey, l_partkey, s_nationkey FROM k JOIN supplier ON s_suppkey = l_suppkey),
n AS (SELECT o_orderkey, count(DISTINCT l_partkey) AS needed FROM c GROUP BY 1),
s AS (SELECT o_orderkey, s_nationkey, count(*) AS has FROM c GROUP BY ALL)
SELECT o_orderkey, min(s_nationkey) AS s_nationkey FROM s JOIN n USING (o_orderkey) WHERE has = needed GROUP BY o_orderkey HAVING count(*) = 1""")
def cooccur_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that could have supplied every part of an order, if exactly one is left."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    candidates = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return resolve.only_candidate(candidates, ["o_orderkey"], "s_nationkey", "l_partkey")


@query("""
WITH e AS (SELECT o_custkey AS id, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
  UNION ALL SELECT o_orderkey + 100000000, o_totalprice FROM (SELECT o_orderkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1))
SELECT id, bal, 0 AS side FROM e UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer WHERE c_custkey NOT IN (SELECT id FROM e)""")
def vendor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key of two sides; the extension's wins over the vendor's."""
    orders = table(spark, sf_dir, "orders")
    changed = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("bal"))
    added = orders.where("o_orderstatus <> 'F'").groupBy((F.col("o_orderkey") + 100000000).alias("id")).agg(F.max("o_totalprice").alias("bal"))
    vendor = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return resolve.merge_by_priority([changed.union(added), vendor], ["id"])


@query("""
WITH own AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), t AS (SELECT c_custkey, p FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders))
SELECT o_custkey, o_orderpriority, 'own' AS origin FROM own UNION ALL
SELECT c_custkey, p, 'template' FROM t WHERE (c_custkey, p) NOT IN (SELECT o_custkey, o_orderpriority FROM own)""")
def template_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer has its own priorities and those of the template that it lacks."""
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    # all customers have the one template; its members are joined by its number
    members = own.select(F.lit(1).alias("template"), "o_orderpriority").distinct()
    template = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("template"))
    template = template.join(members, "template").drop("template")
    return resolve.complete_from_template(own, template, ["o_custkey"], "o_orderpriority")


@query("""
WITH s AS (SELECT l_partkey AS id, 'ext' AS signal, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1
  UNION ALL SELECT l_partkey, 'orm', count(*) FROM lineitem WHERE l_discount > 0.09 GROUP BY 1 UNION ALL SELECT l_partkey, 'op', count(*) FROM lineitem WHERE l_tax > 0.07 GROUP BY 1)
SELECT id, CAST(coalesce(sum(hits) FILTER (WHERE signal = 'ext'), 0) AS BIGINT) AS ext, CAST(coalesce(sum(hits) FILTER (WHERE signal = 'orm'), 0) AS BIGINT) AS orm,
  CAST(coalesce(sum(hits) FILTER (WHERE signal = 'op'), 0) AS BIGINT) AS op, CAST(sum(hits) AS BIGINT) AS hits, coalesce(sum(hits) FILTER (WHERE signal = 'ext'), 0) > 0 AS leads FROM s GROUP BY id""")
def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "id")
    conditions = {"ext": "l_returnflag = 'R' and l_quantity > 45", "orm": "l_discount > 0.09", "op": "l_tax > 0.07"}
    signals = {n: lines.where(c).groupBy("id").agg(F.count("*").alias("hits")) for n, c in conditions.items()}
    return resolve.combine_signals(signals, "id", "ext")


@query("""
SELECT o_orderkey, o_orderstatus, 'old' AS origin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT o_orderkey, 'N', 'new' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-row replacement by key: orders of one nation come anew."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nation = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    new = orders.join(nation, "o_custkey", "left_semi").withColumns({"o_orderstatus": F.lit("N"), "origin": F.lit("new")})
    old = orders.withColumn("origin", F.lit("old"))
    return resolve.replace_by_key(old, new, ["o_custkey"]).select("o_orderkey", "o_orderstatus", "origin")


# order, groups, pages


@query("""
SELECT event_type, count(DISTINCT user_id) AS users, count(CASE WHEN value > 50 THEN 1 END) AS persisting FROM events GROUP BY event_type ORDER BY users DESC, event_type LIMIT 20""")
def hot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.hot(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value") > 50, 20)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
  max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER w AS s, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS h
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN s = 1 AND h = 1 THEN 'mixed' WHEN s = 1 THEN 'symbol' WHEN h = 1 THEN 'heuristic' ELSE 'local' END AS edge_source FROM r WHERE k = 1""")
def dedup_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    flag = F.col("l_returnflag")
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return dedup.keep_first(lines, ["l_orderkey", "l_linenumber"], order, flag == "A", flag == "R").drop("l_returnflag")


@query("""
WITH v AS (SELECT l_partkey, s_nationkey, count(*) AS votes FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT l_partkey, s_nationkey, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, s_nationkey) AS k FROM v) WHERE k = 1""")
def module_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rank.majority(rows, ["l_partkey"], "s_nationkey", [F.col("s_nationkey")])


@query("""
WITH l AS (SELECT nullif(l_linestatus, 'F') AS status, l_returnflag AS flag, l_linenumber AS line FROM lineitem)
SELECT status, flag, line, count(CASE WHEN flag <> 'N' THEN 1 END) AS writers, count(CASE WHEN flag = 'N' THEN 1 END) AS readers, status IS NOT NULL AS located FROM l GROUP BY ALL""")
def coord_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_linestatus", F.lit("F")).alias("status"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")
    )
    return aggregate.coordinates(rows, ["status", "flag", "line"], F.col("flag") != "N", F.col("status").isNotNull())


_SITE_ORDER = "l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_SITE_ORDER}) AS k, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
SELECT l_suppkey, total, string_agg(l_orderkey || ':' || l_linenumber, '|' ORDER BY k) AS sites, total - 3 AS capped FROM r WHERE k <= 3 GROUP BY l_suppkey, total""")
def merge_writers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_quantity"), *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))]
    site = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return aggregate.merge_sites(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, site, 3)


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS total, count(*) AS parts, string_agg(p || '=' || n, '|' ORDER BY n DESC, p) AS detail FROM c GROUP BY o_custkey""")
def merge_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.two_level(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, CAST(total AS BIGINT) AS total, event_type AS dominant, round(n / total, 4) AS share FROM r WHERE k = 1""")
def unlocated_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
WITH e AS (SELECT user_id, event_id, value > 50 AS w, event_type FROM events),
a AS (SELECT user_id, string_agg(event_id, '|' ORDER BY event_id) AS anchors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e) WHERE k <= 3 GROUP BY user_id)
SELECT user_id, count(*) AS total, count(CASE WHEN w THEN 1 END) AS writes,
  array_to_string(list_filter(['view', 'click', 'purchase', 'signup', 'logout'], lambda x: list_contains(list(DISTINCT event_type), x)), ',') AS causes, any_value(anchors) AS anchors
FROM e JOIN a USING (user_id) GROUP BY user_id""")
def dynwrites_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = ["view", "click", "purchase", "signup", "logout"]
    return aggregate.worklist(table(spark, sf_dir, "events"), ["user_id"], F.col("value") > 50, "event_type", causes, ["event_id"], 3)


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey, o_totalprice) AS position FROM orders)
SELECT o_orderkey, CAST(position AS INTEGER) AS position FROM r WHERE position BETWEEN 41 AND 80""")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")]
    return rank.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), order, 40, 40).select("o_orderkey", "position")


@query("""
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, size, 0 AS page, size AS used FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.turn, o.k, o.size, CASE WHEN f.used > 0 AND f.used + o.size > 600 THEN f.page + 1 ELSE f.page END,
  CASE WHEN f.used > 0 AND f.used + o.size > 600 THEN o.size ELSE f.used + o.size END FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
SELECT conv_id, turn, page FROM f""")
def budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation put on pages of at most 600 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return rank.budget_pages(rows, ["conv_id"], ["turn"], "size", 600).drop("size")


# classification


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'f' END AS form, CASE WHEN event_id % 5 > 0 THEN 'k' END AS field, CASE WHEN event_type = 'signup' THEN 'concat' ELSE 'literal' END AS res,
  CASE WHEN value < 20 THEN 'basedata' ELSE 'header' END AS lvl, CASE WHEN user_id % 2 = 0 THEN 'write' ELSE 'read' END AS acc,
  CASE user_id % 5 WHEN 0 THEN 'note:dynamic-entity' WHEN 1 THEN 'x note:helper-caller' WHEN 2 THEN 'note:source-unidentified' END AS ev, CASE WHEN event_type = 'click' THEN 'model.getValue' ELSE 'obj.get' END AS via FROM events)
SELECT event_id, CASE WHEN form IS NOT NULL THEN NULL WHEN field IS NULL OR res IN ('dynamic', 'dynamic-loop', 'concat', 'external-const', 'unknown', 'ambiguous') THEN 'field-key-undeterminable'
  WHEN lvl = 'basedata' AND acc = 'write' THEN 'basedata-write-suspect' WHEN lvl = 'basedata' THEN 'basedata-ref' WHEN contains(ev, 'note:dynamic-entity') THEN 'dynamic-entity'
  WHEN contains(ev, 'note:helper-caller') THEN 'helper-caller-unknown' WHEN contains(ev, 'note:source-unidentified') THEN 'local-or-container-source' WHEN starts_with(via, 'model.') THEN 'model-context' ELSE 'unknown' END AS reason FROM e""")
def null_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("user_id") % 5
    reason = classify.null_reason(
        F.when(F.col("event_id") % 4 == 0, "f"),
        F.when(F.col("event_id") % 5 > 0, "k"),
        F.when(F.col("event_type") == "signup", "concat").otherwise("literal"),
        F.when(F.col("value") < 20, "basedata").otherwise("header"),
        F.when(F.col("user_id") % 2 == 0, "write").otherwise("read"),
        F.when(user == 0, classify.NOTE_DYNAMIC).when(user == 1, "x " + classify.NOTE_HELPER).when(user == 2, classify.NOTE_SOURCE),
        F.when(F.col("event_type") == "click", "model.getValue").otherwise("obj.get"),
    )
    return e.select("event_id", reason.alias("reason"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderkey % 11 = 0 AS sink, o_orderkey % 3 = 0 AS leak, CASE o_orderstatus WHEN 'O' THEN 'transaction' WHEN 'F' THEN 'memory' ELSE 'build' END AS phase,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'save' WHEN '2-HIGH' THEN 'donothing' WHEN '3-MEDIUM' THEN 'audit' WHEN '5-LOW' THEN 'query' END AS op FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN sink THEN 'yes' WHEN phase = 'transaction' AND op IN ('save', 'audit') THEN 'yes' WHEN phase = 'transaction' AND leak THEN 'unknown'
  WHEN phase = 'transaction' AND op = 'donothing' THEN 'no' WHEN phase = 'transaction' THEN 'unknown' WHEN phase = 'build' THEN 'yes' WHEN leak THEN 'unknown' ELSE 'no' END AS persists,
  CASE WHEN sink THEN 0.85 WHEN phase = 'transaction' AND op IN ('save', 'audit') THEN 0.9 WHEN phase = 'transaction' AND leak THEN 0.3
  WHEN phase = 'transaction' AND op = 'donothing' THEN 0.7 WHEN phase = 'transaction' THEN 0.4 WHEN phase = 'build' THEN 0.6 WHEN leak THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM o""")
def persist_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    phase = F.when(status == "O", "transaction").when(status == "F", "memory").otherwise("build")
    op = F.when(priority == "1-URGENT", "save").when(priority == "2-HIGH", "donothing").when(priority == "3-MEDIUM", "audit").when(priority == "5-LOW", "query")
    verdict = classify.persistence(key % 11 == 0, phase, op, key % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", verdict.alias("v")).select("o_orderkey", "o_totalprice", "v.persists", "v.confidence")


@query("""
WITH t AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'f' || o_custkey WHEN 1 THEN 'b' || o_orderkey || '.f' || o_custkey
  WHEN 2 THEN 'b' || o_orderkey || '.e.f' || o_custkey ELSE 'b' || o_orderkey || '.e.s.f' || o_custkey END AS loc FROM orders), s AS (SELECT *, string_split(loc, '.') AS p FROM t)
SELECT o_orderkey, o_totalprice, p[-1] AS field, CASE WHEN len(p) >= 2 THEN p[1] END AS form, CASE WHEN len(p) >= 3 THEN p[-2] END AS entry, CASE len(p) WHEN 3 THEN 'entry' WHEN 4 THEN 'subentry' END AS level FROM s""")
def level_from_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    form, field = F.concat(F.lit("b"), "o_orderkey"), F.concat(F.lit("f"), "o_custkey")
    middle = F.when(kind == 2, ".e.").when(kind == 3, ".e.s.").otherwise(".")
    loc = F.when(kind == 0, field).otherwise(F.concat(form, middle, field))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", text.locator(loc).alias("l")).select("o_orderkey", "o_totalprice", "l.*")


@query("""
WITH t AS (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS target, nullif(o_orderpriority, '1-URGENT') AS op FROM orders),
r AS (SELECT *, CASE WHEN target = 'O' AND op = '2-HIGH' THEN 'exact' WHEN target = 'O' AND op IS NULL THEN 'op_unresolved' WHEN target IS NULL AND op = '2-HIGH' THEN 'target_unresolved'
  WHEN target IS NULL AND op IS NULL THEN 'both_unresolved' END AS reason FROM t)
SELECT o_orderkey, o_totalprice, reason FROM r WHERE reason IS NOT NULL""")
def op_trigger_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, op = F.nullif("o_orderstatus", F.lit("P")), F.nullif("o_orderpriority", F.lit("1-URGENT"))
    reason = classify.inbound_suspect(target, op, "O", "2-HIGH")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", reason.alias("reason")).where("reason is not null")


# graphs


@query("""
WITH e AS (SELECT 'm' || l_partkey % 400 AS caller, 'm' || l_orderkey % 400 AS target, l_quantity AS confidence, l_orderkey, l_linenumber, l_suppkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY caller, target ORDER BY confidence DESC, l_orderkey, l_linenumber, l_suppkey) AS k, count(*) OVER (PARTITION BY caller, target) AS sites FROM e WHERE caller <> target)
SELECT caller, target, confidence, l_orderkey, l_linenumber, l_suppkey, sites FROM r WHERE k = 1""")
def caller_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative call site of each caller and target."""
    edges = _edges(spark, sf_dir).select("caller", "target", F.col("l_quantity").alias("confidence"), "l_orderkey", "l_linenumber", "l_suppkey")
    return graph.representative_edges(edges, ["caller"], ["target"], "confidence", ["l_orderkey", "l_linenumber", "l_suppkey"])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("m"), (F.col(c) % 400).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("caller"), name("l_orderkey").alias("target"), "*")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts call the orders that hold them; numbers that are both a part's and an order's are one node."""
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("l_partkey").alias("caller"), name("l_orderkey").alias("target"), "*")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'm' || l_partkey AS caller, 'm' || l_orderkey AS target FROM lineitem WHERE l_partkey <> l_orderkey),
b AS (SELECT 'm7' AS node, 0 AS depth UNION SELECT caller, depth + 1 FROM b JOIN e ON target = node WHERE depth < 10)
SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def reverse_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers_of(_calls(spark, sf_dir), "caller", "target", "m7", 10)


@query("""
WITH RECURSIVE t(node, up) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1),
b AS (SELECT node, up AS base, 1 AS depth FROM t WHERE up IN (1, 2, 3) UNION ALL SELECT t.node, b.base, b.depth + 1 FROM b JOIN t ON t.up = b.node),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, base) AS k FROM b)
SELECT node, base, depth FROM r WHERE k = 1""")
def base_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("up")).where("node > 1")
    bases = spark.range(1, 4).withColumnRenamed("id", "base")
    return graph.closure_to_bases(parents, "node", "up", bases, 40)


@query("""
WITH RECURSIVE s AS (SELECT 8 AS k, (SELECT list(p_partkey % 3 ORDER BY i) FROM range(8) r(i) LEFT JOIN part ON p_partkey = i) AS v, list_transform(range(8), lambda i: 0) AS d
  UNION ALL SELECT k + 1, list_append(v, CASE WHEN k < 40 OR v[k // 2 + 1] = v[k // 2 - k % 5 + 1] THEN v[k // 2 + 1] END),
    list_append(d, CASE WHEN k < 40 THEN d[k // 2 + 1] ELSE greatest(d[k // 2 + 1], d[k // 2 - k % 5 + 1]) END + 1) FROM s WHERE k <= (SELECT max(p_partkey) FROM part)),
last AS (SELECT v, d FROM s ORDER BY k DESC LIMIT 1), flat AS (SELECT unnest(range(len(v))) AS node, unnest(v) AS value, unnest(d) AS depth FROM last)
SELECT node, value, CAST(depth AS INTEGER) AS depth FROM flat WHERE value IS NOT NULL""")
def reverse_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of part k are k/2, and k/2 - k%5 from 40 on; parts below 8 are seeds."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    half = F.floor(F.col("k") / 2)
    edges = part.where("k >= 8").select(half.alias("caller"), F.col("k").alias("target")).union(part.where("k >= 40").select(half - F.col("k") % 5, "k"))
    seeds = part.where("k < 8").select(F.col("k").alias("node"), (F.col("k") % 3).alias("value"))
    return graph.agree_fixpoint(edges, "caller", "target", seeds)


@query(None)
def entry_chain_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _calls(spark, sf_dir).select(
        "caller", "target", (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_tax") > 0.04).alias("heuristic"), "l_orderkey", "l_linenumber", "l_suppkey"
    )
    edges = graph.representative_edges(edges, ["caller"], ["target"], "confidence", ["l_orderkey", "l_linenumber", "l_suppkey"])
    nodes = edges.select(F.col("caller").alias("node")).distinct()
    number = F.substring("node", 2, 9).cast("int")
    found, _ = graph.entry_chains(edges, "m7", nodes.where(number % 50 == 0), nodes.where(number % 7 == 0))
    return found.where("terminal is not null").select("node", "depth", "terminal", graph.chain_confidence(F.col("terminal"), F.col("heuristic")).alias("confidence"))


@query("""
SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'no_registration' WHEN max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'registered_enabled'
  WHEN min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'registered_disabled' ELSE 'registered_enabled_unknown' END AS status
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= '2000-01-01') ON o_custkey = c_custkey GROUP BY c_custkey""")
def registration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    bindings = table(spark, sf_dir, "orders").where("o_orderdate >= '2000-01-01'").select(F.col("o_custkey").alias("c_custkey"), flag.alias("enabled"))
    return graph.registration_status(table(spark, sf_dir, "customer"), "c_custkey", bindings, "enabled")


# text


@query("""
WITH t AS (SELECT doc_id, string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id FROM t WHERE list_has_all(w, ['the', 'that', 'license'])""")
def fts_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fts.inverted_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return fts.match_all(index, "doc_id", "The THAT license")


@query("""
SELECT p_partkey, p_name, count(l_partkey) AS touches FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_name ILIKE '%RING%' GROUP BY ALL ORDER BY p_name, p_partkey LIMIT 100""")
def whois_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "part").where(fts.like_any_case(F.col("p_name"), "RING")).select("p_partkey", "p_name")
    first = rank.top_k(hits, [F.col("p_name"), F.col("p_partkey")], fts.CLASS_LIMIT)
    touches = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(first.select("p_partkey"), "p_partkey", "left_semi")
    return first.join(touches.groupBy("p_partkey").agg(F.count("*").alias("touches")), "p_partkey", "left").fillna(0, ["touches"])


@query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("""
WITH k AS (SELECT DISTINCT lower(regexp_extract(url, '://([a-z]+)\\.', 1)) AS key FROM pages), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'))) AS key FROM documents)
SELECT key, count(*) AS documents FROM t JOIN k USING (key) GROUP BY key""")
def known_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents mention a known key (first host label), counted by key."""
    keys = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"://([a-z]+)\.", 1)).alias("key"))
    found = fts.known_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), text.key_tokens(F.col("text")), keys, "key")
    return found.groupBy("key").agg(F.count("*").alias("documents"))


_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"
_LANG = "regexp_extract(html, 'lang=\"([a-z]+)\"', 1)"


@query(f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_LANG} AS lang FROM pages), x AS (SELECT host, min(lang) AS lang FROM p WHERE page_id % 2 = 0 GROUP BY host HAVING min(lang) = max(lang))
SELECT page_id, coalesce(x.lang, 'unclassified') AS owner FROM p LEFT JOIN x USING (host) WHERE page_id % 2 = 1""")
def exclusive_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages are orphans; a host that even pages show with one language owns them."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("owner"))
    owners = aggregate.exclusive_owner(pages.where("page_id % 2 = 0"), "owner", "host")
    return pages.where("page_id % 2 = 1").select("page_id", "host").join(owners, "host", "left").select("page_id", F.coalesce("owner", F.lit("unclassified")).alias("owner"))


@query(f"""
WITH p AS (SELECT page_id, {_LANG} AS lang, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS s FROM pages),
x AS (SELECT page_id, lang, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/'))) AS prefix FROM p),
e AS (SELECT prefix, min(lang) AS lang FROM x WHERE page_id % 2 = 0 GROUP BY prefix HAVING min(lang) = max(lang)),
j AS (SELECT x.page_id, e.lang, row_number() OVER (PARTITION BY x.page_id ORDER BY CASE WHEN e.lang IS NULL THEN -1 ELSE length(x.prefix) END DESC) AS k FROM x LEFT JOIN e USING (prefix) WHERE page_id % 2 = 1)
SELECT page_id, lang FROM j WHERE k = 1""")
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a path as a dotted name; its own dots stand aside
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    prefixes = text.package_prefixes(F.translate(path, "./", "\1."))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), prefixes.alias("prefixes"))
    return aggregate.owner_by_longest_prefix(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), "prefixes", "lang", "page_id")


@query(f"""
SELECT {_HOST} AS host, regexp_extract(url, '://[^/]+/([^/?#]*)', 1) AS first, count(*) AS n FROM pages GROUP BY ALL""")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+/([^/?#]*)", 1).alias("first")).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS changed, count(DISTINCT user_id) AS users FROM events WHERE ts > TIMESTAMP '2024-01-15' GROUP BY event_type""")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("ts > timestamp '2024-01-15'")
    return events.groupBy("event_type").agg(F.count("*").alias("changed"), F.count_distinct("user_id").alias("users"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, coalesce(lines, 0) AS lines, coalesce(suppliers, 0) AS suppliers, coalesce(returned, 0) AS returned FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def bill_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What touches a bill: counts of its lines, decorrelated into one aggregation."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    any_line = F.lit(True)
    found = aggregate.touches(lines, "o_orderkey", "l_suppkey", {"suppliers": any_line}, {"lines": any_line, "returned": F.col("l_returnflag") == "R"})
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(found, "o_orderkey", "left").fillna(0)
