"""Text functions, metadata operators and order on the test tables, with DuckDB equivalents.

Each query calls an operator of the library on all rows of a table, with columns of
the tables in the roles of the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify, events, text
from factloom.operators import aggregate, rank, resolve, setcmp
from factloom.plans import reports
from factloom.sources import formxml, jdbc, scan, symbols

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


# text


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 'Map' WHEN 2 THEN 'T' || p_partkey WHEN 3 THEN 'In' END AS simple FROM part""")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple names of types with packages, generics and arrays."""
    k = F.col("p_partkey")
    own = F.concat(F.lit("T"), k)
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("a.b."), own))
        .when(k % 5 == 1, F.concat(F.lit("java.util.Map<K"), k, F.lit(", List<Set<V>>>")))
        .when(k % 5 == 2, F.concat(own, F.lit("[][]")))
        .when(k % 5 == 3, F.concat(F.lit("x.Out"), k, F.lit(".In...")))
        .otherwise("1x")
    )
    return table(spark, sf_dir, "part").select(k, text.simple_type(name).alias("simple"))


@query("""SELECT p_partkey, 'C' || p_size AS last FROM part""")
def last_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last segment of qualified and inner names."""
    name = F.concat(F.lit("p.q"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".C").otherwise("$C"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.last_segment(name).alias("last"))


@query("""SELECT o_orderkey, 'op' || o_orderkey AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_custkey END AS form FROM orders""")
def operation_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of operations, with or without a form."""
    op = F.concat(F.lit("op"), "o_orderkey")
    loc = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("f"), "o_custkey", F.lit("."), op)).otherwise(op)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.operation_locator(loc).alias("l")).select("o_orderkey", "l.*")


@query("""SELECT lower(c_mktsegment) AS prefix, count(*) AS n FROM customer GROUP BY 1""")
def key_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first underscore."""
    key = F.concat_ws("_", F.lower("c_mktsegment"), "c_custkey", F.lit("x"))
    return table(spark, sf_dir, "customer").groupBy(text.first_prefix(key).alias("prefix")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT c_custkey, unnest(['a' || c_nationkey, 'a' || c_nationkey || '.b' || c_custkey % 7, 'a' || c_nationkey || '.b' || c_custkey % 7 || '.C']) AS prefix FROM customer)
SELECT prefix, count(*) AS n FROM t GROUP BY prefix""")
def dotted_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of dotted names."""
    name = F.concat(F.lit("a"), "c_nationkey", F.lit(".b"), F.col("c_custkey") % 7, F.lit(".C"))
    found = table(spark, sf_dir, "customer").select(F.explode(text.package_prefixes(name)).alias("prefix"))
    return found.groupBy("prefix").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 300 ELSE 1 END AS n, 'Keys' || c_nationkey || '.' || 'F_' || c_mktsegment AS first FROM customer""")
def constant_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to constants in a text, at most 300 of them."""
    ref = F.concat(F.lit("Keys"), "c_nationkey", F.lit(".F_"), "c_mktsegment")
    said = F.concat(F.lit("x = "), ref, F.lit(" + lower.NO + Z.AB; "))
    said = F.when(F.col("c_custkey") % 50 == 0, F.repeat(said, F.lit(310))).otherwise(said)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.constant_refs(said).alias("refs"))
    return rows.select("c_custkey", F.size("refs").alias("n"), F.col("refs")[0].alias("first"))


@query("""SELECT lower(c_mktsegment) || '_' || c_nationkey AS key, count(*) AS n FROM customer WHERE c_custkey % 4 < 2 AND lower(c_mktsegment) <> 'machinery'
  AND lower(c_mktsegment) || '_' || c_nationkey NOT IN (SELECT 'building_' || n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1""")
def form_like_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that look like a form's key, are not known and not one's own."""
    base = F.concat_ws("_", F.lower("c_mktsegment"), F.col("c_nationkey"))
    shape = F.col("c_custkey") % 4
    key = F.when(shape < 2, base).when(shape == 2, F.upper(base)).otherwise(F.concat(F.lit("fk_"), base))
    candidates = table(spark, sf_dir, "customer").select(key.alias("key"))
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("building_"), "n_nationkey").alias("key"))
    own = spark.createDataFrame([("machinery_",)], "prefix string")
    return reports.form_like(candidates, known, own).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false END AS flag FROM events""")
def tri_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as documents and databases write them."""
    said = F.element_at(F.array(*map(F.lit, ["true", "1", " Yes", "FALSE", "n", "maybe", ""])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", classify.tri_state(said).alias("flag"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS text FROM documents""")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts cut."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text"), 100).alias("text"))


@query("""WITH t AS (SELECT doc_id, substr(text, 1, 40 * (doc_id % 50)) AS t FROM documents) SELECT doc_id, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS INTEGER) AS line FROM t""")
def lines_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of an offset."""
    return table(spark, sf_dir, "documents").select("doc_id", text.line_of(F.col("text"), F.col("doc_id") % 50 * 40).alias("line"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS idiom FROM orders""")
def access_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a key stands in a call that reads or writes."""
    before = F.element_at(F.array(*map(F.lit, ['m.getValue("', 'put("', "o.set(Keys.", "setValues("])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.is_access_idiom(F.concat(F.col("o_orderstatus"), F.lit(" "), before)).alias("idiom"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(o_orderkey), 4) END AS rate
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share, or null of nothing."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").fillna(0)
    return joined.select("c_custkey", setcmp.rate(F.col("f"), F.col("n")).alias("rate"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS relpath, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' ELSE 'utf-8-sig' END AS encoding, 1.0::DOUBLE AS confidence, coalesce(text, '') AS text FROM documents""")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in several encodings, read as text."""
    said, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    content = F.when(kind == 0, F.encode(said, "UTF-8")).when(kind == 1, F.encode(said, "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(said, "UTF-8")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relpath"), F.lit(0).cast("long").alias("size"), content.alias("content"))
    return scan.decoded(files).select("relpath", "encoding", "confidence", "text")


# metadata


@query("""SELECT o.n_nationkey AS fnumber, o.n_name AS fdata, m.n_nationkey AS m_number, m.n_name AS m_data FROM nation o LEFT JOIN nation m ON m.n_nationkey = o.n_regionkey
WHERE o.n_nationkey IN (SELECT c_nationkey FROM customer)""")
def master_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design rows with the data of their master rows."""
    design = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fid"), F.col("n_nationkey").alias("fnumber"), F.col("n_regionkey").alias("fmasterid"), F.col("n_name").alias("fdata"))
    numbers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("number"))
    return jdbc.masters(design, numbers).select("fnumber", "fdata", "m_number", "m_data")


@query("""SELECT c_mktsegment AS fisv, count(*) AS n FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1""")
def isv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their maker, without those that name none."""
    isv = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 2 == 0, "  ")
    return jdbc.counts_by_isv(table(spark, sf_dir, "customer").select(isv.alias("fisv")))


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS fnumber FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1997-01-01'
UNION SELECT DISTINCT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'F'""")
def changed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of one maker changed after a time, of both halves."""
    forms = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("fisv"), F.col("o_orderdate").cast("timestamp").alias("fmodifydate"), F.col("o_custkey").cast("string").alias("fnumber"))
    none = F.lit(None).cast("timestamp")
    entities = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("fisv"), none.alias("fmodifydate"), F.col("c_custkey").cast("string").alias("fnumber"))
    return jdbc.changed_keys(forms, entities, "F", "1997-01-01")


@query("""SELECT coalesce(n_nationkey, s) AS fnumber, n_name AS form_data, d AS entity_data, coalesce(n_name, d) AS isv FROM nation
FULL JOIN (SELECT s_suppkey AS s, max(s_name) AS d FROM supplier GROUP BY 1) ON n_nationkey = s""")
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of documents side by side."""
    forms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fnumber"), F.col("n_name").alias("fdata"), F.col("n_name").alias("fisv"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fnumber"), F.col("s_name").alias("fdata"), F.col("s_name").alias("fisv"))
    return jdbc.reassemble(forms, entities)


@query("""WITH v AS (SELECT 'f' || c_nationkey AS form_key, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_nationkey ELSE 'e' END AS entity_key, 'k' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'header' ELSE 'entry' END AS level, 'v' AS name FROM customer),
x AS (SELECT 'f' || c_nationkey AS form_key, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0) THEN 'h' || c_nationkey END ELSE 'e' END AS entity_key,
  'k' || CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS key, CASE WHEN c_custkey % 2 = 0 THEN 'header' ELSE 'entry' END AS level, 'x' AS name FROM customer WHERE c_custkey % 5 = 0)
SELECT *, 'extension' AS provenance FROM x UNION ALL SELECT *, 'vendor' FROM v WHERE (form_key, entity_key, key) NOT IN (SELECT form_key, entity_key, key FROM x)""")
def vendor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms merged with those of their extensions."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    header = k % 2 == 0
    level = F.when(header, "header").otherwise("entry").alias("level")
    customer = table(spark, sf_dir, "customer")
    form = F.concat(F.lit("f"), n)
    vendor = customer.select(form.alias("form_key"), F.when(header, F.concat(F.lit("h"), n)).otherwise("e").alias("entity_key"), F.concat(F.lit("k"), k).alias("key"), level, F.lit("v").alias("name"))
    extension = customer.where(k % 5 == 0).select(
        F.concat(form, F.lit("_ext")).alias("form_key"), F.when(header, "own").otherwise("e").alias("entity_key"),
        F.concat(F.lit("k"), F.when(k % 10 == 0, k).otherwise(k + 1000000)).alias("key"), level, F.lit("x").alias("name"), form.alias("extends"),
    )
    return formxml.merge_vendor(vendor, extension)


@query("""SELECT c_custkey, c_nationkey AS form_key, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS enabled FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR c_custkey % 3 = 1""")
def own_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's plugins go, but those that are switched off."""
    enabled = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    plugins = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("form_key"), enabled.alias("enabled"))
    vendor = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("form_key"))
    return formxml.without_vendor_plugins(plugins, vendor).select("c_custkey", "form_key", "enabled")


@query("""SELECT 'ab_f' || s_suppkey || '_ext' AS key, 'f' || s_suppkey AS extends FROM supplier WHERE s_suppkey % 3 = 0""")
def extension_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that extend another, by their name and where they inherit from."""
    k = F.col("s_suppkey")
    prefix = F.when(k % 3 == 2, "zz_f").otherwise("ab_f")
    path = F.when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("root")))
    models = table(spark, sf_dir, "supplier").select(F.concat(prefix, k, F.lit("_ext")).alias("key"), path.alias("inherit_path"), F.lit(None).cast("string").alias("error"))
    return formxml.extension_target(models, spark.createDataFrame([("ab_",), ("cd_",)], "prefix string"))


@query("""SELECT e.event_id, CASE WHEN t IS NOT NULL AND b IS NOT NULL AND b <> t THEN t WHEN t IS NOT NULL THEN t WHEN b IS NOT NULL THEN b ELSE 'unknown' END AS kind,
  CASE WHEN t IS NOT NULL AND b IS NOT NULL AND b <> t THEN 0.8 WHEN t IS NOT NULL THEN 0.95 WHEN b IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'op' WHEN 1 THEN 'form' END AS t, CASE event_id % 4 WHEN 0 THEN 'op' WHEN 1 THEN 'task' END AS b FROM events) e""")
def plugin_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of plugins as registered, else by their base class."""
    k = F.col("event_id")
    kind = events.plugin_kind(F.when(k % 3 == 0, "op").when(k % 3 == 1, "form"), F.when(k % 4 == 0, "op").when(k % 4 == 1, "task"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("k")).select("event_id", "k.*")


# joins and order


@query("""WITH s AS (SELECT l_orderkey, l_partkey % 3 AS name, l_linenumber AS col, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R'),
g AS (SELECT l_orderkey, name, count(*) AS n, any_value(target) AS sole FROM s GROUP BY ALL), d AS (SELECT l_orderkey, name, col, min(target) AS t, max(target) AS u FROM s GROUP BY ALL),
r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 3 AS name FROM lineitem)
SELECT r.l_orderkey, r.l_linenumber AS col, r.name, CASE WHEN g.n = 1 THEN sole WHEN g.n > 1 AND t = u THEN t END AS target
FROM r LEFT JOIN g USING (l_orderkey, name) LEFT JOIN d ON d.l_orderkey = r.l_orderkey AND d.name = r.name AND d.col = r.l_linenumber WHERE t IS NULL OR t = u""")
def symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only site of a place, or that of several in its column. Places that two
    different sites share down to the column are left out of the comparison."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("name"), F.col("l_linenumber").alias("col"), F.col("l_suppkey").alias("target"), "l_returnflag")
    sites = lines.where("l_returnflag = 'R'").drop("l_returnflag")
    unsure = sites.groupBy("l_orderkey", "name", "col").agg(F.count_distinct("target").alias("n")).where("n > 1")
    found = resolve.unique_match(lines.select("l_orderkey", "name", "col").distinct(), sites, ["l_orderkey", "name"], "col")
    return found.join(unsure, ["l_orderkey", "name", "col"], "left_anti")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p AS position FROM (SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS p FROM lineitem) WHERE p <= 5""")
def first_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each group in the fixed order of accesses."""
    lines = table(spark, sf_dir, "lineitem")
    access = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").otherwise("other")
    lines = lines.withColumns({"access": access, "persists": F.when(F.col("l_linestatus") == "F", "yes").otherwise("no")})
    order = [*rank.access_order("access", "persists", "l_quantity", "l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return rank.top_per_group(lines, ["l_suppkey"], order, 5).select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").alias("position"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer)
SELECT c_nationkey, c_custkey, total, greatest(total - 3, 0) AS capped FROM r WHERE p <= 3""")
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped groups with their true totals."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    top = rank.top_per_group(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).drop("rank", "c_acctbal")
    return rank.with_totals(top, rows, ["c_nationkey"], 3)


@query("""SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS p FROM customer) WHERE p = 1""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    return rank.first_per_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")])


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS votes, min(o_orderkey) AS seen FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT o_custkey, o_orderpriority, votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, seen, o_orderpriority) AS p FROM v) WHERE p = 1""")
def majority_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value; on ties the one seen first."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("seen"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").join(first, ["o_custkey", "o_orderpriority"])
    rows = rows.withColumn("both", F.struct("seen", "o_orderpriority"))
    return rank.majority(rows, ["o_custkey"], "both", [F.col("both")]).select("o_custkey", "both.o_orderpriority", "votes")


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS p, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM v)
SELECT l_suppkey, CAST(total AS BIGINT) AS total, l_returnflag AS dominant, round(n / total, 4) AS share FROM r WHERE p = 1""")
def module_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the dominant value of each group and its share."""
    return aggregate.consistency(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag").select("l_suppkey", "total", "dominant", "share")


@query("""SELECT 'encoding' AS metric, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'files', NULL, count(*) FROM documents UNION ALL SELECT 'decoded', NULL, count(text) FROM documents
UNION ALL SELECT 'errors', NULL, count(*) FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'low_confidence', NULL, count(*) FROM documents WHERE doc_id % 3 = 0""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and encodings of a scan."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("lang").alias("encoding"), "text", F.when(F.col("doc_id") % 7 == 0, "broken").alias("error"), F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(1.0).alias("confidence"))
    return scan.coverage_report(files)


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)
SELECT 'ok' AS status, count(DISTINCT l_orderkey) AS files, 0::BIGINT AS failed_files, 0::BIGINT AS malformed, count(*) AS sites, count(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 END) AS resolved,
  round(count(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 END) / count(*), 4) AS coverage, count(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 END) / count(*) >= 0.95 AS strong_zero FROM g""")
def symbol_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and coverage of a log of compile-time symbols, one file for each order."""
    resolution = F.when(F.col("l_returnflag") == "A", "expr").when(F.col("l_returnflag") == "R", "scope").otherwise("failed")
    site = F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.lit("m").alias("name"), resolution.alias("resolution")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(site), ",").alias("sites"))
    log = orders.select(F.concat(F.lit('{"event":"file","status":"ok","relpath":"'), "l_orderkey", F.lit('","sites":['), "sites", F.lit("]}")).alias("value"))
    log = log.unionByName(spark.createDataFrame([('{"event":"solver_ready"}',), ('{"event":"summary"}',)], "value string"))
    return symbols.status(symbols.events_of(log))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS relpath, CAST(l_linenumber AS INTEGER) AS line, 'm' AS name, count(*) AS n FROM lineitem GROUP BY ALL""")
def symbol_log_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites of a log."""
    site = F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.lit("m").alias("name")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(site), ",").alias("sites"))
    log = orders.select(F.concat(F.lit('{"event":"file","relpath":"'), "l_orderkey", F.lit('","sites":['), "sites", F.lit(',{"line":1},{"name":"x"}]}')).alias("value"))
    return symbols.sites(symbols.events_of(log)).groupBy("relpath", "line", "name").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, CASE WHEN min(rate) IS NULL THEN 'warn' WHEN min(rate) >= 0.9 AND count(CASE WHEN rate < 0.5 THEN 1 END) = 0 THEN 'good' WHEN min(rate) >= 0.6 THEN 'ok' ELSE 'low' END AS health
FROM (SELECT n_regionkey, CASE WHEN n_regionkey < 4 THEN 1 - n_nationkey / 40.0 END AS rate FROM nation) GROUP BY 1""")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: health of modules by their consistency."""
    rate = F.when(F.col("n_regionkey") < 4, 1 - F.col("n_nationkey") / 40)
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min(rate).alias("rate"), F.count(F.when(rate < 0.5, 1)).alias("scattered"))
    return rows.select("n_regionkey", classify.module_health(F.col("rate"), F.col("scattered")).alias("health"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'constant' WHEN 1 THEN 'plugin' WHEN 2 THEN 'constant' ELSE 'unknown' END AS role FROM supplier""")
def orphan_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of classes that nothing is bound to."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("a.consts.K"), k)).when(k % 4 == 2, F.concat(F.lit("a.S"), k, F.lit("Const"))).otherwise(F.concat(F.lit("a.S"), k))
    return table(spark, sf_dir, "supplier").select("s_suppkey", classify.orphan_role(k % 4 == 1, name).alias("role"))


@query("""SELECT o_orderkey, CASE WHEN x THEN 'not_analyzed' WHEN c = 'not_found' THEN 'no_entry_found' WHEN e THEN 'entry_reachable' WHEN i AND NOT t THEN 'entries_inactive' ELSE 'entry_unverifiable' END AS verdict,
  CASE WHEN x THEN 'unknown' WHEN c = 'not_found' THEN CASE WHEN z AND NOT t THEN 'likely' ELSE 'unknown' END WHEN e THEN CASE WHEN z THEN 'confirmed' ELSE 'likely' END WHEN i AND NOT t THEN 'likely' ELSE 'unknown' END AS confidence
FROM (SELECT o_orderkey, o_orderkey % 11 = 0 AS x, CASE WHEN o_orderkey % 3 = 0 THEN 'not_found' ELSE 'reached' END AS c, o_custkey % 2 = 0 AS e, o_custkey % 3 = 0 AS i, o_orderkey % 5 = 0 AS t, o_orderstatus = 'F' AS z FROM orders)""")
def entry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on whether a method can be reached."""
    k, c, z = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus") == "F"
    verdict = classify.entry_verdict(k % 11 == 0, F.when(k % 3 == 0, "not_found").otherwise("reached"), c % 2 == 0, c % 3 == 0, z, k % 5 == 0, F.lit(False), z)
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.*")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'basedata_prop' WHEN 1 THEN 'inherited' WHEN 2 THEN 'inherited' WHEN 3 THEN 'entity' WHEN 4 THEN 'dynamic' ELSE 'platform' END AS kind FROM part""")
def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: kinds of fields, the first rule that fits."""
    k = F.col("p_partkey") % 6
    kind = classify.field_kind(
        F.when(k == 0, "BasedataPropField").otherwise("TextField"), k == 1, k == 2, F.when(k != 2, "key"), F.when(k <= 3, "fcolumn").otherwise(""), F.when(k == 4, "dynamic").otherwise("bill")
    )
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'header' WHEN 2 THEN 'entry' WHEN 3 THEN 'subentry' ELSE 'unknown' END AS level FROM lineitem""")
def levels_by_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of an access by its number of arguments."""
    write = F.col("l_returnflag") == "R"
    n = F.col("l_linenumber") + F.when(write, 1).otherwise(0)
    level = classify.level_by_arguments(F.when(write, "write").otherwise("read"), n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", level.alias("level"))
