"""Reports on what was read, and completion from vendor metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.events import EVENTS, event_table
from factloom.functions.text import KEY_SHAPE
from factloom.operators import aggregate, rank, resolve
from factloom.sources import formxml
from factloom.sources.javasource import facts

EVIDENCE = 5
# Calls that name a form, and the position of its name by number of arguments.
ORM_CALLS = {
    ("BusinessDataServiceHelper", "newDynamicObject"): 0,
    ("BusinessDataServiceHelper", "load"): 0,
    ("BusinessDataServiceHelper", "loadFromCache"): 0,
    ("QueryServiceHelper", "query"): 0,
    ("QueryServiceHelper", "queryOne"): 0,
    ("QueryServiceHelper", "exists"): 0,
}
SINGLE_CALLS = ("loadSingle", "loadSingleFromCache")
# Lanes of plugins in the order in which a form shows them.
LANES = ["op", "form", "list", "writeback", "convert"]


def metadata_summary(models: DataFrame) -> DataFrame:
    """(facet, value, n): documents, fields, plugins and operations by kind."""
    fine = models.where("error is null")
    field = fine.select(F.explode("fields").alias("f")).select("f.kind", "f.level", "f.field_type")
    plugin = fine.select(F.explode("plugins").alias("p")).select("p.plugin_type", "p.source")
    parts = [
        aggregate.breakdown(models.withColumn("readable", F.col("error").isNull()), "form_type", "readable", "app_key"),
        aggregate.breakdown(field, "kind", "level", "field_type"),
        aggregate.breakdown(plugin, "plugin_type", "source"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def bridge_summary(bindings: DataFrame, classes: DataFrame) -> DataFrame:
    """(facet, value, n): bindings by status, distinct classes, orphans by role."""
    names = bindings.agg(F.count_distinct("class_name").alias("n")).select(F.lit("classes").alias("facet"), F.lit("distinct").alias("value"), "n")
    orphans = aggregate.breakdown(classes.where("is_orphan"), "orphan_role")
    return aggregate.breakdown(bindings, "status", "plugin_type").unionByName(names).unionByName(orphans)


def known_keys(models: DataFrame) -> DataFrame:
    """Keys of forms, entities and fields."""
    fine = models.where("error is null")
    parts = [fine.select("key"), fine.select(F.explode("entities").alias("x")).select("x.key"), fine.select(F.explode("fields").alias("x")).select("x.key")]
    return parts[0].union(parts[1]).union(parts[2]).where("key is not null").distinct()


def form_like(candidates: DataFrame, known: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Candidates that look like a form's key, are not known and not one's own."""
    shaped = candidates.where(F.col("key").rlike(KEY_SHAPE) & ~F.col("key").rlike("^(fk|tk)_"))
    own = prefixes.select(F.col("prefix").alias("own")).distinct()
    marked = shaped.withColumn("own", F.concat(F.substring_index("key", "_", 1), F.lit("_")))
    return marked.join(own, "own", "left_anti").drop("own").join(known.select("key").distinct(), "key", "left_anti")


def discover_candidates(parsed: DataFrame, models: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Vendor forms that the project refers to: extended ones first, then by hits. Evidence
    is the first few places of each."""
    calls = facts(parsed, "calls")
    tail = F.regexp_extract("receiver", r"(\w+)$", 1)
    position = F.lit(None).cast("int")
    for (cls, name), at in ORM_CALLS.items():
        position = F.when((tail == cls) & (F.col("name") == name), at).otherwise(position)
    n = F.size("args")
    literal = lambda i: F.get("args", F.lit(i)).rlike('^"[^"]*"$')
    single = F.when(n == 2, 1).when((n == 3) & literal(2), 1).when(n == 3, 0)
    position = F.when((tail == "BusinessDataServiceHelper") & F.col("name").isin(*SINGLE_CALLS), single).otherwise(position)
    first = F.get("args", F.lit(0))
    position = F.when((tail == "QueryServiceHelper") & literal(0) & first.contains("."), 1).otherwise(position)
    value = lambda at: F.regexp_extract(F.coalesce(F.get("args", at), F.lit("")), '^"([^"]*)"$', 1)
    orm = calls.withColumn("key", value(position)).where("key <> ''").select("key", "relpath", "line")
    runs = calls.where("name = 'executeOperate'").withColumn("key", value(F.lit(1))).where("key <> ''").select("key", "relpath", "line")
    known = known_keys(models)
    extended = formxml.extension_target(models, prefixes).select(F.col("extends").alias("key"), F.col("key").alias("relpath"), F.lit(0).alias("line"))
    signals = {"ext": extended.join(known, "key", "left_anti"), "orm": form_like(orm, known, prefixes), "operation": form_like(runs, known, prefixes)}
    totals = resolve.combine_signals({k: v.groupBy("key").agg(F.count("*").alias("hits")) for k, v in signals.items()}, "key", "ext")
    places = signals["ext"].union(signals["orm"].select("key", "relpath", "line")).union(signals["operation"].select("key", "relpath", "line"))
    merged = aggregate.merge_sites(places.distinct(), ["key"], [F.col("relpath"), F.col("line")], F.concat_ws(":", "relpath", F.col("line").cast("string")), EVIDENCE)
    return totals.join(merged.select("key", F.col("sites").alias("evidence")), "key")


def integrate_vendor(own: DataFrame, vendor: DataFrame, extensions: DataFrame) -> DataFrame:
    """Models with those of the vendor that are extended or used and not there yet; a vendor
    form that has an extension is named in ``extended_by``."""
    by_form = extensions.groupBy(F.col("extends").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("extended_by"))
    new = vendor.join(own.select("key").distinct(), "key", "left_anti")
    new = rank.first_per_group(new, ["key"], [F.col("source_file")])
    return own.withColumn("extended_by", F.lit(None).cast("string")).unionByName(new.join(by_form, "key", "left"), allowMissingColumns=True)


def templates(models: DataFrame) -> DataFrame:
    """Operations of template documents, for completing others of the same model type."""
    rows = models.where("error is null").select("model_type", F.explode("operations").alias("o")).select("model_type", "o.*")
    return rows.where("id is not null and key is not null").select("model_type", "key", "name", "operation_type", F.col("id").alias("oid")).distinct()


def local_calls(edges: DataFrame) -> DataFrame:
    """Calls within a class, and how many calls leave it, by method."""
    inside = F.col("receiver").isin("", "this") & (F.col("caller_method") != F.col("target_method"))
    return edges.groupBy(F.col("caller_fqn").alias("class_fqn"), F.col("caller_method").alias("method")).agg(
        F.array_sort(F.collect_set(F.when(inside & (F.col("target_fqn") == F.col("caller_fqn")), F.col("target_method")))).alias("callees"),
        F.count(F.when(F.col("receiver").contains("."), 1)).alias("external"),
    )


def roots(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods that nothing in their own class calls."""
    called = edges.where("caller_fqn = target_fqn and caller_method <> target_method").select(F.col("target_fqn").alias("class_fqn"), F.col("target_method").alias("name"))
    return methods.select("class_fqn", "name").distinct().join(called.distinct(), ["class_fqn", "name"], "left_anti")


def event_topics(spark: SparkSession, methods: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Document to read on a method (event_method, plugin_type): that of the kind if the
    method is one of its events, else that of any event of this name, else of the kind."""
    by_kind = spark.createDataFrame(list(topics.items()) or [("", "")], "plugin_type string, kind_topic string")
    known = event_table(spark).where("kind <> 'unknown'").select(F.col("kind").alias("plugin_type"), F.col("event").alias("event_method"), F.lit(True).alias("own_event"))
    any_kind = known.join(by_kind, "plugin_type").groupBy("event_method").agg(F.min("kind_topic").alias("name_topic"))
    rows = methods.join(by_kind, "plugin_type", "left").join(known, ["plugin_type", "event_method"], "left").join(any_kind, "event_method", "left")
    return rows.select(*methods.columns, F.when(F.col("own_event"), F.col("kind_topic")).otherwise(F.coalesce("name_topic", "kind_topic")).alias("topic"))


def lane(plugin_type: str | None) -> str:
    return plugin_type if plugin_type in LANES else "other"


def event_counts() -> dict[str, int]:
    return {kind: sum(len(names) for names in phases.values()) for kind, phases in EVENTS.items()}
