"""From sources and form metadata to the knowledge base.

Every step is a join or an aggregation over the parsed facts; the parser's
output is written once and read by all of them. Where the data flow of a file
leaves a question open (a parameter's source, a constant, a call's target), it is
settled here over all files, or stays open with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify, events, text
from factloom.lang.javaparse import CONSTANT_FORM
from factloom.operators import aggregate, dedup, graph, rank, resolve, setcmp
from factloom.schema import CALL_CONFIDENCE
from factloom.sources import formxml
from factloom.sources.javasource import facts, parse_files
from factloom.sources.store import KnowledgeBase, write_kb
from factloom.storage import written

#: A walk from an event follows calls so far.
EVENT_DEPTH = 8
# Platform calls that trigger an operation, and classes of bulk setters.
TRIGGERS = ["executeOperate", "invokeOperation", "invokeOperationWithSelect"]
UNKNOWN_NODE = "?"


def node(cls: str, method: str):
    return F.concat_ws("#", F.col(cls), F.col(method))


# metadata tables


def metadata_tables(models: DataFrame, extensions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Forms, entities, fields, plugins, operations and rules of read models. Forms that
    ``extensions`` (key, extends) names are aliases of the forms they extend."""
    fine = models.where("error is null")
    forms = fine.where("form_type <> 'convert'")
    form_key = F.col("key").alias("form_key")
    raw_entities = forms.select(form_key, F.explode("entities").alias("e")).select("form_key", "e.*")
    parents = raw_entities.select("form_key", F.col("id").alias("parent_id"), F.col("key").alias("parent_key")).where("parent_id is not null").dropDuplicates(["form_key", "parent_id"])
    entity = raw_entities.join(parents, ["form_key", "parent_id"], "left")
    # an entity id that two forms have refers to neither
    owner = raw_entities.where("level = 'header' and id is not null").groupBy(F.col("id").alias("ref_entity_id")).agg(
        F.when(F.min("form_key") == F.max("form_key"), F.min("form_key")).alias("ref_form_key")
    )
    names = forms.groupBy(F.col("key").alias("ref_form_key")).agg(F.first("name").alias("ref_form_name"))
    fields = forms.select(form_key, F.explode("fields").alias("f")).select("form_key", "f.*").withColumnRenamed("basedata_id", "ref_entity_id")
    fields = fields.withColumn("uid", F.concat_ws("::", "form_key", F.coalesce("entity_key", F.lit("")), F.coalesce("key", "id")))
    field = fields.join(owner, "ref_entity_id", "left").join(names, "ref_form_key", "left")
    plugins = fine.select(form_key, F.explode("plugins").alias("p")).select("form_key", "p.*")
    plugin = plugins.withColumn("uid", F.concat_ws("::", "form_key", F.coalesce("class_name", F.lit("")), "plugin_type"))
    op_plugins = plugin.where("plugin_type = 'op'").select("form_key", F.col("operation_key").alias("key")).distinct().withColumn("has_operation_plugin", F.lit(True))
    operation = forms.select(form_key, F.explode("operations").alias("o")).select("form_key", "o.*").where("key is not null")
    operation = operation.withColumn("resolved_from", F.lit("self")).join(op_plugins, ["form_key", "key"], "left").fillna(False, ["has_operation_plugin"])
    rules = fine.where("convert is not null").select(
        F.col("key").alias("id"), "name", "convert.*", "isv", "app_key", F.coalesce("app_key", F.lit("(none)")).alias("module"),
        F.size("plugins").cast("long").alias("plugin_count"), "source_file",
    )
    form = forms.select(
        "key", "name", "form_type", "model_type", "isv", "app_key", F.coalesce("app_key", F.lit("(none)")).alias("module"),
        F.col("source_file").alias("source_dym"),
    )
    if extensions is None:
        form = form.withColumns({"is_extension": F.lit(False), "extends": F.lit(None).cast("string")})
    else:
        alias = extensions.groupBy("key").agg(F.min("extends").alias("extends"))
        form = form.join(alias, "key", "left").withColumn("is_extension", F.col("extends").isNotNull())
    combo = fields.select(F.col("uid").alias("field_uid"), F.explode("combo_items").alias("c")).select("field_uid", "c.value", "c.caption")
    return {"form": form, "entity": entity, "field": field, "field_combo_item": combo, "plugin": plugin, "operation": operation, "convert_rule": rules}


def property_edges(meta: dict[str, DataFrame]) -> DataFrame:
    def edge(df: DataFrame, src: str, src_id, dst: str, dst_id, kind: str) -> DataFrame:
        return df.select(F.lit(src).alias("src_type"), src_id.alias("src_id"), F.lit(dst).alias("dst_type"), dst_id.alias("dst_id"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"))

    c = F.col
    parts = [
        edge(meta["entity"], "form", c("form_key"), "entity", F.concat_ws("::", "form_key", "key"), "has_entity"),
        edge(meta["field"], "entity", F.concat_ws("::", "form_key", "entity_key"), "field", c("uid"), "has_field"),
        edge(meta["plugin"], "form", c("form_key"), "plugin", c("uid"), "has_plugin"),
        edge(meta["form"], "module", c("module"), "form", c("key"), "module_contains"),
        edge(meta["convert_rule"], "form", c("source_entity"), "form", c("target_entity"), "converts_to"),
    ]
    if "binding" in meta:
        bound = meta["binding"].where("status in ('linked', 'linked_by_name')")
        parts.append(edge(bound, "plugin", F.concat_ws("::", "form_key", "class_name", "plugin_type"), "class", c("class_name"), "bound_to"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


# classes and bindings


def source_classes(parsed: DataFrame) -> DataFrame:
    """Declared classes with the platform base class above them, if any."""
    types = facts(parsed, "types")
    spark = parsed.sparkSession
    parents = types.select(F.col("simple").alias("child"), F.explode("supers").alias("parent"))
    bases = events.base_table(spark).select("base")
    above = graph.closure_to_bases(parents, "child", "parent", bases).select(F.col("node").alias("simple"), F.col("base").alias("plugin_base"))
    return types.join(above, "simple", "left").select("fqn", "simple", "package", "relpath", "plugin_base", F.col("line"))


def bindings(plugins: DataFrame, classes: DataFrame) -> DataFrame:
    """Each plugin of a form, linked to its source class."""
    refs = plugins.select("class_name", "form_key", "plugin_type", "source").withColumn("fqn", F.col("class_name")).withColumn("simple", text.last_segment(F.col("class_name")))
    outside = resolve.external_rules(F.col("class_name"), F.col("source"))
    linked = resolve.tiered_link(refs, "fqn", "simple", classes.where("instr(fqn, '$') = 0"), outside.isNotNull())
    path = classes.groupBy(F.col("fqn").alias("target")).agg(F.min("relpath").alias("source_relpath"))
    return linked.withColumn("confidence", F.coalesce("confidence", outside)).join(path, "target", "left").select(
        "class_name", "form_key", "plugin_type", "status", "source_relpath", "confidence", "target", F.lit(None).cast("string").alias("note")
    )


def with_orphans(classes: DataFrame, bound: DataFrame) -> DataFrame:
    used = bound.where("target is not null").select(F.col("target").alias("fqn")).distinct().withColumn("used", F.lit(True))
    role = classify.orphan_role(F.col("plugin_base").isNotNull(), F.col("fqn"))
    orphan = F.col("used").isNull()
    return classes.join(used, "fqn", "left").withColumns({"is_orphan": orphan, "orphan_role": F.when(orphan, role)}).drop("used")


# calls


def call_edges(parsed: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Every call site with its target: by compile-time symbol where there is one (which
    also forbids a guess of another target), else by receiver type among the project's
    classes if that name is unique and the method exists."""
    calls = facts(parsed, "calls")
    methods = facts(parsed, "methods").select(F.col("class_fqn").alias("t_fqn"), F.col("name").alias("t_name")).distinct()
    types = facts(parsed, "types").select("fqn", "simple").distinct()
    unique = types.groupBy("simple").agg(F.min("fqn").alias("t_fqn"), F.count("*").alias("n")).where("n = 1").select(F.col("simple").alias("receiver_type"), "t_fqn")
    own = F.col("receiver").isin("", "this") | (F.col("receiver") == "super")
    guess = calls.join(unique, "receiver_type", "left").withColumn("t_fqn", F.when(own & (F.col("kind") == "invocation"), F.col("class_fqn")).otherwise(F.col("t_fqn")))
    found = guess.join(methods.withColumn("exists", F.lit(True)), (guess["t_fqn"] == methods["t_fqn"]) & (guess["name"] == methods["t_name"]), "left").select(
        guess["*"], F.col("exists")
    )
    implicit = (F.col("kind") == "constructor") & F.col("t_fqn").isNotNull()
    rows = found.withColumn("t_fqn", F.when(F.col("exists") | implicit, F.col("t_fqn")))
    if symbols is not None:
        site = symbols.select("relpath", "line", "name", "col", F.col("resolution").alias("s_resolution"), F.col("declaring").alias("s_fqn"), F.col("signature").alias("s_signature"), F.col("target_kind").alias("s_kind"))
        rows = resolve.unique_match(rows, site, ["relpath", "line", "name"], "col")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("s_resolution", "s_fqn", "s_signature", "s_kind")})
    sure = F.col("s_resolution").isin("expr", "scope")
    resolution = F.when(sure, F.col("s_resolution")).when(F.col("t_fqn").isNotNull(), "heuristic").otherwise("failed")
    edges = rows.select(
        F.col("class_fqn").alias("caller_fqn"), F.col("method").alias("caller_method"), F.when(sure, F.col("s_fqn")).otherwise(F.col("t_fqn")).alias("target_fqn"),
        F.col("name").alias("target_method"), F.col("s_signature").alias("target_signature"), "kind", "line", "col", F.col("relpath").alias("source_relpath"),
        resolution.alias("resolution"), F.when(sure, F.col("s_kind")).when(F.col("t_fqn").isNotNull(), "project").alias("target_kind"),
        F.col("receiver").alias("evidence"), "args", "sources", "receiver",
    )
    if symbols is not None:
        edges = edges.unionByName(unmatched_sites(calls, symbols, facts(parsed, "methods")), allowMissingColumns=True)
    confidence = F.lit(0.0)
    for name, value in CALL_CONFIDENCE.items():
        confidence = F.when(F.col("resolution") == name, value).otherwise(confidence)
    return edges.withColumn("confidence", confidence)


def unmatched_sites(calls: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges of symbol sites that the reader has no call for; the caller is the innermost
    method around the line, or unknown."""
    alone = symbols.join(calls.select("relpath", "line", "name").distinct(), ["relpath", "line", "name"], "left_anti")
    around = methods.select("relpath", "class_fqn", F.col("name").alias("caller_method"), F.col("line").alias("first"), "end_line")
    inside = alone.join(around, "relpath", "left").where("first is null or line between first and end_line")
    placed = rank.first_per_group(inside, ["relpath", "line", "col", "name"], [F.desc("first"), F.col("end_line"), F.col("class_fqn")])
    rest = alone.join(placed.select("relpath", "line", "col", "name"), ["relpath", "line", "col", "name"], "left_anti")
    rows = placed.unionByName(rest, allowMissingColumns=True)
    sure = F.col("resolution").isin("expr", "scope")
    return rows.select(
        F.col("class_fqn").alias("caller_fqn"), "caller_method", F.when(sure, F.col("declaring")).alias("target_fqn"), F.col("name").alias("target_method"),
        F.col("signature").alias("target_signature"), F.col("kind"), "line", "col", F.col("relpath").alias("source_relpath"),
        F.when(sure, F.col("resolution")).otherwise("failed").alias("resolution"), F.when(sure, F.col("target_kind")).alias("target_kind"), F.lit("symbol only").alias("evidence"),
    )


def with_constant_forms(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """Rows whose ``form`` may name a constant: with its value, or as of a dynamic ``source``
    where the constant is unknown or has several values."""
    named = rows.where(F.col("form").startswith(CONSTANT_FORM)).select("form").distinct()
    part = F.split(F.substring("form", len(CONSTANT_FORM) + 1, 1000), "[.]")
    refs = named.select("form", part[0].alias("class_name"), part[1].alias("const_name"))
    values = resolve.resolve_constants(refs, constants.select("class_name", "const_name", "literal"), "class_name", "const_name", "literal").select("form", F.col("value").alias("const_form"))
    joined = rows.join(values, "form", "left")
    open_ = F.col("form").startswith(CONSTANT_FORM)
    source = F.when(open_ & F.col("const_form").isNull(), "dynamic").otherwise(F.col("source"))
    return joined.withColumns({"source": source, "form": F.when(open_, F.col("const_form")).otherwise(F.col("form"))}).select(*rows.columns)


def parameter_forms(edges: DataFrame, constants: DataFrame) -> DataFrame:
    """(class_fqn, method, param, form, depth) of the parameters for which all call sites
    agree on one form."""
    sites = edges.where("target_kind = 'project'").select(
        F.col("caller_fqn"), F.col("caller_method"), F.col("target_fqn"), F.col("target_method"), F.posexplode("sources").alias("pos", "s")
    )
    sites = with_constant_forms(sites.select("*", "s.form", "s.source", "s.param").drop("s"), constants)
    sites = sites.withColumn("s", F.struct("form", "source", "param"))
    target = F.concat_ws("#", "target_fqn", "target_method", F.col("pos").cast("string"))
    origin = (
        F.when(F.col("s.form").isNotNull(), F.concat(F.lit("form:"), "s.form"))
        .when(F.col("s.source") == "param", F.concat_ws("#", "caller_fqn", "caller_method", F.col("s.param").cast("string")))
        .when(F.col("s.source") == "own", F.concat(F.lit("own:"), "caller_fqn"))
        .otherwise(UNKNOWN_NODE)
    )
    flow = sites.select(origin.alias("from"), target.alias("to"))
    seeds = flow.where("`from` like 'form:%' or `from` like 'own:%'").select(F.col("from").alias("node"), F.col("from").alias("value")).distinct()
    found = graph.agree_fixpoint(flow, "from", "to", seeds).where("depth > 0")
    part = F.split("node", "#")
    return found.select(part[0].alias("class_fqn"), part[1].alias("method"), part[2].cast("int").alias("param"), F.col("value").alias("origin"), "depth")


def event_parameter_forms(reach: DataFrame, edges: DataFrame, homes: DataFrame, constants: DataFrame) -> DataFrame:
    """(start, node, param, event_form): forms of parameters as the walk from an event passes
    them along its path; a parameter that the calls of one step give different forms has none.
    ``reach`` has (start, node, depth, before: the node before it), ``homes`` (plugin_fqn, home_form)."""
    sites = edges.where("target_kind = 'project'").select(
        node("caller_fqn", "caller_method").alias("before"), node("target_fqn", "target_method").alias("node"), F.posexplode("sources").alias("param", "s")
    )
    sites = written(with_constant_forms(sites.select("*", "s.form", "s.source", F.col("s.param").alias("from_param")).drop("s"), constants), "sites")
    own = homes.select("plugin_fqn", "home_form")
    spark = reach.sparkSession
    known = found = spark.createDataFrame([], "start string, node string, param int, event_form string")
    for depth in range(1, EVENT_DEPTH + 1):
        steps = reach.where(F.col("depth") == depth).select("start", "node", "before")
        if steps.isEmpty():
            break
        passed = known.select("start", F.col("node").alias("before"), F.col("param").alias("from_param"), "event_form")
        rows = steps.join(sites, ["before", "node"]).join(passed, ["start", "before", "from_param"], "left")
        rows = rows.withColumn("plugin_fqn", F.substring_index("start", "#", 1)).join(own, "plugin_fqn", "left")
        value = F.when(F.col("source") == "form", F.col("form")).when(F.col("source") == "own", F.col("home_form")).when(F.col("source") == "param", F.col("event_form"))
        agreed = rows.groupBy("start", "node", "param").agg(F.count("*").alias("n"), F.count(value).alias("valued"), F.min(value).alias("event_form"), F.max(value).alias("other"))
        known = written(agreed.where("n = valued and event_form = other").select("start", "node", "param", "event_form"), "contexts")
        found = found.unionByName(known)
    return found


# accesses


def event_methods(parsed: DataFrame, classes: DataFrame, plugins: DataFrame) -> DataFrame:
    """Methods of plugin classes with event and phase; others are helpers."""
    spark = parsed.sparkSession
    kinds = classes.select(F.col("fqn").alias("class_fqn"), "plugin_base").join(
        plugins.select(F.col("class_name").alias("class_fqn"), "plugin_type").distinct(), "class_fqn", "left"
    )
    kinds = kinds.join(events.base_table(spark).withColumnRenamed("base", "plugin_base"), "plugin_base", "left").where("plugin_type is not null or base_kind is not null")
    kinds = kinds.select("class_fqn", events.plugin_kind(F.col("plugin_type"), F.col("base_kind"))["kind"].alias("plugin_kind")).distinct()
    methods = facts(parsed, "methods").join(kinds, "class_fqn")
    table = events.event_table(spark).select(F.col("kind").alias("plugin_kind"), F.col("event").alias("name"), "phase")
    joined = methods.join(F.broadcast(table), ["plugin_kind", "name"], "left")
    flow = F.col("plugin_kind") == "workflow"
    return joined.select(
        F.col("class_fqn").alias("plugin_fqn"), F.col("name").alias("method_name"),
        F.when(F.col("phase").isNotNull() | flow, F.col("name")).otherwise("helper").alias("event_kind"),
        F.coalesce("phase", F.when(flow, "transaction").otherwise("helper")).alias("event_phase"),
        F.col("line").alias("start_line"), F.col("end_line"), F.col("relpath").alias("source_relpath"), "plugin_kind",
    )


def resolved_keys(parsed: DataFrame) -> DataFrame:
    """Accesses whose constant keys are looked up over all files."""
    constants = facts(parsed, "constants").select("class_name", "const_name", "literal")
    raw = with_constant_forms(facts(parsed, "accesses"), constants).withColumn("id", F.monotonically_increasing_id())
    raw = written(raw, "accesses")
    refs = raw.where("key_resolution = 'constant'").select(
        "id", F.coalesce("key_class", text.last_segment(F.col("class_fqn"))).alias("class_name"), F.col("key_const").alias("const_name")
    )
    found = resolve.resolve_constants(refs, constants, "class_name", "const_name", "literal").select("id", F.col("resolution").alias("tier"), "value", F.col("confidence").alias("key_confidence"))
    joined = raw.join(found, "id", "left")
    how = F.when(F.col("key_resolution") != "constant", F.col("key_resolution")).when(F.col("tier").isin("class", "unique_name"), "constant").when(F.col("tier") == "ambiguous", "ambiguous").otherwise("external-const")
    base = F.when(F.col("key_resolution") == "literal", 1.0).when(F.col("key_resolution") == "constant", F.greatest("key_confidence", F.when(F.col("tier") == "unknown", 0.3).otherwise(0.0))).otherwise(0.3)
    return joined.withColumns({"field_key": F.coalesce("key", "value"), "key_resolution": how, "confidence": base}).drop("key", "key_class", "key_const", "tier", "value", "key_confidence")


def field_accesses(parsed: DataFrame, meta: dict[str, DataFrame], edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Field accesses seen from the events that reach them, and from no event where none does."""
    accesses = resolved_keys(parsed)
    entries = methods.where("event_kind <> 'helper'").select(
        node("plugin_fqn", "method_name").alias("start"), "plugin_fqn", F.col("method_name").alias("event_method"), "event_phase", "plugin_kind"
    )
    across = F.col("caller_fqn") != F.col("target_fqn")
    steps = edges.where("target_kind = 'project'").select(
        node("caller_fqn", "caller_method").alias("a"), node("target_fqn", "target_method").alias("b"),
        (across & F.col("resolution").isin("expr", "scope")).alias("symbol"), (across & (F.col("resolution") == "heuristic")).alias("heuristic"),
    )
    reach = graph.walks(steps, entries.select("start").distinct(), EVENT_DEPTH).withColumn("before", F.get("path", F.size("path") - 2))
    bare = reach.select("start", "node", "depth", "before")
    # methods of other classes are named with them
    plugin = F.substring_index("start", "#", 1)
    named = F.transform("path", lambda x: F.when(F.substring_index(x, "#", 1) == plugin, F.substring_index(x, "#", -1)).otherwise(
        F.concat_ws(".", text.last_segment(F.substring_index(x, "#", 1)), F.substring_index(x, "#", -1))
    ))
    reach = reach.withColumn("path", named).drop("before")
    sinks = facts(parsed, "methods").where("sink").select(node("class_fqn", "name").alias("node")).distinct().withColumn("sink", F.lit(True))
    sunk = reach.join(sinks, "node").select("start").distinct().withColumn("sinks", F.lit(True))
    # a call on a plain variable is none, a call on what another call or a member gives may be
    leaks = edges.where("target_fqn is null and kind <> 'constructor' and instr(receiver, '.') > 0").select(node("caller_fqn", "caller_method").alias("node")).distinct()
    leaky = reach.join(leaks, "node").select("start").distinct().withColumn("leaks", F.lit(True))
    home = meta["plugin"].groupBy(F.col("class_name").alias("plugin_fqn")).agg(
        F.when(F.min("form_key") == F.max("form_key"), F.min("form_key")).alias("home_form"), F.min("plugin_type").alias("plugin_type"),
        F.min("operation_key").alias("operation_key"),
    )
    # a plugin of several operations acts for each of them; one of several forms for none of them alone
    bound = meta["plugin"].select(F.col("class_name").alias("plugin_fqn"), "plugin_type", "operation_key").distinct().join(home.select("plugin_fqn", "home_form"), "plugin_fqn")
    op_types = meta["operation"].groupBy(F.col("form_key").alias("home_form"), F.col("key").alias("operation_key")).agg(F.min("operation_type").alias("op_type"))
    seen = (
        reach.join(entries, "start").join(sunk, "start", "left").join(leaky, "start", "left")
        .join(bound, "plugin_fqn", "left").join(op_types, ["home_form", "operation_key"], "left")
    )
    at = accesses.withColumn("node", node("class_fqn", "method"))
    verdict = classify.reasoned_persistence(F.col("sinks"), F.col("event_phase"), F.col("op_type"), F.col("leaks"))
    inside = at.join(seen, "node").withColumn("v", verdict)
    covered = inside.select("id").distinct()
    own_sink = at.join(covered, "id", "left_anti").join(sinks, "node", "left")
    alone = own_sink.select(
        *at.columns, F.col("class_fqn").alias("plugin_fqn"), F.col("method").alias("event_method"), F.lit("unknown").alias("event_phase"),
        F.struct(
            F.when(F.col("sink"), "yes").otherwise("unknown").alias("persists"), F.lit(0.6).alias("confidence"),
            F.when(F.col("sink"), "the method itself saves").otherwise("no analysed event reaches the method; its caller decides").alias("reason"),
        ).alias("v"), F.array("method").alias("path"), F.lit(False).alias("symbol"), F.lit(False).alias("heuristic"), F.lit(None).cast("string").alias("start"),
    ).join(home.select("plugin_fqn", "home_form", "plugin_type"), "plugin_fqn", "left")
    columns = [*at.columns, "plugin_fqn", "plugin_type", "event_method", "event_phase", "home_form", "v", "path", "symbol", "heuristic", "start"]
    rows = inside.select(*columns).unionByName(alone.select(*columns))

    params = parameter_forms(edges, facts(parsed, "constants")).withColumnRenamed("depth", "param_depth")
    caller_home = home.select(F.concat(F.lit("own:"), "plugin_fqn").alias("origin"), F.col("home_form").alias("caller_form"))
    params = params.join(caller_home, "origin", "left").withColumn("param_form", F.when(F.col("origin").startswith("form:"), F.substring("origin", 6, 1000)).otherwise(F.col("caller_form")))
    rows = rows.join(params.select("class_fqn", "method", "param", "param_form", "param_depth"), ["class_fqn", "method", "param"], "left")
    rows = rows.join(event_parameter_forms(bare, edges, home, facts(parsed, "constants")), ["start", "node", "param"], "left")
    by_flow = F.when(F.col("source") == "form", F.col("form")).when((F.col("source") == "own"), F.col("home_form"))
    by_param = F.when(F.col("source") == "param", F.col("param_form"))
    # callers that differ are told apart by the event
    by_event = F.when((F.col("source") == "param") & F.col("param_form").isNull(), F.col("event_form"))
    cap = F.when(F.col("param_depth") == 1, 0.85).otherwise(0.8)
    note = (
        F.when(F.col("source") == "dynamic", classify.NOTE_DYNAMIC)
        .when((F.col("source") == "param") & F.col("param_form").isNull() & F.col("event_form").isNull(), classify.NOTE_HELPER)
        .when(F.col("source").isNull() & (F.col("level") != "basedata"), classify.NOTE_SOURCE)
    )
    writes = F.col("access") == "write"
    located = rows.select(
        F.coalesce(by_flow, by_param, by_event).alias("form_key"), "field_key", "level", F.col("entry").alias("entry_key"), "plugin_fqn", "plugin_type",
        F.col("class_fqn").alias("access_class"), F.col("method").alias("access_method"), "event_method", "event_phase", "access",
        F.when(writes, F.col("v.persists")).otherwise("na").alias("persists"), F.when(writes, F.col("v.reason")).alias("persist_reason"), "via", "line",
        "path", "key_resolution",
        F.least(F.col("confidence"), F.when(writes, F.col("v.confidence")).otherwise(1.0), F.when(by_flow.isNull() & by_param.isNotNull(), cap).when(by_event.isNotNull(), 0.85).otherwise(1.0)).alias("confidence"),
        F.col("relpath").alias("source_relpath"), note.alias("evidence"),
        F.when(by_flow.isNotNull(), "data_flow").when(by_param.isNotNull(), "reverse_callgraph").when(by_event.isNotNull(), "data_flow").alias("form_key_source"),
        "symbol", F.col("heuristic").alias("guessed"), "receiver",
    )
    return finished(located, meta)


def finished(rows: DataFrame, meta: dict[str, DataFrame]) -> DataFrame:
    """Fill open forms from the metadata, deduplicate, and give the rest their reasons. A
    header access whose key is an entry's own key means that entry."""
    entries = entity_levels(meta["entity"]).where("level in ('entry', 'subentry')").select(F.col("key").alias("field_key"), F.col("level").alias("entry_level"))
    rows = rows.join(entries, "field_key", "left")
    means_entry = F.col("entry_level").isNotNull() & (F.col("level") == "header")
    rows = rows.withColumns({"entry_key": F.when(means_entry, F.col("field_key")).otherwise(F.col("entry_key")), "level": F.when(means_entry, F.col("entry_level")).otherwise(F.col("level"))})
    rows = back_filled(rows.drop("entry_level"), meta)
    key = ["form_key", "field_key", "level", "entry_key", "plugin_fqn", "access_class", "access_method", "event_method", "access", "line", "persists"]
    rest = [c for c in rows.columns if c not in key]
    no = F.lit(False)
    kept = dedup.keep_first(rows, key, sorted(c for c in rest if c not in ("path",)), F.coalesce("symbol", no), F.coalesce("guessed", no))
    reason = classify.null_reason(*(F.col(c) for c in ("form_key", "field_key", "key_resolution", "level", "access", "evidence", "via")))
    return kept.withColumn("null_reason", reason).drop("symbol", "guessed", "receiver")


def entity_levels(entities: DataFrame) -> DataFrame:
    """Level of each entity key; null where forms differ."""
    return setcmp.unique_reverse(entities.where("key is not null"), "key", "level")


def back_filled(rows: DataFrame, meta: dict[str, DataFrame]) -> DataFrame:
    """Forms of open rows from the metadata: a field key of one form; else the one of its
    forms that the class is bound to; else the one that all keys of the same method and
    receiver share. The platform's own fields prove nothing. Only open rows change."""
    fields = meta["field"].where("kind <> 'platform' and key is not null").select(F.col("key").alias("field_key"), F.col("form_key").alias("cand")).distinct()
    one = fields.groupBy("field_key").agg(F.when(F.count("*") == 1, F.min("cand")).alias("unique_form"))
    bound = meta["plugin"].select(F.col("class_name").alias("cls"), F.col("form_key").alias("cand")).distinct()
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "accesses")
    todo = rows.where("form_key is null and field_key is not null").select("row_id", "field_key", "access_class", "plugin_fqn", "source_relpath", "event_method", "receiver")
    pairs = todo.join(fields, "field_key")
    in_bound = (
        pairs.select("row_id", "cand", F.explode(F.array_distinct(F.array("access_class", "plugin_fqn"))).alias("cls"))
        .join(bound, ["cls", "cand"]).select("row_id", "cand").distinct().groupBy("row_id").agg(F.when(F.count("*") == 1, F.min("cand")).alias("bound_form"))
    )
    group = ["source_relpath", "access_class", "event_method", "receiver"]
    shared = resolve.only_candidate(pairs.where("receiver is not null"), group, "cand", "field_key")
    shared = pairs.join(shared, [*group, "cand"]).select("row_id", F.col("cand").alias("shared_form"))
    joined = rows.join(one, "field_key", "left").join(in_bound, "row_id", "left").join(shared, "row_id", "left")
    free = F.col("form_key").isNull() & F.col("field_key").isNotNull()
    form = F.when(free, F.coalesce("unique_form", "bound_form", "shared_form")).otherwise(F.col("form_key"))
    source = (
        F.when(free & F.col("unique_form").isNotNull(), "metadata_unique").when(free & F.col("bound_form").isNotNull(), "metadata_binding")
        .when(free & F.col("shared_form").isNotNull(), "metadata_cooccur").otherwise(F.col("form_key_source"))
    )
    cap = F.when(source == "metadata_unique", 0.9).when(source.isin("metadata_binding", "metadata_cooccur"), 0.7).otherwise(1.0)
    filled = joined.withColumns({"new_form": form, "new_source": source, "confidence": F.round(F.least("confidence", cap), 3)})
    return filled.withColumns({"form_key": F.col("new_form"), "form_key_source": F.col("new_source")}).drop(
        "new_form", "new_source", "unique_form", "bound_form", "shared_form", "row_id"
    )


def annotation_writes(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    """Classes whose annotations name known fields and that are filled by reflection write
    those fields; nothing is known of when or where to."""
    marks = facts(parsed, "annotations").where("value is not null").withColumnRenamed("value", "field_key")
    keys = fields.where("key is not null").select(F.col("key").alias("field_key")).distinct()
    setters = facts(parsed, "calls").where("receiver_type = 'Field' and name = 'get' or name in ('getDeclaredFields', 'getAnnotation')").select("class_fqn").distinct()
    return marks.join(keys, "field_key", "left_semi").join(setters, "class_fqn", "left_semi").select(
        "field_key", F.col("class_fqn").alias("access_class"), F.col("class_fqn").alias("plugin_fqn"), F.lit("write").alias("access"), F.lit("unknown").alias("persists"),
        F.lit("filled by reflection; whoever saves the result decides").alias("persist_reason"),
        F.lit("annotation-map").alias("key_resolution"), F.lit("annotation-map").alias("via"), F.lit(0.6).alias("confidence"), F.col("relpath").alias("source_relpath"), F.lit("unknown").alias("level"),
    ).distinct()


def argument_values(calls: DataFrame, constants: DataFrame, at: int, name: str) -> DataFrame:
    """Add the value of an argument (a literal, or a constant looked up) and how it was found."""
    arg = F.coalesce(F.get("args", F.lit(at)), F.lit(""))
    literal = F.regexp_extract(arg, '^"([^"]*)"$', 1)
    named = r"^(?:[\w.]*?(\w+)\.)?([A-Z][A-Z0-9_]*)$"
    cls, const = F.regexp_extract(arg, named, 1), F.regexp_extract(arg, named, 2)
    rows = written(calls.withColumn("call_id", F.monotonically_increasing_id()), "calls")
    refs = rows.where(const != "").select("call_id", F.when(cls != "", cls).otherwise(text.last_segment(F.col("caller_fqn"))).alias("class_name"), const.alias("const_name"))
    found = resolve.resolve_constants(refs, constants.select("class_name", "const_name", "literal"), "class_name", "const_name", "literal")
    found = found.select("call_id", F.col("resolution").alias("tier"), F.col("value").alias("looked_up"), F.col("confidence").alias("sure"))
    tier = F.when(F.col("tier").isin("class", "unique_name"), "constant").otherwise(F.coalesce("tier", F.lit("unknown")))
    return rows.join(found, "call_id", "left").select(
        *calls.columns,
        F.when(literal != "", literal).otherwise(F.col("looked_up")).alias(name),
        F.when(literal != "", "literal").otherwise(tier).alias(f"{name}_how"),
        F.when(literal != "", 1.0).otherwise(F.coalesce("sure", F.lit(0.0))).alias(f"{name}_sure"),
    )


def operation_triggers(edges: DataFrame, meta: dict[str, DataFrame], constants: DataFrame) -> DataFrame:
    """Calls that trigger an operation, with its key and the form it runs on. A call that
    symbols resolve to a class outside the platform is none."""
    calls = edges.where(F.col("target_method").isin(TRIGGERS))
    calls = calls.where("resolution not in ('expr', 'scope') or target_fqn like 'kd.bos.%'")
    rows = argument_values(argument_values(calls, constants, 0, "op_key"), constants, 1, "given")
    bound = meta["plugin"].groupBy(F.col("class_name").alias("caller_fqn")).agg(F.count_distinct("form_key").alias("forms"), F.min("form_key").alias("one_form"))
    rows = rows.join(bound, "caller_fqn", "left")
    execute, one, several = F.col("target_method") == "executeOperate", F.col("forms") == 1, F.col("forms") > 1
    target = F.when(execute, F.col("given")).when(one, F.col("one_form"))
    how = F.when(execute, F.col("given_how")).when(one, "binding").when(several, "ambiguous").otherwise("unknown")
    sure = F.when(execute, F.col("given_sure")).when(one, 0.85).when(several, 0.3).otherwise(0.0)
    receiver = F.when(F.col("resolution").isin("expr", "scope"), "symbol").otherwise("text")
    found = rows.select(
        F.col("caller_fqn").alias("caller_class"), "caller_method", "line", "source_relpath", F.col("target_method").alias("via"), "op_key",
        F.col("op_key_how").alias("op_key_resolution"), F.col("op_key_sure").alias("op_key_confidence"), target.alias("target_form_key"),
        how.alias("target_resolution"), sure.alias("target_confidence"), F.col("evidence"), receiver.alias("receiver_source"),
    )
    return rank.first_per_group(found, ["caller_class", "caller_method", "line", "via"], [F.col("op_key"), F.col("target_form_key"), F.col("source_relpath")])


def coarse_hits(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    """Places that mention a business key, as a string or by a constant's name that stands
    for one key only; one row for each key and line, the first in the file's order."""
    keys = fields.where("kind in ('entity', 'dynamic') and key is not null").select(F.col("key").alias("field_key")).distinct()
    words = parsed.select("relpath", F.posexplode("tokens").alias("pos", "t")).select("relpath", "pos", "t.*")
    strings = words.where("kind = 'string'").withColumnRenamed("text", "field_key").join(keys, "field_key", "left_semi")
    constants = facts(parsed, "constants").groupBy("const_name").agg(F.when(F.min("literal") == F.max("literal"), F.min("literal")).alias("field_key")).where("field_key is not null")
    named = words.where("kind = 'name'").withColumnRenamed("text", "const_name").join(constants, "const_name").join(keys, "field_key", "left_semi")
    via = lambda a, b: F.when(F.col("idiom"), a).otherwise(b).alias("via")
    rows = strings.select("field_key", "relpath", "line", "pos", via("rw-idiom", "literal")).union(named.select("field_key", "relpath", "line", "pos", via("const-rw-idiom", "const-ref")))
    return rows.groupBy("field_key", "relpath", "line").agg(F.min_by("via", "pos").alias("via"))


def search_rows(meta: dict[str, DataFrame], classes: DataFrame) -> DataFrame:
    c, lit = F.col, F.lit
    return (
        meta["form"].select(lit("form").alias("kind"), c("key"), c("name"), c("module").alias("extra"))
        .union(meta["entity"].select(lit("entity"), "key", "name", "form_key"))
        .union(meta["field"].select(lit("field"), "key", "name", "form_key"))
        .union(meta["plugin"].select(lit("plugin"), "class_name", "operation_name", "form_key"))
        .union(classes.select(lit("class"), "fqn", "simple", "module"))
    )


def module_map(meta: dict[str, DataFrame], bound: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, classes with module): a file belongs to the module that most of its
    bindings vote for; other classes to the owner of their longest exclusive package."""
    modules = meta["form"].select(F.col("key").alias("form_key"), "module").distinct()
    votes = bound.where("source_relpath is not null").join(modules, "form_key").select("source_relpath", "module")
    by_file = rank.majority(votes, ["source_relpath"], "module", [F.col("module")]).select(F.col("source_relpath").alias("relpath"), "module")
    placed = classes.join(by_file, "relpath", "left")
    packages = placed.withColumn("prefixes", text.package_prefixes(F.col("package")))
    owners = aggregate.owner_by_longest_prefix(packages.where("module is not null"), packages.where("module is null"), "prefixes", "module", "fqn").withColumnRenamed("module", "owner")
    placed = placed.join(owners, "fqn", "left").withColumn("module", F.coalesce("module", "owner", F.lit("(unclassified)"))).drop("owner")
    dominant = aggregate.consistency(placed.where("module <> '(unclassified)'"), "module", "package").select("module", F.col("dominant").alias("dominant_package"), F.col("share").alias("pkg_consistency"))
    per = lambda df, name: df.groupBy("module").agg(F.count("*").alias(name))
    forms = meta["form"].select(F.col("key").alias("form_key"), "module")
    rows = per(meta["form"], "form_count")
    counts = {"entity_count": meta["entity"].join(forms, "form_key"), "plugin_count": meta["plugin"].join(forms, "form_key"), "class_count": placed, "orphan_real_count": placed.where("is_orphan and orphan_role = 'plugin'")}
    for name, df in counts.items():
        rows = rows.join(per(df, name), "module", "full_outer")
    rows = rows.join(dominant, "module", "left").fillna(0, ["form_count", *counts])
    return rows.select(F.col("module").alias("name"), F.col("module").alias("app_key"), "*", F.lit(1.0).alias("confidence")).drop("module"), placed


def build(spark: SparkSession, folder: str, files: DataFrame, models: DataFrame, symbols: DataFrame | None = None, status: dict | None = None, prefixes: DataFrame | None = None) -> KnowledgeBase:
    """Build the knowledge base in a folder from source files and models. ``prefixes``
    (column ``prefix``) are those of one's own keys, by which extensions are known."""
    parsed = written(parse_files(files), "parsed")
    models = written(models, "models")
    meta = metadata_tables(models, formxml.extension_target(models, prefixes) if prefixes is not None else None)
    classes = written(source_classes(parsed), "classes")
    bound = written(bindings(meta["plugin"], classes), "bindings")
    modules, placed = module_map(meta, bound, with_orphans(classes, bound))
    placed = written(placed, "classes")
    edges = written(call_edges(parsed, symbols), "edges")
    methods = written(event_methods(parsed, classes, meta["plugin"]), "methods")
    accesses = field_accesses(parsed, meta, edges, methods).unionByName(annotation_writes(parsed, meta["field"]), allowMissingColumns=True)
    constants = facts(parsed, "constants").withColumnRenamed("relpath", "source_relpath")
    tables = {
        **meta, "binding": bound, "source_class": placed, "module": modules, "call_edge": edges, "plugin_method": methods, "field_access": accesses,
        "java_constant": constants, "operation_trigger": operation_triggers(edges, meta, constants), "coarse_field_hit": coarse_hits(parsed, meta["field"]),
        "edge": property_edges({**meta, "binding": bound}), "search": search_rows(meta, placed),
    }
    states = {r["status"]: r["files"] for r in parsed.groupBy("status").agg(F.count("*").alias("files")).collect()}
    return write_kb(spark, folder, tables, {"java_analysis": states, "symbol_resolution": status or {"status": "unavailable"}})
