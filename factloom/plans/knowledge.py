"""Queries over a knowledge base.

Each answers with a plain dict: exact totals first, then lists that are capped or
paged with the number of items left out and a cursor to the rest. Filters on
keys reach the Parquet scans; only capped lists are collected. Nothing is
guessed: an ambiguous question is answered with its candidates.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import classify
from factloom.functions.text import KEY_TOKEN, fold
from factloom.operators import aggregate, fts, graph, rank, resolve, setcmp
from factloom.sources.store import KnowledgeBase

#: Items of a list, characters of an answer, bytes of a page of callers.
CAP, PAGE, BUDGET, CALLERS_PAGE, CALLERS_BUDGET = 20, 40, 31_000, 40, 28 * 1024
OVERSIZED, LOW_CONSISTENCY, STRONG_ZERO = 150, 0.6, 0.95
ACCESS_FIELDS = [
    "form_key", "level", "entry_key", "plugin_fqn", "plugin_type", "access_class", "access_method", "event_method", "event_phase",
    "access", "persists", "via", "line", "key_resolution", "confidence", "source_relpath", "form_key_source", "null_reason", "edge_source",
]


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def counts(df: DataFrame, *by: str) -> dict:
    return {"|".join(str(r[c]) for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


def paged(df: DataFrame, order: list[Column], section: str, cursor: str | None = None, size: int = PAGE) -> dict:
    """One page of a list, with its exact total and the cursor of the next."""
    name, offset = rank.parse_cursor(cursor)
    offset = offset if name == section else 0
    total = df.count()
    items = rows_of(rank.page(df, order, offset, size).orderBy("position").drop("position"))
    return {"total": total, "items": items, **rank.pagination(total, offset, size, section)}


def within_budget(answer: dict, lists: list[str], budget: int = BUDGET) -> dict:
    """Shorten the named lists, longest first, until the answer fits; what is left out is
    counted beside each list."""
    ladder = [CAP, 10, 5, 3, 1, 0]
    for cap in ladder:
        if len(json.dumps(answer, indent=2, default=str)) <= budget:
            break
        for name in lists:
            items = answer.get(name) or []
            if len(items) > cap:
                answer[f"{name}_capped"] = answer.get(f"{name}_capped", 0) + len(items) - cap
                answer[name] = items[:cap]
    return answer


def parse_locator(locator: str) -> dict:
    parts = locator.split(".")
    if len(parts) > 4 or not all(parts):
        raise ValueError(f"not a field locator: {locator!r}")
    return {
        "field": parts[-1], "form": parts[0] if len(parts) > 1 else None, "entry": parts[-2] if len(parts) > 2 else None,
        "level": {3: "entry", 4: "subentry"}.get(len(parts)),
    }


# fields


def trace_field(kb: KnowledgeBase, locator: str, access: str | None = None, cursor: str | None = None) -> dict:
    """Who reads and writes a field, where from, and whether it is saved."""
    at = parse_locator(locator)
    field = kb.table("field").where(F.col("key") == at["field"])
    occurrences = rows_of(field.select("form_key", "entity_key", "key", "name", "kind", "level").orderBy("form_key", "entity_key"))
    forms = sorted({o["form_key"] for o in occurrences if o["form_key"]})
    if at["form"] is None and len(forms) > 1:
        return {"need_clarification": True, "field": at["field"], "candidates": [f"{f}.{at['field']}" for f in forms], "occurrences": occurrences}
    form = at["form"] or (forms[0] if forms else None)
    alias = kb.table("form").where((F.col("key") == form) & F.col("is_extension")).select("extends").first()
    if alias and alias["extends"]:
        return {"redirect": f"{alias['extends']}.{at['field']}", "reason": "extension_alias", "field": at["field"]}
    rows = kb.table("field_access").where(F.col("field_key") == at["field"])
    if access:
        rows = rows.where(F.col("access") == access)
    exact = F.col("form_key").eqNullSafe(F.lit(form)) if form else F.lit(True)
    if at["entry"]:
        exact = exact & (F.col("entry_key") == at["entry"])
    if at["level"]:
        exact = exact & (F.col("level") == at["level"])
    bucket = F.when(F.col("form_key").isNull(), "unlocated").when(exact, "exact").otherwise("possible")
    rows = rows.withColumn("bucket", bucket)
    found = rows.where("bucket = 'exact'").select(*ACCESS_FIELDS)
    is_write = F.col("access") == "write"
    groups = aggregate.coordinates(rows.where("bucket <> 'unlocated'"), ["form_key", "level", "entry_key"], is_write, F.col("form_key").isNotNull())
    by_class = aggregate.merge_sites(
        found.where(is_write).select("access_class", "access_method", "line", "persists"), ["access_class"],
        [rank.place_in(F.col("persists"), rank.PERSIST_ORDER), F.col("line"), F.col("access_method")], F.concat_ws(":", "access_method", F.col("line").cast("string")), CAP,
    )
    readers = aggregate.two_level(found.where(~is_write), "access_class", "access_method")
    high = kb.table("field_access").where(F.col("field_key") == at["field"]).select("field_key", F.col("source_relpath").alias("relpath"), "line")
    coarse = kb.table("coarse_field_hit").where(F.col("field_key") == at["field"])
    constants = kb.table("source_class").where("orphan_role = 'constant'").select("relpath")
    blind = setcmp.blind_spots(coarse, high, "field_key", ["relpath", "line"], constants, CAP)
    dynamic = dynamic_candidates(kb, form)
    order = [*rank.access_order("access", "persists", "confidence", "plugin_fqn"), F.col("source_relpath"), F.col("line"), F.col("event_method"), F.col("access_method"), F.col("via")]
    unlocated = aggregate.worklist(rows.where("bucket = 'unlocated'"), ["access_class", "access_method"], is_write, "null_reason", classify_reasons(), ["source_relpath", "line"], 3)
    methods = found.where("access_method is not null").groupBy("access_class", "access_method").count()
    by_name = [F.col("access_class"), F.col("access_method")]
    sections: dict[str, tuple[DataFrame, list[Column]]] = {
        "exact": (found, order), "writers": (by_class, [F.col("access_class")]), "readers": (readers, [F.col("access_class")]), "unlocated": (unlocated, by_name),
        "groups": (groups, [F.desc("located"), F.desc("writers"), F.col("form_key"), F.col("level"), F.col("entry_key")]), "dynamic_candidates": (dynamic, by_name),
        "coarse_blind_spots": (blind, [F.col("field_key")]), "entries": (methods, [F.desc("count"), *by_name]),
    }
    section, offset = rank.parse_cursor(cursor)
    if cursor and section not in sections:
        return {"error": f"no section {section!r}", "sections": sorted(sections)}
    if section and section != "exact":
        # a page of one section only
        rows_, size = sections[section], 3 if section == "entries" else PAGE
        page = paged(rows_[0], rows_[1], section, cursor, size)
        answer = {"field": at["field"], "form": form, "section": section, "total": page["total"], "items": entry_items(kb, page["items"], offset) if section == "entries" else page["items"]}
        answer = within_budget(answer, ["items"])
        return answer | {"pagination": rank.pagination(page["total"], offset, max(1, len(answer["items"])), section)}
    page = paged(found, order, "exact", cursor)
    listed = {n: rows_of(df.orderBy(*by).limit(CAP)) for n, (df, by) in sections.items() if n not in ("exact", "entries")}
    answer = {
        "field": at["field"], "form": form, "access": access or "all", "occurrences": occurrences, "summary": counts(rows, "bucket", "access"), "persists": counts(found.where(is_write), "persists"),
        "total": page["total"], "accesses": page["items"], **listed, "entries": entries_of(kb, found, CAP), "convert_context": converts(kb, form) if form else None,
    }
    answer = within_budget(answer, ["unlocated", "readers", "writers", "dynamic_candidates", "groups", "entries", "accesses"])
    # cursors begin where the lists, as they are now, end
    answer["pagination"] = rank.pagination(page["total"], offset, max(1, len(answer["accesses"])), "exact")
    totals = {n: df.count() for n, (df, _) in sections.items() if n != "exact"}
    answer["sections"] = {n: {"total": t, **rank.pagination(t, 0, len(answer[n]), n)} for n, t in totals.items()}
    return answer


def first_accesses(kb: KnowledgeBase, locator: str, n: int = PAGE) -> tuple[list[dict], int]:
    """The first ``n`` exact accesses of a field, and the number of all. An answer that the
    budget shortened is followed by its cursors."""
    items, cursor = [], None
    while True:
        found = trace_field(kb, locator, cursor=cursor)
        items += found.get("accesses", [])
        total, cursor = found.get("total", 0), found.get("pagination", {}).get("next_cursor")
        if len(items) >= min(n, total):
            return items[:n], total
        if not found["accesses"]:
            raise ValueError(f"no access of {locator!r} fits an answer")


def classify_reasons() -> list[str]:
    from factloom.schema import VOCABULARIES

    return VOCABULARIES["field_access.null_reason"]


def dynamic_candidates(kb: KnowledgeBase, form: str | None) -> DataFrame:
    """Writes with an undetermined key that could mean a field of the form: those of the form,
    and those of no form in classes bound to it."""
    rows = kb.table("field_access").where("field_key is null and access = 'write'")
    if form:
        homes = home_forms(kb).where(F.col("form_key") == form).select(F.col("class_name").alias("plugin_fqn")).distinct()
        of_form = rows.where(F.col("form_key") == form)
        rows = of_form.unionByName(rows.where("form_key is null").join(homes, "plugin_fqn", "left_semi").select(*rows.columns))
    return aggregate.worklist(rows, ["access_class", "access_method"], F.lit(True), "key_resolution", classify.UNDETERMINED_KEYS, ["source_relpath", "line"], 3)


def home_forms(kb: KnowledgeBase) -> DataFrame:
    """(class_name, form_key): forms that a class is registered or linked for."""
    plugin = kb.table("plugin").select("class_name", "form_key")
    return plugin.union(kb.table("binding").select("class_name", "form_key")).where("form_key is not null").distinct()


def converts(kb: KnowledgeBase, form: str) -> dict:
    rules = kb.table("convert_rule")
    return {
        "from": [r["source_entity"] for r in rules.where(F.col("target_entity") == form).select("source_entity").distinct().orderBy("source_entity").collect()],
        "to": [r["target_entity"] for r in rules.where(F.col("source_entity") == form).select("target_entity").distinct().orderBy("target_entity").collect()],
    }


def entries_of(kb: KnowledgeBase, found: DataFrame, cap: int) -> list[dict]:
    """The entry chains of the physical methods that hold accesses, one for each method."""
    methods = found.where("access_method is not null").groupBy("access_class", "access_method").count().orderBy(F.desc("count"), "access_class", "access_method").limit(3)
    return entry_items(kb, rows_of(methods), 0)[:cap]


def entry_items(kb: KnowledgeBase, methods: list[dict], offset: int) -> list[dict]:
    return [
        {"ref": f"ec{i}", "class": r["access_class"], "method": r["access_method"], **chains(kb, r["access_class"], r["access_method"], max_chains=2)}
        for i, r in enumerate(methods, offset + 1)
    ]


# calls


def chains(kb: KnowledgeBase, cls: str, method: str, max_chains: int = graph.MAX_CHAINS, max_depth: int = graph.MAX_DEPTH, max_nodes: int = graph.MAX_NODES) -> dict:
    """How a method is reached from plugin events, by the shortest paths."""
    join = lambda a, b: F.concat_ws("#", a, b)
    methods = kb.table("plugin_method").where("event_kind <> 'helper'")
    own = methods.where((F.col("plugin_fqn") == cls) & (F.col("method_name") == method)).first()
    if own:
        return {"status": "self_entry", "event": own["event_kind"], "phase": own["event_phase"], "chains": [], "chains_truncated": 0, "search_truncated": False}
    calls = kb.table("call_edge").where("caller_fqn is not null and target_fqn is not null")
    sites = calls.select(join("caller_fqn", "caller_method").alias("caller"), join("target_fqn", "target_method").alias("target"), "confidence", (~F.col("resolution").isin("expr", "scope")).alias("heuristic"), "source_relpath", "line", "col")
    edges = graph.representative_edges(sites, ["caller"], ["target"], "confidence", ["source_relpath", "line", "col"])
    entries = methods.select(join("plugin_fqn", "method_name").alias("node"))
    plugin_classes = kb.table("plugin").select("class_name").union(kb.table("source_class").where("orphan_role = 'plugin'").select("fqn")).distinct()
    nodes = calls.select("caller_fqn", join("caller_fqn", "caller_method").alias("node")).union(calls.select("target_fqn", join("target_fqn", "target_method"))).distinct()
    bounds = nodes.join(plugin_classes.withColumnRenamed("class_name", "caller_fqn"), "caller_fqn", "left_semi").select("node")
    found, truncated = graph.entry_chains(edges, f"{cls}#{method}", entries, bounds, max_depth, max_nodes)
    ends = found.where("terminal is not null").withColumn("place", rank.place_in(F.col("terminal"), graph.TERMINALS))
    total = ends.count()
    first = ends.orderBy("place", "node").limit(max_chains)
    confidence = graph.chain_confidence(F.col("terminal"), F.col("heuristic")).alias("confidence")
    listed = first.join(graph.chain_hops(found, first), "node").select("place", "node", "terminal", confidence, "hops").orderBy("place", "node").drop("place")
    items = rows_of(listed)
    kinds = {i["terminal"] for i in items}
    status = "reached" if "entry" in kinds else "boundary_only" if "plugin_boundary" in kinds else "not_found"
    return {"status": status, "chains": items, "chains_truncated": max(0, total - max_chains), "search_truncated": truncated}


def registration(kb: KnowledgeBase, classes: list[str]) -> dict[str, str]:
    """Whether classes are registered as plugins and switched on. A rule's plugins take the
    rule's flag; a class without registration may still be a plugin by its base class."""
    spark = kb.spark
    wanted = spark.createDataFrame([(c,) for c in classes], "class_name string")
    plugin = kb.table("plugin").select("class_name", "form_key", "plugin_type", "enabled").join(wanted, "class_name", "left_semi")
    rules = kb.table("convert_rule").select(F.col("id").alias("form_key"), F.col("enabled").alias("rule_enabled"))
    flags = plugin.join(rules, "form_key", "left").select("class_name", F.when(F.col("plugin_type") == "convert", F.col("rule_enabled")).otherwise(F.col("enabled")).alias("enabled"))
    status = graph.registration_status(wanted, "class_name", flags, "enabled")
    base = kb.table("source_class").groupBy(F.col("fqn").alias("class_name")).agg(F.min("plugin_base").alias("base"))
    rows = status.join(base, "class_name", "left").collect()
    from factloom.functions.events import BASES, REGISTERED

    out = {}
    for r in rows:
        found = r["status"]
        if found == "no_registration":
            kind = BASES.get(r["base"])
            found = "no_registration_evidence" if r["base"] is None else "orphan_unregistered" if kind in REGISTERED else "orphan_unverifiable"
        out[r["class_name"]] = found
    return out


def resolution_coverage(kb: KnowledgeBase) -> dict:
    state = kb.meta().get("symbol_resolution") or {}
    coverage = state.get("coverage")
    strong = state.get("status") == "ok" and (coverage or 0) >= STRONG_ZERO and not state.get("failed_files")
    return {"status": state.get("status", "unavailable"), "coverage": coverage, "failed_files": state.get("failed_files", 0), "strong_zero": bool(strong), "resolutions": counts(kb.table("call_edge"), "resolution")}


def entry_analysis(kb: KnowledgeBase, cls: str, method: str, platform: bool = False) -> dict:
    """Verdict on whether a method can be reached from a registered, enabled entry."""
    if platform:
        return {"verdict": "not_analyzed", "confidence": "unknown", "chains": []}
    coverage = resolution_coverage(kb)
    found = chains(kb, cls, method, max_chains=12)
    tops = {cls} if found["status"] == "self_entry" else {c["node"].split("#")[0] for c in found["chains"] if c["terminal"] in ("entry", "plugin_boundary")}
    states = registration(kb, sorted(tops)) if tops else {}
    enabled = {c for c, s in states.items() if s == "registered_enabled"}
    sure = found["status"] == "self_entry" or any(c["confidence"] == "confirmed" and c["node"].split("#")[0] in enabled for c in found["chains"])
    inactive = bool(states) and all(s in ("registered_disabled", "orphan_unregistered") for s in states.values())
    truncated = found["search_truncated"] or found["chains_truncated"] > 0
    weak = coverage["status"] != "ok" or bool(coverage["failed_files"])
    lit = F.lit
    verdict = classify.entry_verdict(lit(False), lit(found["status"]), lit(bool(enabled)), lit(inactive), lit(bool(sure)), lit(truncated), lit(weak), lit(coverage["strong_zero"]))
    row = kb.spark.range(1).select(verdict.alias("v")).first()["v"]
    return {"verdict": row["verdict"], "confidence": row["confidence"], "registration": states, **found}


def callers(kb: KnowledgeBase, target: str, cursor: str | None = None) -> dict:
    """Call sites of ``Class.method``, with the analysis of its entries on the first page."""
    cls, _, method = target.rpartition(".")
    if not cls:
        return {"error": "name the class and the method"}
    offset = rank.strict_cursor(cursor)
    edges = kb.table("call_edge")
    ends = F.col("fqn") == cls if "." in cls else (F.col("fqn") == cls) | F.col("fqn").endswith("." + cls) | F.col("fqn").endswith("$" + cls)
    known = kb.table("source_class").select("fqn").union(edges.select(F.col("target_fqn"))).where("fqn is not null").where(ends).distinct()
    names = [r["fqn"] for r in known.orderBy("fqn").limit(CAP + 1).collect()]
    if not names:
        return {"error": f"unknown class {cls}", "coverage": resolution_coverage(kb)}
    if len(names) > 1:
        return {"need_clarification": True, "candidates": [f"{n}.{method}" for n in names[:CAP]]}
    fqn = names[0]
    sites = edges.where((F.col("target_fqn") == fqn) & (F.col("target_method") == method))
    order = [F.desc("confidence"), *(F.col(c) for c in ("caller_fqn", "caller_method", "source_relpath", "line", "col"))]
    summary = sites.agg(
        F.count("*").alias("sites"), F.count_distinct("caller_fqn", "caller_method").alias("caller_methods"), F.count(F.when(F.col("kind") == "method_reference", 1)).alias("method_references")
    ).first().asDict()
    items = rows_of(rank.page(sites, order, offset, CALLERS_PAGE).orderBy("position").drop("position", "evidence"))
    pages = rank.pages_by_budget([len(json.dumps(i, default=str).encode()) for i in items], CALLERS_BUDGET)
    items = [i for i, p in zip(items, pages, strict=True) if p == 0]
    answer = {"target": f"{fqn}.{method}", "summary": {**summary, "by_resolution": counts(sites, "resolution")}, "coverage": resolution_coverage(kb), "sites": items}
    answer |= rank.pagination(summary["sites"], offset, max(1, len(items)), "sites")
    if not offset:
        outside = sites.where("target_kind in ('jar', 'jdk')").limit(1).count() > 0
        answer["entry_analysis"] = entry_analysis(kb, fqn, method, platform=outside)
    return answer


# operations


def trace_operation(kb: KnowledgeBase, locator: str) -> dict:
    """What triggers an operation, what may, and what it triggers in turn."""
    parts = locator.split(".")
    if len(parts) > 2:
        raise ValueError(f"not an operation locator: {locator!r}")
    op, triggers = parts[-1], kb.table("operation_trigger")
    forms = kb.table("operation").where(F.col("key") == op).select("form_key").union(triggers.where(F.col("op_key") == op).select("target_form_key")).where("form_key is not null").distinct()
    if len(parts) == 1:
        names = [r["form_key"] for r in forms.orderBy("form_key").limit(CAP + 1).collect()]
        if len(names) != 1:
            return {"need_clarification": len(names) > 1, "candidates": [f"{n}.{op}" for n in names[:CAP]], "error": None if names else f"unknown operation {op}"}
        form = names[0]
    else:
        form = parts[0]
    reasons = ["exact", "op_unresolved", "target_unresolved", "both_unresolved"]
    rows = triggers.withColumn("reason", classify.inbound_suspect(F.col("target_form_key"), F.col("op_key"), form, op)).where("reason is not null")
    order = [rank.place_in(F.col("reason"), reasons), *(F.col(c) for c in ("caller_class", "caller_method", "line", "via"))]
    homes = home_forms(kb).groupBy(F.col("class_name").alias("caller_class")).agg(F.array_sort(F.collect_set("form_key")).alias("caller_forms"))
    inbound = rows.join(homes, "caller_class", "left")
    bound = kb.table("plugin").where((F.col("form_key") == form) & (F.col("plugin_type") == "op") & (F.col("operation_key") == op)).select(F.col("class_name").alias("caller_class")).distinct()
    down = triggers.join(bound, "caller_class", "left_semi").withColumn("next_trace", F.concat_ws(".", "target_form_key", "op_key"))
    here = kb.table("operation").where((F.col("form_key") == form) & (F.col("key") == op))
    answer = {
        "operation": f"{form}.{op}", "definition": rows_of(here), "plugins": sorted(r["caller_class"] for r in bound.collect()), "summary": counts(rows, "reason"),
        "triggered_by": rows_of(inbound.where("reason = 'exact'").orderBy(*order).limit(CAP)), "unresolved_inbound": rows_of(inbound.where("reason <> 'exact'").orderBy(*order).limit(CAP)),
        "triggers_downstream": rows_of(down.orderBy("caller_class", "line", "via").limit(CAP)),
    }
    return within_budget(answer, ["unresolved_inbound", "triggers_downstream", "triggered_by"])


# forms


def bill(kb: KnowledgeBase, form: str) -> dict:
    """Everything on one form: entities and fields with what touches them, plugin lanes, triggers."""
    own = kb.table("form").where(F.col("key") == form).first()
    if own is None:
        return {"error": f"unknown form {form}"}
    if own["is_extension"]:
        return {"redirect": own["extends"], "reason": "extension_alias"}
    accesses = kb.table("field_access").where(F.col("form_key") == form)
    is_write = F.col("access") == "write"
    users = {"writers": is_write, "persisting": is_write & (F.col("persists") == "yes"), "readers": ~is_write}
    touches = aggregate.touches(accesses, "field_key", "plugin_fqn", users).join(
        accesses.groupBy("field_key").agg(F.array_sort(F.collect_set("event_method")).alias("events")), "field_key"
    )
    fields = kb.table("field").where(F.col("form_key") == form).select("entity_key", F.col("key").alias("field_key"), "name", "kind", "level")
    listed = fields.join(touches, "field_key", "left").fillna(0, ["writers", "persisting", "readers"])
    lanes = kb.table("plugin").where((F.col("form_key") == form) & (F.col("enabled").isNull() | F.col("enabled")))
    methods = kb.table("plugin_method").where("event_kind <> 'helper'").select(F.col("plugin_fqn").alias("class_name"), "event_kind", "event_phase")
    lanes = lanes.join(methods, "class_name", "left").groupBy("plugin_type", "class_name", "operation_key").agg(F.array_sort(F.collect_set("event_kind")).alias("events"))
    classes = kb.table("plugin").where(F.col("form_key") == form).select(F.col("class_name").alias("caller_class")).distinct()
    outbound = kb.table("operation_trigger").join(classes, "caller_class", "left_semi")
    entities = kb.table("entity").where(F.col("form_key") == form).select("key", "name", "level", "parent_key", "table_name")
    page = paged(listed, [F.desc("writers"), F.desc("readers"), F.col("entity_key"), F.col("field_key"), F.col("name")], "fields", size=CAP)
    answer = {
        "form": own.asDict(), "entities": rows_of(entities.orderBy("level", "key").limit(CAP)), "field_total": page["total"], "fields": page["items"], "pagination": {k: page[k] for k in ("complete", "next_cursor", "pending")},
        "touched": counts(accesses, "access"), "lanes": rows_of(lanes.orderBy("plugin_type", "class_name", "operation_key").limit(CAP)),
        "operations": rows_of(kb.table("operation").where(F.col("form_key") == form).orderBy("key").limit(CAP)), "triggers": rows_of(outbound.orderBy("caller_class", "line", "via").limit(CAP)), "converts": converts(kb, form),
    }
    return within_budget(answer, ["triggers", "operations", "entities", "lanes", "fields"])


def resolve_keys(kb: KnowledgeBase, keys: list[str], kind: str | list[str] | None = None) -> dict:
    """What each key names (field, entity, form or plugin): a list per key, or None."""
    kinds = kind if isinstance(kind, list) else [kind] * len(keys)
    if len(kinds) != len(keys):
        raise ValueError("as many kinds as keys are needed")
    wanted = kb.spark.createDataFrame([(k, k.rpartition(".")[0] or None, k.rpartition(".")[2]) for k in keys], "asked string, qualifier string, key string")
    c = F.col
    field = kb.table("field").select(c("key"), F.lit("field").alias("kind"), "form_key", c("entity_key").alias("owner"), "name")
    entity = kb.table("entity").select("key", F.lit("entity").alias("kind"), "form_key", c("form_key").alias("owner"), "name")
    form = kb.table("form").select("key", F.lit("form").alias("kind"), c("key").alias("form_key"), c("module").alias("owner"), "name")
    plugin = kb.table("plugin").select(c("class_name").alias("key"), F.lit("plugin").alias("kind"), "form_key", c("plugin_type").alias("owner"), c("operation_key").alias("name"))
    whole = wanted.withColumn("key", c("asked"))
    hits = wanted.join(field.unionByName(entity), "key").unionByName(whole.join(form.unionByName(plugin), "key")).distinct()
    out: dict = {"resolved": {k: None for k in keys}, "mismatched_form": {}, "mismatched_kind": {}}
    want = dict(zip(keys, kinds, strict=True))
    for r in sorted(rows_of(hits), key=lambda r: tuple(str(r[x]) for x in ("kind", "form_key", "owner", "name"))):
        item = {x: r[x] for x in ("kind", "key", "form_key", "owner", "name")}
        first = (r["qualifier"] or "").split(".")[0]
        if r["kind"] in ("field", "entity") and first and first not in (r["form_key"], r["owner"]):
            out["mismatched_form"].setdefault(r["asked"], []).append(item)
        elif want[r["asked"]] and want[r["asked"]] != r["kind"]:
            out["mismatched_kind"].setdefault(r["asked"], []).append(item)
        else:
            out["resolved"][r["asked"]] = [*(out["resolved"][r["asked"]] or []), item]
    return out


# quality


def coverage(kb: KnowledgeBase) -> dict:
    """How much of the business fields the scan touched, and how well it located accesses."""
    fields = kb.table("field").where("kind in ('entity', 'dynamic') and key is not null")
    accesses = kb.table("field_access").where("form_key is not null and field_key is not null").select("form_key", F.col("field_key").alias("key"), "access")
    sides = {"touched": accesses, "written": accesses.where("access = 'write'"), "was_read": accesses.where("access = 'read'")}
    by_form = setcmp.coverage(fields, "form_key", "key", sides).cache()
    modules = kb.table("form").select(F.col("key").alias("form_key"), "module")
    total = by_form.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *sides))).first().asDict()
    by_module = by_form.join(modules, "form_key", "left").groupBy("module").agg(*(F.sum(c).alias(c) for c in ("total", *sides)))
    rows = kb.table("field_access")
    known = kb.table("field").select(F.col("key").alias("field_key")).distinct().withColumn("known", F.lit(True))
    quality = rows.join(known, "field_key", "left").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("key_resolution").isin("literal", "constant"), 1)).alias("reliable"), F.count("form_key").alias("located"),
        F.count(F.when(F.col("form_key").isNotNull() | F.col("null_reason").isin(classify.CORRECT_NULLS), 1)).alias("settled"), F.count("known").alias("in_metadata"),
    ).first().asDict()
    part = lambda n: round(quality[n] / quality["rows"], 4) if quality["rows"] else None
    rates = {n: part(n) for n in ("reliable", "located", "settled", "in_metadata")}
    good = all(v is None or v >= b for v, b in zip((rates["located"], rates["reliable"], rates["in_metadata"]), (0.6, 0.9, 0.9), strict=True))
    fair = all(v is None or v >= b for v, b in zip((rates["located"], rates["reliable"]), (0.3, 0.75), strict=True))
    answer = {
        "project": {**total, "rate": round(total["touched"] / total["total"], 4) if total["total"] else None}, "quality": {**quality, **{f"{k}_rate": v for k, v in rates.items()}},
        "verdict": "good" if good else "ok" if fair else "low", "modules": rows_of(by_module.orderBy("module")),
        "low_forms": rows_of(by_form.withColumn("rate", setcmp.rate(F.col("touched"), F.col("total"))).orderBy("rate", "form_key").limit(CAP)),
        "breakdown": rows_of(aggregate.breakdown(rows, "key_resolution", "persists", "form_key_source", "null_reason", "edge_source").orderBy("facet", F.desc("n"), "value")),
    }
    by_form.unpersist()
    return answer


def scan_compare(kb: KnowledgeBase) -> dict:
    """The precise scan against the coarse one, key by key."""
    universe = kb.table("field").where("kind in ('entity', 'dynamic') and key is not null").select(F.col("key").alias("field_key"))
    high, coarse = kb.table("field_access").where("field_key is not null"), kb.table("coarse_field_hit")
    buckets = setcmp.compare_scans(universe, "field_key", high, coarse).cache()
    found = counts(buckets, "bucket")
    only = coarse.join(buckets.where("bucket = 'coarse_only'"), "field_key", "left_semi")
    idiom = F.max(F.col("via").isin("rw-idiom", "const-rw-idiom"))
    suspects = only.groupBy("field_key").agg(F.count("*").alias("hits"), idiom.alias("idiom"), F.max(F.col("via").startswith("const")).alias("constant"))
    both, coarse_only = found.get("both", 0), found.get("coarse_only", 0)
    rate = both / (both + coarse_only) if both + coarse_only else None
    miss = None if rate is None else 1 - rate
    verdict = "unknown" if miss is None else "consistent" if miss == 0 else "minor_gaps" if miss <= 0.02 else "gaps"
    items = rows_of(suspects.orderBy(F.desc("idiom"), F.desc("hits"), "field_key").limit(CAP))
    buckets.unpersist()
    return {"buckets": found, "agreement": None if rate is None else round(rate, 4), "verdict": verdict, "coarse_only": items, "coarse_only_total": coarse_only}


def dynamic_writes(kb: KnowledgeBase, form: str | None = None, cause: str | None = None, cls: str | None = None) -> dict:
    """Writes with undetermined keys, as a worklist by place and by cause."""
    rows = kb.table("field_access").where("field_key is null and access = 'write'")
    if form:
        rows = rows.where(F.col("form_key") == form)
    if cause:
        rows = rows.where(F.col("key_resolution") == cause)
    if cls:
        rows = rows.where((F.col("access_class") == cls) | (F.col("plugin_fqn") == cls))
    places = aggregate.worklist(rows, ["access_class", "access_method"], F.lit(True), "key_resolution", classify.UNDETERMINED_KEYS, ["source_relpath", "line"], 3)
    page = paged(places, [F.desc("writes"), F.col("access_class"), F.col("access_method")], "places")
    return {"total": rows.count(), "by_cause": counts(rows, "key_resolution"), "places": page["items"], "places_total": page["total"]}


def overview(kb: KnowledgeBase) -> dict:
    """The project at a glance: size, bindings, hot fields and risks."""
    bindings, classes, modules = kb.table("binding"), kb.table("source_class"), kb.table("module")
    status = counts(bindings, "status")
    own = sum(status.get(s, 0) for s in ("linked", "linked_by_name", "missing", "ambiguous"))
    hit = round((status.get("linked", 0) + status.get("linked_by_name", 0)) / own, 4) if own else None
    sizes = kb.table("field").groupBy("form_key").agg(F.count("*").alias("fields"))
    hot = aggregate.hot(kb.table("field_access").where("field_key is not null"), "field_key", "plugin_fqn", F.col("persists") == "yes", CAP)
    trust = kb.spark.range(1).select(classify.bridge_trust(F.lit(hit), F.lit(status.get("missing", 0)), F.lit(status.get("ambiguous", 0))).alias("t")).first()["t"] if hit is not None else None
    return {
        "counts": kb.meta().get("counts", {}), "bindings": status, "hit_rate": hit, "trust": trust, "form_types": counts(kb.table("form"), "form_type"), "orphans": counts(classes.where("is_orphan"), "orphan_role"),
        "hot_fields": rows_of(hot),
        "risks": {
            "missing": rows_of(bindings.where("status = 'missing'").select("class_name", "form_key").orderBy("class_name", "form_key").limit(CAP)),
            "ambiguous": rows_of(bindings.where("status = 'ambiguous'").select("class_name", "form_key").orderBy("class_name", "form_key").limit(CAP)),
            "oversized": rows_of(sizes.where(F.col("fields") >= OVERSIZED).orderBy(F.desc("fields"), "form_key").limit(CAP)),
            "scattered": rows_of(modules.where(F.col("pkg_consistency") < LOW_CONSISTENCY).select("name", "pkg_consistency").orderBy("pkg_consistency", "name").limit(CAP)),
            "plugin_orphans": [r["fqn"] for r in classes.where("is_orphan and orphan_role = 'plugin'").select("fqn").orderBy("fqn").limit(CAP).collect()],
        },
    }


def project_map(kb: KnowledgeBase) -> dict:
    return {"modules": rows_of(kb.table("module").orderBy("name")), "unclassified": kb.table("source_class").where("module = '(unclassified)'").count()}


# text


def read_source(kb: KnowledgeBase, relpath: str, text: str, max_keys: int = 60) -> dict:
    """Known field keys in a source text, with the forms they can belong to."""
    import re

    tokens = sorted(set(re.findall(KEY_TOKEN, text)))
    words = kb.spark.createDataFrame([(t,) for t in tokens], "key string")
    fields = kb.table("field").where("key is not null").select("key", "form_key", "name", "level").join(words, "key", "left_semi")
    forms = fields.groupBy("key").agg(F.count_distinct("form_key").alias("forms"), F.array_sort(F.collect_set("form_key")).alias("in_forms"), F.min("name").alias("name"))
    here = kb.table("field_access").where((F.col("source_relpath") == relpath) & F.col("form_key").isNotNull() & F.col("field_key").isNotNull())
    here = here.groupBy(F.col("field_key").alias("key")).agg(F.array_sort(F.collect_set("form_key")).alias("resolved_forms"))
    rows = forms.join(here, "key", "left")
    tier = F.when(F.col("forms") <= 1, "unique").when(F.col("resolved_forms").isNotNull(), "resolved").otherwise("ambiguous")
    total = rows.count()
    keys = rows_of(rows.select("key", tier.alias("tier"), "in_forms", "resolved_forms", F.when(tier != "ambiguous", F.col("name")).alias("name")).orderBy("key").limit(max_keys))
    found = list(dict.fromkeys(re.findall(r"\b([A-Z]\w*)\.([A-Z][A-Z0-9_]{2,})\b", text)))[:300]
    constants = []
    if found:
        refs = kb.spark.createDataFrame(found, "class_name string, const_name string")
        definitions = kb.table("java_constant").select("class_name", "const_name", "literal")
        constants = rows_of(resolve.resolve_constants(refs, definitions, "class_name", "const_name", "literal").orderBy("class_name", "const_name"))
    return {"relpath": relpath, "keys": keys, "keys_capped": max(0, total - max_keys), "constants": constants}


def search(kb: KnowledgeBase, query: str) -> list[dict]:
    """Entries that hold every token of the query, in a fixed order."""
    rows = kb.table("search").withColumn("id", F.concat_ws("\0", *(F.coalesce(c, F.lit("")) for c in ("kind", "key", "name", "extra"))))
    index = fts.inverted_index(rows, "id", F.concat_ws(" ", "key", "name", "extra"))
    return rows_of(rows.join(fts.match_all(index, "id", query), "id", "left_semi").drop("id").distinct().orderBy("kind", "key", "name", "extra").limit(fts.SEARCH_LIMIT))


def whois(kb: KnowledgeBase, needle: str) -> dict:
    """Classes whose name holds the needle, and what they touch."""
    first = kb.table("source_class").where(fts.like_any_case(F.col("fqn"), needle)).orderBy("fqn", "relpath").limit(fts.CLASS_LIMIT)
    names = first.select(F.col("fqn").alias("access_class")).distinct()
    touches = kb.table("field_access").join(names, "access_class", "left_semi").select("access_class", "form_key", "field_key", "access").distinct()
    return {"classes": rows_of(first), "touches": rows_of(touches.orderBy("access_class", "form_key", "field_key", "access").limit(fts.TOUCH_LIMIT))}


def forms(kb: KnowledgeBase) -> list[dict]:
    """Forms with counts of entities, fields, plugins and operations."""
    out = kb.table("form").select(F.col("key").alias("form_key"), "name", "form_type", "module", "is_extension")
    for name in ("entity", "field", "plugin", "operation"):
        out = out.join(kb.table(name).groupBy("form_key").agg(F.count("*").alias(f"{name}_count")), "form_key", "left").fillna(0, [f"{name}_count"])
    return rows_of(out.orderBy("form_key", "name"))


def topic(topics: dict[str, str], wanted: str) -> dict:
    """A document by its path, else by its exact name, else the only one whose name holds it."""
    if wanted in topics:
        return {"path": wanted, "text": topics[wanted]}
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for test in (lambda p: stem(p) == wanted, lambda p: fold(wanted) in fold(p)):
        hits = sorted(p for p in topics if test(p))
        if len(hits) == 1:
            return {"path": hits[0], "text": topics[hits[0]]}
        if hits:
            return {"need_clarification": True, "candidates": hits}
    return {"error": f"no topic {wanted!r}", "topics": sorted(topics)}
