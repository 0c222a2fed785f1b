import pytest

from factloom.plans import knowledge as k
from factloom.schema import TABLES
from factloom.sources import store


def frame(spark, table, rows):
    names = TABLES[table].names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table])


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    op, service = "app.CardAudit", "app.CardService"
    access = {"plugin_fqn": op, "plugin_type": "op", "access_class": service, "access_method": "apply", "event_method": "beginOperationTransaction", "event_phase": "transaction",
              "via": "object.set", "key_resolution": "literal", "source_relpath": "CardService.java", "edge_source": "heuristic", "form_key_source": "data_flow"}
    edge = {"target_fqn": service, "target_method": "apply", "kind": "invocation", "col": 5, "source_relpath": "CardAudit.java", "target_kind": "project"}
    rows = {
        "form": [{"key": "card", "name": "Asset card", "form_type": "bill", "module": "fa", "is_extension": False}, {"key": "contract", "name": "Contract", "form_type": "bill", "module": "fa", "is_extension": False},
                 {"key": "card_ext", "form_type": "bill", "module": "fa", "is_extension": True, "extends": "card"}],
        "entity": [{"form_key": "card", "key": "card", "level": "header"}, {"form_key": "card", "key": "lines", "level": "entry", "parent_key": "card"}, {"form_key": "contract", "key": "contract", "level": "header"}],
        "field": [{"uid": "1", "form_key": "card", "entity_key": "card", "key": "status", "name": "Status", "kind": "entity", "level": "header"},
                  {"uid": "2", "form_key": "card", "entity_key": "lines", "key": "amount", "name": "Amount", "kind": "entity", "level": "entry"},
                  {"uid": "3", "form_key": "contract", "entity_key": "contract", "key": "amount", "name": "Amount", "kind": "entity", "level": "header"}],
        "plugin": [{"uid": "p", "form_key": "card", "class_name": op, "plugin_type": "op", "operation_key": "audit", "enabled": True}],
        "source_class": [{"fqn": op, "simple": "CardAudit", "relpath": "CardAudit.java", "is_orphan": False, "module": "fa"}, {"fqn": service, "simple": "CardService", "relpath": "CardService.java", "is_orphan": True, "module": "fa"}],
        "operation": [{"form_key": "card", "key": "audit", "resolved_from": "self", "has_operation_plugin": True}, {"form_key": "card", "key": "save", "resolved_from": "template", "has_operation_plugin": False}],
        "plugin_method": [{"plugin_fqn": op, "method_name": "beginOperationTransaction", "event_kind": "beginOperationTransaction", "event_phase": "transaction"}, {"plugin_fqn": op, "method_name": "help", "event_kind": "helper", "event_phase": "helper"}],
        "field_access": [{**access, "form_key": "card", "field_key": "status", "level": "header", "access": "write", "persists": "yes", "line": 41, "confidence": 0.85},
                         {**access, "form_key": "card", "field_key": "amount", "level": "entry", "entry_key": "lines", "access": "read", "persists": "na", "line": 55, "confidence": 1.0},
                         {**access, "form_key": None, "field_key": "status", "level": "header", "access": "write", "persists": "unknown", "line": 60, "confidence": 0.3, "null_reason": "helper-caller-unknown", "form_key_source": None},
                         {**access, "form_key": None, "field_key": None, "level": "header", "access": "write", "persists": "unknown", "line": 61, "confidence": 0.3, "null_reason": "field-key-undeterminable", "key_resolution": "concat"}],
        "binding": [{"class_name": op, "form_key": "card", "plugin_type": "op", "status": "linked", "confidence": 1.0}],
        "call_edge": [{**edge, "caller_fqn": op, "caller_method": "beginOperationTransaction", "line": 20, "resolution": "expr", "confidence": 1.0},
                      {**edge, "caller_fqn": op, "caller_method": "help", "line": 44, "resolution": "scope", "confidence": 0.95, "kind": "method_reference"},
                      {"caller_fqn": service, "caller_method": "apply", "target_fqn": "kd.bos.Save", "target_method": "save", "kind": "invocation", "line": 42, "col": 1, "source_relpath": "CardService.java", "resolution": "expr", "target_kind": "jar", "confidence": 1.0},
                      {"caller_fqn": service, "caller_method": "apply", "target_method": "odd", "kind": "invocation", "line": 43, "col": 1, "source_relpath": "CardService.java", "resolution": "failed", "confidence": 0.0}],
        "operation_trigger": [{"caller_class": op, "caller_method": "help", "line": 50, "via": "invokeOperation", "op_key": "save", "target_form_key": "card"}, {"caller_class": service, "caller_method": "x", "line": 9, "via": "executeOperate", "target_form_key": "card"}],
        "coarse_field_hit": [{"field_key": "status", "relpath": "CardService.java", "line": 41, "via": "rw-idiom"}, {"field_key": "status", "relpath": "Other.java", "line": 3, "via": "literal"}],
        "java_constant": [{"class_name": "Keys", "const_name": "STATUS", "literal": "status"}],
        "module": [{"name": "fa", "pkg_consistency": 0.5}],
        "search": [{"kind": "field", "key": "status", "name": "Státus", "extra": "card"}, {"kind": "form", "key": "card", "name": "Asset card", "extra": "fa"}],
    }
    folder = str(tmp_path_factory.mktemp("kb"))
    store.write_kb(spark, folder, {n: frame(spark, n, r) for n, r in rows.items()}, {"symbol_resolution": {"status": "ok", "coverage": 0.97, "failed_files": 0}})
    return store.open_kb(spark, folder)


def test_trace_gates_redirects_and_buckets(kb):
    asked = k.trace_field(kb, "amount")
    assert asked["need_clarification"] and asked["candidates"] == ["card.amount", "contract.amount"]
    assert k.trace_field(kb, "card_ext.status")["redirect"] == "card.status"
    got = k.trace_field(kb, "status")
    assert got["summary"] == {"exact|write": 1, "unlocated|write": 1} and got["total"] == 1 and got["accesses"][0]["line"] == 41
    assert got["coarse_blind_spots"][0]["total"] == 1 and got["unlocated"][0]["causes"] == "helper-caller-unknown"
    assert got["dynamic_candidates"][0]["total"] == 1 and got["writers"][0]["sites"] == "apply:41" and got["entries"][0]["status"] == "reached"
    assert k.trace_field(kb, "card.lines.amount")["total"] == 1 and k.trace_field(kb, "contract.amount")["total"] == 0
    with pytest.raises(ValueError):
        k.trace_field(kb, "a.b.c.d.e")


def test_callers_and_entries(kb):
    got = k.callers(kb, "CardService.apply")
    assert (got["summary"]["sites"], got["summary"]["method_references"], got["summary"]["caller_methods"]) == (2, 1, 2)
    assert (got["entry_analysis"]["verdict"], got["entry_analysis"]["confidence"]) == ("entry_reachable", "confirmed")
    chain = next(c for c in got["entry_analysis"]["chains"] if c["terminal"] == "entry")
    assert chain["hops"] == ["app.CardAudit#beginOperationTransaction", "app.CardService#apply"]
    assert any(c["terminal"] == "plugin_boundary" for c in got["entry_analysis"]["chains"])
    own = k.entry_analysis(kb, "app.CardAudit", "beginOperationTransaction")
    assert (own["status"], own["verdict"], own["confidence"]) == ("self_entry", "entry_reachable", "confirmed")
    nothing = k.entry_analysis(kb, "app.CardService", "unused")
    assert (nothing["verdict"], nothing["confidence"]) == ("no_entry_found", "likely")
    assert k.callers(kb, "kd.bos.Save.save")["entry_analysis"]["verdict"] == "not_analyzed"
    assert "error" in k.callers(kb, "Nobody.x") and "error" in k.callers(kb, "x")
    with pytest.raises(ValueError):
        k.callers(kb, "CardService.apply", cursor="bad")


def test_operations(kb):
    got = k.trace_operation(kb, "card.save")
    assert [t["caller_class"] for t in got["triggered_by"]] == ["app.CardAudit"] and got["triggered_by"][0]["caller_forms"] == ["card"]
    assert [t["reason"] for t in got["unresolved_inbound"]] == ["op_unresolved"]
    assert k.trace_operation(kb, "card.audit")["triggers_downstream"][0]["next_trace"] == "card.save"
    assert k.trace_operation(kb, "audit")["operation"] == "card.audit" and k.trace_operation(kb, "none")["error"]


def test_bill_resolve_and_forms(kb):
    got = k.bill(kb, "card")
    assert got["field_total"] == 2 and got["fields"][0]["field_key"] == "status" and got["fields"][0]["persisting"] == 1
    assert got["lanes"][0]["events"] == ["beginOperationTransaction"] and k.bill(kb, "card_ext")["redirect"] == "card" and "error" in k.bill(kb, "no")
    keys = k.resolve_keys(kb, ["amount", "card.amount", "contract.status", "card", "zzz", "app.CardAudit"])
    assert len(keys["resolved"]["amount"]) == 2 and len(keys["resolved"]["card.amount"]) == 1 and keys["resolved"]["zzz"] is None
    assert keys["resolved"]["contract.status"] is None and "contract.status" in keys["mismatched_form"]
    assert {i["kind"] for i in keys["resolved"]["card"]} == {"entity", "form"} and keys["resolved"]["app.CardAudit"][0]["kind"] == "plugin"
    assert "status" in k.resolve_keys(kb, ["status"], kind="form")["mismatched_kind"]
    with pytest.raises(ValueError):
        k.resolve_keys(kb, ["a", "b"], kind=["form"])
    assert [(f["form_key"], f["field_count"]) for f in k.forms(kb)] == [("card", 2), ("card_ext", 0), ("contract", 1)]


def test_quality(kb):
    got = k.coverage(kb)
    assert (got["project"]["total"], got["project"]["touched"], got["project"]["written"], got["project"]["was_read"]) == (3, 2, 1, 1)
    assert (got["quality"]["reliable"], got["quality"]["located"], got["quality"]["in_metadata"]) == (3, 2, 3)
    cmp = k.scan_compare(kb)
    assert cmp["buckets"] == {"both": 1, "high_only": 1} and cmp["verdict"] == "consistent"
    assert k.dynamic_writes(kb)["by_cause"] == {"concat": 1} and k.dynamic_writes(kb, cls="no")["total"] == 0
    over = k.overview(kb)
    assert over["hit_rate"] == 1.0 and over["trust"] == "high" and over["risks"]["scattered"][0]["name"] == "fa" and over["hot_fields"][0]["field_key"] in ("amount", "status")
    assert len(k.project_map(kb)["modules"]) == 1


def test_text_queries(kb):
    got = k.read_source(kb, "CardService.java", 'o.set("amount", Keys.STATUS); status; unknown_key; Other.NOPE_X')
    assert {i["key"]: i["tier"] for i in got["keys"]} == {"amount": "resolved", "status": "unique"}
    assert {(c["const_name"], c["resolution"]) for c in got["constants"]} == {("STATUS", "class"), ("NOPE_X", "unknown")}
    assert [r["key"] for r in k.search(kb, "STATUS card")] == ["status"] and k.search(kb, "!!") == []
    assert [c["fqn"] for c in k.whois(kb, "cardSERV")["classes"]] == ["app.CardService"] and k.whois(kb, "cardSERV")["touches"]
    topics = {"a/save.md": "S", "b/push_down.md": "P", "b/push_up.md": "Q"}
    assert k.topic(topics, "save")["text"] == "S" and k.topic(topics, "down")["text"] == "P" and len(k.topic(topics, "push")["candidates"]) == 2 and "error" in k.topic(topics, "x9")


def test_pages_hold_every_row(spark, kb):
    from pyspark.sql import functions as F

    rows = spark.range(95)
    seen, cursor = [], None
    while True:
        page = k.paged(rows, [F.col("id")], "ids", cursor, size=20)
        seen += [i["id"] for i in page["items"]]
        assert page["total"] == 95
        if page["complete"]:
            break
        cursor = page["next_cursor"]
    assert seen == list(range(95))
    long = {"a": ["x" * 100] * 1000, "b": list(range(50))}
    got = k.within_budget(long, ["a", "b"], 5000)
    assert len(got["a"]) + got["a_capped"] == 1000


def test_read_source_counts_all_keys_left_out(kb):
    text = "amount status billno entry_id"
    whole = k.read_source(kb, "CardService.java", text)
    capped = k.read_source(kb, "CardService.java", text, max_keys=0)
    assert whole["keys_capped"] == 0 and capped["keys"] == [] and capped["keys_capped"] == len(whole["keys"]) > 1


def test_first_accesses_are_whole_beyond_the_budget_of_an_answer(spark, kb, tmp_path, monkeypatch):
    row = {"plugin_type": "op", "access_method": "apply", "event_method": "beginOperationTransaction", "event_phase": "transaction", "via": "object.set", "form_key": "card",
           "field_key": "status", "level": "header", "access": "write", "persists": "yes", "confidence": 0.85, "key_resolution": "literal", "edge_source": "heuristic", "form_key_source": "data_flow"}
    names = [f"app.{'long' * 20}.S{i:03}" for i in range(95)]
    accesses = [{**row, "plugin_fqn": x, "access_class": x, "source_relpath": f"{x}.java", "line": i} for i, x in enumerate(names)]
    monkeypatch.setattr(kb, "table", lambda name, own=kb.table: frame(spark, name, accesses) if name == "field_access" else own(name))
    assert len(k.trace_field(kb, "card.status")["accesses"]) < k.PAGE
    found, total = k.first_accesses(kb, "card.status")
    assert [x["access_class"] for x in found] == names[: k.PAGE] and total == 95
    assert k.first_accesses(kb, "contract.amount") == ([], 0)
