import io
import json

import pytest

from factloom import tools
from factloom.plans import knowledge as k
from tests.test_knowledge import frame, kb  # noqa: F401


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """A field that 45 classes write and 25 read, 30 more from nowhere known."""
    from factloom.sources import store

    base = {"field_key": "no", "level": "header", "key_resolution": "literal", "confidence": 0.9, "event_phase": "memory", "via": "object.set"}
    rows = [{**base, "form_key": "f", "access": "write", "persists": "no", "access_class": f"p.W{i:02}", "plugin_fqn": f"p.W{i:02}", "access_method": "m", "line": i, "source_relpath": "W.java"} for i in range(45)]
    rows += [{**base, "form_key": "f", "access": "read", "persists": "na", "access_class": f"p.R{i:02}", "plugin_fqn": f"p.R{i:02}", "access_method": "m", "line": i, "source_relpath": "R.java"} for i in range(25)]
    rows += [{**base, "form_key": None, "access": "write", "persists": "unknown", "access_class": f"p.U{i:02}", "access_method": "m", "line": i, "source_relpath": "U.java", "null_reason": "helper-caller-unknown"} for i in range(30)]
    folder = str(tmp_path_factory.mktemp("kb"))
    tables = {"field_access": rows, "field": [{"uid": "1", "form_key": "f", "key": "no", "kind": "entity"}], "form": [{"key": "f", "is_extension": False}]}
    store.write_kb(spark, folder, {n: frame(spark, n, r) for n, r in tables.items()}, {})
    return store.open_kb(spark, folder)


@pytest.mark.parametrize(("section", "name", "total"), [("writers", "access_class", 45), ("readers", "access_class", 25), ("unlocated", "access_class", 30), ("exact", "line", 70)])
def test_cursors_lead_through_every_section(big, section, name, total):
    first = k.trace_field(big, "f.no")
    gate = first["pagination"] | {"total": first["total"]} if section == "exact" else first["sections"][section]
    seen = list(first["accesses" if section == "exact" else section])
    assert gate["total"] == total and not gate["complete"] and gate["pending"] == total - len(seen)
    cursor = gate["next_cursor"]
    while cursor:
        page = k.trace_field(big, "f.no", cursor=cursor)
        items = page["accesses"] if section == "exact" else page["items"]
        assert items
        seen += items
        cursor = page["pagination"]["next_cursor"]
    assert len(seen) == total and len({(x["access_class"], x[name]) for x in seen}) == total


def test_an_answer_stays_in_its_budget_and_counts_what_it_leaves_out(big):
    answer = k.trace_field(big, "f.no")
    assert len(json.dumps(answer, default=str)) < 1.2 * k.BUDGET
    assert k.trace_field(big, "f.no", access="read")["sections"]["writers"]["total"] == 0
    assert "error" in k.trace_field(big, "f.no", cursor="nothing@3")


def test_five_tools_answer_like_the_functions(kb):  # noqa: F811
    own = tools.Tools(kb, {"plugins/op.md": "text"})
    assert list(own.table()) == ["trace", "bill", "resolve_fields", "callers", "semantics"] == list(tools.SCHEMAS)
    assert own.trace("card.status") == k.trace_field(kb, "card.status") and own.trace("card.save", kind="operation") == k.trace_operation(kb, "card.save")
    assert own.bill("card") == k.bill(kb, "card") and "error" in own.bill("none") and "error" in own.trace("x", kind="odd")
    assert own.semantics()["topics"] == ["plugins/op.md"] and own.semantics("op")["text"] == "text"


def test_the_server_speaks_the_protocol(kb):  # noqa: F811
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "resolve_fields", "arguments": {"keys": ["amount"]}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "bill", "arguments": {"odd": 1}}}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "none"}},
        {"jsonrpc": "2.0", "id": 6, "method": "odd"},
    ]
    sink = io.StringIO()
    tools.serve(tools.Tools(kb), io.StringIO("\n".join(map(json.dumps, asked)) + "\n\n{broken\n"), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None]
    assert len(replies[1]["result"]["tools"]) == 5 and "amount" in replies[2]["result"]["content"][0]["text"]
    assert replies[3]["result"]["isError"] and all("error" in r for r in replies[4:])


def test_answers_as_text(kb, big):  # noqa: F811
    from factloom.render import RENDERERS, rendered

    answers = {
        "trace": k.trace_field(kb, "card.status"), "operation": k.trace_operation(kb, "card.save"), "callers": k.callers(kb, "CardService.apply"), "bill": k.bill(kb, "card"),
        "resolve": k.resolve_keys(kb, ["amount", "none"]), "coverage": k.coverage(kb), "scan-compare": k.scan_compare(kb), "dynwrites": k.dynamic_writes(kb), "overview": k.overview(kb),
        "map": k.project_map(kb), "forms": k.forms(kb), "search": k.search(kb, "status"), "whois": k.whois(kb, "service"),
    }
    said = {n: rendered(n, a) for n, a in answers.items()}
    assert set(said) == set(RENDERERS) and all(said.values())
    assert "CardService" in said["trace"] and "41" in said["trace"] and "entry_reachable (confirmed)" in said["callers"] and "Status" in said["bill"]
    assert rendered("trace", k.trace_field(kb, "amount")).splitlines()[0] == "which one is meant? candidates:" and rendered("bill", k.bill(kb, "zz")).startswith("error: ")
    assert rendered("trace", k.trace_field(kb, "card_ext.status")).startswith("see card.status")
    long = rendered("trace", k.trace_field(big, "f.no"))
    assert "writers (45)" in long and "… " in long and rendered("trace", k.trace_field(big, "f.no", cursor="writers@40")).count("p.W") == 5
    assert rendered("search", []) == "nothing found"
