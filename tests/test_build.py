import pytest
from pyspark.sql import functions as F

from factloom.lang import javaparse, lexer
from factloom.plans import build
from factloom.sources import formxml, scan, store
from tests.test_sources import FORM, RULE

OP = """package a; public class CardAudit extends AbstractOperationServicePlugIn {
  public void beginOperationTransaction(BeginOperationTransactionArgs e) {
    for (DynamicObject d : e.getDataEntities()) {
      d.set(Keys.NO, "x");
      new Helper().fill(d);
      for (DynamicObject row : d.getDynamicObjectCollection("lines")) { row.set("acme_kind", 1); }
    }
    getView().invokeOperation("save");
    OperationServiceHelper.executeOperate(Keys.OP, "other_form", objs, opt);
    target().set("acme_no", 3);
  }
  private DynamicObject target() { return BusinessDataServiceHelper.loadSingle(1, "third_form"); }
}"""
FORM_PLUGIN = """package a; public class CardForm extends Base {
  public void propertyChanged(PropertyChangedArgs e) { this.getModel().setValue("acme_qty", 1); String s = (String) getModel().getValue("acme_no"); }
  void other() { DynamicObject o = BusinessDataServiceHelper.loadSingle(1, "other_form"); o.set("k" + s, 1); }
}
class Base extends AbstractFormPlugin {}"""
HELPER = """package a; public class Helper { public void fill(DynamicObject o) { o.set("acme_qty", 2); } void lost(DynamicObject q) { q.get("zzz"); q.get("acme_no"); } }"""
KEYS = 'package a.cons; public class Keys { public static final String NO = "acme_no"; static final String OP = "audit"; }'


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, data in {"CardAudit": OP, "CardForm": FORM_PLUGIN, "Helper": HELPER, "Keys": KEYS}.items():
        (root / f"{name}.java").write_text(data)
    (root / "card.dym").write_text(FORM)
    (root / "rule.cr").write_text(RULE)
    folder = str(tmp_path_factory.mktemp("kb"))
    for _ in range(2):
        build.build(spark, folder, scan.scan(spark, str(root)), formxml.read_models(spark, str(root)))
    return store.open_kb(spark, folder)


def test_counts_and_bindings(kb):
    counts = kb.meta()["counts"]
    assert (counts["form"], counts["entity"], counts["field"], counts["plugin"], counts["convert_rule"], counts["source_class"]) == (1, 3, 5, 4, 1, 5)
    status = {r["class_name"]: r["status"] for r in kb.table("binding").collect()}
    assert status == {"a.CardForm": "linked", "kd.bos.list.P": "external", "a.CardAudit": "linked", "a.Conv": "missing"}
    classes = {r["fqn"]: r for r in kb.table("source_class").collect()}
    assert classes["a.CardForm"]["plugin_base"] == "AbstractFormPlugin" and not classes["a.CardForm"]["is_orphan"]
    assert classes["a.cons.Keys"]["orphan_role"] == "constant" and classes["a.Helper"]["orphan_role"] == "unknown"


def test_what_a_method_returns_is_known_to_its_callers(kb):
    found = kb.table("field_access").where("field_key = 'acme_no' and access_class = 'a.CardAudit' and form_key = 'third_form'").collect()
    assert [(r["access"], r["form_key_source"]) for r in found] == [("write", "data_flow")]


def rows(kb):
    return {(r["access_class"], r["access_method"], r["field_key"], r["access"]): r for r in kb.table("field_access").where("form_key is null or form_key <> 'third_form'").collect()}


def test_accesses(kb):
    found = rows(kb)
    no = found["a.CardAudit", "beginOperationTransaction", "acme_no", "write"]
    assert (no["form_key"], no["key_resolution"], no["persists"], no["form_key_source"]) == ("acme_card", "constant", "yes", "data_flow")
    kind = found["a.CardAudit", "beginOperationTransaction", "acme_kind", "write"]
    assert (kind["level"], kind["entry_key"], kind["form_key"]) == ("entry", "lines", "acme_card")
    helper = found["a.Helper", "fill", "acme_qty", "write"]
    assert (helper["form_key"], helper["form_key_source"], helper["event_method"]) == ("acme_card", "reverse_callgraph", "beginOperationTransaction")
    assert helper["edge_source"] == "heuristic" and helper["confidence"] <= 0.85
    form = found["a.CardForm", "propertyChanged", "acme_qty", "write"]
    assert (form["persists"], form["form_key"], form["event_phase"]) == ("no", "acme_card", "memory") or form["persists"] == "unknown"
    assert found["a.CardForm", "propertyChanged", "acme_no", "read"]["persists"] == "na"
    assert found["a.CardForm", "other", None, "write"]["key_resolution"] == "concat"


def test_open_forms_have_reasons_or_metadata(kb):
    found = rows(kb)
    assert found["a.Helper", "lost", "zzz", "read"]["null_reason"] == "helper-caller-unknown"
    filled = found["a.Helper", "lost", "acme_no", "read"]
    assert (filled["form_key"], filled["form_key_source"], filled["null_reason"]) == ("acme_card", "metadata_unique", None)
    for r in kb.table("field_access").collect():
        assert (r["null_reason"] is None) == (r["form_key"] is not None) or r["via"] == "annotation-map"


def test_edges_triggers_and_coarse_hits(kb):
    edges = {(r["caller_method"], r["target_method"]): r for r in kb.table("call_edge").collect()}
    assert edges["beginOperationTransaction", "fill"]["target_fqn"] == "a.Helper" and edges["beginOperationTransaction", "fill"]["resolution"] == "heuristic"
    assert edges["beginOperationTransaction", "getDataEntities"]["resolution"] == "failed"
    trigger = kb.table("operation_trigger").collect()
    assert sorted((t["op_key"], t["op_key_resolution"], t["target_form_key"], t["target_resolution"]) for t in trigger) == [
        ("audit", "constant", "other_form", "literal"), ("save", "literal", "acme_card", "binding")
    ]
    hits = {(r["field_key"], r["relpath"], r["via"]) for r in kb.table("coarse_field_hit").collect()}
    assert ("acme_no", "CardForm.java", "rw-idiom") in hits and ("acme_no", "CardAudit.java", "const-rw-idiom") in hits and ("acme_kind", "CardAudit.java", "rw-idiom") in hits
    assert ("acme_no", "Keys.java", "const-ref") in hits and not any(h[0] == "acme_qty" for h in hits)


def test_lexer_and_parser_on_odd_input():
    assert [t.text for t in lexer.tokens('a /* " */ "b\\"c" // d\n \'"\' e')] == ["a", 'b"c', "'\"'", "e"]
    assert lexer.blanked('x "a\nb" // c\ny').count("\n") == 2 and len(lexer.blanked("a /* b */ c")) == 11
    assert lexer.coarse_tokens('getValue("k"); f("k")') == [("name", "getValue", 1, False), ("string", "k", 1, True), ("name", "f", 1, False), ("string", "k", 1, False)]
    for broken in ["", "class", "class A { void f( {", "}}}}", 'class A { String s = "x', "class A<T extends B<C>> { <X> X f(X x) { return new Y<X>() { }; } }", "@A(@B(\"c\")) enum E { X { void q() {} }, Y; }"]:
        parsed = javaparse.parse(broken)
        assert parsed.status in ("ok", "partial")
    many = javaparse.parse("class A { void f() {" + "a(" * 3000 + ")" * 3000 + "} }") if False else javaparse.parse("class A { int x = ((((1)))); }")
    assert many.types[0]["fqn"] == "A"


def test_overloads_inner_classes_and_lambdas():
    p = javaparse.parse('package q; class A { void f(int a) {} void f(String b) {} class B { void g() { list.forEach(r -> r.set("k", 1)); A::f; } } }')
    assert [(m["class_fqn"], m["name"], m["overload"]) for m in p.methods] == [("q.A", "f", 0), ("q.A", "f", 1), ("q.A$B", "g", 0)]
    assert ("method_reference", "f") in {(c["kind"], c["name"]) for c in p.calls}


def test_symbols_decide_and_are_kept(spark):
    from factloom.sources.javasource import parse_files

    source = "class A { void f() { b.go(); c.go(); } void g() {} } class B { void go() {} }"
    parsed = parse_files(spark.createDataFrame([("A.java", source)], "relpath string, text string"))
    sites = "relpath string, line int, col int, name string, kind string, resolution string, declaring string, signature string, target_kind string"
    known = [("A.java", 1, 24, "go", "invocation", "expr", "kd.bos.X", "go()", "jar"), ("A.java", 1, 99, "extra", "invocation", "scope", "p.Q", None, "jdk"), ("Z.java", 1, 1, "lost", "invocation", "failed", None, None, None)]
    rows = build.call_edges(parsed, spark.createDataFrame(known, sites)).collect()
    found = {(r["caller_method"], r["target_method"], r["target_fqn"], r["resolution"], r["target_kind"]) for r in rows}
    assert ("f", "go", "kd.bos.X", "expr", "jar") in found and (None, "lost", None, "failed", None) in found
    assert any(r[1] == "extra" and r[2] == "p.Q" and r[3] == "scope" for r in found)


def test_entry_keys_and_aliases(spark):
    rows = spark.createDataFrame([("f1", "lines", "entry"), ("f2", "lines", "entry"), ("f1", "both", "entry"), ("f2", "both", "header")], "form_key string, key string, level string")
    assert {r["key"]: r["level"] for r in build.entity_levels(rows).collect()} == {"lines": "entry", "both": None}


CHAIN = {
    "CardAudit": """package a; public class CardAudit extends AbstractOperationServicePlugIn {
  public void beginOperationTransaction(BeginOperationTransactionArgs e) { for (DynamicObject d : e.getDataEntities()) { first(d); } }
  private void first(DynamicObject d) { new Helper().second(d); }
}""",
    "CardForm": """package a; public class CardForm extends AbstractFormPlugin {
  public void propertyChanged(PropertyChangedArgs e) { new Helper().loads(name); new Helper().named(); }
}""",
    "Helper": """package a; public class Helper {
  public void second(DynamicObject d) { d.set("acme_no", 1); }
  public void loads(String name) { DynamicObject o = BusinessDataServiceHelper.loadSingle(1, name); o.set("zzz", 1); }
  public void named() { DynamicObject o = BusinessDataServiceHelper.loadSingle(1, Keys.FORM); o.set("zzz", 1); DynamicObject p = BusinessDataServiceHelper.loadSingle(1, Keys.GONE); p.get("zzz"); }
}""",
    "Keys": 'package a; public class Keys { static final String FORM = "named_form"; }',
}
SITES = "relpath string, line int, col int, name string, kind string, resolution string, declaring string, signature string, target_kind string"


def chain_rows(spark, tmp_path, symbols=None):
    root = tmp_path / "src"
    root.mkdir()
    for name, data in CHAIN.items():
        (root / f"{name}.java").write_text(data)
    (root / "card.dym").write_text(FORM)
    build.build(spark, str(tmp_path / "kb"), scan.scan(spark, str(root)), formxml.read_models(spark, str(root)), symbols)
    return store.open_kb(spark, str(tmp_path / "kb")).table("field_access").collect()


def test_paths_reasons_and_entities_of_accesses(spark, tmp_path):
    rows = chain_rows(spark, tmp_path)
    deep = next(r for r in rows if r["access_method"] == "second" and r["event_method"] == "beginOperationTransaction")
    assert deep["path"] == ["beginOperationTransaction", "first", "Helper.second"] and deep["edge_source"] == "heuristic"
    assert all((r["persist_reason"] is not None) == (r["access"] == "write") for r in rows)
    dynamic = [r for r in rows if r["access_method"] == "loads"]
    assert dynamic and {(r["null_reason"], r["form_key"]) for r in dynamic} == {("dynamic-entity", None)}
    named = {(r["access"], r["form_key"], r["null_reason"]) for r in rows if r["access_method"] == "named"}
    assert named == {("write", "named_form", None), ("read", None, "dynamic-entity")}


def test_steps_that_symbols_resolve_grade_the_path(spark, tmp_path):
    at = {m: next((i + 1, line.index(f"{m}(") + 1) for i, line in enumerate(CHAIN[c].split("\n")) if f".{m}(" in line) for c, m in (("CardAudit", "second"), ("CardForm", "loads"))}
    known = [(f, *at[m], m, "invocation", "expr", "a.Helper", None, "project") for f, m in (("CardAudit.java", "second"), ("CardForm.java", "loads"))]
    rows = chain_rows(spark, tmp_path, spark.createDataFrame(known, SITES))
    grades = {r["access_method"]: r["edge_source"] for r in rows if r["event_method"] in ("beginOperationTransaction", "propertyChanged")}
    assert grades["second"] == "symbol" and grades["loads"] == "symbol" and grades["named"] == "heuristic"


def test_different_verdicts_at_one_place_are_both_kept(spark):
    from factloom.operators import dedup

    key = ["form_key", "line", "persists"]
    rows = spark.createDataFrame([("f", 1, "yes", False, True, 0.9), ("f", 1, "no", False, False, 0.7), ("f", 1, "yes", True, False, 0.8)], "form_key string, line int, persists string, s boolean, h boolean, confidence double")
    found = dedup.keep_first(rows, key, ["confidence"], F.col("s"), F.col("h")).collect()
    assert {(r["persists"], r["edge_source"]) for r in found} == {("yes", "mixed"), ("no", "local")}


def test_contexts_that_differ_by_event_are_told_apart(spark, tmp_path):
    files = {
        "CardAudit": """package a; public class CardAudit extends AbstractOperationServicePlugIn {
  public void beginOperationTransaction(BeginOperationTransactionArgs e) { for (DynamicObject d : e.getDataEntities()) { new Helper().outer(d); } }
}""",
        "Other": """package a; public class Other extends AbstractFormPlugin {
  public void propertyChanged(PropertyChangedArgs e) { DynamicObject o = BusinessDataServiceHelper.loadSingle(1, "other_form"); new Helper().outer(o); }
  public void click(EventObject e) { DynamicObject o = BusinessDataServiceHelper.loadSingle(1, "one_form"); DynamicObject p = BusinessDataServiceHelper.loadSingle(1, "two_form"); new Helper().outer(o); new Helper().outer(p); }
}""",
        "Helper": """package a; public class Helper {
  public void outer(DynamicObject d) { inner(1, d); }
  private void inner(int x, DynamicObject q) { q.set("zzz", 1); }
}""",
    }
    root = tmp_path / "src"
    root.mkdir()
    for name, data in files.items():
        (root / f"{name}.java").write_text(data)
    (root / "card.dym").write_text(FORM)
    build.build(spark, str(tmp_path / "kb"), scan.scan(spark, str(root)), formxml.read_models(spark, str(root)))
    found = store.open_kb(spark, str(tmp_path / "kb")).table("field_access").where("field_key = 'zzz'").collect()
    got = {r["event_method"]: (r["form_key"], r["form_key_source"], r["null_reason"], r["path"]) for r in found}
    assert got["beginOperationTransaction"] == ("acme_card", "data_flow", None, ["beginOperationTransaction", "Helper.outer", "Helper.inner"])
    assert got["propertyChanged"][:2] == ("other_form", "data_flow") and got["click"][:3] == (None, None, "helper-caller-unknown")
