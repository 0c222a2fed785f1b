import json
import threading
import urllib.request

import pytest

from factloom import __main__ as cli
from factloom import web
from factloom.plans import reports
from factloom.sources import classpath, formxml, scan
from factloom.sources.javasource import facts, parse_files, parse_report
from factloom.streaming import refresh
from tests.test_build import FORM_PLUGIN, HELPER, KEYS, OP
from tests.test_sources import FORM, RULE

USER = """class U { void a() { BusinessDataServiceHelper.loadSingle(1, "bd_vendor"); BusinessDataServiceHelper.load("bd_vendor", "x", f);
QueryServiceHelper.queryOne("kd.x.y", "bd_other", f); QueryServiceHelper.query("acme_card", "x", f); BusinessDataServiceHelper.load(pks, type);
OperationServiceHelper.executeOperate("save", "bd_run", o, c); b(); this.b(); } void b() { x.y.z(); } }"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("p")
    for name, data in {"CardAudit": OP, "CardForm": FORM_PLUGIN, "Helper": HELPER, "Keys": KEYS, "U": USER}.items():
        (root / f"{name}.java").write_text(data)
    (root / "card.dym").write_text(FORM)
    (root / "ext.dym").write_text(FORM.replace("<Key>acme_card</Key><Name>", "<Key>acme_bd_base_ext</Key><Name>"))
    (root / "rule.cr").write_text(RULE)
    return str(root)


def test_candidates_from_three_signals(spark, project):
    parsed = parse_files(scan.scan(spark, project))
    prefixes = spark.createDataFrame([("acme_",)], "prefix string")
    found = {r["key"]: r for r in reports.discover_candidates(parsed, formxml.read_models(spark, project), prefixes).collect()}
    assert set(found) == {"bd_base", "bd_vendor", "bd_other", "bd_run", "other_form", "third_form"}
    assert found["bd_base"]["leads"] and found["bd_vendor"]["orm"] == 2 and found["bd_run"]["operation"] == 1 and "U.java:1" in found["bd_vendor"]["evidence"]


def test_summaries(spark, project):
    models = formxml.read_models(spark, project)
    rows = {(r["facet"], r["value"]): r["n"] for r in reports.metadata_summary(models).collect()}
    assert rows["form_type", "bill"] == 2 and rows["kind", "entity"] == 4 and rows["plugin_type", "convert"] == 1
    assert {r["status"]: r["files"] for r in parse_report(parse_files(scan.scan(spark, project))).collect()} == {"ok": 5}
    keys = {r["key"] for r in reports.known_keys(models).collect()}
    assert {"acme_card", "lines", "acme_qty"} <= keys
    templates = reports.templates(models)
    assert templates.count() == 0
    vendor = models.where("source_file = 'card.dym'").withColumn("key", __import__("pyspark").sql.functions.lit("bd_base"))
    ext = spark.createDataFrame([("acme_bd_base_ext", "bd_base")], "key string, extends string")
    got = {r["key"]: r["extended_by"] for r in reports.integrate_vendor(models, vendor, ext).collect()}
    assert got["bd_base"] == "acme_bd_base_ext" and got["acme_card"] is None


def test_calls_within_a_class(spark, project):
    from factloom.plans.build import call_edges

    parsed = parse_files(scan.scan(spark, project))
    edges = call_edges(parsed)
    rows = {(r["class_fqn"], r["method"]): r for r in reports.local_calls(edges).collect()}
    assert rows["U", "a"]["callees"] == ["b"] and rows["U", "b"]["external"] == 1
    assert ("U", "b") not in {tuple(r) for r in reports.roots(facts(parsed, "methods"), edges).collect()}


def test_topics_and_lanes(spark):
    rows = spark.createDataFrame([("beginOperationTransaction", "op"), ("itemClick", "list"), ("afterConvert", None), ("own", "form"), ("own", None)], "event_method string, plugin_type string")
    found = {(r["event_method"], r["plugin_type"]): r["topic"] for r in reports.event_topics(spark, rows, {"op": "ops", "form": "ui", "list": "lists", "convert": "push"}).collect()}
    assert found == {("beginOperationTransaction", "op"): "ops", ("itemClick", "list"): "lists", ("afterConvert", None): "push", ("own", "form"): "ui", ("own", None): None}
    assert reports.lane("op") == "op" and reports.lane("zz") == "other"
    assert reports.event_counts() == {"form": 15, "op": 8, "convert": 5, "writeback": 3, "list": 4, "validator": 1}


def test_classpaths(tmp_path):
    assert classpath.discover(str(tmp_path)).status == "none"
    (tmp_path / "libs/bos").mkdir(parents=True)
    (tmp_path / "libs/bos/a.jar").write_text("")
    (tmp_path / "settings.gradle").write_text("include 'mod', \"gone\"")
    (tmp_path / "mod").mkdir()
    (tmp_path / "gradle.properties").write_text("systemProp.acme_libs_path=libs\n")
    (tmp_path / "config.gradle").write_text('path = [ bos : "${acme_libs_path}/bos", x : "${acme_libs_path}/none" ]')
    found = classpath.discover(str(tmp_path))
    assert (found.provider, found.modules, found.jars(), len(found.warnings), len(found.attempts)) == ("gradle", ["mod"], 1, 2, 2)
    (tmp_path / ".idea/libraries").mkdir(parents=True)
    (tmp_path / "m.iml").write_text('<module><component><orderEntry type="library" name="L"/><orderEntry type="library" name="no"/></component></module>')
    (tmp_path / ".idea/libraries/L.xml").write_text('<c><library name="L"><CLASSES><root url="file://$PROJECT_DIR$/libs/bos"/></CLASSES></library></c>')
    assert classpath.discover(str(tmp_path)).provider == "idea" and classpath.discover(str(tmp_path), ["/none", str(tmp_path)]).provider == "explicit"


def test_command_line_and_web(spark, project, tmp_path, capsys):
    folder = str(tmp_path / "kb")
    assert cli.main(["--kb", folder, "trace", "x"], spark) == 2
    assert cli.main(["--kb", folder, "build", project, project], spark) == 0
    capsys.readouterr()
    assert cli.main(["--kb", folder, "--json", "trace", "acme_card.acme_no"], spark) == 0
    # two forms register the plugin, so its accesses stay open, with their reasons
    answer = json.loads(capsys.readouterr().out)
    assert answer["total"] == 0 and sum(answer["summary"].values()) == 4
    assert cli.main(["--kb", folder, "trace", "acme_no"], spark) == 3 and "candidates" in capsys.readouterr().out
    assert cli.main(["--kb", folder, "trace", "a.b.c.d.e"], spark) == 2 and cli.main(["--kb", folder, "overview"], spark) == 0
    from factloom.sources.store import open_kb

    kb = open_kb(spark, folder)
    assert web.handle(kb, "/api/field", {}) [0] == 400 and web.handle(kb, "/api/none", {})[0] == 404 and web.handle(kb, "/api/bill/zz", {})[0] == 404
    site = web.server(kb, 0)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{site.server_address[1]}/api/search?q=acme_qty") as answer:
        assert json.load(answer)["results"]
    site.shutdown()


def test_changes_replace_the_facts_of_their_files(spark, tmp_path):
    changes, state = tmp_path / "c", str(tmp_path / "s")
    changes.mkdir()
    put = lambda n, *rows: (changes / n).write_text("\n".join(json.dumps(r) for r in rows))
    table = refresh.ParsedTable(spark)
    put("1.json", {"relpath": "A.java", "text": "class A { void f() {} }", "seq": 1}, {"relpath": "B.java", "text": "class B {}", "seq": 2})
    refresh.refresh(spark, str(changes), state, table)
    put("2.json", {"relpath": "A.java", "text": "class A2 {}", "seq": 4}, {"relpath": "A.java", "text": "class Old {}", "seq": 3}, {"relpath": "B.java", "deleted": True, "seq": 5})
    now = refresh.refresh(spark, str(changes), state, table)
    assert [r["fqn"] for r in facts(now, "types").collect()] == ["A2"]


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:05:00", "b", 3.0)], "t string, event_type string, value double")
    rows = rows.selectExpr("cast(t as timestamp) ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = refresh.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["event_type"], r["n"], r["value"]) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
