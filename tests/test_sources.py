import io
import json
import os
import zipfile

import pytest
from pyspark.sql import Row

from factloom.schema import KB_VERSION, TABLES
from factloom.sources import formxml, jdbc, scan, store, symbols

FORM = """<?xml version="1.0" encoding="UTF-8"?><DeployMetadata><DesignMetas>
<DesignFormMeta><ModelType>BillFormModel</ModelType><DataXml><FormMetadata><Key>acme_card</Key><Name>Card</Name><Isv>acme</Isv>
<InheritPath>R1,R2</InheritPath><Items><BillFormAp><Plugins><Plugin><ClassName>a.CardForm</ClassName><Enabled>true</Enabled></Plugin></Plugins></BillFormAp>
<ListMeta><X><Plugins><Plugin oid="kd.bos.list.P"/></Plugins></X></ListMeta></Items></FormMetadata></DataXml></DesignFormMeta>
<DesignEntityMeta><DataXml><EntityMetadata><Items>
<BillEntity><Id>E1</Id><Key>acme_card</Key><TableName>t_card</TableName></BillEntity><EntryEntity><Id>E2</Id><Key>lines</Key></EntryEntity>
<SubEntryEntity><Id>E3</Id><Key>subs</Key><ParentEntryId>E2</ParentEntryId></SubEntryEntity>
<TextField><Id>F1</Id><Key>acme_no</Key><FieldName>fno</FieldName></TextField>
<ComboField><Id>F2</Id><Key>acme_kind</Key><FieldName>fkind</FieldName><ParentId>E2</ParentId><Items><ComboItem><Caption>A</Caption><Value>1</Value></ComboItem></Items></ComboField>
<QtyField><Id>F3</Id><Key>acme_qty</Key><ParentId>E9</ParentId></QtyField><BasedataPropField><Key>p</Key><ParentId>E3</ParentId></BasedataPropField>
<TextField action="edit" oid="x"><ParentId>R1</ParentId></TextField><FieldId>no</FieldId>
</Items><Operations><Operation><Key>audit</Key><OperationType>audit</OperationType><Plugins><Plugin><ClassName>a.CardAudit</ClassName></Plugin></Plugins></Operation>
<Operation oid="T9"/><Operation oid="T1"/></Operations></EntityMetadata></DataXml></DesignEntityMeta></DesignMetas></DeployMetadata>"""
RULE = """<DeployMetadata><DesignMetas><DesignConvertRuleMeta><Id>77</Id><Enabled>false</Enabled><SourceEntityNumber>s</SourceEntityNumber>
<TargetEntityNumber>t</TargetEntityNumber><DataXml><ConvertRuleMetadata><RuleElement><ConvertRuleElement><Name>push</Name><L><SourceEntryKey>se</SourceEntryKey></L>
<FieldMaps><FieldMapItem/><FieldMapItem/></FieldMaps><Plugins><CRPlugin><ClassName>a.Conv</ClassName></CRPlugin><CRPlugin/></Plugins></ConvertRuleElement></RuleElement>
</ConvertRuleMetadata></DataXml></DesignConvertRuleMeta></DesignMetas></DeployMetadata>"""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def models(spark, tmp_path):
    inner = zipped({"x/main/app1/metadata/card.dym": FORM, "x/main/app1/metadata/rule.cr": RULE, "readme.txt": "no"})
    (tmp_path / "pack.zip").write_bytes(zipped({"dm/app.zip": inner, "dm/bad.zip": b"broken"}))
    (tmp_path / "gb.dym").write_bytes(FORM.replace("UTF-8", "GB18030").replace("Card", "资产").encode("gb18030"))
    (tmp_path / "wrong.dym").write_bytes(b"<a><b></a>")
    return formxml.read_models(spark, str(tmp_path))


def test_packages_and_documents(models):
    rows = {r["source_file"]: r for r in models.collect()}
    assert set(rows) == {"pack.zip!dm/app.zip!x/main/app1/metadata/card.dym", "pack.zip!dm/app.zip!x/main/app1/metadata/rule.cr", "pack.zip!dm/bad.zip", "gb.dym", "wrong.dym"} or len(rows) == 5
    card = next(r for n, r in rows.items() if n.endswith("card.dym"))
    assert card["app_key"] == "app1" and card["form_type"] == "bill" and card["inherit_path"] == ["R1", "R2"]
    assert [(e["key"], e["level"], e["parent_id"]) for e in card["entities"]] == [("acme_card", "header", None), ("lines", "entry", "E1"), ("subs", "subentry", "E2")]
    assert [(f["key"], f["kind"], f["level"], f["entity_key"]) for f in card["fields"]] == [
        ("acme_no", "entity", "header", "acme_card"), ("acme_kind", "entity", "entry", "lines"), ("acme_qty", "platform", "unknown", None),
        ("p", "basedata_prop", "subentry", "subs"), (None, "inherited", "header", "acme_card"),
    ]
    assert card["fields"][1]["combo_items"][0]["caption"] == "A"
    assert [(p["class_name"], p["plugin_type"], p["source"], p["enabled"]) for p in card["plugins"]] == [
        ("a.CardForm", "form", "project", True), ("kd.bos.list.P", "list", "platform", None), ("a.CardAudit", "op", "project", None)
    ]
    rule = next(r for n, r in rows.items() if n.endswith("rule.cr"))
    assert rule["convert"]["enabled"] is False and rule["convert"]["field_map_count"] == 2 and rule["convert"]["source_entry"] == "se"
    assert [p["class_name"] for p in rule["plugins"]] == ["a.Conv"]
    assert rows["gb.dym"]["name"] == "资产"
    assert sum(r["error"] is not None for r in rows.values()) == 2


def test_operations_are_completed_from_templates(spark, models):
    templates = spark.createDataFrame(
        [("BillFormModel", "save", "Save", "save", "T1"), ("BillFormModel", "audit", "Audit", "audit", "T2"), ("BillFormModel", "print", "Print", "print", "T3")],
        "model_type string, key string, name string, operation_type string, oid string",
    )
    found = formxml.own_operations(models.where("source_file like '%card.dym'"), templates).collect()
    assert sorted((r["key"] or "", r["resolved_from"]) for r in found) == [("", "unknown"), ("audit", "self"), ("print", "template"), ("save", "template")]


def test_extension_merge(spark):
    cols = "form_key string, entity_key string, key string, level string, name string"
    vendor = spark.createDataFrame([("v", "head", "a", "header", "old"), ("v", "lines", "b", "entry", "x")], cols)
    ext = spark.createDataFrame([("e", "e_head", "a", "header", "new", "v"), ("e", "e_head", "c", "header", "add", "v")], cols + ", extends string")
    found = {(r["entity_key"], r["key"], r["name"], r["provenance"]) for r in formxml.merge_vendor(vendor, ext).collect()}
    assert found == {("head", "a", "new", "extension"), ("head", "c", "add", "extension"), ("lines", "b", "x", "vendor")}
    models = spark.createDataFrame([Row(key="acme_bill_ext", inherit_path=["x"], error=None), Row(key="acme_other", inherit_path=["x"], error=None)], "key string, inherit_path array<string>, error string")
    got = formxml.extension_target(models, spark.createDataFrame([("acme_",), ("zz_",)], "prefix string")).collect()
    assert [tuple(r) for r in got] == [("acme_bill_ext", "bill")]
    plugins = spark.createDataFrame([("v", "p1", True), ("v", "p2", False), ("v", "p3", None), ("w", "p4", None)], "form_key string, class_name string, enabled boolean")
    assert {r["class_name"] for r in formxml.without_vendor_plugins(plugins, vendor).collect()} == {"p2", "p4"}


def test_scan_of_encodings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "a/U.java").write_bytes("class U { String s = \"é\"; }".encode())
    (tmp_path / "a/B.java").write_bytes(b"\xef\xbb\xbfclass B {}")
    (tmp_path / "a/G.java").write_bytes(("// " + "这是一个用来测试编码检测的中文注释，资产卡片的审核操作插件。" * 5).encode("gb18030"))
    (tmp_path / "a/X.java").write_bytes(b"\xff\x00\xff\x80\x81 class")
    (tmp_path / "target/T.java").write_bytes(b"class T {}")
    (tmp_path / "a/n.txt").write_bytes(b"no")
    os.symlink(tmp_path / "a/U.java", tmp_path / "L.txt")
    rows = {r["relpath"]: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/U.java", "a/B.java", "a/G.java", "a/X.java"}
    assert rows["a/U.java"]["encoding"] == "utf-8" and rows["a/B.java"]["text"] == "class B {}" and "资产卡片" in rows["a/G.java"]["text"]
    assert rows["a/G.java"]["encoding"] == "gb18030" and all(r["text"] is not None for r in rows.values())
    report = {(r["metric"], r["value"]): r["n"] for r in scan.coverage_report(scan.scan(spark, str(tmp_path))).collect()}
    assert report[("files", None)] == 4 and report[("decoded", None)] == 4
    assert scan.skipped(str(tmp_path)) == {"folders": ["target"], "links": ["L.txt"]}


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (SELECT 1) SELECT * FROM a", "select 'delete; from' x", "select 1 -- drop"])
def test_read_only_statements_pass(sql):
    assert jdbc.guard_read_only(sql) == sql


@pytest.mark.parametrize("sql", ["delete from a", "select 1; drop table x", "with a as (delete from b returning 1) select 1", "", "select * into x from y", "update a set b = 1"])
def test_others_do_not(sql):
    with pytest.raises(ValueError):
        jdbc.guard_read_only(sql)


def test_config_and_isv(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('// comment\n{"driver": "pg", "host": "h", "database": "d"}')
    monkeypatch.setenv(jdbc.PASSWORD, "secret")
    config = jdbc.load_config(str(path))
    assert config.url() == "jdbc:postgresql://h:5432/d" and config.password == "secret"
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        jdbc.load_config(str(path))
    assert jdbc.choose_isv(None, {"a": 1}, []) == "a" and jdbc.choose_isv("z", {"a": 1, "b": 2}, []) == "z" and jdbc.choose_isv(None, {"a": 1, "b": 2}, ["b"]) == "b"
    with pytest.raises(ValueError):
        jdbc.choose_isv(None, {"a": 1, "b": 2}, [])


def test_design_tables(spark):
    cols = "fid string, fnumber string, fdata string, fmasterid string, fisv string, fmodifydate timestamp"
    design = spark.createDataFrame([("1", "bill", "M", None, "", None), ("2", "bill_x", "X", "1", "acme", None)], cols)
    got = jdbc.masters(design, spark.createDataFrame([("bill_x",)], "number string")).collect()
    assert [(r["fnumber"], r["fdata"], r["m_number"], r["m_data"]) for r in got] == [("bill_x", "X", "bill", "M")]
    assert [tuple(r) for r in jdbc.counts_by_isv(design).collect()] == [("acme", 1)]
    assert [r[0] for r in jdbc.changed_keys(design, design, "acme").collect()] == ["bill_x"]
    assert jdbc.reassemble(design, design.where("fid = '1'")).count() == 2


def test_symbol_log(spark, tmp_path):
    site = {"line": 3, "col": 5, "name": "save", "kind": "invocation", "resolution": "expr", "declaring": "a.B"}
    log = [{"event": "start", "protocol": 1}, {"event": "solver_ready", "jar_count": 2}, {"event": "file", "relpath": "A.java", "status": "ok", "sites": [site, {"name": "x", "resolution": "failed"}]}]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in log) + "\nnot json\n")
    events = symbols.read_events(spark, str(path))
    got = symbols.status(events).first()
    assert (got["status"], got["files"], got["sites"], got["resolved"], got["coverage"], got["malformed"], got["strong_zero"]) == ("partial", 1, 2, 1, 0.5, 1, False)
    assert symbols.sites(events).count() == 1


def test_store_rebuilds_and_gates_versions(spark, tmp_path):
    folder = str(tmp_path / "kb")
    assert store.open_kb(spark, folder) is None
    forms = spark.createDataFrame([("f", "Form")], "key string, name string")
    for _ in range(2):
        store.write_kb(spark, folder, {"form": forms}, {"built_at": "now"})
        kb = store.open_kb(spark, folder)
        assert kb.table("form").count() == 1 and kb.meta()["counts"]["form"] == 1
        assert kb.table("form").schema.names == TABLES["form"].names and kb.meta()["schema_version"] == KB_VERSION
    assert store.meta_value(spark, folder, "built_at") == "now" and store.meta_value(spark, str(tmp_path), "x") is None


def test_find_kb(tmp_path, monkeypatch):
    monkeypatch.delenv("FACTLOOM_KB", raising=False)
    (tmp_path / ".factloom-kb").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    assert store.find_kb("x") == "x" and store.find_kb(start=str(tmp_path / "a/b")) == str(tmp_path / ".factloom-kb")
    assert store.find_kb(build_root="/r") == "/r/.factloom-kb"
