"""Form and rule metadata: XML documents, alone or in nested packages, as rows.

``read_models`` gives one row per document with nested entities, fields,
operations and plugins; an unreadable one has an error instead.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.sources.scan import binary_files

# Element and model names of the metadata format.
HEADER_TAGS = ("BillEntity", "BaseEntity", "MainEntity")
ENTITY_LEVELS = {**dict.fromkeys(HEADER_TAGS, "header"), "EntryEntity": "entry", "SubEntryEntity": "subentry"}
NOT_FIELDS = ("TargetField", "SrcField", "DataDimensionField", "DataAssistDimensionField", "DataDimensionFieldId", "FieldId")
FORM_TYPES = {
    "BillFormModel": "bill",
    "BaseFormModel": "basedata",
    "DynamicFormModel": "dynamic",
    "ReportFormModel": "report",
    "WidgetFormModel": "widget",
    "ParameterFormModel_bill": "param",
    "ParameterFormModel_application": "param",
    "ConvertRuleModel": "convert",
}
LIST_LAYOUTS = ("ListMeta", "MobListMeta")
PLATFORM_PREFIX = "kd.bos."

ENTITY = "struct<tag:string,key:string,name:string,id:string,level:string,parent_id:string,table_name:string>"
COMBO = "struct<value:string,caption:string>"
FIELD = (
    "struct<field_type:string,key:string,name:string,db_column:string,id:string,parent_id:string,kind:string,level:string,"
    f"entity_key:string,combo_items:array<{COMBO}>,must_input:boolean,basedata_id:string>"
)
OPERATION = "struct<key:string,name:string,operation_type:string,id:string,oid:string>"
PLUGIN = (
    "struct<class_name:string,plugin_type:string,source:string,description:string,enabled:boolean,operation_key:string,"
    "operation_name:string,operation_oid:string>"
)
CONVERT = "struct<source_entity:string,target_entity:string,source_entry:string,target_entry:string,field_map_count:bigint,enabled:boolean>"
MODELS = (
    "source_file string, app_key string, error string, key string, name string, model_type string, form_type string, isv string, "
    f"inherit_path array<string>, entities array<{ENTITY}>, fields array<{FIELD}>, operations array<{OPERATION}>, "
    f"plugins array<{PLUGIN}>, convert {CONVERT}"
)


def parse_xml(data: bytes) -> ET.Element:
    """The root element: as declared, else as GB18030 with what is broken replaced."""
    try:
        return ET.fromstring(data)
    except (ET.ParseError, LookupError, ValueError):
        text = data.decode("gb18030", "replace")
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text.lstrip("﻿")))


def flag(text: str | None) -> bool | None:
    return None if text is None else text.strip().lower() == "true"


def plugin_source(name: str | None) -> str:
    return "unknown" if not name else "platform" if name.startswith(PLATFORM_PREFIX) else "project"


def _plugin(e: ET.Element, kind: str, operation: dict | None = None) -> dict:
    name = e.findtext("ClassName") or e.get("oid")
    own = operation or {}
    return {
        "class_name": name, "plugin_type": kind, "source": plugin_source(name), "description": e.findtext("Description"),
        "enabled": flag(e.findtext("Enabled")), "operation_key": own.get("key"), "operation_name": own.get("name"), "operation_oid": own.get("oid"),
    }


def layout_plugins(root: ET.Element) -> list[dict]:
    """Plugins of a layout in document order; those below a list layout are list plugins."""
    found, todo = [], [(root, "form")]
    while todo:
        e, kind = todo.pop()
        if e.tag == "Plugins":
            found += [_plugin(p, kind) for p in e.findall("Plugin")]
            continue
        kind = "list" if e.tag in LIST_LAYOUTS else kind
        todo += [(child, kind) for child in reversed(e)]
    return found


def entities_of(items: ET.Element) -> list[dict]:
    found, main = [], None
    for e in items:
        level = ENTITY_LEVELS.get(e.tag)
        if level is None:
            continue
        own = e.findtext("Id") or e.get("oid")
        if level == "header":
            main, parent = own, None
        elif level == "entry":
            parent = e.findtext("ParentId") or main
        else:
            parent = e.findtext("ParentEntryId") or e.findtext("ParentId")
        found.append(
            {"tag": e.tag, "key": e.findtext("Key"), "name": e.findtext("Name"), "id": own, "level": level, "parent_id": parent, "table_name": e.findtext("TableName")}
        )
    return found


def fields_of(items: ET.Element, entities: list[dict], roots: set[str], form_type: str) -> list[dict]:
    """Fields with owner and level by their parent's id, never by position."""
    owners = {e["id"]: e for e in entities if e["id"]}
    main = next((e for e in entities if e["level"] == "header"), None)
    found = []
    for e in items:
        if not e.tag.endswith("Field") or e.tag in NOT_FIELDS:
            continue
        parent, key, column = e.findtext("ParentId"), e.findtext("Key"), e.findtext("FieldName")
        if parent in owners and parent:
            level, owner = owners[parent]["level"], owners[parent]["key"]
        elif not parent or parent in roots:
            level, owner = "header", main["key"] if main else None
        else:
            level, owner = "unknown", None
        overrides = e.get("action") == "edit" and e.get("oid") is not None
        if e.tag == "BasedataPropField":
            kind = "basedata_prop"
        elif parent in roots or overrides and key is None:
            kind = "inherited"
        else:
            kind = "entity" if column else "dynamic" if form_type == "dynamic" else "platform"
        combo = [{"value": c.findtext("Value"), "caption": c.findtext("Caption")} for c in e.findall("Items/ComboItem")]
        found.append(
            {
                "field_type": e.tag, "key": key, "name": e.findtext("Name"), "db_column": column, "id": e.findtext("Id") or e.get("oid"),
                "parent_id": parent, "kind": kind, "level": level, "entity_key": owner, "combo_items": combo,
                "must_input": bool(flag(e.findtext("MustInput"))), "basedata_id": e.findtext("BaseEntityId"),
            }
        )
    return found


def operations_of(root: ET.Element) -> tuple[list[dict], list[dict]]:
    """Operations as written (a reference to a template has only its oid) and their plugins."""
    operations, plugins = [], []
    for e in root.iter("Operation"):
        own = {
            "key": e.findtext("Key"), "name": e.findtext("Name"), "operation_type": e.findtext("OperationType"),
            "id": e.findtext("Id"), "oid": e.get("oid"),
        }
        operations.append(own)
        plugins += [_plugin(p, "op", own) for p in e.findall("Plugins/Plugin")]
    return operations, plugins


def rule_model(root: ET.Element, meta: ET.Element) -> dict:
    rule = meta.find(".//ConvertRuleMetadata")
    elements = list(rule.iter("ConvertRuleElement")) if rule is not None else []

    def text(tag: str) -> str | None:
        return meta.findtext(tag) or (rule.findtext(tag) if rule is not None else None)

    def first(path: str) -> str | None:
        return next((v for e in elements if (v := e.findtext(path))), None)

    crs = [c for e in elements for c in e.iter("CRPlugin") if c.findtext("ClassName")]
    return {
        "key": text("Id"), "name": first("Name") or text("Name"), "model_type": meta.findtext("ModelType") or "ConvertRuleModel",
        "form_type": "convert", "isv": text("Isv"), "inherit_path": [], "entities": [], "fields": [], "operations": [],
        "plugins": [_plugin(c, "convert") | {"description": c.findtext("Description") or c.findtext("DisplayName")} for c in crs],
        "convert": {
            "source_entity": text("SourceEntityNumber"), "target_entity": text("TargetEntityNumber"), "source_entry": first(".//SourceEntryKey"),
            "target_entry": first(".//TargetEntryKey"), "field_map_count": sum(len(list(e.iter("FieldMapItem"))) for e in elements),
            "enabled": flag(meta.findtext("Enabled")),
        },
    }


def model_of(root: ET.Element) -> dict:
    """One document as a nested row."""
    meta = root.find(".//DesignConvertRuleMeta")
    if meta is not None:
        return rule_model(root, meta)
    form, entity = root.find(".//DesignFormMeta"), root.find(".//DesignEntityMeta")
    layout, data = (next(iter(x.find("DataXml")), None) if x is not None and x.find("DataXml") is not None else None for x in (form, entity))
    model_type = next((t for x in (form, entity) if x is not None and (t := x.findtext("ModelType"))), None)
    form_type = FORM_TYPES.get(model_type or "", "unknown")
    head = layout if layout is not None else data

    def text(tag: str) -> str | None:
        return head.findtext(tag) if head is not None else None

    path = [x for x in (text("InheritPath") or "").split(",") if x]
    items = data.find("Items") if data is not None else None
    entities = entities_of(items) if items is not None else []
    operations, plugins = operations_of(data) if data is not None else ([], [])
    return {
        "key": text("Key"), "name": text("Name"), "model_type": model_type, "form_type": form_type, "isv": text("Isv"), "inherit_path": path,
        "entities": entities, "fields": fields_of(items, entities, set(path), form_type) if items is not None else [],
        "operations": operations, "plugins": (layout_plugins(layout) if layout is not None else []) + plugins, "convert": None,
    }


def members(name: str, data: bytes) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
    """(name, app key, bytes, error) of the documents in a file; packages may be nested."""
    if not name.lower().endswith(".zip"):
        yield name, app_key(name), data, None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        yield name, None, None, str(error)
        return
    for info in archive.infolist():
        inner = info.filename
        if inner.lower().endswith((".dym", ".cr", ".zip")) and not info.is_dir():
            try:
                content = archive.read(info)
            except Exception as error:  # one broken member must not hide the others
                yield f"{name}!{inner}", app_key(inner), None, str(error)
                continue
            for found, key, part, error in members(inner, content):
                yield f"{name}!{found}", key or app_key(inner), part, error


def app_key(path: str) -> str | None:
    found = re.search(r"/main/([^/]+)/metadata/", "/" + path.replace("\\", "/"))
    return found[1] if found else None


def read_models(spark: SparkSession, root: str, glob: str = "*.{dym,cr,zip}") -> DataFrame:
    """Models of all documents below a folder, or of one file."""
    return models_of(binary_files(spark, root, glob, excluded=["\0"]))


def models_of(files: DataFrame) -> DataFrame:
    """Models of documents and packages (relpath, content)."""
    schema = files.sparkSession.createDataFrame([], MODELS).schema
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("relpath").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for name, key, data, error in members(path, content):
                    row: dict = {"source_file": name, "app_key": key, "error": error}
                    if data is not None:
                        try:
                            row |= model_of(parse_xml(data))
                        except ET.ParseError as problem:
                            row["error"] = str(problem)
                    rows.append(row)
                yield from pa.Table.from_pylist(rows, arrow).to_batches()

    return files.select("relpath", "content").mapInArrow(read, schema)


# operators over models


def own_operations(models: DataFrame, templates: DataFrame) -> DataFrame:
    """Operations of each form: its own; those that only name a template's oid, filled in
    from it (or unknown); and the template's other ones.

    ``templates`` has (model_type, key, name, operation_type, oid)."""
    written = models.where("error is null and form_type <> 'convert'").select(F.col("key").alias("form_key"), "model_type", F.explode("operations").alias("o"))
    written = written.select("form_key", "model_type", "o.*").withColumnRenamed("key", "own_key")
    t = templates.select("model_type", "oid", F.col("key").alias("t_key"), F.col("name").alias("t_name"), F.col("operation_type").alias("t_type"))
    named = written.join(t, ["model_type", "oid"], "left")
    resolved = F.when(F.col("own_key").isNotNull(), "self").when(F.col("t_key").isNotNull(), "template").otherwise("unknown")
    own = named.select(
        "form_key", "model_type", F.coalesce("own_key", "t_key").alias("key"), F.coalesce("name", "t_name").alias("name"),
        F.coalesce("operation_type", "t_type").alias("operation_type"), resolved.alias("resolved_from"), "oid",
    )
    forms = models.where("error is null and form_type <> 'convert'").select(F.col("key").alias("form_key"), "model_type").distinct()
    rest = forms.join(templates, "model_type").join(own.select("form_key", "key").where("key is not null").distinct(), ["form_key", "key"], "left_anti")
    rest = rest.select("form_key", "model_type", "key", "name", "operation_type", F.lit("template").alias("resolved_from"), "oid")
    return own.unionByName(rest)


def extension_target(models: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, extends): extensions are named prefix + vendor form + ``_ext`` and inherit."""
    rows = models.where("error is null and key is not null and size(inherit_path) > 0 and key like '%\\_ext'")
    p = prefixes.select("prefix").distinct()
    own = rows.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    return own.join(p, "prefix").select(
        "key", F.expr("substring(key, char_length(prefix) + 1, char_length(key) - char_length(prefix) - 4)").alias("extends")
    ).where("extends <> ''")


def merge_vendor(vendor: DataFrame, extension: DataFrame, extends: str = "extends") -> DataFrame:
    """Fields of vendor forms with those of their extensions: on the same entity and key
    the extension's wins, and fields of its header belong to the vendor's header."""
    from factloom.operators.resolve import merge_by_priority

    header = vendor.where("level = 'header'").groupBy("form_key").agg(F.min("entity_key").alias("header_key"))
    moved = extension.withColumn("form_key", F.col(extends)).drop(extends).join(header, "form_key", "left")
    moved = moved.withColumn("entity_key", F.when(F.col("level") == "header", F.coalesce("header_key", "entity_key")).otherwise(F.col("entity_key")))
    merged = merge_by_priority([moved.select(*vendor.columns), vendor], ["form_key", "entity_key", "key"])
    return merged.withColumn("provenance", F.when(F.col("side") == 0, "extension").otherwise("vendor")).drop("side")


def without_vendor_plugins(plugins: DataFrame, vendor_forms: DataFrame) -> DataFrame:
    """A vendor form's own plugins are not the project's, but those switched off are kept
    as evidence."""
    marks = vendor_forms.select("form_key").distinct().withColumn("v", F.lit(True))
    return plugins.join(marks, "form_key", "left").where("v is null or enabled = false").drop("v")
