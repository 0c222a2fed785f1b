"""The knowledge base: tables, their columns and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

KB_VERSION = "20"

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: Tri-state flags (``enabled``) are nullable booleans: null is unknown, never false.
TABLES: dict[str, T.StructType] = {
    "module": _table(
        name=_S, app_key=_S, dominant_package=_S, pkg_consistency=_D, form_count=_L, entity_count=_L, plugin_count=_L,
        class_count=_L, orphan_real_count=_L, confidence=_D, evidence=_S,
    ),
    "form": _table(key=_S, name=_S, form_type=_S, model_type=_S, isv=_S, app_key=_S, module=_S, source_dym=_S, is_extension=_B, extends=_S),
    "entity": _table(form_key=_S, key=_S, name=_S, level=_S, parent_key=_S, table_name=_S),
    "field": _table(
        uid=_S, form_key=_S, entity_key=_S, key=_S, name=_S, db_column=_S, field_type=_S, kind=_S, level=_S, ref_entity_id=_S,
        ref_form_key=_S, ref_form_name=_S,
    ),
    "field_combo_item": _table(field_uid=_S, value=_S, caption=_S),
    "plugin": _table(uid=_S, form_key=_S, class_name=_S, plugin_type=_S, source=_S, operation_key=_S, operation_name=_S, enabled=_B),
    "source_class": _table(fqn=_S, simple=_S, package=_S, relpath=_S, module=_S, is_orphan=_B, orphan_role=_S, plugin_base=_S),
    "convert_rule": _table(
        id=_S, name=_S, source_entity=_S, target_entity=_S, source_entry=_S, target_entry=_S, isv=_S, app_key=_S, module=_S,
        field_map_count=_L, plugin_count=_L, enabled=_B, source_file=_S,
    ),
    "binding": _table(class_name=_S, form_key=_S, plugin_type=_S, status=_S, source_relpath=_S, confidence=_D, note=_S),
    "operation": _table(form_key=_S, key=_S, name=_S, operation_type=_S, resolved_from=_S, has_operation_plugin=_B),
    "plugin_method": _table(plugin_fqn=_S, method_name=_S, event_kind=_S, event_phase=_S, start_line=_I, end_line=_I, source_relpath=_S),
    "field_access": _table(
        form_key=_S, field_key=_S, level=_S, entry_key=_S, plugin_fqn=_S, plugin_type=_S, access_class=_S, access_method=_S,
        event_method=_S, event_phase=_S, access=_S, persists=_S, persist_reason=_S, via=_S, line=_I, path=T.ArrayType(_S),
        key_resolution=_S, confidence=_D, source_relpath=_S, evidence=_S, form_key_source=_S, null_reason=_S, edge_source=_S,
    ),
    "call_edge": _table(
        caller_fqn=_S, caller_method=_S, target_fqn=_S, target_method=_S, target_signature=_S, kind=_S, line=_I, col=_I,
        source_relpath=_S, resolution=_S, target_kind=_S, confidence=_D, evidence=_S,
    ),
    "operation_trigger": _table(
        caller_class=_S, caller_method=_S, line=_I, source_relpath=_S, via=_S, op_key=_S, op_key_resolution=_S,
        op_key_confidence=_D, target_form_key=_S, target_resolution=_S, target_confidence=_D, evidence=_S, receiver_source=_S,
    ),
    "java_constant": _table(class_name=_S, const_name=_S, literal=_S, source_relpath=_S, line=_I),
    "coarse_field_hit": _table(field_key=_S, relpath=_S, line=_I, via=_S),
    "edge": _table(src_type=_S, src_id=_S, dst_type=_S, dst_id=_S, kind=_S, confidence=_D, evidence=_S),
    "kb_meta": _table(key=_S, value=_S),
    "search": _table(kind=_S, key=_S, name=_S, extra=_S),
}

# Closed vocabularies of the columns.
VOCABULARIES: dict[str, list[str]] = {
    "field.kind": ["entity", "dynamic", "basedata_prop", "platform", "inherited", "unknown"],
    "field.level": ["header", "entry", "subentry", "unknown"],
    "form.form_type": ["bill", "basedata", "dynamic", "report", "widget", "param", "convert", "unknown"],
    "plugin.plugin_type": ["form", "list", "op", "writeback", "convert", "unknown"],
    "plugin.source": ["project", "platform", "unknown"],
    "binding.status": ["linked", "linked_by_name", "external", "missing", "ambiguous"],
    "source_class.orphan_role": ["plugin", "constant", "unknown"],
    "field_access.access": ["read", "write"],
    "field_access.level": ["header", "entry", "subentry", "basedata", "unknown"],
    "field_access.persists": ["yes", "no", "unknown", "na"],
    "field_access.key_resolution": ["literal", "constant", "ambiguous", "unknown", "dynamic", "dynamic-loop", "concat", "external-const", "annotation-map"],
    "field_access.form_key_source": ["data_flow", "metadata_unique", "metadata_binding", "metadata_cooccur", "reverse_callgraph"],
    "field_access.null_reason": [
        "field-key-undeterminable", "basedata-write-suspect", "basedata-ref", "dynamic-entity", "helper-caller-unknown",
        "local-or-container-source", "model-context", "unknown",
    ],
    "field_access.edge_source": ["local", "symbol", "mixed", "heuristic"],
    "plugin_method.event_phase": ["memory", "transaction", "build", "validate", "none", "helper", "unknown"],
    "call_edge.resolution": ["expr", "scope", "heuristic", "failed"],
    "call_edge.target_kind": ["project", "jar", "jdk"],
    "coarse_field_hit.via": ["rw-idiom", "literal", "const-rw-idiom", "const-ref"],
    "edge.kind": ["has_entity", "has_field", "has_plugin", "bound_to", "module_contains", "converts_to"],
}
#: Confidence of a call edge by its resolution.
CALL_CONFIDENCE = {"expr": 1.0, "scope": 0.95, "heuristic": 0.6, "failed": 0.0}
