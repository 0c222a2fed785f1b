"""Classifications as column expressions: first rule that fits wins, and what no
rule decides is unknown with a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operation types that write to the database when their transaction ends.
PERSISTING_OPERATIONS = ["save", "submit", "unsubmit", "audit", "unaudit", "delete", "push", "disable", "enable", "drawbill"]
# Resolutions of a field key that leave it undetermined.
UNDETERMINED_KEYS = ["dynamic", "dynamic-loop", "concat", "external-const", "unknown", "ambiguous"]
#: Null reasons that are correct answers rather than gaps.
CORRECT_NULLS = ["basedata-ref", "dynamic-entity"]
# Notes in the evidence of an access.
NOTE_DYNAMIC, NOTE_HELPER, NOTE_SOURCE = "note:dynamic-entity", "note:helper-caller", "note:source-unidentified"


def persistence(sink: Column, phase: Column, op_type: Column, leaks: Column) -> Column:
    """struct(persists, confidence) of ``reasoned_persistence``."""
    found = reasoned_persistence(sink, phase, op_type, leaks)
    return F.struct(found["persists"].alias("persists"), found["confidence"].alias("confidence"))


def reasoned_persistence(sink: Column, phase: Column, op_type: Column, leaks: Column) -> Column:
    """struct(persists, confidence, reason): whether what an event writes reaches the database,
    and why. ``leaks``: a call of unknown target could have done it."""

    def verdict(value: str, confidence: float, reason: str | Column) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(value).alias("persists"), F.lit(confidence).alias("confidence"), why.alias("reason"))

    leaks = F.coalesce(leaks, F.lit(False))
    saving = F.concat(F.lit("the operation "), op_type, F.lit(" saves when its transaction ends"))
    unsure = F.concat(F.lit("a transaction whose operation ("), F.coalesce(op_type, F.lit("unknown")), F.lit(") is not known to save"))
    return (
        F.when(F.coalesce(sink, F.lit(False)), verdict("yes", 0.85, "a call that saves is reached from the event"))
        .when((phase == "transaction") & op_type.isin(PERSISTING_OPERATIONS), verdict("yes", 0.9, saving))
        .when((phase == "transaction") & leaks, verdict("unknown", 0.3, "a call out of the project could save"))
        .when((phase == "transaction") & (op_type == "donothing"), verdict("no", 0.7, "the operation does nothing, and no call saves"))
        .when(phase == "transaction", verdict("unknown", 0.4, unsure))
        .when(phase == "build", verdict("yes", 0.6, "the built object is saved by its framework"))
        .when(phase.isin("memory", "validate", "none") & leaks, verdict("unknown", 0.3, "a call out of the project could save"))
        .when(phase == "memory", verdict("no", 0.7, "the event changes a form in memory, and no call saves"))
        .when(phase.isin("validate", "none"), verdict("no", 0.6, "the event is outside the transaction, and no call saves"))
        .otherwise(verdict("unknown", 0.3, "the event's phase is unknown"))
    )


def null_reason(form_key: Column, field_key: Column, key_resolution: Column, level: Column, access: Column, evidence: Column, via: Column) -> Column:
    """Why an access has no form; null if it has one."""
    return (
        F.when(form_key.isNotNull(), F.lit(None).cast("string"))
        .when(field_key.isNull() | key_resolution.isin(UNDETERMINED_KEYS), "field-key-undeterminable")
        .when((level == "basedata") & (access == "write"), "basedata-write-suspect")
        .when(level == "basedata", "basedata-ref")
        .when(evidence.contains(NOTE_DYNAMIC), "dynamic-entity")
        .when(evidence.contains(NOTE_HELPER), "helper-caller-unknown")
        .when(evidence.contains(NOTE_SOURCE), "local-or-container-source")
        .when(via.startswith("model."), "model-context")
        .otherwise("unknown")
    )


def field_kind(tag: Column, inherits: Column, overrides: Column, key: Column, db_column: Column, form_type: Column) -> Column:
    return (
        F.when(tag == "BasedataPropField", "basedata_prop")
        .when(inherits | (overrides & key.isNull()), "inherited")
        .when(db_column.isNotNull() & (db_column != ""), "entity")
        .when(form_type == "dynamic", "dynamic")
        .otherwise("platform")
    )


def orphan_role(is_plugin: Column, fqn: Column) -> Column:
    """Role of a class that nothing is bound to."""
    constant = fqn.rlike(r"(^|\.)(cons|const|consts|constant|constants)\.") | fqn.rlike(r"(Const|Consts|Constant|Constants)$")
    return F.when(is_plugin, "plugin").when(constant, "constant").otherwise("unknown")


def tri_state(value: Column) -> Column:
    """true, false, or null for anything that is neither."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1", "t", "y", "yes"), True).when(text.isin("false", "0", "f", "n", "no"), False)


def level_by_arguments(access: Column, count: Column) -> Column:
    """Level of a model access from its number of arguments."""
    n = count - F.when(access == "write", 1).otherwise(0)
    return F.when(n == 1, "header").when(n == 2, "entry").when(n == 3, "subentry").otherwise("unknown")


def module_health(consistency: Column, scattered: Column) -> Column:
    return (
        F.when(consistency.isNull(), "warn")
        .when((consistency >= 0.9) & (scattered == 0), "good")
        .when(consistency >= 0.6, "ok")
        .otherwise("low")
    )


def bridge_trust(hit_rate: Column, missing: Column, ambiguous: Column) -> Column:
    return F.when((hit_rate >= 0.95) & (missing + ambiguous == 0), "high").when(hit_rate >= 0.8, "ok").otherwise("low")


def inbound_suspect(target: Column, op: Column, form_key: str, op_key: str) -> Column:
    """Why an unresolved trigger could still mean (form_key, op_key); null if it can't,
    ``exact`` if it does."""
    this_form, this_op = target == form_key, op == op_key
    return (
        F.when(this_form & this_op, "exact")
        .when(this_form & op.isNull(), "op_unresolved")
        .when(target.isNull() & this_op, "target_unresolved")
        .when(target.isNull() & op.isNull(), "both_unresolved")
    )


def entry_verdict(platform: Column, chain: Column, any_enabled: Column, all_inactive: Column, confirmed: Column, truncated: Column, symbol_weak: Column, strong_zero: Column) -> Column:
    """struct(verdict, confidence) on whether a method can be reached from an entry. A
    negative verdict is never confirmed."""

    def out(verdict: str, confidence: Column | str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))

    return (
        F.when(platform, out("not_analyzed", "unknown"))
        .when(chain == "not_found", out("no_entry_found", F.when(strong_zero & ~truncated, "likely").otherwise("unknown")))
        .when(any_enabled, out("entry_reachable", F.when(confirmed, "confirmed").otherwise("likely")))
        .when(all_inactive & ~truncated & ~symbol_weak, out("entries_inactive", "likely"))
        .otherwise(out("entry_unverifiable", "unknown"))
    )
