"""Answers as text for a reader: a heading, the totals, then aligned lists. Each kind of
answer names what it shows; nothing is computed here, and what an answer left out is said."""

from __future__ import annotations

from collections.abc import Callable

WIDEST = 60


def cell(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, list | tuple):
        return " > ".join(map(cell, value)) or "-"
    text = str(value).replace("\n", " ")
    return text if len(text) <= WIDEST else text[: WIDEST - 1] + "…"


def table(title: str, rows: list[dict], columns: list[str], left_out: int = 0) -> list[str]:
    """A titled list with aligned columns; empty lists are not shown."""
    if not rows:
        return []
    cells = [[cell(r.get(c)) for c in columns] for r in rows]
    widths = [max(len(c), *(len(x[i]) for x in cells)) for i, c in enumerate(columns)]
    line = lambda parts: "  " + "  ".join(p.ljust(w) for p, w in zip(parts, widths, strict=True)).rstrip()
    more = [f"  … {left_out} more"] if left_out > 0 else []
    return ["", f"{title} ({len(rows) + max(0, left_out)})", line(columns), *map(line, cells), *more]


def pairs(title: str, values: dict) -> list[str]:
    return [f"{title}: " + (", ".join(f"{k} {cell(v)}" for k, v in values.items()) or "none")]


def left_out(answer: dict, name: str) -> int:
    section = (answer.get("sections") or {}).get(name) or {}
    return section.get("pending") or answer.get(f"{name}_capped") or 0


def asked_back(answer: dict) -> list[str] | None:
    """What to say instead of an answer."""
    if answer.get("error"):
        return [f"error: {answer['error']}"]
    if answer.get("need_clarification"):
        return ["which one is meant? candidates:", *(f"  {c}" for c in answer.get("candidates", []))]
    if answer.get("redirect"):
        return [f"see {answer['redirect']} ({answer.get('reason')})"]
    return None


def trace(a: dict) -> list[str]:
    if "section" in a:
        return [f"{a['field']}: {a['section']}", *table(a["section"], a["items"], list(a["items"][0]) if a["items"] else [], a["pagination"]["pending"])]
    out = [f"field {a['field']} of {cell(a['form'])}", *pairs("accesses", a["summary"]), *pairs("saved", a["persists"])]
    out += table("accesses", a["accesses"], ["access", "persists", "access_class", "access_method", "line", "event_method", "confidence", "edge_source"], a["pagination"]["pending"])
    out += table("writers", a["writers"], ["access_class", "total", "sites"], left_out(a, "writers"))
    out += table("readers", a["readers"], ["access_class", "total", "detail"], left_out(a, "readers"))
    out += table("of no known form", a["unlocated"], ["access_class", "access_method", "total", "writes", "causes", "anchors"], left_out(a, "unlocated"))
    out += table("dynamic writes that could mean it", a["dynamic_candidates"], ["access_class", "access_method", "writes", "causes"], left_out(a, "dynamic_candidates"))
    out += table("mentioned elsewhere", a["coarse_blind_spots"], ["field_key", "total", "places"])
    return out + table("entries", a["entries"], ["class", "method", "status"], left_out(a, "entries"))


def operation(a: dict) -> list[str]:
    columns = ["caller_class", "caller_method", "line", "via", "reason", "caller_forms"]
    out = [f"operation {a['operation']}", *pairs("triggers", a["summary"]), f"plugins: {cell(a['plugins'])}"]
    out += table("triggered by", a["triggered_by"], columns, left_out(a, "triggered_by")) + table("may be triggered by", a["unresolved_inbound"], columns, left_out(a, "unresolved_inbound"))
    return out + table("triggers", a["triggers_downstream"], ["caller_class", "line", "via", "next_trace"], left_out(a, "triggers_downstream"))


def callers(a: dict) -> list[str]:
    found = a.get("entry_analysis") or {}
    out = [f"calls of {a['target']}", *pairs("summary", a["summary"])]
    out += [f"entry: {cell(found.get('verdict'))} ({cell(found.get('confidence'))})"] if found else []
    out += table("sites", a["sites"], ["caller_fqn", "caller_method", "line", "kind", "resolution", "confidence"], a["pending"])
    return out + table("chains", found.get("chains") or [], ["terminal", "confidence", "hops"])


def bill(a: dict) -> list[str]:
    out = [f"form {a['form']['key']} {cell(a['form'].get('name'))}", *pairs("touched", a["touched"]), *pairs("converts", a["converts"])]
    out += table("entities", a["entities"], ["key", "name", "level", "parent_key", "table_name"], left_out(a, "entities"))
    out += table("fields", a["fields"], ["entity_key", "field_key", "name", "kind", "writers", "persisting", "readers"], a["pagination"]["pending"])
    out += table("plugins", a["lanes"], ["plugin_type", "class_name", "operation_key", "events"], left_out(a, "lanes"))
    return out + table("operations", a["operations"], ["key", "operation_type", "resolved_from"], left_out(a, "operations"))


def resolved(a: dict) -> list[str]:
    rows = [{"asked": k, **i} for k, items in a["resolved"].items() for i in items or [{}]]
    wrong = [{"asked": k, **i} for name in ("mismatched_form", "mismatched_kind") for k, items in a[name].items() for i in items]
    columns = ["asked", "kind", "form_key", "owner", "name"]
    return ["keys", *table("resolved", rows, columns), *table("of another form or kind", wrong, columns)]


def coverage(a: dict) -> list[str]:
    out = [f"coverage: {a['verdict']}", *pairs("project", a["project"]), *pairs("quality", a["quality"])]
    out += table("modules", a["modules"], ["module", "total", "touched", "written", "was_read"])
    return out + table("forms with the least", a["low_forms"], ["form_key", "total", "touched", "rate"]) + table("breakdown", a["breakdown"], ["facet", "value", "n"])


def scan_compare(a: dict) -> list[str]:
    return [f"scans: {a['verdict']}", *pairs("keys", a["buckets"]), *table("only mentioned", a["coarse_only"], ["field_key", "hits", "idiom", "constant"], a["coarse_only_total"] - len(a["coarse_only"]))]


def dynamic_writes(a: dict) -> list[str]:
    return [f"dynamic writes: {a['total']}", *pairs("causes", a["by_cause"]), *table("places", a["places"], ["access_class", "access_method", "writes", "causes", "anchors"], a["places_total"] - len(a["places"]))]


def overview(a: dict) -> list[str]:
    out = ["project", *pairs("tables", a["counts"]), *pairs("bindings", a["bindings"]), f"hit rate {cell(a['hit_rate'])}, trust {cell(a['trust'])}", *pairs("orphans", a["orphans"])]
    out += table("hot fields", a["hot_fields"], ["field_key", "users", "persisting"])
    risks = a["risks"]
    for name, columns in {"missing": ["class_name", "form_key"], "ambiguous": ["class_name", "form_key"], "oversized": ["form_key", "fields"], "scattered": ["name", "pkg_consistency"]}.items():
        out += table(f"risk: {name}", risks[name], columns)
    return out


def project_map(a: dict) -> list[str]:
    return [f"unclassified classes: {a['unclassified']}", *table("modules", a["modules"], ["name", "form_count", "entity_count", "plugin_count", "class_count", "dominant_package", "pkg_consistency"])]


def forms(a: list[dict]) -> list[str]:
    return table("forms", a, ["form_key", "name", "form_type", "module", "entity_count", "field_count", "plugin_count", "operation_count"])


def search(a: list[dict]) -> list[str]:
    return table("found", a, ["kind", "key", "name", "extra"]) or ["nothing found"]


def whois(a: dict) -> list[str]:
    return [*table("classes", a["classes"], ["fqn", "relpath", "module", "plugin_base"]), *table("touches", a["touches"], ["access_class", "form_key", "field_key", "access"])] or ["no such class"]


RENDERERS: dict[str, Callable[..., list[str]]] = {
    "trace": trace, "operation": operation, "callers": callers, "bill": bill, "resolve": resolved, "coverage": coverage, "scan-compare": scan_compare,
    "dynwrites": dynamic_writes, "overview": overview, "map": project_map, "forms": forms, "search": search, "whois": whois,
}


def rendered(command: str, answer: object) -> str:
    lines = asked_back(answer) if isinstance(answer, dict) else None
    return "\n".join(lines if lines is not None else RENDERERS[command](answer)).strip("\n")
