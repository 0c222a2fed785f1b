"""Five tools over a knowledge base for a language model's host, and a server of the
model context protocol on standard input and output (JSON-RPC, a message a line).

The tools answer with the same dicts as the command line. The server needs no package.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from factloom.plans import knowledge
from factloom.sources.store import KnowledgeBase

PROTOCOL = "2024-11-05"
INSTRUCTIONS = (
    "Answers hold what was found with its confidence; null means unknown. Follow next_cursor for the rest of a list. "
    "If need_clarification is set, ask again with one of the candidates."
)


class Tools:
    """The tools of one knowledge base; ``topics`` maps paths of documents to texts."""

    def __init__(self, kb: KnowledgeBase, topics: dict[str, str] | None = None) -> None:
        self.kb, self.topics = kb, topics or {}

    def trace(self, key: str, kind: str = "field", access: str | None = None, cursor: str | None = None) -> dict:
        """Who reads, writes or triggers a field (form.field) or, with kind=operation, an operation (form.operation)."""
        if kind == "operation":
            return knowledge.trace_operation(self.kb, key)
        if kind != "field" or access not in (None, "read", "write"):
            return {"error": "kind is field or operation, access is read or write"}
        return knowledge.trace_field(self.kb, key, access, cursor)

    def bill(self, form: str) -> dict:
        """A form's entities, fields, plugins, operations and conversions, and what touches them."""
        return knowledge.bill(self.kb, form)

    def resolve_fields(self, keys: list[str], kind: str | list[str] | None = None) -> dict:
        """What keys name: fields, entities, forms or plugins."""
        return knowledge.resolve_keys(self.kb, keys, kind)

    def callers(self, target: str, cursor: str | None = None) -> dict:
        """Call sites of Class.method and whether an enabled entry reaches it."""
        return knowledge.callers(self.kb, target, cursor)

    def semantics(self, topic: str = "") -> dict:
        """A document on the platform's events and plugins; without a topic, the list of all."""
        return knowledge.topic(self.topics, topic) if topic else {"status": "need_topic", "topics": sorted(self.topics)}

    def table(self) -> dict[str, Callable[..., dict]]:
        return {f.__name__: f for f in (self.trace, self.bill, self.resolve_fields, self.callers, self.semantics)}


_TEXT = {"type": "string"}
_TEXTS = {"type": "array", "items": _TEXT}
#: Parameters of the tools, the required ones first named.
SCHEMAS = {
    "trace": (["key"], {"key": _TEXT, "kind": _TEXT, "access": _TEXT, "cursor": _TEXT}),
    "bill": (["form"], {"form": _TEXT}),
    "resolve_fields": (["keys"], {"keys": _TEXTS, "kind": {"anyOf": [_TEXT, _TEXTS]}}),
    "callers": (["target"], {"target": _TEXT, "cursor": _TEXT}),
    "semantics": ([], {"topic": _TEXT}),
}


def listing(tools: Tools) -> list[dict]:
    return [
        {"name": n, "description": f.__doc__, "inputSchema": {"type": "object", "required": SCHEMAS[n][0], "properties": SCHEMAS[n][1]}}
        for n, f in tools.table().items()
    ]


def answered(tools: Tools, request: dict) -> dict | None:
    """The response to a message, or None for a notification."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "factloom", "version": "1"}, "instructions": INSTRUCTIONS}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": listing(tools)}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    tool = tools.table().get(params.get("name"))
    if tool is None:
        return reply | {"error": {"code": -32602, "message": f"no tool {params.get('name')}"}}
    try:
        found = tool(**(params.get("arguments") or {}))
    except (TypeError, ValueError) as error:
        found = {"error": str(error)}
    text = json.dumps(found, default=str, ensure_ascii=False)
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": "error" in found and bool(found["error"])}}


def serve(tools: Tools, source: TextIO, sink: TextIO) -> None:
    """Answer messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answered(tools, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
