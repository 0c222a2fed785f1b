"""A read-only JSON interface to a knowledge base."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from factloom.plans import knowledge
from factloom.sources.store import KnowledgeBase


def handle(kb: KnowledgeBase, path: str, query: dict[str, str]) -> tuple[int, object]:
    """(status, answer) of a request."""
    plain = {
        "/api/overview": knowledge.overview, "/api/coverage": knowledge.coverage, "/api/scan-compare": knowledge.scan_compare,
        "/api/modules": knowledge.project_map, "/api/dynwrites": knowledge.dynamic_writes,
    }
    if path in plain:
        return 200, plain[path](kb)
    if path == "/api/forms":
        return 200, {"forms": knowledge.forms(kb)}
    if path in ("/api/field", "/api/operation", "/api/callers"):
        key = query.get("key", "").strip()
        if not key:
            return 400, {"error": "the parameter key is missing"}
        ask = {"/api/field": knowledge.trace_field, "/api/operation": knowledge.trace_operation, "/api/callers": knowledge.callers}[path]
        try:
            return 200, ask(kb, key)
        except ValueError as error:
            return 400, {"error": str(error)}
    if path == "/api/whois":
        return 200, knowledge.whois(kb, query["q"]) if query.get("q") else {"classes": [], "touches": []}
    if path == "/api/search":
        return 200, {"results": knowledge.search(kb, query["q"]) if query.get("q") else []}
    for head in ("/api/bill/", "/api/forms/"):
        if path.startswith(head):
            found = knowledge.bill(kb, unquote(path.removeprefix(head)))
            return (404 if "error" in found else 200), found
    return 404, {"error": f"no such path: {path}"}


def server(kb: KnowledgeBase, port: int = 8765) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            status, answer = handle(kb, url.path, {k: v[0] for k, v in parse_qs(url.query).items()})
            body = json.dumps(answer, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
