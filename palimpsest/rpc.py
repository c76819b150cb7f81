"""The engine's functions as JSON-RPC 2.0: JSON lines over a pair of streams, and HTTP (POST /mcp, GET /health).

Two dialects share the functions: 'tools' (initialize, tools/list, tools/call) and 'plain' (the functions' names are the methods).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from .archive import Archives, totals
from .errors import PalimpsestError
from .plans.query import Flags
from .sources.discover import infer_scope, scoped_path
from .wire import JSON, TOON, accepted, to_toon

# Error codes of JSON-RPC 2.0.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, FAILED = -32700, -32600, -32601, -32602, -32000


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _taken(params: dict, kinds: dict[str, type]) -> dict:
    """The parameters with their types checked; unknown ones are an error, null ones are left out."""
    out = {}
    for name, value in params.items():
        if name not in kinds:
            raise RpcError(INVALID_PARAMS, f"unknown parameter {name}")
        if value is None:
            continue
        if type(value) is not kinds[name]:
            raise RpcError(INVALID_PARAMS, f"{name}: expected {kinds[name].__name__}")
        out[name] = value
    return out


_SCOPE = {"service": str, "account": str}
#: What each function takes, and what it needs.
PARAMS: dict[str, tuple[dict[str, type], tuple[str, ...]]] = {
    "list_archives": ({}, ()),
    "search": ({"pattern": str, "ignore_case": bool, "fixed_strings": bool, "word_regexp": bool, "max_count": int, **_SCOPE}, ("pattern",)),
    "stats": (_SCOPE, ("service", "account")),
    "ingest": ({"inputs": list, **_SCOPE}, ()),
    "scoped_path": (_SCOPE, ("service", "account")),
    "infer_export": ({"input": str}, ("input",)),
}


def schema(name: str) -> dict:
    """A function's parameters as a JSON schema; lists are of strings."""
    kinds = {str: {"type": "string"}, bool: {"type": "boolean"}, int: {"type": "integer", "minimum": 0}, list: {"type": "array", "items": {"type": "string"}}}
    params, needed = PARAMS[name]
    out = {"type": "object", "properties": {k: kinds[t] for k, t in params.items()}, "additionalProperties": False}
    return out | ({"required": list(needed)} if needed else {})


def _list_archives(a: Archives, p: dict) -> dict:
    _taken(p, PARAMS["list_archives"][0])
    return {"archives": a.list()}


def _search(a: Archives, p: dict) -> dict:
    p = _taken(p, PARAMS["search"][0])
    if "pattern" not in p:
        raise RpcError(INVALID_PARAMS, "pattern is required")
    if p.get("max_count", 0) < 0:
        raise RpcError(INVALID_PARAMS, "max_count: negative")
    flags = Flags(ignore_case=p.get("ignore_case", False), fixed=p.get("fixed_strings", False), word=p.get("word_regexp", False))
    more = {"max_count": p["max_count"]} if "max_count" in p else {}
    found = a.search(p["pattern"], flags, service=p.get("service"), account=p.get("account"), **more)
    return {"hits": [r.asDict(recursive=True) for r in found.select("snippet", "field", "occurrences").collect()]}


def _stats(a: Archives, p: dict) -> dict:
    p = _taken(p, _SCOPE)
    if len(p) != 2:
        raise RpcError(INVALID_PARAMS, "service and account are required")
    return {"stats": [r.asDict(recursive=True) for r in a.stats(p["service"], p["account"]).collect()]}


def _ingest(a: Archives, p: dict) -> dict:
    p = _taken(p, PARAMS["ingest"][0])
    if not p.get("inputs"):
        if p.get("service") or p.get("account"):
            raise RpcError(INVALID_PARAMS, "a service or account needs inputs")
        reports = a.ingest_home(os.path.expanduser("~"))
        return {"reports": reports} | totals(reports)
    return a.ingest(*p["inputs"], service=p.get("service"), account=p.get("account"))


def _scoped_path(a: Archives, p: dict) -> dict:
    p = _taken(p, _SCOPE)
    if len(p) != 2:
        raise RpcError(INVALID_PARAMS, "service and account are required")
    return {"path": scoped_path(a.root, p["service"], p["account"])}


def _infer_scope(a: Archives, p: dict) -> dict:
    p = _taken(p, PARAMS["infer_export"][0])
    if "input" not in p:
        raise RpcError(INVALID_PARAMS, "input is required")
    service, account = infer_scope(p["input"])
    return {"service": service, "account": account}


FUNCTIONS: dict[str, tuple[Callable[[Archives, dict], dict], str]] = {
    "list_archives": (_list_archives, "Names of all archives"),
    "search": (_search, "Search all archives, or one by service and account"),
    "stats": (_stats, "Counts of one archive"),
    "ingest": (_ingest, "Add exports to an archive"),
    "scoped_path": (_scoped_path, "The folder of an archive"),
    "infer_export": (_infer_scope, "Service and account of an export"),
}


def call(archives: Archives, name: str, params: dict | None = None) -> dict:
    """One of the six functions, by name."""
    if name not in FUNCTIONS:
        raise RpcError(NO_METHOD, f"no function {name}")
    return FUNCTIONS[name][0](archives, params or {})


def _dispatch(archives: Archives, method: str, params: dict, dialect: str) -> dict:
    if dialect == "plain":
        return call(archives, method, params)
    if method == "initialize":
        return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "palimpsest", "version": "1"}}
    if method == "ping" or method.startswith("notifications/"):
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": schema(n)} for n, (_, d) in FUNCTIONS.items()]}
    if method == "tools/call":
        if not isinstance(params.get("name"), str):
            raise RpcError(INVALID_PARAMS, "name is required")
        got = call(archives, params["name"], params.get("arguments"))
        return {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False)}]}
    raise RpcError(NO_METHOD, f"no method {method}")


def answer(archives: Archives, line: str | bytes, dialect: str = "tools") -> dict | None:
    """The reply to one request; None to a notification."""
    own = None
    try:
        try:
            request = json.loads(line)
        except ValueError as e:
            raise RpcError(PARSE_ERROR, str(e)) from None
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            raise RpcError(INVALID_REQUEST, "not a request")
        own, params = request.get("id"), request.get("params") or {}
        if not isinstance(params, dict):
            raise RpcError(INVALID_PARAMS, "params is an object")
        result = _dispatch(archives, request["method"], params, dialect)
        return {"jsonrpc": "2.0", "id": own, "result": result} if "id" in request else None
    except RpcError as e:
        code, text = e.code, str(e)
    except (PalimpsestError, OSError) as e:
        code, text = FAILED, str(e)
    return {"jsonrpc": "2.0", "id": own, "error": {"code": code, "message": text}}


def serve_lines(archives: Archives, source: IO[str], sink: IO[str], dialect: str = "tools", toon: bool = False) -> None:
    """A request a line until the source ends; blank lines are passed over. With ``toon``, replies are TOON, each followed by an empty line."""
    for line in source:
        if line.strip() and (got := answer(archives, line, dialect)) is not None:
            sink.write(to_toon(got) + "\n\n" if toon else json.dumps(got, ensure_ascii=False) + "\n")
            sink.flush()


def http_server(archives: Archives, bind: str = "127.0.0.1:8741") -> ThreadingHTTPServer:
    """POST /mcp takes one request, GET /health says ok; notifications get 204. The caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes = b"", kind: str = "application/json") -> None:
            self.send_response(code)
            if body:
                self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(200, b"ok", "text/plain") if self.path == "/health" else self._send(404)

        def do_POST(self) -> None:
            if self.path.split("?")[0] != "/mcp":
                self._send(404)
                return
            got = answer(archives, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            if got is None:
                self._send(204)
            elif accepted(self.headers.get("Accept")) == TOON:
                self._send(200, to_toon(got).encode(), TOON)
            else:
                self._send(200, json.dumps(got, ensure_ascii=False).encode(), JSON)

        def log_message(self, *args) -> None:
            pass

    host, port = bind.rsplit(":", 1)
    return ThreadingHTTPServer((host, int(port)), Handler)
