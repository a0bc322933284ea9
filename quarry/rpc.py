"""JSON-RPC 2.0 over lines: the engine's look-ups as tools."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from quarry.engine import Engine

PROTOCOL = "2024-11-05"
_TEXT = {"type": "string"}
TOOLS = [
    {"name": "search_code", "description": "Finds code that helps to answer a question.", "inputSchema": {"type": "object", "properties": {"query": _TEXT, "limit": {"type": "integer"}}, "required": ["query"]}},
    {"name": "find_definition", "description": "Where a symbol is defined.", "inputSchema": {"type": "object", "properties": {"symbol": _TEXT}, "required": ["symbol"]}},
    {"name": "find_references", "description": "Where a symbol is used.", "inputSchema": {"type": "object", "properties": {"symbol": _TEXT, "only_calls": {"type": "boolean"}}, "required": ["symbol"]}},
    {"name": "project_status", "description": "What the index holds.", "inputSchema": {"type": "object", "properties": {}}},
]


class BadParams(Exception):
    pass


def _call(engine: Engine, name: str, args: dict) -> object:
    def need(key: str) -> str:
        if not isinstance(args.get(key), str) or not args[key].strip():
            raise BadParams(f"{key} must be a string")
        return args[key]

    rows: Callable = lambda df, *cols: [r.asDict() for r in df.select(*cols).collect()]
    if name == "search_code":
        limit = args.get("limit", engine.config.search.top_k)
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
            raise BadParams("limit must be a number from 1 to 100")
        found = rows(engine.search(need("query"), limit), "file_path", "start_line", "end_line", "name", "score", "found_via_calls", "content")
        return [r | {"score": round(r["score"], 2)} for r in found]
    if name == "find_definition":
        return rows(engine.definitions(need("symbol")), "file_path", "start_line", "end_line", "name", "parent", "chunk_type", "content")
    if name == "find_references":
        return rows(engine.references(need("symbol"), bool(args.get("only_calls", args.get("calls_only")))), "file_path", "line", "kind", "symbol")
    if name == "project_status":
        root = engine.index.meta("project_root")
        return engine.status(str(root)) if root else engine.stats()
    raise BadParams(f"unknown tool {name}")


def handle(engine: Engine, line: str) -> dict | None:
    """The reply to one request line; None for a notification."""
    def fail(code: int, message: str, ident: object = None) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError:
        return fail(-32700, "not JSON")
    if not isinstance(request, dict) or "method" not in request:
        return fail(-32600, "not a request")
    if "id" not in request:
        return None
    ident, method, params = request["id"], request["method"], request.get("params") or {}
    result: object
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        try:
            value = _call(engine, params.get("name", ""), params.get("arguments") or {})
        except BadParams as e:
            return fail(-32602, str(e), ident)
        result = {"content": [{"type": "text", "text": json.dumps(value, default=str)}]}
    else:
        return fail(-32601, f"no method {method}", ident)
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip():
            reply = handle(engine, line)
            if reply is not None:
                yield json.dumps(reply)
