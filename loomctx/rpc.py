"""JSON-RPC over lines: tools for agents on one long-lived session."""

from __future__ import annotations

import json

from loomctx import __version__
from loomctx import schema as S

_TEXT, _COUNT = {"type": "string"}, {"type": "integer"}


def _tool(name: str, description: str, required: list[str], **properties) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required}}


TOOLS = [
    _tool("search_code", "Ranked code and documents for a query", ["query"], query=_TEXT, limit=_COUNT | {"default": 10, "minimum": 1, "maximum": 50}),
    _tool("explain_symbol", "A symbol's signature and neighbours", ["symbol"], symbol=_TEXT),
    _tool("find_callers", "Who calls a symbol", ["symbol"], symbol=_TEXT),
    _tool("find_tests", "Tests that cover a file or symbol", ["file_or_symbol"], file_or_symbol=_TEXT),
    _tool("build_context_pack", "A budgeted, explained selection of context", ["query"], query=_TEXT, token_budget=_COUNT | {"minimum": 500}, include_content={"type": "boolean", "default": True}, mode={"type": "string", "enum": list(S.MODES)}),
    _tool("changed_since", "Files changed since the last index", []),
    _tool("impact_analysis", "What depends on a file or symbol, by distance", ["file_or_symbol"], file_or_symbol=_TEXT, depth=_COUNT | {"default": 3, "minimum": 1, "maximum": 5}),
    _tool("get_content", "Contents of nodes by id", ["node_ids"], node_ids={"type": "array", "items": _TEXT}),
]


def dispatch(engine, name: str, arguments: dict):
    """Run a tool; a missing argument or unknown tool is a ValueError."""
    tool = next((t for t in TOOLS if t["name"] == name), None)
    if tool is None:
        raise ValueError(f"unknown tool '{name}'; known: {', '.join(t['name'] for t in TOOLS)}")
    for key in tool["inputSchema"]["required"]:
        if key not in arguments:
            raise ValueError(f"missing '{key}'")
    get = arguments.get
    if name == "search_code":
        return {"hits": engine.search(get("query"), int(get("limit", 10)))}
    if name == "explain_symbol":
        found = engine.explain(get("symbol"))
        if found is None:
            raise ValueError(f"no symbol '{get('symbol')}'")
        return found
    if name == "find_callers":
        return {"callers": engine.callers(get("symbol"))}
    if name == "find_tests":
        return {"tests": engine.tests(get("file_or_symbol"))}
    if name == "build_context_pack":
        return engine.pack(get("query"), get("token_budget"), get("mode"), get("include_content", True), surface="rpc")
    if name == "changed_since":
        return engine.changed()
    if name == "impact_analysis":
        return {"levels": engine.impact(get("file_or_symbol"), int(get("depth", 3)))}
    return {"nodes": engine.content(list(get("node_ids")))}


def answer(engine, message: dict) -> dict | None:
    """The reply to one message; notifications have none."""
    method, id_ = message.get("method"), message.get("id")
    if id_ is None:
        return None
    if method == "initialize":
        result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loomctx", "version": __version__}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        params = message.get("params") or {}
        try:
            value, failed = dispatch(engine, params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # a failing tool is a result, not a protocol error
            value, failed = str(e), True
        text = value if failed else json.dumps(value, ensure_ascii=False, default=str)
        result = {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})
    else:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method '{method}'"}}
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def serve(engine, source, sink) -> None:
    """One message a line until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except (ValueError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
