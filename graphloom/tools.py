"""The three questions as tools for assistants: list them, call one, over JSON-RPC messages of one line each."""

from __future__ import annotations

import json
from typing import TextIO

from graphloom import query as Q

_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
# The tools' names and arguments.
TOOLS = {
    "search_hybrid_context": ("Entities whose meaning is near to a query, with the graph around each", {"query": _TEXT, "max_results": _WHOLE, "repo_name": _TEXT}, ["query"]),
    "find_callers": ("What calls, extends, implements or references an entity", {"entity_name": _TEXT, "repo_name": _TEXT, "page": _WHOLE}, ["entity_name"]),
    "explore_file": ("What a file declares", {"file_path": _TEXT, "repo_name": _TEXT, "page": _WHOLE}, ["file_path"]),
}
VERSION = "2025-06-18"


class ToolError(ValueError):
    """A call that can't be answered."""


def list_tools() -> list[dict]:
    return [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": props, "required": need}} for n, (text, props, need) in TOOLS.items()]


def call_tool(index: Q.CodeIndex | None, name: str, given: dict) -> str:
    """The answer in Markdown. Without an index (a dry run) no tool is called."""
    if name not in TOOLS:
        raise ToolError(f"unknown tool: {name}")
    _, props, need = TOOLS[name]
    for key in need:
        if key not in given:
            raise ToolError(f"{name} needs {key}")
    for key, v in given.items():
        if key not in props or v is None:
            continue
        if not isinstance(v, str if props[key] is _TEXT else int) or isinstance(v, bool):
            raise ToolError(f"{key} is to be a {props[key]['type']}")
    if index is None:
        raise ToolError("a dry run: there is no index to ask")
    repo, page = given.get("repo_name"), given.get("page") or 1
    try:
        if name == "search_hybrid_context":
            return Q.search_markdown(Q.rows(index.search(given["query"], 5 if given.get("max_results") is None else given["max_results"], repo)))
        if name == "find_callers":
            return Q.callers_markdown(given["entity_name"], Q.rows(index.callers(given["entity_name"], repo), page, 1000))
        return Q.explore_markdown(given["file_path"], Q.rows(index.explore(given["file_path"], repo), page, 1000))
    except (ValueError, RuntimeError) as e:
        raise ToolError(str(e)) from e


def answer(index: Q.CodeIndex | None, message: dict) -> dict | None:
    """The reply to one message; null for a notification."""
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return head | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}}
    if method == "ping":
        return head | {"result": {}}
    if method == "tools/list":
        return head | {"result": {"tools": list_tools()}}
    if method == "tools/call":
        try:
            return head | {"result": {"content": [{"type": "text", "text": call_tool(index, params.get("name"), params.get("arguments") or {})}], "isError": False}}
        except ToolError as e:
            return head | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    return head | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(index: Q.CodeIndex | None, source: TextIO, sink: TextIO) -> int:
    """Answers messages until the source ends; what is no JSON gets an error and stops nothing."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(index, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
    return 0
