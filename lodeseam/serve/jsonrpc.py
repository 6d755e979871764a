"""JSON-RPC over lines of text: the search tools of an engine, for assistants."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import Any, TextIO

from ..operators.retrieval import Mode, SearchFilter

PARSE_ERROR, UNKNOWN_METHOD, BAD_PARAMS = -32700, -32601, -32602
PROTOCOL = "2024-11-05"

_FILTERS = {
    "path_includes": {"type": "array", "items": {"type": "string"}, "description": "Keep documents whose path holds any of these"},
    "path_excludes": {"type": "array", "items": {"type": "string"}, "description": "Leave out documents whose path holds any of these"},
    "since": {"type": "string", "format": "date-time", "description": "Keep documents updated at this time or later"},
    "frontmatter": {"type": "object", "additionalProperties": {"type": "string"}, "description": "Keep documents with all of these fields"},
}


def most(top_k: int) -> int:
    """The greatest limit that a call may ask for."""
    return max(2 * top_k, 10)


def tools(top_k: int) -> list[dict]:
    """The tools and their arguments, with the session's limits."""
    search = {
        "query": {"type": "string", "description": "What to look for"},
        "limit": {"type": "integer", "default": top_k, "minimum": 1, "maximum": most(top_k), "description": "Most results to return"},
        "mode": {"type": "string", "enum": [m.value for m in (Mode.HYBRID, Mode.SEMANTIC, Mode.KEYWORD)], "description": "By words, by meaning, or by both (default)"},
        "group_by_doc": {"type": "boolean", "default": True, "description": "One result per document, or one per passage"},
    } | _FILTERS
    schema = lambda properties, *needed: {"type": "object", "properties": properties} | ({"required": list(needed)} if needed else {})
    return [
        {"name": "search_library", "description": "Search all documents", "inputSchema": schema(search, "query")},
        {"name": "search_books", "description": "Search books only", "inputSchema": schema(search, "query")},
        {"name": "list_books", "description": "All books with their passage counts and files", "inputSchema": schema({})},
        {"name": "browse_topics", "description": "Tags and how many documents have them", "inputSchema": schema({"classification": {"type": "string", "description": "Count documents of this class only"}})},
    ]


class BadParams(ValueError):
    pass


def _strings(args: dict, key: str) -> list[str]:
    value = args.get(key, [])
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise BadParams(f"'{key}' must be an array of strings")
    return value


def parse_filter(args: dict) -> SearchFilter:
    """A filter from a call's arguments, each checked for its type."""
    if args.get("since") is not None and not isinstance(args["since"], str):
        raise BadParams("'since' must be a string")
    front = args.get("frontmatter", {})
    if not isinstance(front, dict) or any(isinstance(v, (dict, list)) or v is None for v in front.values()):
        raise BadParams("'frontmatter' must be an object of strings, numbers or booleans")
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    try:
        return SearchFilter(None, None, _strings(args, "path_includes"), _strings(args, "path_excludes"), args.get("since"), {k: text(v) for k, v in front.items()})
    except ValueError as e:
        raise BadParams(f"'since' must be an RFC 3339 time: {e}") from e


class NotReady(RuntimeError):
    """No profile can be queried."""


class Server:
    def __init__(self, engine) -> None:
        self.engine = engine

    def _tool(self, name: str, args: dict) -> Any:
        if name == "list_books":
            books = self.engine.books()
            return {"total_books": len(books), "books": [{"title": b["title"], "chunks": b["chunk_count"], "file": b["file"]} for b in books]}
        if name == "browse_topics":
            topics = self.engine.topics(args.get("classification"))
            return {"total_topics": len(topics), "topics": topics}
        if name not in ("search_library", "search_books"):
            raise LookupError(f"unknown tool '{name}'")
        try:
            mode = Mode.parse(args["mode"]) if isinstance(args.get("mode"), str) else Mode.HYBRID
        except ValueError as e:
            raise BadParams(str(e)) from e
        top_k, limit = self.engine.config.top_k, args.get("limit")
        limit = min(limit, most(top_k)) if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0 else top_k
        group, query = args.get("group_by_doc"), args.get("query")
        query = query if isinstance(query, str) else ""
        search = self.engine.search_books if name == "search_books" else self.engine.search_library
        results = search(query, where=parse_filter(args), group_by_doc=group if isinstance(group, bool) else True, limit=limit, mode=mode)
        return {"query": query, "search_mode": mode.value, "total_results": len(results), "results": results}

    def handle(self, request: dict) -> dict | None:
        method, ident, params = request.get("method", ""), request.get("id"), request.get("params") or {}
        reply = lambda **x: {"jsonrpc": "2.0", "id": ident} | x
        if method.startswith("notifications/") or method == "initialized":
            return None
        if method == "initialize":
            return reply(result={"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseam", "version": "1"}})
        if method == "ping":
            return reply(result={})
        if method == "tools/list":
            return reply(result={"tools": tools(self.engine.config.top_k)})
        if method != "tools/call":
            return reply(error={"code": UNKNOWN_METHOD, "message": f"unknown method '{method}'"})
        try:
            value = self._tool(params.get("name", ""), params.get("arguments") or {})
        except BadParams as e:
            return reply(error={"code": BAD_PARAMS, "message": str(e)})
        except Exception as e:  # noqa: BLE001  a tool's failure is its answer
            return reply(result={"isError": True, "content": [{"type": "text", "text": json.dumps({"error": str(e)})}]})
        return reply(result={"content": [{"type": "text", "text": json.dumps(value, default=str)}]})

    def serve(self, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answers line by line; refuses to start while no profile can be queried."""
        startup = self.engine.startup()
        if not startup["queryable_profiles"]:
            raise NotReady(f"no profile is ready to be queried: {'; '.join(startup['issues'])}")
        for line in filter(str.strip, lines):
            try:
                reply = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
            if reply is not None:
                print(json.dumps(reply), file=out, flush=True)
