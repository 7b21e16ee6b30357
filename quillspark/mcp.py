"""The engine as tools over JSON-RPC on standard input and output, a message a line."""

from __future__ import annotations

import json

from . import render
from .engine import VERSION, Engine
from .errors import NotFoundError, QuillError

PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
_TAGS = {"type": "array", "items": _TEXT}


def _tool(name: str, about: str, required: tuple = (), **properties) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}, "annotations": {"readOnlyHint": True}}


TOOLS = [
    _tool("search_docs", "Ranked documents for words or a short question, with their best sections.", ("query",), query=_TEXT, limit={"type": "integer", "minimum": 1, "maximum": 50}, tags=_TAGS),
    _tool("read_doc", "A document by id, one section of it (id#anchor), or its outline.", ("id",), id=_TEXT, section=_TEXT, outline=_FLAG),
    _tool("list_docs", "All documents with their summaries.", tags=_TAGS),
]
TYPES = {"string": str, "integer": int, "boolean": bool, "array": list}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, message) -> dict | None:
        """The answer to a message; none to a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
        if "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            return {**out, "result": self.call(message["method"], message.get("params") or {})}
        except RpcError as e:
            return {**out, "error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return {**out, "error": {"code": -32603, "message": f"internal error: {e}"}}

    def call(self, method: str, params: dict) -> dict:
        if method == "initialize":
            asked = params.get("protocolVersion")
            return {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "quillspark", "version": VERSION}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": TOOLS}
        if method != "tools/call":
            raise RpcError(-32601, f"unknown method {method}")
        tool = next((t for t in TOOLS if t["name"] == params.get("name")), None)
        if tool is None:
            raise RpcError(-32602, f"unknown tool {params.get('name')!r}")
        given = params.get("arguments") or {}
        schema = tool["inputSchema"]
        for key in schema["required"]:
            if key not in given:
                return self.said(f"argument '{key}' is missing", True)
        for key, value in given.items():
            kind = schema["properties"].get(key, {}).get("type")
            if kind is None or not isinstance(value, TYPES[kind]) or (kind == "integer" and isinstance(value, bool)):
                return self.said(f"argument '{key}' is unknown or of the wrong type", True)
        try:
            return self.said(getattr(self, tool["name"])(**given))
        except NotFoundError as e:
            return self.said(f"{e}" + (". Did you mean: " + ", ".join(e.suggestions) if e.suggestions else ""), True)
        except QuillError as e:
            return self.said(str(e), True)

    @staticmethod
    def said(text: str, error: bool = False) -> dict:
        return {"content": [{"type": "text", "text": text}], "isError": error}

    def search_docs(self, query: str, limit: int = 8, tags: list | tuple = ()) -> str:
        return render.search(self.engine.search(query, limit, tags), "Next: read_doc with an id, or id#anchor.")

    def read_doc(self, id: str, section: str | None = None, outline: bool = False) -> str:
        return render.outline(self.engine.outline(id)) if outline else render.doc(self.engine.read(id, section))

    def list_docs(self, tags: list | tuple = ()) -> str:
        return render.listing(self.engine.list_docs(tags), "Next: read_doc with an id.")


def serve_stdio(engine: Engine, lines, out) -> int:
    tools = Tools(engine)
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            answer: object = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        else:
            answer = [a for m in message if (a := tools.handle(m))] if isinstance(message, list) and message else tools.handle(message)
        if answer:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
    return 0
