"""The agents' verbs over standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from typing import IO

from quillmark.plans.library import Tools, schemas

VERSION = "2024-11-05"


def answered(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; a notification has none."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillmark", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": t["name"], "description": t["description"], "inputSchema": t["input_schema"]} for t in schemas()]}}
    if method == "tools/call":
        params = message.get("params") or {}
        try:
            text, failed = json.dumps(tools.dispatch(params.get("name", ""), params.get("arguments")), ensure_ascii=False), False
        except (KeyError, ValueError) as e:  # what the caller got wrong is told to the caller
            text, failed = str(e.args[0] if e.args else e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def serve(tools: Tools, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answer messages until the input ends; a line that is no JSON object gets an error."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answered(tools, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not an object"}}
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
