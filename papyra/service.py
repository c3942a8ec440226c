"""Commands for a caller that speaks JSON: their definitions, checked arguments, calls by name, and a JSON-RPC handler.

Paths may be confined to a folder. A call reads its files and returns rows as JSON; the work is done by the commands.
"""

from __future__ import annotations

import inspect as python
import json
import os
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commands
from .sources.pdf_edit import Refused

#: The protocol version that is spoken, and codes of errors.
PROTOCOL = "2024-11-05"
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_ARGUMENTS = -32700, -32600, -32601, -32602
#: Arguments that name files or folders.
PATHS = ("input", "inputs", "output", "out_dir", "cert", "key", "trust")

_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "bytes": "string", "dict[str, str]": "object"}


def public_name(command: str) -> str:
    """A command's name as a tool."""
    return "pdf_" + command.replace("-", "_")


def definitions() -> list[dict[str, Any]]:
    """Name, first line of help and JSON schema of every command."""
    out = []
    for name, f in commands.COMMANDS.items():
        properties: dict[str, Any] = {}
        required = []
        for p in python.signature(f).parameters.values():
            if p.kind is p.VAR_KEYWORD:
                continue
            if p.name in ("files", "sources"):
                properties["input"] = {"type": "string"}
                properties["password"] = {"type": "string"}
                required.append("input")
                continue
            kind = str(p.annotation).replace(" | None", "")
            listed = kind.startswith(("tuple", "list"))
            properties[p.name.rstrip("_")] = {"type": "array", "items": {"type": "string"}} if listed else {"type": _TYPES.get(kind, "string")}
            if p.default is p.empty:
                required.append(p.name.rstrip("_"))
        extra = any(p.kind is p.VAR_KEYWORD for p in python.signature(f).parameters.values())
        schema = {"type": "object", "properties": properties, "required": required, "additionalProperties": extra}
        out.append({"name": public_name(name), "description": (f.__doc__ or "").strip().splitlines()[0], "inputSchema": schema})
    return out


def resolve(path: str, root: str | None) -> str:
    """A path with the links of its nearest existing parent followed; one that leads out of ``root`` is refused."""
    full = os.path.abspath(path if os.path.isabs(path) or root is None else os.path.join(root, path))
    if ".." in path.split("/"):
        raise Refused(f"{path} leaves the folder it may use")
    have, rest = full, []
    while not os.path.lexists(have) and have != "/":
        have, last = os.path.split(have)
        rest.insert(0, last)
    full = os.path.join(os.path.realpath(have), *rest)
    if root is not None and os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise Refused(f"{path} leaves the folder it may use")
    return full


def check_args(args: dict[str, Any], root: str | None) -> dict[str, Any]:
    """Arguments with every path resolved inside the folder."""
    out = dict(args)
    for name in PATHS:
        if name in out:
            v = out[name]
            out[name] = [resolve(x, root) for x in v] if isinstance(v, list) else resolve(v, root)
    return out


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows as JSON values; binary columns as their size."""
    plain = [F.octet_length(c).alias(c + "_bytes") if t == "binary" else F.col(c) for c, t in df.dtypes]
    return [json.loads(x) for x in df.select(*plain).toJSON().collect()]


def call(spark: SparkSession, tool: str, args: dict[str, Any], *, root: str | None = None) -> dict[str, Any]:
    """A command by either of its names; ``input`` is a file or folder, ``output`` or ``out_dir`` where results go.

    The rows of one call are collected, so it is meant for the files of one request; a corpus takes the commands.
    """
    known = {public_name(n): n for n in commands.COMMANDS} | {n: n for n in commands.COMMANDS}
    if tool not in known:
        raise Refused(f"unknown tool {tool}")
    f = commands.COMMANDS[known[tool]]
    args = check_args(args, root)
    names = [p.name for p in python.signature(f).parameters.values()]
    free = any(p.kind is p.VAR_KEYWORD for p in python.signature(f).parameters.values())
    given = {("with_" if k == "with" else k): v for k, v in args.items() if k not in ("input", "inputs", "output", "out_dir", "password", "dry_run")}
    if names[:1] == ["sources"]:
        given.pop("markdown", None)
    if unknown := [k for k in given if k not in names and not free]:
        raise Refused(f"unknown argument {unknown[0]}")
    for k in ("cert", "key", "trust"):
        if isinstance(given.get(k), str):
            with open(given[k], "rb") as source:
                given[k] = source.read()
    source = _sources(spark, f, args)
    found = f(source, **given) if source is not None else f(**given)
    if "content" not in found.columns:
        rows = _rows(found)
        return {"rows": rows, "repaired_inputs": _repaired(source)}
    found = found.persist()
    try:
        rows = _rows(found)
        if errors := [r["error"] for r in rows if r.get("error")]:
            raise Refused(errors[0])
        return {"rows": rows, "files": _written(found, args), "repaired_inputs": _repaired(source)}
    finally:
        found.unpersist()


def _sources(spark: SparkSession, f: Any, args: dict[str, Any]) -> DataFrame | None:
    first = next(iter(python.signature(f).parameters), None)
    if first == "sources":
        if ("input" in args) == ("markdown" in args):
            raise Refused("give either a Markdown file or markdown text")
        if "input" in args:
            read = spark.read.text(args["input"], wholetext=True)
            return read.select(F.lit("result.pdf").alias("doc_id"), F.col("value").alias("markdown"))
        return spark.createDataFrame([("result.pdf", args.pop("markdown"))], "doc_id string, markdown string")
    if first != "files":
        return None
    from .sources.files import read_files

    inputs = args.get("inputs") or [args["input"]]
    out = None
    for k, path in enumerate(inputs):
        if not os.path.exists(path):
            raise Refused(f"cannot read {path}")
        one = read_files(spark, "file://" + path, glob="*").withColumns(
            {"password": F.lit(args.get("password")).cast("string"), "merge_id": F.lit("result.pdf"), "pos": F.lit(k + 1)}
        )
        out = one if out is None else out.unionByName(one)
    return out


def _repaired(source: DataFrame | None) -> list[str]:
    """Inputs that had to be rebuilt before they could be read."""
    if source is None or "content" not in source.columns:
        return []
    found = commands.info(source).where("repaired").select("doc_id").collect()
    return [r.doc_id for r in found]


def _written(found: DataFrame, args: dict[str, Any]) -> list[dict[str, Any]]:
    target = args.get("output") or args.get("out_dir")
    if target is None:
        return []
    folder, single = (os.path.split(target)[0], os.path.basename(target)) if "output" in args else (target, None)
    name = F.lit(single) if single else F.col("file") if "file" in found.columns else F.substring_index("doc_id", "/", -1)
    rows = found.where("content is not null").select(name.alias("doc_id"), "content")
    return [r.asDict() for r in commands.save(rows, "file://" + folder, dry_run=bool(args.get("dry_run"))).collect()]


def handle(spark: SparkSession, line: str, *, root: str | None = None) -> str | None:
    """The answer to one JSON-RPC message; none to a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return _error(None, PARSE_ERROR, "not JSON")
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return _error(None, BAD_REQUEST, "not a request")
    ident, method, params = request.get("id"), request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return _result(ident, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "papyra", "version": "1"}})
    if method == "ping":
        return _result(ident, {})
    if method == "tools/list":
        return _result(ident, {"tools": definitions()})
    if method != "tools/call":
        return _error(ident, NO_METHOD, f"unknown method {method}")
    if not isinstance(params.get("name"), str):
        return _error(ident, BAD_ARGUMENTS, "no tool is named")
    try:
        found, bad = json.dumps(call(spark, params["name"], params.get("arguments") or {}, root=root), ensure_ascii=False, default=str), False
    except (ValueError, TypeError, KeyError) as problem:
        found, bad = json.dumps({"error": str(problem)}, ensure_ascii=False), True
    return _result(ident, {"content": [{"type": "text", "text": found}], "isError": bad})


def serve(spark: SparkSession, lines: Iterable[str], write: Callable[[str], None], *, root: str | None = None) -> None:
    """Answer messages, one a line, until there are no more."""
    for line in lines:
        if line.strip() and (answer := handle(spark, line, root=root)) is not None:
            write(answer + "\n")


def _result(ident: Any, result: dict[str, Any]) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": ident, "result": result}, ensure_ascii=False)


def _error(ident: Any, code: int, message: str) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}, ensure_ascii=False)
