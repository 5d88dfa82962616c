"""One file to many units: functions and methods, whole files where there are none, chunks of what is too long."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.guards import ENTRYPOINT_NAMES, language, unit_id

METADATA = {
    "class_name": "string", "is_async": "boolean", "parameters": "int", "branches": "int", "raises": "int", "calls": "int",
    "fallback": "boolean", "chunked_from": "string", "parent_symbol": "string", "chunk_index": "int", "chunk_count": "int",
}
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
_META = pa.struct([(k, _TYPES[v]) for k, v in METADATA.items()])
_UNIT = pa.schema(
    [(c, pa.string()) for c in ("repo_name", "repo_path", "relative_path", "symbol", "unit_type")]
    + [("line_start", pa.int32()), ("line_end", pa.int32()), ("interface", pa.string()), ("code", pa.string())]
    + [("parser_metadata", _META), ("parsed", pa.bool_()), ("reason", pa.string())]
)
_SCHEMA = (
    "repo_name string, repo_path string, relative_path string, symbol string, unit_type string, line_start int, line_end int, "
    "interface string, code string, parser_metadata struct<" + ", ".join(f"{k}: {v}" for k, v in METADATA.items()) + ">, parsed boolean, reason string"
)

# The signatures that begin a unit in languages with braces, and what their bodies are counted by.
SIGNATURES = [
    re.compile(r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{"),
    re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\([^)]*\)[^{]*\{"),
    re.compile(r"\bfn\s+([A-Za-z_]\w*)\s*\([^)]*\)[^{]*\{"),
    re.compile(
        r"(?m)^[ \t]*(?:public|private|protected|static|final|async|export|inline|virtual|const|\s)+"
        r"[A-Za-z_$][\w$:<>,\[\]?*&. ]*\s+([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^\{]+)?\{"
    ),
]
BRANCH_WORDS = re.compile(r"\b(?:if|for|while|switch|match|try|catch)\b")
CALLS = re.compile(r"\b[A-Za-z_$][\w$]*\s*\(")

_COUNTED = dict.fromkeys((ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.Match), 0) | {ast.Raise: 1, ast.Call: 2}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: comments and quoted texts as wholes, also where they do not end, and braces
_STEP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|([\"'`])(?:\\.|(?!\1)[^\\])*(?:\1|\\?\Z)|[{}]", re.S)


def _python_units(text: str, least: int) -> Iterator[dict]:
    """Functions in breadth-first order, each with the nearest class around it."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = text.splitlines()
    # each function with its class, the function around it (an index) and its counts of branches, raises and calls
    found: list[tuple[ast.AST, str, int, list[int]]] = []
    queue: list[tuple[ast.AST, str, int]] = [(tree, "", -1)]
    for node, owner, around in queue:
        kind = type(node)
        if kind is ast.ClassDef:
            owner = node.name
        elif kind in _FUNCTIONS:
            found.append((node, owner, around, [0, 0, 0]))
            around = len(found) - 1
        elif kind in _COUNTED:
            at = around
            while at >= 0:
                found[at][3][_COUNTED[kind]] += 1
                at = found[at][2]
        for name in node._fields:
            value = getattr(node, name, None)
            if type(value) is list:
                queue.extend([(x, owner, around) for x in value if isinstance(x, ast.AST)])
            elif isinstance(value, ast.AST) and value._fields:
                queue.append((value, owner, around))
    for node, owner, _, (branches, raises, calls) in found:
        if node.end_lineno - node.lineno + 1 < least:
            continue
        a = node.args
        named = [x.arg for x in (*a.posonlyargs, *a.args)]
        shown = named + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs]
        shown += [f"**{a.kwarg.arg}"] if a.kwarg else []
        is_async = isinstance(node, ast.AsyncFunctionDef)
        yield {
            "symbol": f"{owner}.{node.name}" if owner else node.name,
            "unit_type": "method" if owner else "function",
            "line_start": node.lineno,
            "line_end": node.end_lineno,
            "interface": f"{'async ' * is_async}{node.name}({', '.join(shown)})",
            "code": "\n".join(lines[node.lineno - 1 : node.end_lineno]),
            "parser_metadata": {
                "class_name": owner, "is_async": is_async, "parameters": len(a.args) + len(a.kwonlyargs),
                "branches": branches, "raises": raises, "calls": calls,
            },
        }


def closing_brace(text: str, opening: int) -> int:
    """Index of the brace that closes the one at ``opening``, or -1; comments and quoted texts don't count."""
    depth = 0
    for step in _STEP.finditer(text, opening):
        depth += {"{": 1, "}": -1}.get(step[0], 0)
        if depth == 0:
            return step.start()
    return -1


def _brace_units(text: str, least: int) -> Iterator[dict]:
    found = {(m.start(), text.index("{", m.start()), m[1]) for signature in SIGNATURES for m in signature.finditer(text)}
    done: set[tuple[int, str]] = set()
    for start, opening, name in sorted(found):
        if (start, name) in done:
            continue
        done.add((start, name))
        end = closing_brace(text, opening)
        first, last = (text.count("\n", 0, i) + 1 for i in (start, end))
        if end < 0 or last - first + 1 < least:
            continue
        code = text[start : end + 1].strip()
        yield {
            "symbol": name, "unit_type": "function", "line_start": first, "line_end": last,
            "interface": code[: code.index("{")].strip().replace("\n", " "), "code": code,
            "parser_metadata": {"branches": len(BRANCH_WORDS.findall(code)), "calls": len(CALLS.findall(code))},
        }


def _chunks(unit: dict, most: int) -> Iterator[dict]:
    """The unit, or runs of its lines of at most so many bytes (a longer line is a run of its own)."""
    if len(unit["code"].encode("utf-8", "surrogatepass")) <= most:
        yield unit
        return
    lines = unit["code"].splitlines()
    cuts, room = [0], most
    for i, line in enumerate(lines):
        size = len(line.encode("utf-8", "surrogatepass")) + 1
        if size > room and i > cuts[-1]:
            cuts.append(i)
            room = most
        room -= size
    cuts.append(len(lines))
    total = len(cuts) - 1
    for n, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        place = {"chunked_from": unit["unit_type"], "parent_symbol": unit["symbol"], "chunk_index": n, "chunk_count": total}
        yield unit | {
            "symbol": f"{unit['symbol']}::chunk_{n}_of_{total}",
            "unit_type": f"{unit['unit_type']}_chunk",
            "line_start": unit["line_start"] + a,
            "line_end": unit["line_start"] + b - 1,
            "interface": f"{unit['interface']} [chunk {n}/{total}]",
            "code": "\n".join(lines[a:b]),
            "parser_metadata": unit["parser_metadata"] | place,
        }


def units_of(path: str, text: str, least: int = 3, most: int = 12_000) -> Iterator[dict]:
    """All units of one file."""
    name = PurePosixPath(path)
    own = list((_python_units if name.suffix.lower() == ".py" else _brace_units)(text, least))
    if not own and len(text.strip().splitlines()) >= least:
        starts = name.name.lower() in ENTRYPOINT_NAMES or '__name__ == "__main__"' in text or "public static void main" in text
        own = [
            {
                "symbol": name.stem, "unit_type": "command_entrypoint" if starts else "file", "line_start": 1,
                "line_end": max(1, len(text.splitlines())), "interface": "file scope", "code": text,
                "parser_metadata": {"fallback": True},
            }
        ]
    for unit in own:
        yield from _chunks(unit, most)


def _parse(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for repo, root, path, text, skipped in zip(*(c.to_pylist() for c in batch.columns)):
            file = {"repo_name": repo, "repo_path": root, "relative_path": path}
            own = [] if skipped else [file | u | {"parsed": True} for u in units_of(path, text, least, most)]
            # a file without units leaves one row that says so
            rows.extend(own or [file | {"parsed": False, "reason": skipped or "no_reusable_sized_unit"}])
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, _UNIT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _UNIT)


def parse_outcomes(files: DataFrame, min_unit_lines: int = 3, max_unit_bytes: int = 12_000) -> DataFrame:
    """files: repo_name, repo_path, relative_path, content and, where files may be skipped, skip_reason. Units with
    parsed = true, and one row with parsed = false and the reason for each file without any. A null content has no units."""
    skipped = F.col("skip_reason") if "skip_reason" in files.columns else F.lit(None).cast("string")
    content = F.when(skipped.isNull(), F.coalesce("content", F.lit(""))).alias("content")
    own = files.select("repo_name", "repo_path", "relative_path", content, skipped.alias("skip_reason"))
    return own.mapInArrow(lambda it: _parse(it, min_unit_lines, max_unit_bytes), _SCHEMA)


UNIT_COLUMNS = (
    "data_id repo_name repo_path relative_path language symbol unit_type line_start line_end interface code parser_metadata"
).split()


def source_units(outcomes: DataFrame) -> DataFrame:
    """The units among the outcomes, with their ids and languages."""
    seed = [F.col(c) for c in ("repo_name", "relative_path", "symbol", "line_start", "line_end", "code")]
    units = outcomes.where("parsed").withColumn("data_id", unit_id(*seed))
    return units.withColumn("language", language(F.col("relative_path"))).select(*UNIT_COLUMNS)


def parse_files(files: DataFrame, min_unit_lines: int = 3, max_unit_bytes: int = 12_000) -> DataFrame:
    return source_units(parse_outcomes(files, min_unit_lines, max_unit_bytes))
