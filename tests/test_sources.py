"""Discovery, listing, guards, parsing and JSON lines on small trees."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from skillweave.operators.parsing import closing_brace, units_of
from skillweave.sources import jsonl
from skillweave.sources.repositories import discover, looks_binary, read_repositories

FUNCTION = "def work(x):\n    if x:\n        return 1\n    return 2\n"


def tree(root: Path, files: dict[str, str | bytes]) -> Path:
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def test_discovery(tmp_path):
    with pytest.raises(ValueError):
        discover(str(tmp_path / "none"))
    tree(tmp_path, {"b/.git/x": "", "a/.git/x": "", ".hidden/.git/x": "", "plain/x.py": ""})
    assert [x.name for x in discover(str(tmp_path))] == ["a", "b"]
    assert discover(str(tmp_path / "a")) == [tmp_path / "a"]
    assert discover(str(tmp_path / "plain")) == [tmp_path / "plain"]


def test_guards_in_order(spark, tmp_path):
    key = "AKIA" + "A1B2" * 4
    root = tree(
        tmp_path / "r",
        {
            "__init__.py": FUNCTION, "_priv/b.py": FUNCTION, ".hidden.py": FUNCTION, ".dir/x.py": FUNCTION, "vendor/x.py": FUNCTION,
            "x.txt": "no", "test_a.py": FUNCTION, "tests/b.py": FUNCTION, "big.py": "x" * 101, "edge.py": "x" * 100, "nul.py": b"a\0b",
            "odd.py": b"\x01" * 3 + b"a" * 7, "key.py": f"k = '{key}'\n", "test_key.py": key, "a_test.go": FUNCTION,
        },
    )
    (root / "out.py").symlink_to("/etc/hostname")
    (root / "lost.py").symlink_to(root / "nowhere.py")
    rows = {r.relative_path: r.skip_reason for r in read_repositories(spark, str(root), max_file_bytes=100).collect()}
    assert rows == {
        "__init__.py": None, "_priv/b.py": None, "test_a.py": "test_file", "tests/b.py": "test_file", "big.py": "file_too_large",
        "edge.py": None, "nul.py": "binary_file", "odd.py": "binary_file", "key.py": "secret_marker:aws_access_key",
        "test_key.py": "test_file", "a_test.go": None, "out.py": "path_escape", "lost.py": "unreadable",
    }


def test_binary_boundary():
    assert not looks_binary(b"") and looks_binary(b"a" * 5000 + b"\0")
    assert not looks_binary(b"\x01" * 2 + b"a" * 8) and looks_binary(b"\x01" * 21 + b"a" * 79)


def names(path: str, text: str, **more: int) -> list[tuple]:
    return [(u["symbol"], u["unit_type"], u["line_start"], u["line_end"]) for u in units_of(path, text, **more)]


def test_python_units():
    text = "class A:\n    @f(1)\n    def m(self):\n        def h():\n            x = 1\n            return x\n        return h\n\nasync def g(a, /, b, *c, d=1, **e):\n    for x in b:\n        raise x\n    return f(1)\ndef tiny(): pass\n"
    assert names("a.py", text) == [("g", "function", 9, 12), ("A.m", "method", 3, 7), ("A.h", "method", 4, 6)]
    g = next(units_of("a.py", text))
    assert g["interface"] == "async g(a, b, *c, d, **e)"
    assert g["parser_metadata"] == {"class_name": "", "is_async": True, "parameters": 2, "branches": 1, "raises": 1, "calls": 1}
    assert names("a.py", "﻿" + FUNCTION) == [("a", "file", 1, 4)]
    assert names("cli.py", "x = 1\ny = 2\nz = (\n") == [("cli", "command_entrypoint", 1, 3)]
    assert names("a.py", "x = 1\n") == []


def test_brace_units():
    js = "function plain(a) {\n  if (a) { return '}'; } // }\n  return `{`;\n}\nfunction bound({a, b}) {\n  return a;\n  }\n"
    assert names("a.js", js) == [("plain", "function", 1, 4)]
    go = "func (r *T) Name(x int) error {\n\treturn f(x)\n\t/* } */\n}\nfunc f(x interface{}) {\n\tg()\n\th()\n}\n"
    assert names("a.go", go) == [("Name", "function", 1, 4)]
    twice = "\nexport function foo() {\n  a();\n  b();\n}\n"
    assert [n[0] for n in names("a.js", twice)] == ["foo", "foo"]
    assert closing_brace("{ '{' ", 0) == -1 and closing_brace("{ a {} }", 0) == 7
    assert names("a.rs", "fn f(a: u8) -> u8 {\n  a\n  }\n") == [("f", "function", 1, 3)]


def test_chunks():
    text = "def f():\n" + "    x = 'é'\n" * 5
    size = len(text.rstrip("\n").encode())
    assert len(list(units_of("a.py", text, most=size))) == 1
    parts = list(units_of("a.py", text, most=30))
    assert [p["symbol"] for p in parts] == [f"f::chunk_{i}_of_3" for i in (1, 2, 3)]
    assert [(p["line_start"], p["line_end"]) for p in parts] == [(1, 2), (3, 4), (5, 6)]
    assert "\n".join(p["code"] for p in parts) == text.rstrip("\n")
    assert parts[0]["unit_type"] == "function_chunk" and parts[0]["parser_metadata"]["chunk_count"] == 3


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"b": [1]}\n')
    bad.write_text('{"a": 1}\n[1]\n')
    assert jsonl.read_lines(spark, str(good)).count() == 2
    with pytest.raises(Exception, match="bad.jsonl"):
        jsonl.read_lines(spark, str(bad)).collect()
    jsonl.write_lines(spark.range(3), str(tmp_path / "out.jsonl"), ("id",))
    assert [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()] == [{"id": i} for i in range(3)]
