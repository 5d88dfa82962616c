"""Repositories whose files lie in one directory: cut, read once, asked and written in bulk."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

import pyarrow as pa

from skillweave.plans.models import ScriptedClient
from skillweave.plans.stages import _ask
from skillweave.sources import jsonl, repositories
from skillweave.sources.repositories import RepositoryReader


def test_a_flat_directory_is_many_parts(tmp_path: Path, monkeypatch):
    monkeypatch.setattr(repositories, "SLICE", 20)
    (tmp_path / ".git").mkdir()
    (tmp_path / "below").mkdir()
    names = {f"f{i}é.py" for i in range(200)} | {"below/x.py"}
    for name in names:
        (tmp_path / name).write_text("x = 1\n")
    reader = RepositoryReader({"path": str(tmp_path)})
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert max(sizes) < 60
    assert Counter(r["relative_path"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == Counter(names)


def test_answers_leave_in_batches():
    rows = [{"data_id": str(i), "request": "r", "messages": [{"role": "user", "content": "x"}]} for i in range(1000)]

    def say(_: str, data_id: str, __: list) -> str:
        if data_id == "7":
            raise RuntimeError("down")
        return data_id

    out = list(_ask(iter([pa.RecordBatch.from_pylist(rows)]), ScriptedClient({"s": say}), "s", False, False))
    assert len(out) < 100
    said = [r for b in out for r in b.to_pylist()]
    assert [(r["data_id"], r["answer"], r["error"], r["messages"]) for r in said] == [
        (str(i), None if i == 7 else str(i), "down" if i == 7 else "", None) for i in range(1000)
    ]


def test_lines_are_written_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"é\u2028\n{i}", None if i % 2 else [float(i), None], (i % 3 == 0, None)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string, invariants array<double>, s struct<b: boolean, c: string>").repartition(7)
    expected = [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in jsonl.objects(df.orderBy("i"))]
    monkeypatch.setattr(jsonl, "objects", None)  # what the driver would read
    jsonl.write_lines(df, str(tmp_path / "out" / "x.jsonl"), ("i",))
    assert (tmp_path / "out" / "x.jsonl").read_text().split("\n") == [*expected, ""]
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["x.jsonl"]


def test_types_of_other_values_are_written_as_before(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-02 03:04:05.5' as t, map('a', 1) as m")
    jsonl.write_lines(df, str(tmp_path / "x.jsonl"))
    assert json.loads((tmp_path / "x.jsonl").read_text()) == {"t": "2024-01-02 03:04:05.500000", "m": {"a": 1}}


def test_files_are_read_once(spark, tmp_path):
    from skillweave.plans.config import Settings
    from skillweave.plans.pipeline import Pipeline

    (tmp_path / "a.py").write_text("def f(x):\n    if x:\n        return 1\n    return 2\n")
    (tmp_path / "short.py").write_text("x = 1\n")
    (tmp_path / "test_a.py").write_text("x = 1\n")
    units, skipped = Pipeline(spark, Settings(model={"base_url": "none", "model": "none"}), ScriptedClient({})).scan(str(tmp_path))
    for name in ("a.py", "short.py", "test_a.py"):
        (tmp_path / name).unlink()
    assert [r.symbol for r in units.collect()] == ["f"]
    assert {(r.path, r.reason) for r in skipped.collect()} == {("short.py", "no_reusable_sized_unit"), ("test_a.py", "test_file")}
