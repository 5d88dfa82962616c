"""Normalisers, guards and purpose inference against plain expectations."""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skillweave import queries
from skillweave.functions import normalize as N
from skillweave.functions import text as T
from skillweave.operators import purpose_index, selection
from skillweave.operators.ranking import within_top


def of(spark, value: object, make) -> object:  # noqa: ANN001
    df = spark.createDataFrame([(json.dumps({"x": value}),)], "j string")
    return df.select(make(N.field(F.try_parse_json("j"), "x")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [(True, True), ("false", False), (" TRUE ", True), ("unknown", False), ("1", True), ("2", False), (2, True), (0, False), (0.5, True), (None, False), ([1], False), ({}, False)],
)
def test_as_bool(spark, value, want):
    assert of(spark, value, N.as_bool) is want


@pytest.mark.parametrize(
    ("value", "want"),
    [(0.9, 0.9), ("0.9", 0.9), (" 1e-1 ", 0.1), ("0_9", 1.0), ("1d", 0.0), (True, 1.0), (None, 0.0), ([1], 0.0), (-1, 0.0), (2, 1.0), ("nan", 0.0), ("inf", 1.0), ("", 0.0)],
)
def test_score(spark, value, want):
    assert of(spark, value, N.score) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("a \u00a0b\x1cc", ["a b c"]), (["x", "x ", "", None, "y"], ["x", "y"]), (5, []), (["a b c d", "a b c e", "z"], ["a b c", "z"]), ([True, 2], ["True", "2"]), ({}, [])],
)
def test_string_list(spark, value, want):
    assert of(spark, value, lambda v: N.string_list(v, 8, 3)) == want


def test_closed_vocabulary(spark):
    assert of(spark, "State Transition", lambda v: N.closed(v, ["state_transition"], "workflow")) == "state_transition"
    assert of(spark, "unknown", lambda v: N.closed(v, ["io"], "workflow")) == "workflow"
    junk = [f"j{i}" for i in range(4)] + ["io"]
    assert of(spark, junk, lambda v: N.closed_list(v, ["io"], 2)) == []
    assert of(spark, junk[1:], lambda v: N.closed_list(v, ["io"], 2)) == ["io"]


def test_features_fingerprint(spark):
    payload = {"transfer_title": "Ü \x1b title", "task_family": "no such", "interaction_pattern": 5, "capability_tags": "fail fast"}
    row = spark.createDataFrame([(json.dumps(payload),)], "j string").select(N.features(F.try_parse_json("j")).alias("f")).first()["f"]
    own = row.asDict() | {"canonical_fingerprint": ""}
    raw = json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert row.canonical_fingerprint == hashlib.sha256(raw.encode()).hexdigest()
    assert (row.task_family, row.interaction_pattern, row.capability_tags) == ("workflow", "single_step", ["fail_fast"])


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('so: {"a": 1} //c', {"a": 1}), ('{"a":1,"a":2}', {"a": 2}), ('{"a":1}}', None), ('{"a":1} {"b":2}', None), ("[1]", None), ("", None), ("x", None)],
)
def test_recover_object(text, want):
    if want is None:
        with pytest.raises(ValueError):
            N.recover_object(text)
    else:
        assert N.recover_object(text) == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \t\n\r\x0b\x0c\x1c\x1f\x85\u00a0\u2003\u2028\u3000é`"), max_size=12), min_size=60, max_size=120))
def test_text_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.bounded(F.col("t"), 3), T.strip(F.col("t")), T.line_count(F.col("t"))).collect()
    for t, words, stripped, lines in rows:
        assert words == " ".join(t.split()[:3]) and stripped == t.strip() and lines == len(t.splitlines())


def test_code_fence(spark):
    cases = {"```py\nx\n```": "x", "  ```\n x \n```\n": "x", "a ```x```": "a ```x```", "```x": "```x", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", T.code_fence_stripped(F.col("t")).alias("s")).collect()} == cases


def test_fences_of_all_documents(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    parts = ["```", "```py\n", "\n```", "x", " ", "\n", "\u2003"]
    texts = [None, "", *("".join(x) for n in range(1, 5) for x in itertools.product(parts, repeat=n))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def inside(text: str | None) -> str | None:
        if text is None:
            return None
        m = re.fullmatch(r"```(?:[A-Za-z0-9_+.-]+)?\s*\n?(.*?)\n?```", text.strip(), re.S)
        return m[1].strip() if m else text.strip()

    want = {(i, inside(t), inside(None if t is None else f"\n```python\n{t}\n```  ")) for i, t in enumerate(texts)}
    assert {tuple(r) for r in queries.QUERIES["strip_fence"](spark, str(tmp_path)).collect()} == want
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(db.execute(queries.SQL["strip_fence"]).fetchall()) == want


def record(**more: object) -> dict:
    own = {"data_id": "a", "repo_name": "r", "symbol": "f", "level": "atomic", "name": "", "summary": "s" * 80, "when_to_use": ""}
    return own | {c: [] for c in purpose_index.LISTS} | more


def frame(spark, rows: list[dict]):
    kinds = ", ".join(["data_id string, repo_name string, symbol string"] + [f"{c} string" for c in ("level", "name", "summary", "when_to_use")] + [f"{c} array<string>" for c in purpose_index.LISTS])
    return spark.createDataFrame(rows, kinds)


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({"name": "a Getter"}, "boilerplate_or_trivial"), ({"summary": "trivial"}, "boilerplate_or_trivial"), ({"name": "logging only"}, "boilerplate_or_trivial"),
        ({"symbol": "getName"}, "getter_setter_like"), ({"symbol": "A.getName"}, ""), ({"symbol": "getName", "workflow": ["a", "b"]}, ""),
        ({"summary": "short"}, "too_little_reusable_logic"), ({"summary": "short", "invariants": ["x"]}, ""), ({"symbol": "__repr__"}, "representation_only"), ({}, ""),
    ],
)
def test_low_value(spark, more, want):
    assert purpose_index.infer(frame(spark, [record(**more)])).first()["reason"] == want


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({"symbol": "x", "summary": ""}, ("workflow", "execute", "object")),
        ({"name": "parses the json input file twice"}, ("parsing", "parse", "json_file")),
        ({"name": "widget sorter runs"}, ("orchestration", "run", "s" * 80)),
        ({"name": "retry widget widget"}, ("recovery", "retry", "widget_widget")),
        ({"name": "parseJson retry"}, ("parsing", "parse", "json_" + "s" * 80)),
        ({"name": "load parse"}, ("parsing", "load", "s" * 80)),
    ],
)
def test_infer_purpose(spark, more, want):
    row = purpose_index.infer(frame(spark, [record(**more)])).first()
    assert (row.task_family, row.intent_action, row.intent_target) == want
    key = json.dumps(dict(zip(("task_family", "intent_action", "intent_target"), want)), sort_keys=True, separators=(",", ":"))
    assert row.purpose_id == hashlib.sha1(key.encode()).hexdigest()[:20]


def test_cards(spark):
    rows = [
        record(data_id="short", name="validate widget schema", workflow=["one"]), record(data_id="rich", repo_name="q", level="composite", name="validate widget schema", workflow=["1", " ", "2"]),
        record(data_id="rich", repo_name="q", level="", name="validate widget schema"), record(data_id="out", summary="x"),
    ]
    inferred = purpose_index.infer(frame(spark, rows))
    card = purpose_index.cards(inferred).collect()
    assert len(card) == 1 and purpose_index.edges(inferred).count() == 3 and purpose_index.dropped(inferred).count() == 1
    c = card[0]
    assert (c.representative_data_id, c.support_count, c.repo_support, c.workflow) == ("rich", 3, 2, ["1", "2"])
    assert c.level_counts == {"atomic": 1, "composite": 1, "unknown": 1}
    assert purpose_index.cards(purpose_index.infer(frame(spark, []))).count() == 0


def test_nested_and_flat_records(spark):
    lines = [{"data_id": "a", "symbol": "f", "skill": {"name": "load file", "summary": "x" * 90, "workflow": "one"}, "name": "ignored"}, {"data_id": "b", "name": "load file", "summary": "x" * 90, "workflow": ["one", None, 2]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "j string").select(F.try_parse_json("j").alias("p"))
    rows = {r.data_id: r for r in purpose_index.infer(purpose_index.records_of(df, "p")).collect()}
    assert rows["a"].purpose_id and rows["a"].intent_action == rows["b"].intent_action == "load"
    assert rows["a"].workflow == ["one"] and rows["b"].workflow == ["one", None, "2"]


def test_gate_is_plain_addition(spark):
    scores = [0.67, 0.37, 0.42, 0.17, 0.55, 0.82]
    df = spark.createDataFrame([tuple(scores)], ", ".join(f"s{i} double" for i in range(6)))
    mean = df.select(selection.mean_score([F.col(f"s{i}") for i in range(6)])).first()[0]
    total = 0.0
    for s in scores:
        total += s
    assert mean == total / 6


def test_top_k_flags_both_sides(spark):
    rows = [("hot", f"{i:03}", float(i % 3)) for i in range(100)] + [("cold", "x", 1.0), (None, "y", 1.0)]
    df = spark.createDataFrame(rows, "repo_path string, data_id string, mean double")
    got = {(r.repo_path, r.data_id) for r in selection.repository_cap(df, k=7).where("selected").collect()}
    best = sorted((-m, i) for g, i, m in rows if g == "hot")[:7]
    assert got == {("hot", i) for _, i in best} | {("cold", "x"), (None, "y")}
    assert within_top(df, "repo_path", "data_id", [F.col("data_id")], 3).count() == 102


def test_records_of_nulls(spark):
    df = spark.createDataFrame([(None, None, [None, " ", "a b"])], "symbol string, name string, inputs array<string>")
    own = purpose_index.infer(df).first()
    assert (own["reason"], own["intent_action"], own["intent_target"]) == ("too_little_reusable_logic", "execute", "none")
    assert own["io_shape"] == "none->unspecified" and own["score"] == 0.0
