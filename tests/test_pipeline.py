"""The whole run with scripted answers: terminal paths, gates, failures, resumption, artifacts."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from skillweave.plans.config import Settings
from skillweave.plans.models import ScriptedClient
from skillweave.plans.pipeline import Pipeline

SOURCE = "def transform(value):\n    if value < 0:\n        raise ValueError('negative')\n    return value * 2\n"
SCORES = "reusable_intent procedural_steps boundary_conditions transferability interface_sufficiency non_triviality".split()
TAG = {"keep_for_extraction": True, "selection_rationale": "a guarded flow", **{f"{s}_score": 0.9 for s in SCORES}}
SKILL = {
    "level": "composite", "name": "Validate positive values", "worth_extracting": True, "skill_value_score": 0.9,
    "summary": "Validate an input before transforming it, keep the interface and raise an explicit error for invalid values.",
    "inputs": ["Numeric input"], "workflow": ["Validate the value", "Transform it"], "invariants": ["Reject negatives"], "error_cases": ["Negative"],
}
FEATURES = {"transfer_title": "Validate input first", "task_family": "validation", "capability_tags": ["validate-input", "junk"]}


def answers(**more: object) -> dict:
    own = {
        "source_tagging": TAG, "extraction": SKILL, "regeneration": "```python\n" + SOURCE + "```",
        "equivalence": {"equivalent": True, "confidence": 0.0, "reason": "match", "risk_level": "high"},
        "adjudication": {"keep": False, "reason": "unfaithful"}, "feature_tagging": FEATURES,
    }
    return own | more


@pytest.fixture
def repo(tmp_path: Path) -> Path:
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "logic.py").write_text(SOURCE)
    return tmp_path


def run(spark, repo: Path, settings: dict | None = None, **more: object) -> tuple[dict, list[dict], Path]:
    out = repo / "run"
    pipeline = Pipeline(spark, Settings(model={"base_url": "offline", "model": "offline"}, pipeline=settings or {}), ScriptedClient(answers(**more)))
    manifest = pipeline.run(str(repo / "repo"), f"file://{out}" if settings else str(out), export=True)
    lines = (out / "accepted_records.jsonl").read_text().splitlines()
    return manifest, [json.loads(x) for x in lines], out


def decisions(out: Path) -> list[dict]:
    return [json.loads(x) for x in (out / "decisions.jsonl").read_text().splitlines()]


def test_direct_accept(spark, repo):
    manifest, accepted, out = run(spark, repo)
    assert manifest["summary"] == {
        "repositories": 1, "source_units": 1, "selected_units": 1, "accepted_records": 1, "rejected_records": 0,
        "retrieval_records": 1, "purpose_cards": 1, "purpose_dropped": 0, "scan_skipped": 0,
    }
    record = accepted[0]
    assert record["accepted_stage"] == "equivalence" and record["adjudication"] is None
    assert record["reconstruction"]["code"] == SOURCE.strip() and record["reconstruction"]["output_valid"]
    assert record["retrieval"]["capability_tags"] == ["validate_input"]
    assert not (out / "traces" / record["data_id"] / "adjudication.json").exists()
    assert json.loads((out / "purpose_index.jsonl").read_text())["purpose_key"]["task_family"] == "validation"


def test_adjudicated_accept_shows_no_failed_code(spark, repo):
    doubt = {"equivalent": False, "reason": "mismatch"}
    _, accepted, _ = run(spark, repo, equivalence=doubt, adjudication={"keep": True, "reason": "skill holds"})
    assert accepted[0]["accepted_stage"] == "adjudication" and accepted[0]["adjudication"]["keep"]
    assert "reconstruction" not in accepted[0]


def _down(*_: object) -> str:
    raise RuntimeError("down")


#: function name -> stage, its answer there, decision stage, rationale
EARLY = {
    "no_tag": ("source_tagging", "no JSON", "source_tagging", "tagging_error"),
    "unsure": ("source_tagging", TAG | {"keep_for_extraction": "unknown"}, "source_tagging", "source_unit_selection_gate"),
    "low": ("source_tagging", TAG | {f"{s}_score": 0.49 for s in SCORES}, "source_tagging", "source_unit_selection_gate"),
    "weak": ("extraction", SKILL | {"skill_value_score": 0.44}, "extraction", "skill_value_gate"),
    "no_skill": ("extraction", "[1]", "error", "pipeline_error"),
    "no_code": ("regeneration", _down, "error", "pipeline_error"),
    "no_judge": ("equivalence", "{", "error", "pipeline_error"),
    "edge": ("source_tagging", TAG | {f"{s}_score": 0.5 for s in SCORES}, "equivalence", "match"),
    "rejected": ("equivalence", {"equivalent": False}, "adjudication", "unfaithful"),
    "broken": ("regeneration", "def broken(:", "equivalence", "match"),
    "plain": ("feature_tagging", "no JSON", "equivalence", "match"),
}


def by_name(stage: str):
    def answer(_: str, __: str, messages: list[dict]) -> object:
        said = messages[1]["content"]
        own = next((v for k, v in EARLY.items() if f"Symbol: {k}\n" in said or f'"symbol":"{k}"' in said), None)
        if own and own[0] == stage:
            return own[1]() if callable(own[1]) else own[1]
        return answers()[stage]

    return answer


def test_every_way_to_end(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    for name in EARLY:
        (tmp_path / "repo" / f"{name}.py").write_text(SOURCE.replace("transform", name))
    manifest, accepted, out = run(spark, tmp_path, **{s: by_name(s) for s in answers()})
    own = {d["symbol"]: d for d in decisions(out)}
    assert {k: (d["decision_stage"], d["rationale"]) for k, d in own.items()} == {k: v[2:] for k, v in EARLY.items()}
    assert {a["symbol"] for a in accepted} == {"edge", "broken", "plain"}
    summary = manifest["summary"]
    assert summary["source_units"] == len(EARLY) == summary["accepted_records"] + summary["rejected_records"]
    assert summary["retrieval_records"] == 2
    for k, d in own.items():
        assert d["accepted_stage"] == (d["decision_stage"] if d["accepted"] else "")
        if d["rationale"].endswith("_error"):
            assert d["error"] and d["skill"] is None
    shown = {a["symbol"]: a for a in accepted}
    assert not shown["broken"]["reconstruction"]["output_valid"]
    assert shown["broken"]["reconstruction"]["validation_notes"][0].startswith("python_parse_error:")
    assert "retrieval" not in shown["plain"] and own["plain"]["error"].startswith("feature_tagging_error:")
    assert not list((out / "traces" / own["rejected"]["data_id"]).glob("feature_tagging.json"))


def test_second_run_asks_only_what_failed(spark, repo):
    _, accepted, out = run(spark, repo, feature_tagging="no JSON")
    assert accepted

    def never(*_: object) -> str:
        raise AssertionError("asked again")

    # all answers but the last are on disk; an unreadable answer is an answer
    manifest, accepted, _ = run(spark, repo, source_tagging=never, extraction=never, regeneration=never, equivalence=never)
    assert manifest["summary"]["accepted_records"] == 1


def test_a_uri_and_no_full_traces(spark, repo):
    manifest, accepted, out = run(spark, repo, {"store_full_traces": False})
    assert manifest["output_dir"] == f"file://{out}" and manifest["summary"]["accepted_records"] == 1 == len(accepted)
    assert not (out / "traces").exists()
    kept = spark.read.parquet(*[str(x) for x in (out / "tables" / "answers").iterdir()])
    assert kept.where("messages is not null or answer is null").count() == 0 < kept.count()
    assert not list(out.glob(".*.crc"))
