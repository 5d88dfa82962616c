"""Settings, endpoint guard, message contracts, HTTP client against a local server, command line."""

from __future__ import annotations

import http.server
import json
import threading
from pathlib import Path

import pytest

from skillweave.__main__ import DEMO, DEMO_SCHEMA, index_purposes, show_prompts
from skillweave.plans import prompts
from skillweave.plans.config import Settings, model_url, read_settings
from skillweave.plans.materialize import materialize, release, scratch, shared_dir
from skillweave.plans.models import HttpClient, ScriptedClient, check_endpoint


def settings(**more):
    return Settings(**{"model": {"base_url": "u", "model": "m"}} | more)


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("SOME_URL", "http://127.0.0.1:1")
    assert model_url(settings(model={"base_url": "env:SOME_URL", "model": "m"}).model) == "http://127.0.0.1:1"
    for bad in ("env:", "env:NOT_SET_ANYWHERE"):
        with pytest.raises(ValueError):
            model_url(settings(model={"base_url": bad, "model": "m"}).model)
    for wrong, said in (
        ({"model": {"model": "m"}}, "model.base_url is required"),
        ({"scan": {"unknown": 1, "min_unit_lines": 0}}, "scan.unknown is unknown; scan.min_unit_lines must be at least 1"),
        ({"pipeline": {"min_selection_score": 1.1}}, r"pipeline.min_selection_score must be in \[0, 1\]"),
        ({"pipeline": {"concurrency": "4"}}, "pipeline.concurrency must be at least 1"),
    ):
        with pytest.raises(ValueError, match=said):
            settings(**wrong)
    own = settings(unknown=1, scan=None, pipeline={"min_selection_score": 0.5})
    assert own.output_dir == "runs" and own.to_dict()["scan"]["max_units_per_repo"] == 400
    own.pipeline.concurrency = 0
    with pytest.raises(ValueError):
        own.validate()
    for text in ("[]", '{"model": {"base_url": "u", "model": "m"}, "output_dir": "x"}'):
        (tmp_path / "c.json").write_text(text)
        if text == "[]":
            with pytest.raises(ValueError):
                read_settings(str(tmp_path / "c.json"))
    assert read_settings(str(tmp_path / "c.json")).output_dir == "x"


def test_package_exports():
    import skillweave

    assert skillweave.Settings is Settings and skillweave.HttpClient is HttpClient
    assert all(getattr(skillweave, name) for name in skillweave.__all__)
    with pytest.raises(AttributeError):
        skillweave.nothing  # noqa: B018


class _Session:
    """As much of a session as names a master and a folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda self: None, "setCheckpointDir": lambda self, x: None})()


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://somewhere:7077"))
    assert shared_dir(_Session("spark://somewhere:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(_Session("local[2]")).startswith("file://")


def test_tables_are_dropped(spark):
    one = materialize(spark.range(3))
    path = Path(one._skillweave_path.removeprefix("file:"))
    assert one.count() == 3 and path.exists()
    with scratch():
        two = Path(materialize(spark.range(3))._skillweave_path.removeprefix("file:"))
    assert path.exists() and not two.exists()
    release(one)
    assert not path.exists()


@pytest.mark.parametrize("url", ["ftp://localhost", "http://", "http://a:b@localhost", "http://8.8.8.8"])
def test_endpoint_guard_refuses(url):
    with pytest.raises(ValueError):
        check_endpoint(url)


def test_endpoint_guard_allows():
    check_endpoint("http://127.0.0.1:8000/v1")
    check_endpoint("https://8.8.8.8", allow_public=True)


def test_http_client():
    seen: list[dict] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if len(seen) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode())

        def log_message(self, *_: object) -> None:
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(settings(model={"base_url": f"http://127.0.0.1:{server.server_port}/v1/", "model": "m", "max_retries": 1}).model)
    assert client.endpoint.endswith("/v1/chat/completions")
    assert client.complete("extraction", "x", [{"role": "user", "content": "hi"}], True) == "hello"
    assert len(seen) == 2 and seen[1]["response_format"] == {"type": "json_object"} and seen[1]["max_tokens"] == 4096
    server.shutdown()


def test_scripted_client():
    client = ScriptedClient({"a": {"x": 1}, "b": lambda stage, data_id, messages: data_id})
    assert json.loads(client.complete("a", "1", [], True)) == {"x": 1} and client.complete("b", "1", [], False) == "1"
    with pytest.raises(KeyError):
        client.complete("c", "1", [], True)


SECRET = {c: f"SENTINEL_{c}" for c in ("repo_name", "relative_path", "code", "unit_type", "generated", "first_reason")}


@pytest.mark.parametrize(
    ("stage", "seen", "unseen"),
    [
        ("source_tagging", ["repo_name", "relative_path", "code", "unit_type"], ["generated", "first_reason"]),
        ("extraction", ["repo_name", "relative_path", "code", "unit_type"], ["generated", "first_reason"]),
        ("regeneration", ["unit_type"], ["repo_name", "relative_path", "code", "generated", "first_reason"]),
        ("equivalence", ["code", "generated"], ["repo_name", "relative_path", "unit_type", "first_reason"]),
        ("adjudication", ["code", "generated", "first_reason"], ["repo_name", "relative_path", "unit_type"]),
        ("feature_tagging", ["repo_name", "relative_path"], ["code", "generated", "unit_type", "first_reason"]),
    ],
)
def test_what_a_stage_sees(spark, stage, seen, unseen):
    chunk = {"chunk_index": 2, "chunk_count": 3, "parent_symbol": "PARENT"}
    one = spark.createDataFrame([DEMO | SECRET | {"parser_metadata": chunk}], DEMO_SCHEMA)
    messages = one.select(prompts.BUILDERS[stage]().alias("m")).first()["m"]
    assert [m.role for m in messages] == ["system", "user"]
    said = " ".join(m.content for m in messages)
    assert all(SECRET[c] in said for c in seen) and not any(SECRET[c] in said for c in unseen)
    assert ("chunk 2 of 3" in said) == (stage in ("extraction", "regeneration", "equivalence", "adjudication"))
    skill = '"workflow":["workflow"]' in said
    assert skill == (stage in ("regeneration", "adjudication", "feature_tagging"))
    assert ("Bounded retry" in said) == (stage in ("regeneration", "adjudication"))


def test_command_line(spark, tmp_path):
    assert len(show_prompts(spark, "extraction")) == 2
    (tmp_path / "in.jsonl").write_text(json.dumps({"data_id": "a", "skill": {"name": "load file", "summary": "x" * 90}}) + "\n" + json.dumps({"data_id": "b", "name": "trivial"}) + "\n")
    said = index_purposes(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.jsonl"))
    assert (said["purpose_cards"], said["edges"], said["dropped"]) == (1, 1, 1)
    assert json.loads((tmp_path / "out_dropped.jsonl").read_text())["reason"] == "boilerplate_or_trivial"


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"data_id": "a"}\n\n[1]\n{"data_id": "b"}\n')
    with pytest.raises(ValueError, match=r"in\.jsonl:3: not a JSON object"):
        index_purposes(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.jsonl"))
