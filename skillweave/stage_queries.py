"""Queries of the core operators whose input the tables don't hold as such: untrusted answers, messages, files, sinks.

Their input is put together from the tables' rows, one case per row, so that SQL can tell what must come out without
doing what the operator does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave import sql_words as W
from skillweave.functions import normalize
from skillweave.functions.vocab import SCORES, STAGES
from skillweave.operators import decisions, parsing, purpose_index
from skillweave.plans import prompts
from skillweave.plans.config import Settings
from skillweave.plans.materialize import materialize, shared_dir
from skillweave.plans.models import ScriptedClient, check_endpoint
from skillweave.plans.pipeline import Pipeline, check_output, summary_counters
from skillweave.plans.stages import Answers
from skillweave.queries import (
    _CLAMP, _DECISION, _HEX, _INFERRED, _MARKER, _NL, _SPACES, _TEST, Query, _bounded, _listed, inferred, purpose_records, scripted, table,
)
from skillweave.sources import jsonl
from skillweave.sources.repositories import read_repositories

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _of(payload: Column, normaliser) -> Column:  # noqa: ANN001
    return normalize.once(F.try_parse_json(payload), normaliser).alias("own")


def _pick(cases: list[str | Column], at: Column) -> Column:
    own = F.coalesce(*[F.when(at == i, F.lit(c) if isinstance(c, str) else c) for i, c in enumerate(cases)])
    return own


# ------------------------------------------------------------------ values of any JSON type

_BOOLS = ["true", "false", '"true"', '" YES "', '"1"', '"2"', '"unknown"', "2", "0", "0.0", "-0.5", "null", "[true]", None, None, None]


@query("select event_id, event_id % 16 in (0, 2, 3, 4, 7, 10) as said from events")
def as_bool_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, numbers, texts, a list, an object, a missing key."""
    events = table(spark, sf_dir, "events")
    cases = [c for c in _BOOLS if c] + [F.col("props"), F.to_json(F.array("event_type"))]
    value = _pick(cases, (F.col("event_id") % 16).cast("int"))
    payload = F.coalesce(F.concat(F.lit('{"v": '), value, F.lit("}")), F.lit("{}"))
    return events.select("event_id", normalize.as_bool(normalize.field(F.try_parse_json(payload), "v")).alias("said"))


_K = "lpad(cast(event_id % 1000 as varchar), 3, '0')"


@query(
    f"select event_id, case event_id % 14 when 0 then cast('0.' || {_K} as double) when 1 then cast('0.' || {_K} as double) when 2 then 0.1 when 4 then 1.0 "
    "when 8 then 1.0 when 9 then 1.0 when 11 then 1.0 when 12 then 0.5 else 0.0 end as score from events"
)
def score_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and texts that are numbers in Python's notation, and what is none."""
    k = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    cases = [
        F.concat(F.lit("0."), k), F.concat(F.lit('" 0.'), k, F.lit('\\n"')), '" 1e-1 "', '"1d"', "true", "null", "[0.5]", F.concat(F.lit("-1"), k),
        F.concat(F.lit("2"), k), '" Infinity"', '"NaN"', '"1_0"', '".5"', "false",
    ]
    payload = F.concat(F.lit('{"v": '), _pick(cases, (F.col("event_id") % 14).cast("int")), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", normalize.score(normalize.field(F.try_parse_json(payload), "v")).alias("score"))


def _joined(c: str, sep: str = "|") -> str:
    return f"array_to_string({c}, '{sep}')"


def _score_sql(c: str) -> str:
    return _CLAMP.format(c)


@query(
    "select distinct tag_id, coalesce(keep_for_extraction, false) as keep, "
    f"{_bounded('selection_rationale', 60)} as rationale, " + ", ".join(f"{_score_sql(s + '_score')} as {s}" for s in SCORES)
    + f", {_joined(_listed('selection_tags', 8))} as tags, {_joined(_listed('risk_tags', 8))} as risks from source_unit_tag"
)
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage's answers, bounded."""
    names = ["keep_for_extraction", "selection_rationale", *[f"{s}_score" for s in SCORES], "selection_tags", "risk_tags"]
    own = table(spark, sf_dir, "source_unit_tag").select("tag_id", _of(F.to_json(F.struct(*names)), normalize.source_tag))
    return own.select(
        "tag_id", F.col("own.keep_for_extraction").alias("keep"), F.col("own.selection_rationale").alias("rationale"),
        *[F.col(f"own.{s}_score").alias(s) for s in SCORES], F.array_join("own.selection_tags", "|").alias("tags"), F.array_join("own.risk_tags", "|").alias("risks"),
    ).distinct()


_LEVEL = "lower(split_part(map_keys(level_counts)[1], ' ', 1))"


@query(
    f"select distinct card_id, case when {_LEVEL} in ('atomic', 'composite', 'pattern') then {_LEVEL} else 'atomic' end as level, "
    f"{_bounded('transfer_title', 12)} as name, {_bounded('transfer_summary', 80)} as summary, coalesce(support_count, 0) != 0 as worth_extracting, "
    f"{_bounded('task_family', 60)} as worth_reason, {_score_sql('representative_score')} as skill_value_score, "
    "case when coalesce(support_count, 0) > 0 then 1.0 else 0.0 end as generality_score, 0.25 as abstraction_score, 1.0 as confidence, "
    + ", ".join(f"{_joined(_listed(c, 6))} as {c}" for c in purpose_index.CARD_LISTS)
    + f", {_joined(_listed('[intent_action]', 6))} as implementation_notes, '' as evidence, '' as anti_goals from purpose_index"
)
def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage's answers, made of cards: a number as a boolean, a text as a list, a number as a list."""
    payload = {
        "level": F.concat(F.upper(F.element_at(F.map_keys("level_counts"), 1)), F.lit(" level")), "name": F.col("transfer_title"),
        "summary": F.col("transfer_summary"), "worth_extracting": F.col("support_count"), "worth_reason": F.col("task_family"),
        "skill_value_score": F.col("representative_score"), "generality_score": F.col("support_count"), "abstraction_score": F.lit(" 0.25"),
        **{c: F.col(c) for c in purpose_index.CARD_LISTS}, "implementation_notes": F.col("intent_action"), "evidence": F.col("support_count"),
        "confidence": F.lit(True),
    }
    whole = F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()]))
    own = table(spark, sf_dir, "purpose_index").select("card_id", _of(whole, normalize.skill)).select("card_id", "own.*")
    return own.select("card_id", *[F.array_join(c, "|").alias(c) if c in normalize.SKILL_LISTS else c for c in own.columns[1:]]).distinct()


_SAID = "case length(coalesce(symbol, '')) % 3 when 0 then 'high' when 1 then 'low' else 'high' end"


@query(
    f"select distinct data_id, accepted as equivalent, 0.0 as confidence, {_bounded('rationale', 80)} as reason, "
    f"{_joined(_listed('[decision_stage, accepted_stage, decision_stage]', 8))} as differences, {_SAID} as risk_level from unit_decision"
)
def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth stage's answers: no confidence, differences twice, risks in words."""
    own = table(spark, sf_dir, "unit_decision")
    risk = F.get(F.array(*map(F.lit, ["High risk", " LOW", "unsure"])), F.length(F.coalesce("symbol", F.lit(""))) % 3)
    stages = F.array("decision_stage", "accepted_stage", "decision_stage")
    payload = F.to_json(F.struct(F.col("accepted").alias("equivalent"), F.col("rationale").alias("reason"), stages.alias("differences"), risk.alias("risk_level")))
    own = own.select("data_id", _of(payload, normalize.judgment)).select("data_id", "own.*")
    return own.withColumn("differences", F.array_join("differences", "|")).distinct()


@query(
    "select distinct data_id, coalesce(accepted, false) as keep, length(coalesce(symbol, '')) > 0 as skill_is_correct, false as generation_failed, "
    f"{_bounded('rationale', 80)} as reason, {_joined(_listed('[rationale]', 8))} as corrective_notes from unit_decision"
)
def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth stage's answers: a text as a boolean, a number as one, a missing one, a text as a list."""
    size = F.length(F.coalesce("symbol", F.lit("")))
    keep = F.concat(F.lit(" "), F.upper(F.col("accepted").cast("string")))
    payload = F.to_json(F.struct(keep.alias("keep"), size.alias("skill_is_correct"), F.col("rationale").alias("reason"), F.col("rationale").alias("corrective_notes")))
    own = table(spark, sf_dir, "unit_decision").select("data_id", _of(payload, normalize.adjudication)).select("data_id", "own.*")
    return own.withColumn("corrective_notes", F.array_join("corrective_notes", "|")).distinct()


# ------------------------------------------------------------------ messages

_META = {
    "class_name": "text", "is_async": "plain", "parameters": "plain", "branches": "plain", "raises": "plain", "calls": "plain", "fallback": "plain",
    "chunked_from": "text", "parent_symbol": "text", "chunk_index": "plain", "chunk_count": "plain",
}
_META_SQL = (
    "case when parser_metadata is null then '' else '{' || array_to_string(list_filter(["
    + ", ".join(
        f"""case when parser_metadata.{k} is not null then '"{k}":' || {f'to_json(parser_metadata.{k})' if v == 'text' else f'cast(parser_metadata.{k} as varchar)'} end"""
        for k, v in _META.items()
    )
    + "], lambda y: y is not null), ',') || '}' end"
)
_CHUNK_SQL = (
    "case when coalesce(parser_metadata.chunk_count, 0) > 0 then 'This is chunk ' || parser_metadata.chunk_index || ' of ' || parser_metadata.chunk_count || ' of ' "
    "|| parser_metadata.parent_symbol || '; state only what this chunk shows.' || chr(10) else '' end"
)


def _line_sql(name: str, c: str) -> str:
    return f"'{name}: ' || coalesce(cast({c} as varchar), '') || chr(10)"


def _block_sql(name: str, c: str) -> str:
    return f"chr(10) || '{name}:' || chr(10) || coalesce({c}, '') || chr(10)"


_LINES_SQL = "'Lines: ' || line_start || ' to ' || line_end || chr(10)"
_WHERE_SQL = [_line_sql("Repository", "repo_name"), _line_sql("Path", "relative_path")]
_LANG_SQL, _SYMBOL_SQL, _TYPE_SQL, _FACE_SQL = (
    _line_sql(a, b) for a, b in (("Language", "language"), ("Symbol", "symbol"), ("Unit type", "unit_type"), ("Interface", "interface"))
)
_TAG_SQL = """'{"keep_for_extraction":' || keep || ',"reusable_intent_score":' || intent || '}'"""
_SKILL_SQL = """'{"name":' || to_json(symbol) || ',"summary":' || to_json('does ' || symbol) || '}'"""
_MADE_SQL = "'pass # ' || symbol"
_TAGGED_SQL = (
    "select u.*, t.keep, t.intent from (select data_id, any_value(repo_name) over w as r, * exclude (data_id) from source_unit window w as (partition by data_id)) u "
    f"left join (select data_id, coalesce(keep_for_extraction, false) as keep, {_score_sql('reusable_intent_score')} as intent, "
    "row_number() over (partition by data_id order by tagged_at desc, tag_id desc) as n from source_unit_tag qualify n = 1) t using (data_id)"
)


def _message_sql(parts: list[str], source: str = "source_unit") -> str:
    return f"select distinct data_id, md5({' || '.join(parts)}) as said from ({source})"


def _message(units: DataFrame, stage: str, mark: str) -> DataFrame:
    """data_id and the digest of what the stage's model is told of a unit, from the mark on (before it stands what
    the model is asked for, the same for all units)."""
    content = "m[1].content"
    own = units.select("data_id", prompts.BUILDERS[stage]().alias("m"))
    return own.selectExpr("data_id", f"md5(substring({content}, locate('{mark}', {content}))) as said").distinct()


def _with_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units with the columns that the later stages see."""
    last = table(spark, sf_dir, "source_unit_tag").groupBy("data_id").agg(
        F.max_by(F.struct("keep_for_extraction", "reusable_intent_score"), F.struct("tagged_at", "tag_id")).alias("t")
    )
    keep = F.coalesce("t.keep_for_extraction", F.lit(False)).alias("keep_for_extraction")
    tag = F.struct(keep, normalize.clamp(F.col("t.reusable_intent_score")).alias("reusable_intent_score"))
    skill = F.struct(F.col("symbol").alias("name"), F.concat(F.lit("does "), "symbol").alias("summary"))
    own = table(spark, sf_dir, "source_unit").join(last.select("data_id", tag.alias("source_tag")), "data_id", "left")
    return own.withColumns({"skill": skill, "generated": F.concat(F.lit("pass # "), "symbol"), "first_reason": F.concat(F.lit("differs: "), "unit_type")})


@query(_message_sql([*_WHERE_SQL, _LANG_SQL, _SYMBOL_SQL, _TYPE_SQL, _LINES_SQL, _FACE_SQL, _line_sql("Parser metadata", _META_SQL), _block_sql("Code", "code")]))
def message_source_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(table(spark, sf_dir, "source_unit"), "source_tagging", "Repository: ")


@query(
    _message_sql(
        [*_WHERE_SQL, _LANG_SQL, _SYMBOL_SQL, _TYPE_SQL, _LINES_SQL, _FACE_SQL, _CHUNK_SQL, _block_sql("Rating of the unit", _TAG_SQL), _block_sql("Code", "code")],
        _TAGGED_SQL,
    )
)
def message_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(_with_stages(spark, sf_dir), "extraction", "Repository: ")


@query(_message_sql([_LANG_SQL, _SYMBOL_SQL, _TYPE_SQL, _FACE_SQL, _CHUNK_SQL, _block_sql("Skill", _SKILL_SQL)]))
def message_regeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither source nor repository nor path."""
    return _message(_with_stages(spark, sf_dir), "regeneration", "Language: ")


@query(_message_sql([_LANG_SQL, _SYMBOL_SQL, _FACE_SQL, _CHUNK_SQL, _line_sql("Summary of the skill", "'does ' || symbol"), _block_sql("Original", "code"), _block_sql("Generated", _MADE_SQL)]))
def message_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(_with_stages(spark, sf_dir), "equivalence", "Language: ")


@query(
    _message_sql(
        [_line_sql("First judgement", "'differs: ' || unit_type"), _LANG_SQL, _SYMBOL_SQL, _FACE_SQL, _CHUNK_SQL, _block_sql("Original", "code"),
         _block_sql("Skill", _SKILL_SQL), _block_sql("Generated", _MADE_SQL)]
    )
)
def message_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message(_with_stages(spark, sf_dir), "adjudication", "First judgement: ")


_HEADS = "data_id repo_name relative_path symbol accepted_stage rationale".split()
_HEADS_SQL = "array_to_string(list_filter([" + ", ".join(f"""case when {c} is not null then '"{c}":' || to_json({c}) end""" for c in _HEADS) + "], lambda y: y is not null), ',')"
_PAYLOAD_SQL = (
    f"""'{{' || {_HEADS_SQL} || ',"level":"atomic","summary":"short","worth_extracting":true,"skill_value_score":0.5,"generality_score":0.25,"abstraction_score":1.0,"""
    + ",".join(f'"{c}":["one"]' for c in "inputs outputs workflow invariants error_cases implementation_notes evidence anti_goals".split())
    + ""","confidence":0.75}'"""
)


@query(_message_sql([_block_sql("Skill", _PAYLOAD_SQL)], "unit_decision"))
def message_feature_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skill's fields beside its provenance, without name and worth_reason."""
    fields = {"level": "atomic", "name": "n", "summary": "short", "worth_extracting": True, "worth_reason": "w", "skill_value_score": 0.5, "generality_score": 0.25, "abstraction_score": 1.0}
    skill = F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], *[F.array(F.lit("one")).alias(c) for c in normalize.SKILL_LISTS], F.lit(0.75).alias("confidence"))
    return _message(table(spark, sf_dir, "unit_decision").withColumn("skill", skill), "feature_tagging", "\\nSkill:\\n")


# ------------------------------------------------------------------ clients, settings, answers


def _checked_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = []
        for url in batch.column(1).to_pylist():
            try:
                check_endpoint(url)
                fine.append(True)
            except ValueError:
                fine.append(False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine)], names=["event_id", "fine"])


@query("select event_id, event_id % 8 in (0, 1, 6, 7) as fine from events")
def endpoint_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loopback, private and link-local addresses, a public one, another scheme, credentials, no host."""
    hosts = ["http://127.0.0.%s:8000/v1", "https://10.%s.0.1", "http://8.8.%s.1", "ftp://127.0.0.%s", "http://a:b@127.0.0.%s", "http:///v1/%s", "http://192.168.%s.7/v1", "http://169.254.1.%s"]
    url = F.replace(_pick(hosts, (F.col("event_id") % 8).cast("int")), F.lit("%s"), (F.col("event_id") % 250 + 1).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", url.alias("url")).mapInArrow(_checked_urls, "event_id bigint, fine boolean")


def _read_settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = []
        for text in batch.column(1).to_pylist():
            try:
                own = Settings(**json.loads(text))
                said.append(f"{own.model.model} {own.scan.max_units_per_repo} {own.output_dir}")
            except (TypeError, ValueError) as e:
                said.append("not an object" if isinstance(e, TypeError) else str(e))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said)], names=["event_id", "said"])


@query(
    "select event_id, case event_id % 7 when 0 then 'm 400 runs' when 1 then 'model.model is required' when 2 then 'scan.depth is unknown' when 3 then 'm ' || event_id || ' there' "
    "when 4 then case when event_id % 1000 > 500 then 'pipeline.min_selection_score must be in [0, 1]' else 'm 400 runs' end "
    "when 5 then case when event_id % 3 = 0 then 'pipeline.concurrency must be at least 1; scan.min_unit_lines must be at least 1' else 'scan.min_unit_lines must be at least 1' end "
    "else 'not an object' end as said from events".replace("pipeline.concurrency must be at least 1; scan.min_unit_lines must be at least 1", "scan.min_unit_lines must be at least 1; pipeline.concurrency must be at least 1")
)
def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as they are read and checked: defaults, what is missing, unknown or out of its range."""
    model = '"model": {"base_url": "u", "model": "m"}'
    k = F.col("event_id").cast("string")
    cases = [
        f"{{{model}}}", '{"model": {"base_url": "u"}}', f'{{{model}, "scan": {{"depth": 1}}}}', f'{{{model}, "unknown": {{"x": 1}}, "scan": {{"max_units_per_repo": %s}}, "output_dir": "there"}}',
        F.concat(F.lit(f'{{{model}, "pipeline": {{"min_selection_score": '), ((F.col("event_id") % 1000) / 500).cast("string"), F.lit("}}")),
        F.concat(F.lit(f'{{{model}, "scan": {{"min_unit_lines": 0}}, "pipeline": {{"concurrency": '), (F.col("event_id") % 3).cast("string"), F.lit("}}")), "[]",
    ]
    text = F.replace(_pick(cases, (F.col("event_id") % 7).cast("int")), F.lit("%s"), k)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).mapInArrow(_read_settings, "event_id bigint, said string")


def _first_byte(stage: str, data_id: str, messages: list) -> dict:
    byte = int(data_id[:2], 16)
    if byte < 20:
        raise ValueError(f"{stage}: no answer, {len(messages)} messages")
    return {"score": byte}


def _silent(stage: str, data_id: str, messages: list) -> dict:
    raise ValueError("asked again")


@query(
    f"select data_id, case when a >= 20 then '{{\"score\": ' || a || '}}' end as answer, case when a < 20 then 'asked again' else '' end as error, "
    f"case when a < 20 then 2 else 1 end as calls, 2 as messages from (select distinct data_id, {_HEX.format(1)} as a from source_unit)"
)
def answers_and_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage asked twice with a scripted client: what has an answer is not asked again, what failed is."""
    units = table(spark, sf_dir, "source_unit").groupBy("data_id").agg(
        *[F.min(c).alias(c) for c in "repo_name relative_path language symbol unit_type line_start line_end interface code".split()],
        F.min("parser_metadata").alias("parser_metadata"),
    )
    units = materialize(units)
    store = Answers(spark, f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}", 8)
    for client in (ScriptedClient({"source_tagging": _first_byte}), ScriptedClient({"source_tagging": _silent})):
        own = store.ask(units, "source_tagging", prompts.source_tagging(), client)
    traced = store.traces().groupBy("data_id").agg(F.count("*").cast("int").alias("calls"), F.max(F.size("messages")).alias("messages"))
    # of two failures either one may be told
    error = F.when(F.col("error") != "", F.lit("asked again")).otherwise(F.lit(""))
    return own.join(traced, "data_id").select("data_id", "answer", error.alias("error"), "calls", "messages")


@query(f"select data_id, a % 5 in (0, 4) as output_valid, case when a % 5 = 1 then 1 else 0 end as notes from (select distinct data_id, {_HEX.format(1)} as a from source_unit)")
def output_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated code that parses, that doesn't, that is empty or blank, and in another language."""
    a = (F.conv(F.substring("data_id", 1, 2), 16, 10).cast("int") % 5).cast("int")
    made = _pick(["def f():\n    return 1", "def f(:", "", "  \n", "func f() {"], a)
    language = F.when(a == 4, F.lit("go")).otherwise(F.lit("python"))
    own = check_output(table(spark, sf_dir, "source_unit").select("data_id", language.alias("language"), made.alias("generated")).distinct())
    return own.select("data_id", "reconstruction.output_valid", F.size("reconstruction.validation_notes").alias("notes"))


# ------------------------------------------------------------------ results of a run


_SKILL_JSON = """'{"worth_extracting":true,"skill_value_score":' || a / 256.0 || ',"summary":' || to_json('skill ' || symbol) || '}'"""
_TAG_JSON = """'{"keep_for_extraction":true,' || array_to_string(list_transform(['""" + "', '".join(SCORES) + """'], lambda s: '"' || s || '_score":' || mean), ',') || '}'"""
_MEMBERS = f"""[
  '"accepted_stage": "' || accepted_stage || '"', '"adjudication": ' || case when b >= 128 then '{{"keep":true,"reason":"adjudicator ' || c || '"}}' else 'null' end,
  '"data_id": "' || data_id || '"', '"equivalence": {{"equivalent":' || (b < 128) || ',"reason":"judge ' || b || '"}}', '"rationale": ' || to_json(rationale),
  case when accepted_stage = 'equivalence' then '"reconstruction": {{"code":"code","output_valid":true,"validation_notes":[]}}' end,
  '"relative_path": ' || to_json(relative_path), '"repo_name": ' || to_json(repo_name),
  case when d >= 10 then '"retrieval": {{"task_family":"validation","transfer_title":' || to_json('title ' || symbol) || '}}' end,
  '"skill": ' || {_SKILL_JSON}, '"source_tag": ' || {_TAG_JSON}, '"symbol": ' || to_json(symbol)]"""


@query(f"select data_id, '{{' || array_to_string(list_filter({_MEMBERS}, lambda y: y is not null), ', ') || '}}' as json from ({_DECISION.replace('d, b', 'd, b, a, c, mean')}) where accepted")
def accepted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted records as other tools read them: fixed keys, an explicit null, keys that are left out."""
    return decisions.accepted_json(decisions.decide(scripted(spark, sf_dir)))


_COUNTERS = {
    "accepted_records": f"(select count(*) from ({_DECISION}) where accepted)",
    "purpose_cards": f"(select count(distinct purpose_id) from ({_INFERRED}) where reason = '')",
    "purpose_dropped": f"(select count(*) from ({_INFERRED}) where reason != '')",
    "rejected_records": f"(select count(*) from ({_DECISION}) where not accepted)",
    "repositories": "(select count(distinct repo_name) from source_unit)",
    "retrieval_records": f"(select count(*) from ({_DECISION}) where accepted and d >= 10)",
    "scan_skipped": "(select count(*) from skipped_file)",
    "selected_units": f"(select count(*) from ({_DECISION}) where decision_stage != 'source_tagging')",
    "source_units": "(select count(distinct data_id) from source_unit)",
}


@query("select cast(unnest(range(1, 12)) as int) as line, unnest(['{', " + ", ".join(f"""'  "{k}": ' || {v} || '{"" if k == "source_units" else ","}'""" for k, v in _COUNTERS.items()) + ", '}']) as text")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine counters of a run as the JSON document that is written, line by line."""
    units = table(spark, sf_dir, "source_unit")
    purposes = materialize(inferred(spark, sf_dir))
    counts = summary_counters(
        units.select("data_id").distinct(), table(spark, sf_dir, "skipped_file"), decisions.decide(scripted(spark, sf_dir)),
        purpose_index.cards(purposes), purpose_index.dropped(purposes), units.select("repo_name").distinct().where("repo_name is not null").count(),
    )
    path = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}/summary.json"
    jsonl.write_document(spark, counts, path)
    return _numbered(spark, path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), text of a written file; what ends its last line begins no other."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line", "text"))
    return whole.select((F.col("line") + 1).alias("line"), "text")


@query(
    f"""select cast(row_number() over (order by data_id) as int) as line, '{{"accepted": ' || accepted || ', "data_id": "' || data_id || '", "decision_stage": "' || decision_stage
    || '", "error": ' || to_json(error) || ', "symbol": ' || to_json(symbol) || '}}' as text from ({_DECISION})"""
)
def decision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key-sorted object per line, in the order of data_id."""
    own = decisions.decide(scripted(spark, sf_dir)).select("symbol", "data_id", "accepted", "decision_stage", "error")
    path = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}/decisions.jsonl"
    jsonl.write_lines(own, path, ("data_id",))
    return _numbered(spark, path)


@query(f"""select cast(row_number() over (order by purpose_id) as int) as line, '{{"purpose_id": "' || purpose_id || '", "support_count": ' || count(*) || '}}' as text
    from ({_INFERRED}) where reason = '' group by purpose_id""")
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as lines in the order of purpose_id."""
    path = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}/cards.jsonl"
    jsonl.write_lines(purpose_index.cards(inferred(spark, sf_dir)).select("support_count", "purpose_id"), path, ("purpose_id",))
    return _numbered(spark, path)


@query(f"select data_id, purpose_id, array_to_string(workflow, '|') as workflow, level is null as open_level from ({_INFERRED})")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines by all tasks, read back as objects."""
    path = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}"
    jsonl.write_table(inferred(spark, sf_dir).select("data_id", "purpose_id", "workflow", "level"), path)
    value = lambda c, kind: F.try_variant_get("payload", f"$.{c}", kind)
    steps = F.array_join(F.filter(F.transform(value("workflow", "array<string>"), lambda x: F.coalesce(x, F.lit("None"))), lambda x: F.trim(x) != ""), "|")
    own = jsonl.read_lines(spark, path).select(value("data_id", "string").alias("data_id"), value("purpose_id", "string").alias("purpose_id"), steps.alias("workflow"), value("level", "string").isNull().alias("open_level"))
    return own.withColumn("workflow", F.coalesce("workflow", F.lit("")))


# ------------------------------------------------------------------ files to units

PYTHON_FILE = """import os

class Box{a}:
    @wrap({b})
    {async}def run_{c}(self, one, *rest, key={b}, **more):
        if one:
            helper(one)
        elif rest:
            raise ValueError(key)
{loops}        return key

def short():
    pass

def outer_{d}(p, /, q):
    def inner(r: int = 0):
        while r:
            r = step(r)
        return r
    return inner(q)
"""
_LOOP = "        for x in rest:\n            use(x)\n"


def _made_file(a: Column, b: Column, c: Column, d: Column) -> Column:
    text = F.lit(PYTHON_FILE)
    for name, value in {"a": a, "b": b, "c": c, "d": d}.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    text = F.replace(text, F.lit("{async}"), F.when(a % 2 == 0, F.lit("async ")).otherwise(F.lit("")))
    text = F.replace(text, F.lit("{loops}"), F.repeat(F.lit(_LOOP), b % 3))
    return F.concat(text, F.when(d % 4 == 0, F.lit("def broken(:\n")).otherwise(F.lit("")))


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for every distinct data_id, its names and shape told by the id's digits."""
    a, b, c, d = (F.conv(F.substring("data_id", i, 2), 16, 10).cast("int") for i in (1, 3, 5, 7))
    return table(spark, sf_dir, "source_unit").select("data_id").distinct().select(
        F.lit("made").alias("repo_name"), F.lit("").alias("repo_path"), F.concat("data_id", F.lit(".py")).alias("relative_path"), _made_file(a, b, c, d).alias("content")
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FILE_SQL = _quote(PYTHON_FILE)
for _name, _value in {"a": "a", "b": "b", "c": "c", "d": "d", "async": "case when a % 2 = 0 then 'async ' else '' end", "loops": f"repeat({_quote(_LOOP)}, b % 3)"}.items():
    _FILE_SQL = _FILE_SQL.replace(f"{{{_name}}}", f"' || {_value} || '")
# the lines of the file by number, from which the units' codes are cut
_UNITS_SQL = f"""
with s as (select distinct data_id as file, {_HEX.format(1)} as a, {_HEX.format(3)} as b, {_HEX.format(5)} as c, {_HEX.format(7)} as d from source_unit),
f as (select *, {_FILE_SQL} || case when d % 4 = 0 then 'def broken(:' || chr(10) else '' end as text, b % 3 as k from s),
u as (
  select *, 'Box' || a || '.run_' || c as symbol, 'method' as unit_type, 5 as line_start, 10 + 2 * k as line_end,
    case when a % 2 = 0 then 'async ' else '' end || 'run_' || c || '(self, one, *rest, key, **more)' as interface,
    'Box' || a as class_name, a % 2 = 0 as is_async, 3 as parameters, 2 + k as branches, 1 as raises, 3 + k as calls from f where d % 4 != 0
  union all select *, 'outer_' || d, 'function', 15 + 2 * k, 20 + 2 * k, 'outer_' || d || '(p, q)', '', false, 1, 1, 0, 2 from f where d % 4 != 0
  union all select *, 'inner', 'function', 16 + 2 * k, 19 + 2 * k, 'inner(r)', '', false, 1, 1, 0, 1 from f where d % 4 != 0
  union all select *, file, 'file', 1, 21 + 2 * k, 'file scope', null, null, null, null, null, null from f where d % 4 = 0
), v as (select *, case when unit_type = 'file' then text else array_to_string(string_split(text, chr(10))[line_start:line_end], chr(10)) end as code from u)
select substr(sha1(concat_ws('|', 'made', file || '.py', symbol, line_start, line_end, code)), 1, 20) as data_id, symbol, unit_type, line_start, line_end, interface,
  md5(code) as code, class_name, is_async, parameters, branches, raises, calls, case when unit_type = 'file' then true end as fallback
from v
"""


@query(_UNITS_SQL)
def python_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, methods and what is nested, of Python files made of the units' ids; files that don't parse as wholes."""
    files = made_files(spark, sf_dir)
    meta = [F.col(f"parser_metadata.{m}").alias(m) for m in ("class_name", "is_async", "parameters", "branches", "raises", "calls", "fallback")]
    own = parsing.parse_files(files)
    return own.select("data_id", "symbol", "unit_type", "line_start", "line_end", "interface", F.md5("code").alias("code"), *meta)


# what begins a unit in languages with braces, as RE2 reads it; words, runs of other characters and line ends are tokens too
_SIGNED = [
    r"\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]*\)\s*\{", r"\bfunc\s+(?:\([^)]*\)\s*)?[A-Za-z_]\w*\s*\([^)]*\)[^{]*\{", r"\bfn\s+[A-Za-z_]\w*\s*\([^)]*\)[^{]*\{",
    r"(?m:^)[ \t]*(?:public|private|protected|static|final|async|export|inline|virtual|const|\s)+[A-Za-z_$][\w$:<>,\[\]?*&. ]*\s+[A-Za-z_$][\w$]*\s*\([^;{}]*\)\s*(?:throws\s+[^\{]+)?\{",
]
_NAMES = [
    r"\bfunction\s+([A-Za-z_$][\w$]*)", r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"\bfn\s+([A-Za-z_]\w*)",
    r"(?m:^)[ \t]*(?:public|private|protected|static|final|async|export|inline|virtual|const|\s)+[A-Za-z_$][\w$:<>,\[\]?*&. ]*\s+([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[^\{]+)?\{",
]
_STEPS = r"""//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)|"(?:\\.|[^"\\])*(?:"|\\?\z)|'(?:\\.|[^'\\])*(?:'|\\?\z)|`(?:\\.|[^`\\])*(?:`|\\?\z)|[^/"'`{}]+|."""


def _text_sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SITES_SQL = " union all ".join(
    f"select file, text, {i} as family, unnest(m) as hit, unnest(range(1, len(m) + 1)) as place, m from (select *, regexp_extract_all(text, {_text_sql('(?s)' + p + r'|\w+|[^\w\n]+|\n')}) as m from t)"
    for i, p in enumerate(_SIGNED)
)
_NAME_SQL = "case family " + " ".join(f"when {i} then regexp_extract(hit, {_text_sql('(?s)' + p)}, 1)" for i, p in enumerate(_NAMES)) + " end"
_BRACES_SQL = rf"""
with t as (select distinct md5(concat_ws('|', repo_name, relative_path, code)) as file, code as text from source_unit where code is not null and not ends_with(lower(relative_path), '.py')),
sites as ({_SITES_SQL}),
p as (select *, coalesce(sum(length(hit)) over (partition by file, family order by place rows between unbounded preceding and 1 preceding), 0) as start from sites),
c as (select file, text, family, hit, cast(start as bigint) as start, start + strpos(hit, '{{') as opening, {_NAME_SQL} as name from p where ends_with(hit, '{{')),
q as (select file, text, cast(start as bigint) as start, name, min(cast(opening as bigint)) as opening from c where name != '' group by all),
steps as (select file, start, name, opening, unnest(s) as step, unnest(range(1, len(s) + 1)) as place from (select *, regexp_extract_all(substr(text, opening), {_text_sql('(?s)' + _STEPS)}) as s from q)),
depth as (select *, sum(case step when '{{' then 1 when '}}' then -1 else 0 end) over w as depth, sum(length(step)) over w as upto from steps window w as (partition by file, start, name order by place)),
ends as (select file, start, name, min(upto) as size from depth where depth = 0 group by all),
u as (select q.*, cast(opening - start - 1 + size as bigint) as total from q join ends using (file, start, name)),
v as (select *, substr(text, start + 1, total) as body, length(replace(substr(text, 1, start), chr(10), chr(10) || chr(10))) - start + 1 as line_start from u),
w as (select *, line_start + length(replace(body, chr(10), chr(10) || chr(10))) - length(body) as line_end, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as code from v)
select file, name as symbol, cast(line_start as int) as line_start, cast(line_end as int) as line_end,
  md5(replace(trim(substr(code, 1, strpos(code, '{{') - 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), ' ')) as interface, md5(code) as code,
  cast(len(regexp_extract_all(code, '\b(?:if|for|while|switch|match|try|catch)\b')) as int) as branches, cast(len(regexp_extract_all(code, '\b[A-Za-z_$][\w$]*\s*\(')) as int) as calls
from w where line_end - line_start + 1 >= 3
"""


@query(_BRACES_SQL)
def brace_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units in every text of a language with braces, read as a file; texts without any are left out."""
    units = table(spark, sf_dir, "source_unit").where("code is not null").where(~F.lower("relative_path").endswith(".py"))
    file = F.md5(F.concat_ws("|", "repo_name", "relative_path", "code"))
    files = units.select(file.alias("repo_name"), F.lit("").alias("repo_path"), "relative_path", F.col("code").alias("content")).distinct()
    own = parsing.parse_files(files, max_unit_bytes=1 << 30).where("unit_type = 'function'")
    meta = [F.col(f"parser_metadata.{m}").alias(m) for m in ("branches", "calls")]
    return own.select(F.col("repo_name").alias("file"), "symbol", "line_start", "line_end", F.md5("interface").alias("interface"), F.md5("code").alias("code"), *meta)


_CHUNKS_SQL = rf"""
with recursive d as (select doc_id, text, 'doc_' || doc_id as stem, case when regexp_matches(text, '(?s)(?:{_NL})\z') then regexp_replace(text, '(?s)(?:{_NL})\z', '') else text end as body from documents where text is not null and text != ''),
l as (select doc_id, stem, text, regexp_split_to_array(body, '{_NL}') as lines, strlen(text) as bytes,
      case when contains(text, '__name__ == "__main__"') or contains(text, 'public static void main') then 'command_entrypoint' else 'file' end as kind from d),
b as (select *, len(lines) as n, len(regexp_split_to_array(trim(text, {{spaces}}), '{_NL}')) as shown from l where trim(text, {{spaces}}) != ''),
f as (select * from b where shown >= 3),
y as (select doc_id, unnest(range(1, n + 1)) as i, unnest(list_transform(lines, lambda x: strlen(x) + 1)) as size from f where bytes > 400),
z as (select doc_id, i, sum(size) over (partition by doc_id order by i) as upto, size from y),
k as (
  select doc_id, 1::bigint as start, 1 as number from z where i = 1
  union all
  select k.doc_id, min(e.i) as start, k.number + 1 from k join z s on s.doc_id = k.doc_id and s.i = k.start join z e on e.doc_id = k.doc_id and e.i > k.start and e.upto - s.upto + s.size > 400
  group by k.doc_id, k.number
),
c as (select *, coalesce(lead(start) over (partition by doc_id order by start), n + 1) - 1 as last, count(*) over (partition by doc_id) as total from k join f using (doc_id)),
u as (
  select stem, stem || '::chunk_' || number || '_of_' || total as symbol, kind || '_chunk' as unit_type, cast(start as int) as line_start, cast(last as int) as line_end,
    'file scope [chunk ' || number || '/' || total || ']' as interface, array_to_string(lines[start:last], chr(10)) as code, kind as chunked_from, stem as parent_symbol,
    number as chunk_index, cast(total as int) as chunk_count from c
  union all select stem, stem, kind, 1, cast(n as int), 'file scope', text, null, null, null, null from f where bytes <= 400
)
select substr(sha1(concat_ws('|', 'docs', stem || '.py', symbol, line_start, line_end, code)), 1, 20) as data_id, symbol, unit_type, line_start, line_end, interface, md5(code) as code,
  chunked_from, parent_symbol, chunk_index, chunk_count from u
"""


@query(_CHUNKS_SQL.replace("{spaces}", _SPACES))
def chunked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files that hold no function: whole ones, or runs of lines of at most 400 bytes."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    files = docs.select(F.lit("docs").alias("repo_name"), F.lit("").alias("repo_path"), path.alias("relative_path"), F.col("text").alias("content"))
    own = parsing.parse_files(files, max_unit_bytes=400)
    place = [F.col(f"parser_metadata.{m}").alias(m) for m in ("chunked_from", "parent_symbol", "chunk_index", "chunk_count")]
    return own.select("data_id", "symbol", "unit_type", "line_start", "line_end", "interface", F.md5("code").alias("code"), *place)


# ------------------------------------------------------------------ repositories on disk

#: beside the units of every repository
PLANTED = {"_private/x.py": "x = 1\n", ".hidden.py": "x = 1\n", ".dot/x.py": "x = 1\n", "vendor/x.py": "x = 1\n", "bytes.py": "x = '\0'\n", "notes.txt": "text\n", "tests/t.py": "x = 1\n"}


def _write_tree(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    made: set[str] = set()
    for batch in batches:
        count = 0
        for repo, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            target = os.path.join(root, repo, path)
            if (folder := os.path.dirname(target)) not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(target, "wb", buffering=0) as out:
                out.write(text.encode("utf-8"))
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["n"])


_PLANTED_SQL = "select distinct repo, unnest(['_private/x.py', 'bytes.py', 'tests/t.py', 'link.py']) as relative_path, unnest(['x = 1' || chr(10), '', 'x = 1' || chr(10), '']) as code, unnest(['', 'binary_file', '', 'path_escape']) as told from r"
_TREE_SQL = f"""
with r as (select md5(coalesce(repo_name, '')) as repo, relative_path, min(code) as code, '' as told from source_unit where code is not null group by all),
a as (select * from r union all {_PLANTED_SQL}),
k as (select *, '/' || lower(replace(relative_path, '\\', '/')) as p, regexp_extract(lower(relative_path), '[^/]*$') as b, string_split(relative_path, '/') as parts from a
      where lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) in ({", ".join(x.split(":")[0] for x in W.LANGUAGE_OF.split(", "))})),
v as (select * from k where len(list_filter(parts[:-2], lambda x: starts_with(x, '.') or x in ({W.SKIPPED}))) = 0 and not starts_with(parts[-1], '.'))
select repo as repo_name, relative_path, case when {_TEST} then 'test_file' when told != '' then told when strlen(code) > 8000 then 'file_too_large'
  when {_MARKER} is not null then 'secret_marker:' || {_MARKER} else '' end as skip_reason,
  case when {_TEST} or told != '' or strlen(code) > 8000 then '' else md5(code) end as content
from v
"""


@query(_TREE_SQL.replace("\\\\", "\\"))
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units' files written as repositories, with hidden, vendored, binary, test and escaping files, and scanned."""
    root = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    units = table(spark, sf_dir, "source_unit").where("code is not null")
    files = units.groupBy(F.md5(F.coalesce("repo_name", F.lit(""))).alias("repo"), "relative_path").agg(F.min("code").alias("code"))
    more = F.explode(F.create_map(*[F.lit(x) for kv in PLANTED.items() for x in kv])).alias("relative_path", "code")
    planted = files.select("repo").distinct().select("repo", more).unionByName(files.select("repo").distinct().withColumns({"relative_path": F.lit(".git/HEAD"), "code": F.lit("")}))
    files.unionByName(planted).mapInArrow(lambda it: _write_tree(it, root), "n bigint").agg(F.sum("n")).collect()
    outside = Path(root, "outside.py")
    outside.write_text("x = 1\n")
    for repo in os.scandir(root):
        if repo.is_dir():
            os.symlink(outside, Path(repo.path, "link.py"))
    own = read_repositories(spark, root, max_file_bytes=8000)
    return own.select("repo_name", "relative_path", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), F.coalesce(F.md5("content"), F.lit("")).alias("content"))


# ------------------------------------------------------------------ the commands

_INDEXED = f"""select 'cards' as artifact, count(distinct purpose_id) as lines from ({_INFERRED}) where reason = ''
union all select 'cards_edges', count(*) from ({_INFERRED}) where reason = '' union all select 'cards_dropped', count(*) from ({_INFERRED}) where reason != ''"""


def _lines_of(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    counts = [(name, spark.read.text(f"{folder}/{name}.jsonl").count()) for name in names]
    return spark.createDataFrame(counts, "artifact string, lines bigint")


@query(_INDEXED)
def purpose_index_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the purpose-index command writes for the records as JSON lines."""
    from skillweave.__main__ import index_purposes

    folder = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}"
    jsonl.write_table(purpose_records(spark, sf_dir), f"{folder}/records")
    index_purposes(spark, f"{folder}/records", f"{folder}/cards.jsonl")
    return _lines_of(spark, folder, ["cards", "cards_edges", "cards_dropped"])


def _scripted_stage(stage: str, data_id: str, messages: list) -> object:
    a, b, c = (int(data_id[i : i + 2], 16) for i in (0, 2, 4))
    name = ["load alpha", "parse beta", "retry gamma"][b % 3]
    return {
        "source_tagging": {"keep_for_extraction": a >= 32, **{f"{s}_score": 0.75 for s in SCORES}},
        "extraction": {"name": name, "summary": "word " * 20, "worth_extracting": True, "skill_value_score": 0.5, "workflow": ["one", "two"]},
        "regeneration": "```python\npass\n```",
        "equivalence": {"equivalent": b < 128, "reason": "said"},
        "adjudication": {"keep": c < 128, "reason": "ruled"},
        "feature_tagging": {"task_family": "validation", "transfer_title": name} if a % 8 else "no JSON",
    }[stage]


# a method's name says run before its skill says load, parse or retry, so that its purpose is another
_RUN = f"""
with u as (select data_id, unit_type, {_HEX.format(1)} as a, {_HEX.format(3)} as b, {_HEX.format(5)} as c from ({_UNITS_SQL})),
s as (select *, a >= 32 and row_number() over (partition by a >= 32 order by data_id) <= 400 as selected from u),
r as (select *, selected and (b < 128 or c < 128) as accepted from s)
select unnest(['source_units', 'decisions', 'accepted_records', 'rejected_records', 'retrieval_records', 'purpose_edges', 'purpose_dropped', 'purpose_index', 'scan_skipped']) as artifact,
  unnest([count(*), count(*), count(*) filter (where accepted), count(*) filter (where not accepted), count(*) filter (where accepted and a % 8 != 0),
          count(*) filter (where accepted), 0, count(distinct (b % 3, a % 8 != 0, unit_type = 'method')) filter (where accepted), 0]) as lines
from r
"""


@query(_RUN)
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the Python files of python_units as one repository on disk, with a scripted model: the lines of every
    artifact. More units pass the gate than a repository may keep."""
    folder = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}"
    root = folder.removeprefix("file://").removeprefix("file:")
    files = made_files(spark, sf_dir).select("repo_name", "relative_path", "content")
    git = spark.createDataFrame([("made", ".git/HEAD", "")], files.schema)
    files.unionByName(git).mapInArrow(lambda it: _write_tree(it, f"{root}/in"), "n bigint").agg(F.sum("n")).collect()
    client = ScriptedClient(dict.fromkeys(STAGES, _scripted_stage))
    Pipeline(spark, Settings(model={"base_url": "none", "model": "scripted"}, pipeline={"store_full_traces": False}), client).run(f"{root}/in", f"{folder}/out", export=True)
    names = "source_units decisions accepted_records rejected_records retrieval_records purpose_edges purpose_dropped purpose_index scan_skipped".split()
    return _lines_of(spark, f"{folder}/out", names)
