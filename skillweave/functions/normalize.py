"""Bounding of untrusted JSON payloads: every field gets its type, its range and its length.

A payload is a VARIANT column. Values keep their JSON type until here, because the number 2 is true, the text
"2" is not, a text is a list of one and a number is none. Missing keys and JSON null are the same.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import WS, bounded, bounded_list, strip
from skillweave.functions.vocab import (
    CAPABILITY_TAGS,
    CONSTRAINT_TAGS,
    INTERACTION_PATTERNS,
    LEVELS,
    RISK_LEVELS,
    SCORES,
    SUCCESS_TAGS,
    TASK_FAMILIES,
)

_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"
_FLOAT = r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once however often then reads it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def as_bool(v: Column) -> Column:
    """True for true, numbers other than 0 and the texts true, yes and 1; all else is false."""
    said = F.lower(strip(_string(v))).isin("true", "yes", "1")
    return F.coalesce(
        F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(_kind(v).rlike(_NUMBERS), _double(v) != 0)
        .when(_kind(v) == "STRING", said),
        F.lit(False),
    )


def clamp(x: Column) -> Column:
    """x within [0, 1]; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def score(v: Column) -> Column:
    """A number, a boolean or a text that is a number in Python's notation, within [0, 1]; all else is 0."""
    plain = strip(_string(v))
    number = F.when(plain.rlike(_FLOAT), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    endless = F.lower(plain).isin("inf", "+inf", "infinity", "+infinity")
    of_text = F.when(endless, 1.0).otherwise(number)
    return clamp(
        F.when(_kind(v).rlike(_NUMBERS) | (_kind(v) == "BOOLEAN"), _double(v)).when(_kind(v) == "STRING", of_text)
    )


def as_text(v: Column) -> Column:
    """The text of a value; null, false, 0 and empty values are "", true is True, containers are their JSON."""

    def said(kind: Column) -> Column:
        return (
            F.when(kind == "STRING", _string(v))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")))
            .when(kind.rlike(_NUMBERS), F.when(_double(v) != 0, _string(v)))
            .when(kind.rlike("^(ARRAY|OBJECT)") & ~F.to_json(v).isin("[]", "{}"), F.to_json(v))
        )

    return F.coalesce(once(_kind(v), said), F.lit(""))


def text(v: Column, n: int = 80) -> Column:
    return bounded(as_text(v), n)


def string_list(v: Column, maximum: int, n: int = 25) -> Column:
    """A list's items as bounded texts, a text as a list of one, all else as an empty list."""
    texts = F.try_variant_get(v, "$", "array<string>")
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), as_text)

    def listed(kind: Column) -> Column:
        # texts alone need no look at each
        return F.when(kind == "ARRAY<STRING>", texts).when(kind == "STRING", F.array(_string(v))).when(kind.startswith("ARRAY"), items)

    return bounded_list(once(_kind(v), listed), maximum, n)


def _snake(x: Column) -> Column:
    return F.translate(F.lower(x), "- ", "__")


def closed(v: Column, allowed: list[str], fallback: str) -> Column:
    """The value as a word of a closed vocabulary, or the fallback."""
    return once(_snake(text(v, 3)), lambda said: F.when(said.isin(allowed), said).otherwise(fallback))


def closed_list(v: Column, allowed: list[str], maximum: int) -> Column:
    """At most maximum different words of a vocabulary among the first 2 x maximum different candidates."""
    return closed_items(string_list(v, 2 * maximum, 5), allowed, maximum)


def closed_items(candidates: Column, allowed: list[str], maximum: int) -> Column:
    said = F.filter(F.transform(candidates, _snake), lambda x: x.isin(allowed))
    return F.slice(F.array_distinct(said), 1, maximum)


def _choice(v: Column, allowed: list[str], fallback: str) -> Column:
    return once(F.lower(text(v, 1)), lambda said: F.when(said.isin(allowed), said).otherwise(fallback))


def source_tag(p: Column) -> Column:
    return F.struct(
        as_bool(field(p, "keep_for_extraction")).alias("keep_for_extraction"),
        text(field(p, "selection_rationale"), 60).alias("selection_rationale"),
        *[score(field(p, f"{s}_score")).alias(f"{s}_score") for s in SCORES],
        string_list(field(p, "selection_tags"), 8).alias("selection_tags"),
        string_list(field(p, "risk_tags"), 8).alias("risk_tags"),
    )


SKILL_LISTS = "inputs outputs workflow invariants error_cases implementation_notes evidence anti_goals".split()


def skill(p: Column) -> Column:
    return F.struct(
        _choice(field(p, "level"), LEVELS, "atomic").alias("level"),
        text(field(p, "name"), 12).alias("name"),
        text(field(p, "summary"), 80).alias("summary"),
        as_bool(field(p, "worth_extracting")).alias("worth_extracting"),
        text(field(p, "worth_reason"), 60).alias("worth_reason"),
        *[score(field(p, c)).alias(c) for c in ("skill_value_score", "generality_score", "abstraction_score")],
        *[string_list(field(p, c), 6).alias(c) for c in SKILL_LISTS],
        score(field(p, "confidence")).alias("confidence"),
    )


def judgment(p: Column) -> Column:
    return F.struct(
        as_bool(field(p, "equivalent")).alias("equivalent"),
        score(field(p, "confidence")).alias("confidence"),
        text(field(p, "reason"), 80).alias("reason"),
        string_list(field(p, "differences"), 8).alias("differences"),
        _choice(field(p, "risk_level"), RISK_LEVELS, "high").alias("risk_level"),
    )


def adjudication(p: Column) -> Column:
    return F.struct(
        *[as_bool(field(p, c)).alias(c) for c in ("keep", "skill_is_correct", "generation_failed")],
        text(field(p, "reason"), 80).alias("reason"),
        string_list(field(p, "corrective_notes"), 8).alias("corrective_notes"),
    )


def feature_fields(p: Column) -> dict[str, Column]:
    return {
        "transfer_title": text(field(p, "transfer_title"), 12),
        "transfer_summary": text(field(p, "transfer_summary"), 60),
        "when_to_use": text(field(p, "when_to_use"), 80),
        "task_family": closed(field(p, "task_family"), TASK_FAMILIES, "workflow"),
        "capability_tags": closed_list(field(p, "capability_tags"), CAPABILITY_TAGS, 8),
        "constraint_tags": closed_list(field(p, "constraint_tags"), CONSTRAINT_TAGS, 5),
        "success_signal": text(field(p, "success_signal"), 30),
        "success_tags": closed_list(field(p, "success_tags"), SUCCESS_TAGS, 4),
        "failure_modes": string_list(field(p, "failure_modes"), 6),
        "interaction_pattern": closed(field(p, "interaction_pattern"), INTERACTION_PATTERNS, "single_step"),
        "domain_hints": string_list(field(p, "domain_hints"), 4, 5),
        "retrieval_phrases": string_list(field(p, "retrieval_phrases"), 8, 10),
        "custom_tags": string_list(field(p, "custom_tags"), 4, 5),
        "notes": text(field(p, "notes"), 40),
    }


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact, key-sorted JSON of all fields with an empty canonical_fingerprint."""
    whole = fields | {"canonical_fingerprint": F.lit("")}
    raw = F.to_json(F.struct(*[whole[k].alias(k) for k in sorted(whole)]))
    # control characters are escaped in lower-case hexadecimal
    for code in (0x0E, 0x0F, 0x1A, 0x1B):
        raw = F.replace(raw, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.sha2(raw, 256)


def features(p: Column) -> Column:
    own = feature_fields(p)

    def printed(whole: Column) -> Column:
        fields = {k: whole[k] for k in own}
        return F.struct(*[v.alias(k) for k, v in fields.items()], fingerprint(fields).alias("canonical_fingerprint"))

    return once(F.struct(*[v.alias(k) for k, v in own.items()]), printed)


def _finite(value: object) -> object:
    """JSON has no NaN and Infinity: the largest doubles, and a tiny negative number that is true and scores 0."""
    if isinstance(value, float) and not math.isfinite(value):
        return -5e-324 if math.isnan(value) else math.copysign(1.7976931348623157e308, value)
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def recover_object(content: str) -> dict:
    """The JSON object in a model's answer: bare, in a code fence, or amid other text."""
    body = content.strip()
    if body.startswith("```"):
        body = body.partition("\n")[2] if "\n" in body else body
        body = body.removesuffix("```").strip()
    try:
        value = json.loads(body)
    except json.JSONDecodeError:
        first, last = body.find("{"), body.rfind("}")
        if not 0 <= first < last:
            raise ValueError("no JSON object in the answer") from None
        value = json.loads(body[first : last + 1])
    if not isinstance(value, dict):
        raise ValueError("the answer is not a JSON object")
    return value


def _recovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        objects, errors = [], []
        for content in batch.column(batch.num_columns - 1).to_pylist():
            try:
                objects.append(json.dumps(_finite(recover_object(content or "")), ensure_ascii=False))
                errors.append("")
            except (ValueError, RecursionError) as e:
                objects.append(None)
                errors.append(str(e))
        columns = [*batch.columns, pa.array(objects, pa.string()), pa.array(errors, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "object", "object_error"])


def with_object(df: DataFrame, content: str) -> DataFrame:
    """df with object (canonical JSON text, null on failure) and object_error ("" on success)."""
    ordered = df.select(*[c for c in df.columns if c != content], content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(_recovered, schema + ", object string, object_error string")


def payload(object_json: Column) -> Column:
    return F.try_parse_json(object_json)


__all__ = [n for n in dir() if not n.startswith("_")]
del WS
