"""The purpose view: filter records, infer their purpose, group them, pick a representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.functions import purpose as P
from skillweave.functions.normalize import field
from skillweave.plans.materialize import materialize

TEXTS = "level name summary when_to_use transfer_title transfer_summary".split()
LISTS = "workflow inputs outputs invariants error_cases anti_goals evidence".split()
CARD_LISTS = "workflow inputs outputs invariants error_cases".split()
KEY = "task_family intent_action intent_target".split()


def flat_records(records: DataFrame) -> DataFrame:
    """One flat row per record from nested (skill struct) or flat records; missing columns are null."""
    nested = isinstance(records.schema["skill"].dataType, T.StructType) if "skill" in records.columns else False
    inner = set(records.schema["skill"].dataType.names) if nested else set()
    retrieval = records.schema["retrieval"].dataType if "retrieval" in records.columns else None
    family = isinstance(retrieval, T.StructType) and "task_family" in retrieval.names

    def pick(name: str, kind: str) -> Column:
        own = F.col(name) if name in records.columns else F.lit(None)
        if nested:
            # a record with a skill is read from it alone
            sub = F.col(f"skill.{name}") if name in inner else F.lit(None)
            own = F.when(F.col("skill").isNotNull(), sub.cast(kind)).otherwise(own.cast(kind))
        return own.cast(kind).alias(name)

    heads = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in records.columns else F.lit("").alias(c)
        for c in ("data_id", "repo_name", "symbol")
    ]
    given = F.col("retrieval.task_family") if family else F.lit(None).cast("string")
    return records.select(
        *heads, *[pick(c, "string") for c in TEXTS], *[pick(c, "array<string>") for c in LISTS], given.alias("given_family")
    )


def records_of(lines: DataFrame, payload: str) -> DataFrame:
    """Flat records of JSON objects (a variant column), nested under skill or flat. A text where a list belongs is
    a list of one; items that are no texts are their JSON."""
    record = F.col(payload)
    skill = field(record, "skill")
    nested = F.coalesce(F.schema_of_variant(skill).startswith("OBJECT"), F.lit(False))

    def of(name: str) -> Column:
        return F.when(nested, field(skill, name)).otherwise(field(record, name))

    def items(name: str) -> Column:
        listed = F.transform(F.try_variant_get(of(name), "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
        alone = F.try_variant_get(of(name), "$", "string")
        kind = F.coalesce(F.schema_of_variant(of(name)), F.lit("VOID"))
        one = F.when(F.coalesce(alone, F.lit("")) != "", F.array(alone))
        return F.when(kind.startswith("ARRAY"), listed).when(kind == "STRING", one).alias(name)

    text = lambda v, name: F.try_variant_get(v, "$", "string").alias(name)
    family = F.try_variant_get(record, "$.retrieval.task_family", "string")
    return lines.select(
        *[text(field(record, c), c) for c in ("data_id", "repo_name", "symbol")], *[text(of(c), c) for c in TEXTS],
        *[items(c) for c in LISTS], F.struct(family.alias("task_family")).alias("retrieval"),
    )


def infer(records: DataFrame) -> DataFrame:
    """Flat records with reason ("" if indexed), the inferred purpose, purpose_id and score. Null texts are empty,
    null lists too; a null item is the text None."""
    lists = {c: f"_{c}" for c in LISTS}
    own = flat_records(records).selectExpr("*", *[f"{P.items(c)} as {x}" for c, x in lists.items()])
    own = own.selectExpr("*", f"{P.blob(lists[c] for c in P.BLOB_LISTS)} as _blob")
    own = own.selectExpr("*", f"{P.low_value_reason(lists)} as reason", f"{P.tokens('_blob')} as _words").drop("_blob")
    own = own.selectExpr("*", f"{P.verb_at('_words')} as _at", f"{P.family_hits('_words')} as _hits")
    own = own.selectExpr(
        "*", f"{P.action('_words', '_at')} as intent_action", f"{P.target('_words', '_at')} as intent_target",
        f"{P.family('given_family', '_hits')} as task_family",
    )
    return own.selectExpr(
        "*", f"{P.lifecycle('intent_action')} as lifecycle_stage", f"{P.io_shape('_inputs', '_outputs')} as io_shape",
        f"{P.signature('_invariants', '_anti_goals')} as constraint_signature", f"{P.signature('_error_cases')} as failure_signature",
        f"{P.purpose_id('task_family', 'intent_action', 'intent_target')} as purpose_id",
        f"{P.representative_score('level', 'summary', lists)} as score",
    ).drop("_words", "_at", "_hits", "given_family", *lists.values())


def dropped(inferred: DataFrame) -> DataFrame:
    return inferred.where("reason != ''").select("data_id", "reason")


def edges(inferred: DataFrame) -> DataFrame:
    more = ["lifecycle_stage", "io_shape", "constraint_signature", "failure_signature"]
    return inferred.where("reason = ''").select(
        "data_id", "purpose_id", F.struct(*KEY).alias("purpose_key"), F.struct(*KEY, *more).alias("inferred_purpose")
    )


def _level() -> Column:
    return F.when(F.coalesce("level", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("level")).alias("level")


def level_histogram(inferred: DataFrame) -> DataFrame:
    return inferred.where("reason = ''").groupBy("purpose_id", _level()).agg(F.count("*").alias("n"))


def cards(inferred: DataFrame) -> DataFrame:
    """One row per purpose. Support, repositories, levels and the winner's key come from one pre-aggregation by
    purpose, repository and level that moves no texts, so that a hot purpose is combined before it moves and no group
    is collected; the winners' texts are joined after the arg-max. Equal keys are one record that came more than
    once: its largest row stands."""
    kept = materialize(inferred.where("reason = ''"))
    key = F.struct("score", "data_id")
    small = materialize(kept.groupBy("purpose_id", "repo_name", _level()).agg(F.count("*").alias("n"), F.max(key).alias("key")))
    by_repo = small.groupBy("purpose_id", "repo_name").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
    best = by_repo.groupBy("purpose_id").agg(
        F.sum("n").alias("support_count"), F.count("*").alias("repo_support"), F.max("key").alias("key")
    )
    by_level = small.groupBy("purpose_id", "level").agg(F.sum("n").alias("n"))
    levels = by_level.groupBy("purpose_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts")
    )
    first = lambda a, b: f"coalesce(nullif({a}, ''), nullif({b}, ''), '')"
    texts = kept.selectExpr(
        "purpose_id", "struct(score, data_id) as key", *KEY, "data_id as representative_data_id", "round(score, 6) as representative_score",
        f"{first('name', 'transfer_title')} as transfer_title", f"{first('summary', 'transfer_summary')} as transfer_summary",
        *[f"{P.items(c)} as {c}" for c in CARD_LISTS],
    )
    shown = [c for c in texts.columns if c not in ("purpose_id", "key")]
    winners = best.join(texts, ["purpose_id", "key"]).groupBy("purpose_id", "support_count", "repo_support").agg(
        F.max(F.struct(*shown)).alias("best")
    )
    return winners.join(levels, "purpose_id").select("purpose_id", "support_count", "repo_support", "level_counts", "best.*")
