"""Every unit's one decision, and the tables read off the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions.vocab import SCORES


def has(c: str) -> Column:
    return F.col(c).isNotNull()


def decide(stages: DataFrame, min_selection: float = 0.50, min_value: float = 0.45) -> DataFrame:
    """stages: one row per unit with data_id, repo_name, relative_path, symbol, selected (boolean), the nullable
    structs source_tag, skill, reconstruction, equivalence, adjudication, retrieval and the errors tag_error,
    stage_error, feature_error ("" or null without one). Adds the decision and keeps what it may show."""
    tag, skill = F.col("source_tag"), F.col("skill")
    total = tag[f"{SCORES[0]}_score"]
    for s in SCORES[1:]:
        total = total + tag[f"{s}_score"]
    error = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    gate = ~tag["keep_for_extraction"] | (total / 6.0 < min_selection)
    value = ~skill["worth_extracting"] | (skill["skill_value_score"] < min_value)
    same, kept = F.col("equivalence.equivalent"), F.col("adjudication.keep")
    case = (
        F.when(error("tag_error") | ~has("source_tag"), F.lit("tagging_error"))
        .when(gate, F.lit("source_unit_selection_gate"))
        .when(~F.col("selected"), F.lit("per_repository_cap"))
        .when(error("stage_error") | ~has("skill"), F.lit("pipeline_error"))
        .when(value, F.lit("skill_value_gate"))
        .when(same, F.lit("equivalent"))
        .otherwise(F.lit("adjudicated"))
    )
    d = stages.withColumn("_case", case)
    c = F.col("_case")
    early = c.isin("tagging_error", "source_unit_selection_gate", "per_repository_cap")
    stage = (
        F.when(early, F.lit("source_tagging")).when(c == "pipeline_error", F.lit("error"))
        .when(c == "skill_value_gate", F.lit("extraction")).when(c == "equivalent", F.lit("equivalence"))
        .otherwise(F.lit("adjudication"))
    )
    accepted = (c == "equivalent") | ((c == "adjudicated") & F.coalesce(kept, F.lit(False)))
    reason = (
        F.when(c == "equivalent", F.col("equivalence.reason")).when(c == "adjudicated", F.col("adjudication.reason"))
        .otherwise(c)
    )
    judged = c.isin("equivalent", "adjudicated")
    shown = {
        "source_tag": c != "tagging_error",
        "skill": judged | (c == "skill_value_gate"),
        "reconstruction": judged,
        "equivalence": judged,
        "adjudication": c == "adjudicated",
        "retrieval": accepted & ~error("feature_error"),
    }
    failed = F.when(c == "tagging_error", F.coalesce("tag_error", F.lit("")))
    failed = failed.when(c == "pipeline_error", F.coalesce("stage_error", F.lit("")))
    failed = failed.when(accepted & error("feature_error"), F.concat(F.lit("feature_tagging_error:"), F.col("feature_error")))
    return d.select(
        "data_id", "repo_name", "relative_path", "symbol",
        accepted.alias("accepted"), stage.alias("decision_stage"),
        F.when(accepted, stage).otherwise(F.lit("")).alias("accepted_stage"),
        F.coalesce(reason, F.lit("")).alias("rationale"),
        *[F.when(when, F.col(name)).alias(name) for name, when in shown.items()],
        F.coalesce(failed, F.lit("")).alias("error"),
    )


def accepted_json(decisions: DataFrame) -> DataFrame:
    """data_id, json: one key-sorted object per accepted record. adjudication is an explicit null where there was
    none; reconstruction is there for equivalence accepts only, retrieval only where it exists."""
    plain = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    inner = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    member = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    keys: dict[str, Column] = {
        name: member(name, inner(name)) for name in ("accepted_stage", "data_id", "rationale", "relative_path", "repo_name", "symbol")
    }
    keys["adjudication"] = member("adjudication", F.coalesce(plain("adjudication"), F.lit("null")))
    for name in ("equivalence", "skill", "source_tag"):
        keys[name] = member(name, F.coalesce(plain(name), F.lit("{}")))
    direct = (F.col("accepted_stage") == "equivalence") & has("reconstruction")
    keys["reconstruction"] = F.when(direct, member("reconstruction", plain("reconstruction")))
    keys["retrieval"] = F.when(has("retrieval"), member("retrieval", plain("retrieval")))
    line = F.concat(F.lit("{"), F.concat_ws(", ", *[keys[k] for k in sorted(keys)]), F.lit("}"))
    return decisions.where("accepted").select("data_id", line.alias("json"))


def accepted_records(decisions: DataFrame) -> DataFrame:
    """The accepted projection as columns; the failed reconstruction of an adjudicated record is left out."""
    direct = F.col("accepted_stage") == "equivalence"
    return decisions.where("accepted").select(
        "data_id", "repo_name", "relative_path", "symbol", "accepted_stage", "rationale", "skill", "source_tag",
        "equivalence", "adjudication", F.when(direct, F.col("reconstruction")).alias("reconstruction"), "retrieval",
    )


def retrieval_records(decisions: DataFrame) -> DataFrame:
    own = decisions.where(F.col("accepted") & has("retrieval"))
    return own.select("data_id", "repo_name", "relative_path", "symbol", "retrieval.*")


def decision_counts(decisions: DataFrame, *more: Column) -> DataFrame:
    """accepted_records, rejected_records and retrieval_records (and more aggregates) in one row."""
    return decisions.agg(
        F.count_if("accepted").alias("accepted_records"),
        F.count_if(~F.col("accepted")).alias("rejected_records"),
        F.count_if(F.col("accepted") & has("retrieval")).alias("retrieval_records"),
        *more,
    )
