"""From repositories to verified, tagged and indexed skill records."""

from __future__ import annotations

import ast
import datetime as dt
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions import normalize
from skillweave.functions.text import code_fence_stripped
from skillweave.operators import decisions, parsing, purpose_index, selection
from skillweave.plans import prompts
from skillweave.plans.config import Settings
from skillweave.plans.materialize import materialize, scratch
from skillweave.plans.models import HttpClient, ModelClient
from skillweave.plans.stages import Answers
from skillweave.sources import jsonl
from skillweave.sources.repositories import discover, read_repositories


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        notes, valid = [], []
        for language, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            note = []
            if language == "python" and code.strip():
                try:
                    ast.parse(code)
                except SyntaxError as e:
                    note = [f"python_parse_error:{e.msg}"]
                except (ValueError, RecursionError, MemoryError) as e:
                    note = [f"python_parse_error:{e}"]
            notes.append(note)
            valid.append(bool(code.strip()) and not note)
        columns = [batch.column(0), batch.column(2), pa.array(valid), pa.array(notes, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["data_id", "code", "output_valid", "validation_notes"])


def check_output(units: DataFrame) -> DataFrame:
    """data_id, reconstruction of (data_id, language, generated); validity is recorded, it never decides."""
    own = units.select("data_id", "language", F.coalesce("generated", F.lit("")).alias("generated"))
    out = own.mapInArrow(_checked, "data_id string, code string, output_valid boolean, validation_notes array<string>")
    return out.select("data_id", F.struct("code", "output_valid", "validation_notes").alias("reconstruction"))


def normalised(answers: DataFrame, normaliser, name: str, error: str) -> DataFrame:  # noqa: ANN001
    """data_id, name (struct, null on failure), error ("" on success) of a stage's answers."""
    own = normalize.with_object(answers, "answer")
    failed = F.when(F.col("error") != "", F.col("error")).otherwise(F.col("object_error"))
    value = normalize.once(normalize.payload(F.col("object")), normaliser)
    return own.select("data_id", F.when(F.col("object").isNotNull(), value).alias(name), failed.alias(error))


def summary_counters(
    units: DataFrame, skipped: DataFrame, decided: DataFrame, cards: DataFrame, dropped: DataFrame, repositories: int
) -> dict[str, int]:
    """The nine counters of a run."""
    selected = F.count_if(F.col("decision_stage") != "source_tagging").alias("selected_units")
    return {
        "repositories": repositories,
        "source_units": units.count(),
        **decisions.decision_counts(decided, selected).first().asDict(),
        "purpose_cards": cards.count(),
        "purpose_dropped": dropped.count(),
        "scan_skipped": skipped.count(),
    }


def absolute(path: str) -> str:
    """A path with a scheme as it is, any other one absolute on this machine."""
    return path.rstrip("/") if "://" in path else str(Path(path).expanduser().resolve())


class Pipeline:
    """One run: set-at-a-time stages, each materialised before the next is asked."""

    def __init__(self, spark: SparkSession, settings: Settings, client: ModelClient | None = None) -> None:
        settings.validate()
        self.spark, self.settings = spark, settings
        self.client = client or HttpClient(settings.model)
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def scan(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(units, skipped) of all repositories under path; both are read off one table, so that files are read and
        parsed once."""
        s = self.settings.scan
        files = read_repositories(
            self.spark, path, extensions=s.allowed_extensions, skip_dirs=s.skip_dirs,
            include_tests=s.include_tests, max_file_bytes=s.max_file_bytes,
        )
        outcomes = materialize(parsing.parse_outcomes(files, s.min_unit_lines, s.max_unit_bytes))
        skipped = outcomes.where("not parsed").select("repo_name", F.col("relative_path").alias("path"), "reason")
        return parsing.source_units(outcomes), skipped

    def decide(self, units: DataFrame, work: str) -> DataFrame:
        """The decision table of units. Each stage sees the units that reached it; its answers are on disk before
        the next gate reads them."""
        p, s = self.settings.pipeline, self.settings.scan
        answers = Answers(self.spark, f"{work}/answers", p.concurrency, p.store_full_traces)

        def stage(some: DataFrame, name: str, normaliser, column: str) -> DataFrame:  # noqa: ANN001
            asked = answers.ask(some, name, prompts.BUILDERS[name](), self.client)
            return self._kept(normalised(asked, normaliser, column, f"{column}_error"), f"{work}/stages/{name}")

        tags = stage(units, "source_tagging", normalize.source_tag, "source_tag")
        tagged = units.join(tags, "data_id").withColumn("mean", selection.tag_mean("source_tag"))
        passed = tagged.where(selection.passes_selection(F.col("source_tag.keep_for_extraction"), F.col("mean"), p.min_selection_score))
        ranked = selection.repository_cap(passed, k=s.max_units_per_repo)
        ranked = self._kept(ranked, f"{work}/stages/selected")
        chosen = ranked.where("selected")

        skills = stage(chosen, "extraction", normalize.skill, "skill")
        able = chosen.join(skills, "data_id")
        worth = able.where(selection.passes_value(F.col("skill.worth_extracting"), F.col("skill.skill_value_score"), p.min_skill_value_score))
        made = answers.ask(worth, "regeneration", prompts.regeneration(), self.client, as_json=False)
        made = made.select("data_id", code_fence_stripped(F.col("answer")).alias("generated"), F.col("error").alias("made_error"))
        written = worth.join(made, "data_id")
        checked = self._kept(check_output(written.where("made_error = ''")), f"{work}/stages/reconstruction")
        written = written.where("made_error = ''")

        judged = stage(written, "equivalence", normalize.judgment, "equivalence")
        doubtful = written.join(judged.where("not equivalence.equivalent"), "data_id").withColumn("first_reason", F.col("equivalence.reason"))
        ruled = stage(doubtful, "adjudication", normalize.adjudication, "adjudication")

        before = (
            units.select("data_id", "repo_name", "relative_path", "symbol")
            .join(tags.withColumnRenamed("source_tag_error", "tag_error"), "data_id", "left")
            .join(ranked.select("data_id", "selected"), "data_id", "left")
            .join(skills, "data_id", "left")
            .join(made.select("data_id", "made_error"), "data_id", "left")
            .join(checked, "data_id", "left")
            .join(judged, "data_id", "left")
            .join(ruled, "data_id", "left")
        )
        stage_error = F.coalesce(
            *[F.when(F.col(c) != "", F.col(c)) for c in ("skill_error", "made_error", "equivalence_error", "adjudication_error")], F.lit("")
        )
        before = before.withColumn("stage_error", stage_error).withColumn("selected", F.coalesce("selected", F.lit(False)))
        blank = normalize.features(F.try_parse_json(F.lit("{}")))
        open_ = before.withColumn("retrieval", F.when(F.lit(False), blank)).withColumn("feature_error", F.lit(""))
        first = self._kept(decisions.decide(open_, p.min_selection_score, p.min_skill_value_score), f"{work}/stages/decided")
        features = stage(first.where("accepted"), "feature_tagging", normalize.features, "retrieval")
        late = first.drop("retrieval").join(features, "data_id", "left")
        failed = F.coalesce("retrieval_error", F.lit("")) != ""
        return self._kept(
            late.withColumn("error", F.when(failed, F.concat(F.lit("feature_tagging_error:"), "retrieval_error")).otherwise(F.col("error"))).drop("retrieval_error"),
            f"{work}/stages/decisions",
        )

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, path: str, output_dir: str | None = None, export: bool = False) -> dict:
        """Runs everything and returns the manifest. Tables are under output_dir/tables, output_dir being any path
        that Hadoop knows; with export the single files that other tools read are beside them, written by the
        driver, one partition at a time."""
        root = absolute(output_dir or self.settings.output_dir)
        work = f"{root}/tables"
        with scratch():
            units, skipped = self.scan(path)
            units, skipped = self._kept(units, f"{work}/source_units"), self._kept(skipped, f"{work}/scan_skipped")
        decided = self.decide(units, work)
        accepted = decisions.accepted_records(decided)
        inferred = purpose_index.infer(accepted) if self.settings.pipeline.build_purpose_index else None
        tables = {"decisions": decided, "rejected_records": decided.where("not accepted"), "retrieval_records": decisions.retrieval_records(decided)}
        if inferred is not None:
            inferred = self._kept(inferred, f"{work}/inferred")
            tables["purpose_index"] = self._kept(purpose_index.cards(inferred), f"{work}/purpose_index")
            tables["purpose_edges"], tables["purpose_dropped"] = purpose_index.edges(inferred), purpose_index.dropped(inferred)
        cards, dropped = (tables.get(x, units.limit(0)) for x in ("purpose_index", "purpose_dropped"))
        summary = summary_counters(units, skipped, decided, cards, dropped, len(discover(path)))
        manifest = {
            "schema_version": "1.0",
            "created_at": dt.datetime.now(dt.timezone.utc).isoformat(),
            "input_path": absolute(path),
            "output_dir": root,
            "config": self.settings.to_dict(),
            "summary": summary,
            "acceptance_rules": {
                "extraction": "worth_extracting and skill_value_score at or above the threshold",
                "direct_accept": "equivalent",
                "adjudicated_accept": "keep",
            },
        }
        if export:
            self._export(root, units, skipped, decided, tables)
        jsonl.write_document(self.spark, summary, f"{root}/summary.json")
        jsonl.write_document(self.spark, manifest, f"{root}/manifest.json")
        return manifest

    def _export(self, root: str, units: DataFrame, skipped: DataFrame, decided: DataFrame, tables: dict[str, DataFrame]) -> None:
        jsonl.write_lines(units, f"{root}/source_units.jsonl", ("repo_name", "relative_path", "line_start", "data_id"))
        jsonl.write_lines(skipped, f"{root}/scan_skipped.jsonl", ("repo_name", "path"))
        jsonl.write_raw_lines(decisions.accepted_json(decided), "json", f"{root}/accepted_records.jsonl", ("data_id",))
        empty = self.spark.createDataFrame([], "data_id string, purpose_id string")
        for name in ("decisions", "rejected_records", "retrieval_records", "purpose_edges", "purpose_dropped"):
            jsonl.write_lines(tables.get(name, empty), f"{root}/{name}.jsonl", ("data_id",))
        cards = tables.get("purpose_index", empty)
        if "task_family" in cards.columns:
            key = F.struct("task_family", "intent_action", "intent_target").alias("purpose_key")
            cards = cards.select(key, *[c for c in cards.columns if c not in purpose_index.KEY])
        jsonl.write_lines(cards, f"{root}/purpose_index.jsonl", ("purpose_id",))
        traces = Answers(self.spark, f"{root}/tables/answers", 1).traces()
        if traces is not None and self.settings.pipeline.store_full_traces:
            for row in jsonl.objects(traces):
                shown = {"stage": row["stage"], "messages": row["messages"], "raw_response": row["answer"], "error": row["error"]}
                jsonl.write_document(self.spark, shown, f"{root}/traces/{row['data_id']}/{row['stage']}.json")

