"""Model stages: messages go out once, answers are written before anything reads them.

A gate over a model's answer must not make Spark ask again, so answers are a table, not a cached plan. The
table is keyed by unit, stage and the messages' hash; a run that is started again asks only for what is
missing. Calls in flight are bounded by the number of tasks, one call per task at a time. Without full traces the
messages never reach the disk, only their hash does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.plans.materialize import exists
from skillweave.plans.models import ModelClient

ANSWERS = "data_id string, stage string, request string, messages array<struct<role: string, content: string>>, answer string, error string"
_TYPES = [("data_id", pa.string()), ("stage", pa.string()), ("request", pa.string())]
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
_SCHEMA = pa.schema([*_TYPES, ("messages", _MESSAGES), ("answer", pa.string()), ("error", pa.string())])
#: answers that leave a task together
ROWS = 200


def _ask(
    batches: Iterator[pa.RecordBatch], client: ModelClient, stage: str, as_json: bool, full: bool
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            rows = []
            for row in batch.slice(at, ROWS).to_pylist():
                answer, error = None, ""
                try:
                    answer = client.complete(stage, row["data_id"], row["messages"], as_json)
                except Exception as e:  # noqa: BLE001 - whatever a client raises is the unit's error, not the job's
                    error = str(e) or type(e).__name__
                said = {} if full else {"messages": None}
                rows.append(row | said | {"stage": stage, "answer": answer, "error": error})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


class Answers:
    """The response table of a run, one directory per stage."""

    def __init__(self, spark: SparkSession, path: str, concurrency: int, full: bool = True) -> None:
        self.spark, self.path, self.concurrency, self.full = spark, path.rstrip("/"), concurrency, full

    def _known(self, stage: str) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/{stage}"):
            return None
        return self.spark.read.schema(ANSWERS).parquet(f"{self.path}/{stage}")

    def ask(self, units: DataFrame, stage: str, messages: Column, client: ModelClient, as_json: bool = True) -> DataFrame:
        """data_id, answer, error for every row of units. Units that have an answer to the same messages from an
        earlier run are not asked again; failed calls are."""
        once = units.dropDuplicates(["data_id"])
        known = self._known(stage)
        if known is None:
            # the units move, not the longer messages
            once = once.repartition(self.concurrency)
        out = once.select("data_id", messages.alias("messages"))
        out = out.withColumn("request", F.sha2(F.to_json("messages"), 256)).select("data_id", "request", "messages")
        wanted = out
        if known is not None:
            wanted = out.join(known.where("error = ''").select("data_id", "request"), ["data_id", "request"], "left_anti")
            wanted = wanted.repartition(self.concurrency)
        asked = wanted.mapInArrow(lambda it, full=self.full: _ask(it, client, stage, as_json, full), ANSWERS)
        asked.write.mode("append").parquet(f"{self.path}/{stage}")
        whole = self.spark.read.schema(ANSWERS).parquet(f"{self.path}/{stage}")
        if known is None:
            return whole.select("data_id", "answer", "error")
        own = whole.join(out.select("data_id", "request"), ["data_id", "request"], "left_semi")
        # an answer wins over an earlier error
        best = own.groupBy("data_id").agg(F.max_by(F.struct("answer", "error"), F.col("error") == "").alias("r"))
        return best.select("data_id", "r.answer", "r.error")

    def traces(self) -> DataFrame | None:
        """All calls of all stages: data_id, stage, messages, answer (raw text, also what could not be read), error."""
        found = [t for t in (self._known(s) for s in _stages()) if t is not None]
        out = found[0] if found else None
        for t in found[1:]:
            out = out.unionByName(t)
        return out


def _stages() -> list[str]:
    from skillweave.functions.vocab import STAGES

    return STAGES
