"""Purpose edges of records as they arrive: the batch projection over a stream of JSON lines.

Filtering and inference look at one record at a time, so the stream needs no state; support counts and
representatives are read off the edges' table in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweave.functions.text import strip
from skillweave.operators import purpose_index


def records(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Flat records from JSON-lines files that appear under path; blank lines and lines that are no object are
    left out, as one bad line must not stop a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(strip(F.col("value")) != "")
    payload = lines.select(F.try_parse_json("value").alias("payload"))
    objects = payload.where(F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False)))
    return purpose_index.records_of(objects, "payload")


def follow(spark: SparkSession, path: str, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends inferred purposes to the Parquet table output, exactly once per input file. once: what is there
    now, else until the query is stopped."""
    inferred = purpose_index.infer(records(spark, path))
    writer = inferred.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def cards(spark: SparkSession, output: str) -> DataFrame:
    """The purpose cards of everything that has arrived so far."""
    return purpose_index.cards(spark.read.parquet(output))
