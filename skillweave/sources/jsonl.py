"""JSON lines in, JSON lines and JSON documents out."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.text import strip
from skillweave.plans.materialize import join_parts, shared_dir, upload


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """json (text), payload (variant) of every line that isn't blank; a line that is no object ends the job with
    an error that names its file."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    value = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    failed = F.raise_error(F.concat(F.input_file_name(), F.lit(": not a JSON object: "), F.substring("value", 1, 80)))
    return lines.select(F.when(is_object, F.col("value")).otherwise(failed.cast("string")).alias("json")).withColumn(
        "payload", F.try_parse_json("json")
    )


def first_bad_line(spark: SparkSession, path: str) -> str:
    """file:line of a line that is no object, "" if there is none. Lines are numbered only for files that hold one."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(strip(F.col("value")) != "")
    bad = lines.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    found = bad.groupBy("value").agg(F.min("file").alias("file")).orderBy("file", "value").limit(1).collect()
    if not found:
        return ""
    whole = spark.read.text(found[0]["file"], wholetext=True)
    numbered = whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "line"))
    at = numbered.where(F.col("line") == found[0]["value"]).agg(F.min("at")).first()[0]
    return f"{found[0]['file']}:{at + 1}"


def plain(value: object) -> object:
    """Rows as dictionaries at every depth."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def objects(df: DataFrame) -> Iterator[dict]:
    """df's rows as dictionaries, one partition at a time."""
    return (plain(r) for r in df.toLocalIterator(prefetchPartitions=True))


def _line(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def _write_parts(df: DataFrame, line: Callable[[Row], str], path: str) -> None:
    """Rows go to Python as they would to the driver; Arrow takes longer over wide structs that are mostly null."""
    parts = f"{shared_dir(df.sparkSession)}/skillweave-{uuid.uuid4().hex}"
    df.rdd.map(line).saveAsTextFile(parts)
    join_parts(df.sparkSession, parts, path)


def write_lines(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One key-sorted object per line, in one file, for people and other tools. The executors write the lines, the
    driver puts their files together. For large results use write_table."""
    _write_parts(df.orderBy(*order) if order else df, lambda row: _line(plain(row)), path)


def write_raw_lines(df: DataFrame, column: str, path: str, order: tuple[str, ...] = ()) -> None:
    """A column of finished JSON texts, normalised to key-sorted lines."""
    _write_parts((df.orderBy(*order) if order else df).select(column), lambda row: _line(json.loads(row[0])), path)


def write_document(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, [json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"], path)


def write_text(spark: SparkSession, parts: Iterable[str], path: str) -> None:
    """One file at any path that Hadoop knows, put together on the driver's disk and moved as a whole."""
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", prefix="skillweave-", delete=False) as out:
        out.writelines(parts)
    upload(spark, out.name, path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "json") -> None:
    """df as a directory of part files, written by all executors; nulls stay explicit in JSON."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("ignoreNullFields", "false").json if kind == "json" else writer.parquet)(path)
