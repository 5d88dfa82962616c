"""Source files that do not parse (problem 5).

Every text is read by the grammars of all dialects its extension may mean (a header is C or C++), which are one
grammar and run together on one stack; a text that every dialect rejects is flagged. The parser is a generalised LL recogniser, see ``syntax.gll``. A whole file
must derive from its dialect's file rule, a function or method from what may stand in a file or a class.

Defined cases: null texts and unknown extensions are no case. An empty text is a valid file, except in JSON.
A repeated id counts once. Nesting may have any depth. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.guards import language
from skillweave.llm.caps import repo_key
from skillweave.llm.spread import spread

#: extension -> dialects whose grammars read it together
DIALECTS = {
    "py": ("python",), "json": ("json",), "yaml": ("yaml",), "yml": ("yaml",), "js": ("javascript",),
    "jsx": ("javascript",), "mjs": ("javascript",), "ts": ("typescript",), "tsx": ("tsx",), "go": ("go",),
    "java": ("java",), "rs": ("rust",), "c": ("c",), "h": ("c", "cpp"), "cpp": ("cpp",), "cc": ("cpp",),
    "cxx": ("cpp",), "hpp": ("cpp",),
}


def is_valid(text: str, extension: str, piece: bool) -> bool:
    """Whether a dialect of the extension derives the text. piece: it stands inside a file or class."""
    from skillweave.llm.syntax.lexers import lexer

    reader = lexer("+".join(DIALECTS[extension]))
    reader.grammar.rest()
    found = reader.lex(text)
    start = "Piece" if piece and "Piece" in reader.grammar.rule_ids else "File"
    return found is not None and reader.grammar.accepts(start, found)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether every dialect of its extension rejects the text; null where the extension has none."""
    for batch in batches:
        extensions, pieces, texts = (c.to_pylist() for c in batch.columns[-3:])
        bad = [not is_valid(t, e, p) if e in DIALECTS else None for e, p, t in zip(extensions, pieces, texts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(bad, pa.bool_())], names=["id", "repo", "e", "bad"])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def verdicts(df: DataFrame, record_id: str, path: str, text: str, piece: Column, repo: Column | None = None) -> DataFrame:
    """id, repo, e (extension), bad (whether all dialects of the extension reject the text; null if there are none) of
    every record with a text."""
    own = df.where(F.col(text).isNotNull()).select(
        F.col(record_id).alias("id"), (F.lit("") if repo is None else repo).alias("repo"), extension(F.col(path)).alias("e"),
        piece.alias("p"), F.col(text).alias("t"),
    )
    return spread(own).mapInArrow(_judged, "id string, repo string, e string, bad boolean")


def unparsable(df: DataFrame, record_id: str, path: str, text: str, piece: Column) -> DataFrame:
    """id of every record whose text all dialects of its path reject."""
    known = df.where(extension(F.col(path)).isin(*DIALECTS))
    return verdicts(known, record_id, path, text, piece).where("bad").select("id").distinct()


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    return units.where(~F.coalesce(F.col("unit_type").endswith("_chunk"), F.lit(False)))


def _piece() -> Column:
    return F.coalesce(F.col("unit_type").isin("function", "method"), F.lit(False))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id of units, chunks excepted, that are not valid in the language of their file."""
    return unparsable(_units(spark, sf_dir), "data_id", "relative_path", "code", _piece()).toDF("data_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_name (one spelling), language (of the path's extension, as a file's language is told), units, unread (those
    of languages without a grammar), invalid, rate (of those that were read; null if none was)."""
    known = verdicts(_units(spark, sf_dir), "data_id", "relative_path", "code", _piece(), repo_key(F.col("repo_name")))
    one = known.groupBy("id").agg(F.min("repo").alias("repo_name"), F.min("e").alias("e"), F.bool_or("bad").alias("bad"))
    named = one.withColumn("language", language(F.concat(F.lit("x."), "e")))
    counts = named.groupBy("repo_name", "language").agg(
        F.count("*").alias("units"), F.count_if(F.col("bad").isNull()).alias("unread"), F.count_if("bad").alias("invalid")
    )
    return counts.withColumn("rate", F.try_divide(F.col("invalid"), F.col("units") - F.col("unread")))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
