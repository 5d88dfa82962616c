"""Generated, minified or vendored source files (problem 7).

Paths and contents tell. A file's own rules look at its path, its header and its token composition (lines of
dense code, lines of mere literals). Vendored copies whose marks were edited away are found by content: the
rare lines of files that are known to be vendored make an inverted index of line hashes, and a unit most of
whose lines stand in the vendored files of other repositories is a copy, edited or not. What holds for a file
holds for all units of its repository and path.

Defined cases: a null or empty code is judged by its path only, as a unit that repeats a data_id counts once;
null code is no case. A repository's own settings files (JSON and YAML that are no list of records) are never
data. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.bloom import filter_of, passing
from skillweave.llm.caps import repo_key
from skillweave.llm.spread import spread
from skillweave.plans.materialize import materialize

GENERATED_PATH = (
    r"(?i)(?:^|/)(?:generated|autogen|auto[_-]generated|__generated__|gen|gen-[a-z]+|generated-sources?|generated-src|codegen-out)/"
    r"|\.(?:pb|generated|gen|g|designer|pb\.gw)\.[a-z]+$|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:cc|h|go)$|(?:^|/)zz_generated|_generated\.[a-z]+$"
)
MINIFIED_PATH = r"(?i)[.-]min\.(?:js|css|mjs)$|\.bundle\.(?:js|mjs|css)$|\.chunk\.(?:js|mjs)$|\.[0-9a-f]{8,32}\.(?:js|mjs|css)$"
#: the second half names directories that hold libraries only if they have directories of their own
VENDORED_PATH = (
    r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|vendor|_vendor|vendored|third[_-]?party"
    r"|godeps|pods|\.yarn)/|(?:^|/)(?:external|externals|extern|contrib|deps)/[^/]+/"
    r"|(?:^|/)[a-z][a-z0-9-]*-\d+\.\d+\.\d+[^/]*\.[a-z]+$"
)

_GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated (?:file|by|from|code)|\b(?:automatically|machine)[- ](?:generated|produced)\b"
    r"|\b(?:code )?generated (?:by|from|with|using)\b(?:[^\n]*\n)?[^\n]*\b(?:do not (?:edit|modify)|edit \S+ instead|don't edit)"
    r"|\bcode generated by\b|\bgenerated (?:by|with|using) \S+ (?:v?\d|on \d)|manual changes will be (?:lost|overwritten)"
    r"|this (?:file|code) (?:is|was) (?:auto|generated|produced)"
)
_VENDORED = re.compile(
    r"(?i)\bv\d+\.\d+(?:\.\d+)?\S* *[|(] *(?:mit|bsd|apache|isc|mpl|l?gpl)|@license\b|\bupstream license\b"
    r"|copyright \(c\)[^\n]*\bauthors\b(?![^\n]*this repository)"
)
_MAPPED = re.compile(r"(?://|/\*)[#@] *sourceMappingURL=\S+(?: *\*/)?\Z")
_COMMENT_LINE = re.compile(r"\s*(?:#(?!include|define|pragma|if|end|else)|//|/\*|\*|<!--|\"\"\"|''')")
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/", re.S)
_LITERALS = re.compile(r"\s*(?:(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)[fFuUlL]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')\s*[,;]?\s*)+$")
_FRAME = re.compile(r"\s*(?:package\s+\w+;?|[^\"']*[=(]\s*[^\"'=]*[\[{(]|[\]})]+[;,)]*)\s*$")
_RECORD = re.compile(r"\s*\[\s*(?:[{\[]|[-+\d\"])")
LONG_LINE, DENSE_BLANKS, DENSE_SHARE = 250, 0.06, 0.5
LITERAL_LINES, LITERAL_SHARE = 3, 0.8
LINE_LENGTH = 16
CONTAINMENT, SHARED_LINES = 0.6, 5
GENERATED, MINIFIED, VENDORED, DATA = 1, 2, 4, 8


def header(text: str) -> str:
    """The comments and doc strings before a text's first line of code."""
    out, inside = [], ""
    for line in (m[0] for m in re.finditer(r"[^\n]+|(?<=\n)(?=\n)", text)):
        bare = line.strip()
        if inside:
            out.append(line)
            if inside in bare:
                inside = ""
            continue
        if not bare or re.match(r"package\s+[\w.]+;?$|['\"]use strict['\"];?$|<\?php$", bare):
            continue
        opened = re.match(r"/\*|<!--|[rRuU]?\"\"\"|[rRuU]?\'\'\'", bare)
        if opened:
            close = {"/*": "*/", "<!": "-->"}.get(bare[:2], bare.lstrip("rRuU")[:3])
            out.append(line)
            inside = "" if close in bare[opened.end() :] else close
        elif _COMMENT_LINE.match(line):
            out.append(line)
        else:
            break
    return "\n".join(out)


def is_dense(text: str) -> bool:
    """Minified: most of the code stands in long lines almost without blanks, strings and comments aside."""
    if len(text) < 200 or max(map(len, text.split("\n"))) < LONG_LINE:
        return False
    dense = total = 0
    for line in _STRINGS.sub("''", text).split("\n"):
        size = len(line)
        total += size
        if size >= LONG_LINE and sum(map(line.count, " \t")) < DENSE_BLANKS * size:
            dense += size
    return total >= 100 and dense >= DENSE_SHARE * total


def is_data(text: str, ext: str) -> bool:
    """Most lines are literals only; in JSON, a list of records."""
    if ext == "json":
        return bool(_RECORD.match(text)) and len(text) >= 200
    if ext in ("yaml", "yml"):
        return False
    # the lines that open and close a list, and a package line, are neither
    lines = [x for x in text.split("\n") if x.strip() and not _FRAME.match(x)]
    if len(lines) < LITERAL_LINES:
        return False
    pure = sum(1 for x in lines if x.rstrip()[-1] in ",;\"'0123456789abcdefABCDEF)" and _LITERALS.match(x))
    return pure >= LITERAL_LINES and pure >= LITERAL_SHARE * len(lines)


def is_mapped(text: str) -> bool:
    """Whether the last line that isn't blank names a source map, which may itself stand in that line."""
    bare = text.rstrip()
    return bool(_MAPPED.match(bare, bare.rfind("\n") + 1))


def told_marks(text: str, ext: str) -> int:
    """What a text says of itself in its header and its last line."""
    if ext in ("json", "yaml", "yml"):
        return 0
    head = header(text)
    marks = 0
    if head and _GENERATED.search(head):
        marks |= GENERATED
    if head and _VENDORED.search(head):
        marks |= VENDORED
    return marks | (MINIFIED if is_mapped(text) else 0)


def content_marks(text: str, ext: str, told: int | None = None) -> int:
    told = told_marks(text, ext) if told is None else told
    marks = told & ~MINIFIED
    if told & MINIFIED or is_dense(text):
        marks |= DATA if is_data(text, ext) else MINIFIED
    elif is_data(text, ext):
        marks |= DATA
    if ext in ("json", "yaml", "yml"):
        marks &= DATA
    return marks


def line_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the lines that are long enough to tell, without blanks around."""
    lines = {x.strip() for x in text.split("\n")}
    return np.array(sorted(xxhash.xxh3_64_intdigest(x) for x in lines if len(x) >= LINE_LENGTH), np.uint64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a number, fixed once the table is written, that stands for the unit in the index."""
    number = TaskContext.get().partitionId() << 40
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            marks, told, chars, hashes = [], [], [], []
            for ext, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                told.append(told_marks(text, ext))
                marks.append(content_marks(text, ext, told[-1]))
                chars.append(len(text))
                hashes.append(line_hashes(text).view(np.int64))
            numbers = pa.array(np.arange(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], numbers, *(pa.array(x, pa.int32()) for x in (marks, told, chars)), pa.array(hashes, pa.list_(pa.int64()))],
                names=["id", "repo", "path", "unit", "marks", "told", "chars", "lines"],
            )


def _known(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(unit, place, lines) to unit, place, line of the lines that pass the filter."""
    for batch in batches:
        lists = batch.column(2)
        lines = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = passing(words, lines.view(np.uint64))
        rows = pa.array(owner[at])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines[at])], names=["unit", "place", "line"])


def path_marks(path: Column) -> Column:
    mark = lambda pattern, bit: F.when(path.rlike(pattern), bit).otherwise(0)
    settings = F.lower(path).rlike(r"\.(json|ya?ml)$")
    code = mark(GENERATED_PATH, GENERATED).bitwiseOR(mark(MINIFIED_PATH, MINIFIED)).bitwiseOR(mark(VENDORED_PATH, VENDORED))
    return F.when(settings, mark(VENDORED_PATH, VENDORED)).otherwise(code)


def of_parts(parts: DataFrame, containment: float) -> DataFrame:
    """repo, path, of_file of files that come in parts: id, part, repo, path, marks, told, chars, copied.

    The first part has the file's header, any part may have its last line. Composition and copies are the file's if
    they hold for as much of it as they must hold for of a text.
    """
    parts = parts.groupBy("repo", "path", "id", "part").agg(
        F.bit_or("marks").alias("marks"), F.bit_or("told").alias("told"), F.max("chars").alias("chars"), F.max("copied").alias("copied")
    )
    bit = lambda c, b: F.col(c).bitwiseAND(F.lit(b)) != 0
    share = lambda x: F.sum(F.when(x, F.col("chars")).otherwise(0)) / F.sum("chars")
    mark = lambda x, b: F.when(x, b).otherwise(0)
    header = F.bit_or(F.when(F.col("part") == 1, F.col("told").bitwiseAND(F.lit(GENERATED | VENDORED))).otherwise(0))
    mapped = F.bit_or(F.col("told").bitwiseAND(F.lit(MINIFIED)))
    dense, data = mark(share(bit("marks", MINIFIED)) >= DENSE_SHARE, MINIFIED), mark(share(bit("marks", DATA)) >= LITERAL_SHARE, DATA)
    copied = mark(share(F.col("copied") > 0) >= containment, VENDORED)
    marks = header.bitwiseOR(mapped).bitwiseOR(dense).bitwiseOR(data).bitwiseOR(copied)
    return parts.groupBy("repo", "path").agg(marks.alias("of_file")).where("of_file > 0")


def not_handwritten(
    df: DataFrame, record_id: str, repo: Column, path: str, whole: Column, text: str, containment: float = CONTAINMENT, part: Column | None = None
) -> DataFrame:
    """id, marks (bits: 1 generated, 2 minified, 4 vendored, 8 data) of the records to drop.

    whole: whether a record is its file's whole text, whose marks then hold for all records of the file. part: of a
    record that is one of the parts into which a file's whole text was cut, its number from 1; null for others.
    """
    ext = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    units = df.where(F.col(text).isNotNull()).select(
        F.col(record_id).alias("id"), F.coalesce(repo, F.lit("")).alias("repo"), F.col(path).alias("path"),
        ext.alias("ext"), F.col(text).alias("text"), whole.alias("whole"),
        (F.lit(None).cast("int") if part is None else part).alias("part"),
    )
    schema = "id string, repo string, path string, unit bigint, marks int, told int, chars int, lines array<bigint>"
    marked = spread(units.drop("whole", "part")).mapInArrow(_marked, schema)
    marked = materialize(marked.withColumn("marks", F.col("marks").bitwiseOR(path_marks(F.col("path")))))
    # the index: lines of vendored files with the repositories they stand in; numbers stand for names, so that
    # the exchange of all other lines moves three numbers a line
    place = F.xxhash64("repo").alias("place")
    seeds = marked.where(F.col("marks").bitwiseAND(F.lit(VENDORED)) != 0)
    index = (
        seeds.select(place, F.explode("lines").alias("line"))
        .distinct()
        .groupBy("line")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("inside"))
    )
    index = materialize(index)
    # only lines that may be in the index are exchanged
    sent = df.sparkSession.sparkContext.broadcast(filter_of(index.select("line")))
    others = marked.where("marks = 0").select("unit", place, "lines")
    others = others.mapInArrow(lambda it: _known(it, sent.value), "unit bigint, place bigint, line bigint")
    hits = materialize(others.join(index, "line").where("first != place or last != place").drop("first", "last"))
    sizes = marked.where("marks = 0").select("unit", "id", F.size("lines").alias("size"))
    shared = hits.groupBy("unit").agg(F.count("*").alias("shared")).join(sizes, "unit")
    strangers = shared.where((F.col("shared") < SHARED_LINES) | (F.col("shared") < containment * F.col("size"))).select("unit")
    # a line that more repositories have in units that share little else than have it in vendored files is an idiom, no
    # trace; copies share most lines, so that any number of them makes no line an idiom
    idioms = (
        hits.join(strangers, "unit").groupBy("line", "place").agg(F.max("inside").alias("inside"))
        .groupBy("line").agg(F.count("*").alias("outside"), F.max("inside").alias("inside"))
        .where("outside > 10 + 10 * inside").select("line", F.lit(1).alias("idle"))
    )
    # idioms count neither as shared nor as lines of the unit
    told = hits.join(idioms, "line", "left").groupBy("unit").agg(F.count("*").alias("all"), F.count("idle").alias("idle"))
    told = told.join(sizes, "unit").withColumn("shared", F.col("all") - F.col("idle")).where(f"shared >= {SHARED_LINES}")
    copies = told.where(F.col("shared") >= containment * (F.col("size") - F.col("idle"))).select("id", F.lit(VENDORED).alias("copied")).distinct()
    own = marked.select("id", "repo", "path", "marks", "told", "chars").join(copies, "id", "left").withColumn("copied", F.coalesce("copied", F.lit(0)))
    own = own.withColumn("marks", F.col("marks").bitwiseOR(F.col("copied")))
    files = units.where("whole").select("id").distinct().join(own, "id").where("marks > 0")
    files = files.select("repo", "path", F.col("marks").alias("of_file"))
    cut = units.where("part is not null").select("id", "part").distinct().join(own, "id")
    files = files.unionByName(of_parts(cut, containment)).groupBy("repo", "path").agg(F.bit_or("of_file").alias("of_file"))
    final = own.drop("told", "chars", "copied").join(files, ["repo", "path"], "left")
    final = final.withColumn("marks", F.col("marks").bitwiseOR(F.coalesce("of_file", F.lit(0))))
    return final.where("marks > 0").groupBy("id").agg(F.bit_or("marks").alias("marks"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    whole = F.coalesce(F.col("unit_type").isin("file", "command_entrypoint"), F.lit(False))
    # file::chunk_2_of_3
    number = F.regexp_extract("symbol", r"::chunk_(\d+)_of_\d+$", 1).try_cast("int")
    part = F.when(F.col("unit_type").isin("file_chunk", "command_entrypoint_chunk"), F.coalesce(number, F.lit(0)))
    return not_handwritten(units, "data_id", repo_key(F.col("repo_name")), "relative_path", whole, "code", part=part)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id of units whose file is generated, minified or bundled, vendored, or data."""
    return _units(spark, sf_dir).select(F.col("id").alias("data_id"))


def p7_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id and why: generated, minified, vendored, data."""
    bit = lambda b: F.col("marks").bitwiseAND(F.lit(b)) != 0
    return _units(spark, sf_dir).select(
        F.col("id").alias("data_id"), bit(GENERATED).alias("generated"), bit(MINIFIED).alias("minified"),
        bit(VENDORED).alias("vendored"), bit(DATA).alias("data"),
    )


QUERIES = {"p7_found": p7_found, "p7_marks": p7_marks}
SQL: dict[str, str] = {}
