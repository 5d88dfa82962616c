"""Splitting oversized items at natural boundaries (problem 3).

Every item over the limit gets a table of boundaries: where an outermost declaration begins, where a line
begins, and inside over-long lines a code point every few hundred bytes. From a boundary the farthest legal
end is the last declaration within the limit, else the last line, else the last code point; the next piece
begins at the last boundary, a declaration if there is one, that leaves at least the overlap. That is the
successor of every boundary; a text's boundaries are sorted, so that it is found by binary search, for all at
once, where the text is read. Pointer doubling then squares the successor table: after k rounds it leads 2^k
pieces ahead, and the set of cuts reached from the item's start doubles with it, so the greedy cuts of an item
of n pieces take log2 n joins.

Defined cases: null texts are no case, items up to the limit stay whole and are not returned. A repeated id
counts once. Pieces are under the limit whatever the text holds. The overlap is at least the one asked for
and at most half the limit. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.llm.parsing import DIALECTS, extension
from skillweave.plans.materialize import materialize, release

LIMIT = 12_000
OVERLAP = 400
DECLARATION, LINE, POINT = 2, 1, 0


def boundaries_of(text: str, language: str | None, step: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Byte offsets, code point offsets, lines (1-based) and kinds of all boundaries; the last is the end."""
    from skillweave.llm.syntax.outline import declaration_lines

    declared = set(declaration_lines(text, language)) if language else set()
    offsets, points, lines, kinds = [], [], [], []
    at = char = 0
    for number, line in enumerate(text.split("\n"), 1):
        size = len(line.encode("utf-8", "surrogatepass")) + 1
        offsets.append(at)
        points.append(char)
        lines.append(number)
        kinds.append(DECLARATION if number in declared else LINE)
        if size > step:
            # an over-long line: a boundary every quarter step of characters, which take at most four bytes
            inside, width = at, max(1, step // 4)
            for begin in range(width, len(line), width):
                inside += len(line[begin - width : begin].encode("utf-8", "surrogatepass"))
                offsets.append(inside)
                points.append(char + begin)
                lines.append(number)
                kinds.append(POINT)
        at += size
        char += len(line) + 1
    offsets.append(at - 1)
    points.append(char - 1)
    lines.append(text.count("\n") + 1)
    kinds.append(DECLARATION)
    return offsets, points, lines, kinds


def successors(offsets: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The end of the piece that begins at each boundary and the begin of the next one (-1 after the last piece).
    offsets ascend, the last one is the item's end."""
    total = offsets[-1]
    by_kind = [offsets[kinds >= k] for k in (POINT, LINE, DECLARATION)]

    def last(kind: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The last boundary of a kind from low to high, -1 where there is none."""
        own = np.r_[-1, by_kind[kind]]
        found = own[np.searchsorted(own, high, "right") - 1]
        return np.where(found >= low, found, -1)

    high = offsets + limit - 1
    far, line, point = (last(k, offsets + 1, high) for k in (DECLARATION, LINE, POINT))
    # a cut at a declaration must still leave a piece of more than half the limit, or lines are used
    end = np.where((far >= 0) & (far - offsets > limit // 2), far, np.where(line >= 0, line, point))
    end = np.where(total - offsets < limit, total, end)
    # the next begin: the last declaration in the half of the limit before end - overlap, else the last boundary
    upto = end - overlap
    low = np.maximum(upto - (limit // 2 - overlap), offsets + 1)
    declared, line, point = (last(k, low, upto) for k in (DECLARATION, LINE, POINT))
    then = np.where(declared >= 0, declared, np.where(line >= 0, line, np.where(point >= 0, point, end)))
    return end, np.where(end < total, then, -1)


_BOUNDS = "id string, offset bigint, point bigint, line int, kind int, end bigint, next bigint"


def _bounded(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, ext, text in zip(*(c.to_pylist() for c in batch.columns)):
            dialects = DIALECTS.get(ext)
            offset, point, line, kind = (np.array(x, np.int64) for x in boundaries_of(text, dialects[-1] if dialects else None, max(8, limit // 8)))
            # an end that is also a line's begin (a text that ends with a line end) is one boundary
            if len(offset) > 1 and offset[-1] == offset[-2]:
                offset, point, line, kind = offset[:-1], point[:-1], line[:-1], np.r_[kind[:-2], max(kind[-2:])]
            end, then = successors(offset, kind, limit, overlap)
            columns = [offset, point, line.astype(np.int32), kind.astype(np.int32), end]
            data = [pa.array([key] * len(offset), pa.string()), *map(pa.array, columns), pa.array(then, mask=then < 0)]
            yield pa.RecordBatch.from_arrays(data, names=["id", "offset", "point", "line", "kind", "end", "next"])


def boundary_table(df: DataFrame, record_id: str, path: str, text: str, limit: int, overlap: int) -> DataFrame:
    """id, offset, point, line, kind of every boundary of the items over limit bytes, with end and next (null for the
    last piece) of the piece that begins there."""
    if not 0 <= overlap <= limit // 4:
        raise ValueError("the overlap must be at most a quarter of the limit")
    known = df.select(F.col(record_id).cast("string").alias("id"), extension(F.col(path)).alias("ext"), F.col(text).alias("text"))
    large = known.where(F.octet_length("text") > limit).groupBy("id").agg(F.max_by("ext", "text").alias("ext"), F.max("text").alias("text"))
    return large.mapInArrow(lambda it: _bounded(it, limit, overlap), _BOUNDS)


def reached(table: DataFrame) -> DataFrame:
    """id, offset of all begins reached from offset 0 by next, by pointer doubling."""
    jump = materialize(table.where(F.col("next").isNotNull()).select("id", "offset", "next"))
    begins = materialize(table.where("offset = 0").select("id", "offset"))
    while True:
        more = begins.join(jump, ["id", "offset"]).select("id", F.col("next").alias("offset"))
        grown = materialize(begins.unionByName(more).distinct())
        squared = jump.join(jump.select("id", F.col("offset").alias("next"), F.col("next").alias("then")), ["id", "next"])
        longer = materialize(squared.select("id", "offset", F.col("then").alias("next")))
        release(jump, begins)
        jump, begins = longer, grown
        if not jump.head(1):
            # no begin has a successor that many pieces ahead: all are reached
            return begins


def piece_table(bounds: DataFrame) -> DataFrame:
    """id, piece (from 1), pieces, line (of its first character), offset and end (bytes), first and last (code points)."""
    cuts = reached(bounds).join(bounds, ["id", "offset"])
    point = bounds.select("id", F.col("offset").alias("end"), F.col("point").alias("last"))
    order = Window.partitionBy("id").orderBy("offset")
    return cuts.join(point, ["id", "end"]).select(
        "id", F.row_number().over(order).alias("piece"), F.count("*").over(Window.partitionBy("id")).alias("pieces"),
        "line", "offset", "end", F.col("point").alias("first"), "last",
    )


def split_items(
    df: DataFrame, record_id: str, path: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """id, piece (from 1), pieces, line (of its first character), first and last (code points), text."""
    bounds = materialize(boundary_table(df, record_id, path, text, limit, overlap))
    cuts = piece_table(bounds).drop("offset", "end")
    whole = df.where(F.octet_length(text) > limit).groupBy(F.col(record_id).cast("string").alias("id")).agg(F.max(text).alias("_text"))
    return cuts.join(whole, "id").select(
        "id", "piece", "pieces", "line", "first", "last",
        F.substring(F.col("_text"), F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int")).alias("text"),
    )


def declarations_in_pieces(bounds: DataFrame, pieces: DataFrame) -> DataFrame:
    """id, piece, line of the declarations that begin in each piece; one in an overlap begins in both its pieces."""
    declared = bounds.where(F.col("kind") == DECLARATION).select("id", F.col("offset").alias("at"), F.col("line").alias("declared"))
    within = pieces.select("id", "piece", "offset", "end").join(declared, "id").where("at >= offset and at < end")
    return within.select("id", "piece", F.col("declared").alias("line"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, line: where the outermost declarations of units over 12,000 bytes begin, told by the pieces: the
    declarations that begin in any of a unit's pieces, which cover it."""
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    bounds = materialize(boundary_table(units, "data_id", "relative_path", "code", LIMIT, OVERLAP))
    found = declarations_in_pieces(bounds, piece_table(bounds))
    return found.select(F.col("id").alias("data_id"), "line").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces under 12,000 bytes of every larger unit."""
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    return split_items(units, "data_id", "relative_path", "code").withColumnRenamed("id", "data_id")


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces under 1,000 bytes of every larger document, which overlap by 100 and are cut at lines or, in
    over-long ones, at code points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", F.lit("document"))
    own = split_items(docs, "doc_id", "path", "text", 1000, 100)
    return own.select("id", "piece", "pieces", "line", "first", "last", F.md5("text").alias("text"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_documents": p3_documents}
# every boundary's end and next begin, then the cuts one after the other
SQL = {
    "p3_documents": """
with recursive d as (select doc_id, text, string_split(text, chr(10)) as lines, strlen(text) as total from documents where strlen(text) > 1000),
l as (select doc_id, unnest(range(1, len(lines) + 1)) as line, unnest(lines) as body from d),
m as (select *, coalesce(sum(strlen(body) + 1) over w, 0) as pos, coalesce(sum(length(body) + 1) over w, 0) as char from l
      window w as (partition by doc_id order by line rows between unbounded preceding and 1 preceding)),
b as (
  select doc_id, pos, min(point) as point, min(line) as line, max(kind) as kind from (
    select doc_id, pos, char as point, line, 1 as kind from m
    union all select doc_id, pos + strlen(substr(body, 1, i)), char + i, line, 0 from (select *, unnest(range(31, length(body), 31)) as i from m where strlen(body) + 1 > 125)
    union all select doc_id, total, length(text), len(lines), 2 from d
  ) group by all
),
e as (
  select b.doc_id, b.pos, b.point, b.line, case when t.total - b.pos < 1000 then t.total else coalesce(max(x.pos) filter (where x.kind >= 1), max(x.pos)) end as stop, t.total
  from b join d t using (doc_id) left join b x on x.doc_id = b.doc_id and x.pos between b.pos + 1 and b.pos + 999 group by b.doc_id, b.pos, b.point, b.line, t.total
),
n as (
  select e.doc_id, e.pos, e.point, e.line, e.stop, e.total, case when e.stop < e.total then
    coalesce(case when max(x.pos) filter (where x.kind >= 1) > e.pos then max(x.pos) filter (where x.kind >= 1) end, case when max(x.pos) > e.pos then max(x.pos) end, e.stop) end as next
  from e left join b x on x.doc_id = e.doc_id and x.pos between e.stop - 500 and e.stop - 100 group by e.doc_id, e.pos, e.point, e.line, e.stop, e.total
),
c as (
  select doc_id, pos, 1 as piece from n where pos = 0
  union all select c.doc_id, n.next, c.piece + 1 from c join n on n.doc_id = c.doc_id and n.pos = c.pos where n.next is not null
)
select cast(c.doc_id as varchar) as id, c.piece, count(*) over (partition by c.doc_id) as pieces, cast(n.line as int) as line, cast(n.point as bigint) as first, cast(s.point as bigint) as last,
       md5(substr(d.text, cast(n.point as bigint) + 1, cast(s.point - n.point as bigint))) as text
from c join n using (doc_id, pos) join b s on s.doc_id = c.doc_id and s.pos = n.stop join d on d.doc_id = c.doc_id
"""
}
