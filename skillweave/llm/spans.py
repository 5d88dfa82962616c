"""Long exact spans shared between records (problem 10).

Fixed-block anchors. With block = length / 2, every window of ``length`` characters contains a whole block of
its text's fixed grid. A block is indexed under the smallest hash of its ``gram``-character substrings, and
every rolling window of block size probes with the smallest hash of its own: equal blocks have equal keys,
and neighbouring windows share theirs, so the probes of all positions come down to a few percent of them.
Keys that a block and another document have in common are anchors. Around an anchor the context (the
characters any window through it can reach) is fetched, equal contexts are collapsed, and hits are extended
to the left and right as far as the texts agree. Groups of more than ``crowd`` contexts are not compared pair
by pair: equal contexts collapse to one, and the windows of the distinct ones are hashed and meet in an
aggregation, which is linear. There two windows count as equal if two 64-bit hashes of them are, one read forwards
and one backwards; among 10^15 windows a wrong match has a probability of 10^-9. Elsewhere characters are compared.

Defined cases: null, empty and short texts share nothing. Positions are code points. A doc_id that is
repeated counts as one document. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.llm.bloom import filter_of, kept
from skillweave.plans.materialize import materialize

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: inverse of _STEP modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
BATCH_CHARS = 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the step and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _STEP)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BACK)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


def rolling(points: np.ndarray, k: int, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of every substring of k code points."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _MIX * up, out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best over every window of w items."""
    size = 1
    while size * 2 <= w:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    block, powers = length // 2, _Powers()
    grams = block - gram + 1
    out: list[tuple] = []
    total = 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [(), (), ()])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "doc_id", "place"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(points) < length:
                continue
            hashes = rolling(points, gram, powers)
            lowest = _sliding(hashes, grams, np.minimum)  # by start of the rolling window
            pad = np.zeros(grams - 1, np.uint64)
            chosen = hashes == _sliding(np.r_[pad, lowest, pad], grams, np.maximum)
            at = np.flatnonzero(chosen)
            # is it the smallest of a fixed block that it lies in as a whole?
            start = at // block * block
            inside = (at + gram <= start + block) & (start + block <= len(points))
            fixed = np.zeros(len(at), np.int64)
            fixed[inside] = lowest[start[inside]] == hashes[at[inside]]
            out.append((hashes[at].view(np.int64), np.full(len(at), doc_id), at * 2 + fixed))
            total += len(points)
            if total >= BATCH_CHARS * 5:
                yield flush()
                out.clear()
                total = 0
    if out:
        yield flush()


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "doc_id", "start", "before", "context", "crowd"]
    reach = length - gram
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
            for hit in hits:
                at = hit["pos"]
                first = max(0, at - reach)
                rows.append((hit["key"], doc_id, first, at - first, text[first : at + length], hit["crowd"]))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _extended(group: list[tuple[str, int, int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """group: (context, before, doc_id, start) of one anchor. Yields doc_id, start, end of shared stretches."""
    same: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for context, before, doc_id, start in group:
        same.setdefault((context, before), []).append((doc_id, start))
    parts = [(c[:b][::-1], c[b:], b, where) for (c, b), where in same.items()]
    for left, right, before, where in parts:
        docs = {d for d, _ in where}
        spans = []
        if len(docs) > 1:
            spans.append((len(left), len(right), None))
        else:
            own = next(iter(docs))
            for left2, right2, _, where2 in parts:
                if where2 is not where and any(d != own for d, _ in where2):
                    spans.append((_common(left, left2), _common(right, right2), None))
        for reach, run, _ in set(spans):
            if reach + run >= length:
                for doc_id, start in where:
                    yield doc_id, start + before - reach, start + before + run


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by key; groups may go on from one batch to the next."""
    key, group, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "span_start", "span_end"]
        )

    for batch in batches:
        for k, doc_id, start, before, context in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                out.extend(_extended(group, length) if len(group) > 1 else ())
                key, group = k, []
            group.append((context, before, doc_id, start))
        if len(out) > 20_000:
            yield flush()
            out.clear()
    out.extend(_extended(group, length) if len(group) > 1 else ())
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """h1, h2 (hashes), a, b (documents) and span_start of every window of (a, b, start, context)."""
    powers = _Powers()
    names = ["h1", "h2", "a", "b", "span_start"]
    for batch in batches:
        out: list[list[np.ndarray]] = []
        held = 0
        for a, b, start, context in zip(*(c.to_pylist() for c in batch.columns)):
            points = np.frombuffer(context.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = rolling(points, length, powers).view(np.int64)
            second = np.ascontiguousarray(rolling(points[::-1], length, powers)[::-1]).view(np.int64)
            n = len(first)
            out.append([first, second, np.full(n, a), np.full(n, b), start + np.arange(n)])
            held += n
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=names)


def merged(spans: DataFrame) -> DataFrame:
    """Stretches that touch or overlap as one; a document's spans are bounded by its length."""
    before = Window.partitionBy("doc_id").orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, 0)
    reached = spans.withColumn("_reached", F.max("span_end").over(before))
    new = (F.col("_reached").isNull() | (F.col("span_start") > F.col("_reached"))).cast("int")
    return (
        reached.withColumn("_island", F.sum(new).over(upto))
        .groupBy("doc_id", "_island")
        .agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        .drop("_island")
    )


def shared_spans(docs: DataFrame, length: int = 200, gram: int = 40, crowd: int = 64) -> DataFrame:
    """doc_id, span_start, span_end of the maximal stretches of shared windows. docs: doc_id, text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= length)
    hits = texts.mapInArrow(lambda it: _anchors(it, length, gram), "key bigint, doc_id bigint, place bigint")
    # written once, read twice: the aggregation combines hot keys before its exchange and the join may split
    # them, which one exchange for both could not
    hits = materialize(hits)
    keys = (
        hits.groupBy("key")
        .agg(
            F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("place") % 2).alias("fixed"),
            F.count("*").alias("crowd"),
        )
        .where("a < b and fixed = 1")
        .select("key", "crowd")
    )
    keys = materialize(keys)
    # hits without an anchor stay where they are
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(keys.select("key")))
    near = hits.mapInArrow(lambda it: kept(it, sent.value), "key bigint, doc_id bigint, place bigint")
    found = near.join(keys, "key").select(
        "doc_id", F.struct("key", F.floor(F.col("place") / 2).cast("int").alias("pos"), "crowd").alias("hit")
    )
    by_doc = materialize(found.groupBy("doc_id").agg(F.collect_list("hit").alias("hits")))
    schema = "key bigint, doc_id bigint, start bigint, before bigint, context string, crowd bigint"
    # texts move once, to their hits; what is around an anchor is written for both ways of comparing
    own = texts.join(by_doc, "doc_id").select("doc_id", "text", "hits")
    around = materialize(own.mapInArrow(lambda it: _contexts(it, length, gram), schema))
    spans = (
        around.where(F.col("crowd") <= crowd)
        .drop("crowd")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda it: _compare(it, length), "doc_id bigint, span_start bigint, span_end bigint")
    )
    # crowded anchors: equal contexts collapse first, so that copies of a text are hashed once
    contexts = around.where(F.col("crowd") > crowd).drop("crowd")
    same = ["key", "before", "context"]
    distinct = materialize(contexts.groupBy(*same).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")))
    size = F.length("context")
    copied = contexts.join(distinct.where("a < b").select(*same), same, "left_semi").where(size >= length)
    copied = copied.select("doc_id", F.col("start").alias("span_start"), (F.col("start") + size).alias("span_end"))
    kinds = "h1 bigint, h2 bigint, a bigint, b bigint, span_start bigint"
    places = F.lit(0).cast("bigint").alias("start")
    twice = (
        distinct.select("a", "b", places, "context")
        .mapInArrow(lambda it: _windows(it, length), kinds)
        .groupBy("h1", "h2")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .where("a < b")
        .select("h1", "h2")
    )
    alone = contexts.join(distinct.where("a = b").select(*same), same, "left_semi")
    alone = alone.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), "start", "context")
    found = alone.mapInArrow(lambda it: _windows(it, length), kinds).join(twice, ["h1", "h2"], "left_semi")
    found = found.select(F.col("a").alias("doc_id"), "span_start", (F.col("span_start") + length).alias("span_end"))
    crowded = copied.unionByName(found)
    return merged(spans.unionByName(crowded).distinct())


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, span_start, span_end: what of each document stands word for word in another."""
    return shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p10_found": p10_found}
SQL = {
    "p10_found": """
with w as (select doc_id, k, substr(text, k + 1, 200) as g
           from (select doc_id, text, unnest(range(0, length(text) - 199)) as k from documents where length(text) >= 200)),
s as (select g from w group by g having count(distinct doc_id) > 1),
h as (select doc_id, k from w where g in (select g from s)),
l as (select doc_id, k, max(k + 200) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) as e from h),
i as (select doc_id, k, sum(case when e is null or k > e then 1 else 0 end) over (partition by doc_id order by k) as n from l)
select doc_id, min(k) as span_start, max(k) + 200 as span_end from i group by doc_id, n
"""
}
