"""Near-duplicate records with small edits (problem 4).

Texts become sets of hashed word shingles. Records with the same set are one class, and the work is done on
one representative per class. MinHash bands propose pairs of classes. Bayesian pruning compares the pairs'
MinHash values step by step: after n values with m matches the similarity has the posterior Beta(m + 1,
n - m + 1), and a pair is dropped as soon as the probability of reaching the threshold is below the
tolerance. What is left is verified exactly on the sets.

Rows and bands follow from the threshold and a recall target (``banding``): a pair at the threshold is proposed
with at least that probability, more similar ones almost surely. The tolerance bounds the loss of the pruning.

What moves: a key per band and class, once per task; pairs of class numbers; sketches of one byte a value for the
classes in pairs, which the pruning reads; and the sets of the survivors. A Bloom filter of bounded size keeps the
sketches and sets of all other classes where they are. A bucket of more than CROWD classes is not paired in one
task: its classes meet block by block.

Defined cases: null texts and texts of fewer than ``min_words`` words are no case. A repeated id counts once
(its texts are taken to be equal; where they are not, each of them may link it). An empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.bloom import filter_of, passing
from skillweave.llm.spread import spread
from skillweave.plans.materialize import materialize

_WORDS = re.compile(r"[A-Za-z0-9_]+").findall
RECALL = 0.99999
#: MinHash values of a sketch, one byte each, read in steps of STEP
SKETCH, STEP = 64, 16
TOLERANCE = 1e-5
#: classes of a bucket that one task pairs at most
CROWD = 1000
BATCH_WORDS = 200_000
#: bytes kept of a shingle's hash; two sets of a thousand shingles meet by chance once in 3e8 pairs
WIDTH = 6
_LOW = np.uint64((1 << 8 * WIDTH) - 1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def packed(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64).ravel()


def shingle_sets(words: list[list[str]], size: int, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts behind one another, and the number of each text."""
    if len(cache) > 1_000_000:
        cache.clear()
    flat = [w for t in words for w in t]
    new = set(flat) - cache.keys()
    cache.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    hashes = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    n = len(hashes) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        total = _mixed(total * _M + hashes[i : i + n])
    inside = owner[: len(total)] == owner[size - 1 :]
    owner, total = owner[: len(total)][inside], total[inside] & _LOW
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[keep], np.bincount(owner[keep], minlength=len(words))


def _sets(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}

    def block(ids: list[str], words: list[list[str]]) -> pa.RecordBatch:
        flat, counts = shingle_sets(words, size, cache)
        raw = packed(flat)
        ends = np.concatenate([[0], np.cumsum(counts)]) * WIDTH
        sets = [raw[a:b] for a, b in zip(ends, ends[1:])]
        # a class's number is its set's hash; of 1e9 classes two share one with a probability of 3 %
        classes = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(classes), pa.array(sets, pa.binary())], names=["id", "class", "shingles"])

    ids, texts, total = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [w.lower() for w in _WORDS(text)]
            if len(words) < max(least, size):
                continue
            ids.append(i)
            texts.append(words)
            total += len(words)
            if total >= BATCH_WORDS:
                yield block(ids, texts)
                ids, texts, total = [], [], 0
    if ids:
        yield block(ids, texts)


def minhashes(flat: np.ndarray, sizes: np.ndarray, first: int, last: int) -> np.ndarray:
    """The MinHash values (32 bits) first to last of every set; the sets are not empty."""
    starts = np.cumsum(sizes) - sizes
    a, b = multipliers(last)
    out = np.empty((len(sizes), last - first), np.uint32)
    for i in range(first, last):
        out[:, i - first] = np.minimum.reduceat(((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def banding(threshold: float, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(rows, bands) with which a pair at the threshold shares a band with probability recall: as many rows as most
    bands allow, for few false candidates, but at least two."""
    bands = lambda rows: ceil(log(1 - recall) / log(1 - threshold**rows))
    rows = max([r for r in range(2, 13) if threshold == 1 or bands(r) <= most], default=2)
    return (rows, 1) if threshold == 1 else (rows, bands(rows))


def _once(batches: Iterator[pa.RecordBatch], words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Numbers and sets of the classes that a task has not seen yet (of the last 300,000), in steps; of those that pass
    a filter, if there is one."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            own = part.column(0).to_numpy()
            rows = range(len(own)) if words is None else passing(words, own.view(np.uint64)).tolist()
            rows = list({int(own[i]): i for i in rows if int(own[i]) not in seen}.values())
            if len(seen) > 300_000:
                seen.clear()
            seen.update(own[rows].tolist())
            if rows:
                yield own[rows], part.column(1).take(pa.array(rows)).to_pylist()


def _signed(sets: list[bytes], n: int) -> np.ndarray:
    return minhashes(unpacked(b"".join(sets)), np.array([len(x) // WIDTH for x in sets]), 0, n)


def _sketched(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """class and sketch, the low bytes of its first MinHash values."""
    for classes, sets in _once(batches, words):
        raw = _signed(sets, SKETCH).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array([r.tobytes() for r in raw], pa.binary())], names=["class", "sketch"])


def _chosen(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for classes, sets in _once(batches, words):
        yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sets, pa.binary())], names=["class", "shingles"])


def _banded(batches: Iterator[pa.RecordBatch], rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    """bucket (40 bits, for less to move) and class, a row per band."""
    for classes, sets in _once(batches):
        signature = _signed(sets, rows * bands)
        for band in range(bands):
            total = np.full(len(sets), band, np.uint64)
            for i in range(rows):
                total = _mixed(total * _M + signature[:, band * rows + i])
            yield pa.RecordBatch.from_arrays([pa.array((total >> np.uint64(24)).view(np.int64)), pa.array(classes)], names=["bucket", "class"])


def _paired(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """(bucket, class), sorted by bucket, to the pairs a < b of each bucket's classes; the classes of a crowded bucket
    come out as they are (a: bucket, b: class, crowded)."""
    held_bucket, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = None  # the crowded bucket that is being read

    def batch_of(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def pairs(buckets: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, none of them crowded."""
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        sizes = np.diff(np.r_[starts, len(buckets)])
        # the members at distance k, for the buckets that have them
        outs = []
        for k in range(1, int(sizes.max(initial=1))):
            starts, sizes = starts[sizes > k], sizes[sizes > k]
            count = sizes - k
            at = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
            outs.append((classes[at], classes[at + k]))
            if sum(len(x) for x, _ in outs) > 100_000:
                x, y = (np.concatenate(z) for z in zip(*outs))
                outs = []
                yield batch_of(np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], False)
        if outs:
            x, y = (np.concatenate(z) for z in zip(*outs))
            yield batch_of(np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], False)

    def settle(buckets: np.ndarray, classes: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held_bucket, held, inside
        if inside is not None:
            own = int((buckets == inside).sum())
            if own:
                yield batch_of(buckets[:own], classes[:own], True)
            buckets, classes = buckets[own:], classes[own:]
            if len(buckets):
                inside = None
        if not len(buckets):
            held_bucket, held = buckets, classes
            return
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        sizes = np.diff(np.r_[starts, len(buckets)])
        open_ = 0 if last else sizes[-1]
        if open_ > crowd:
            inside, open_ = buckets[-1], 0
        cut = len(buckets) - open_
        held_bucket, held = buckets[cut:], classes[cut:]
        done = starts < cut
        big = np.repeat(sizes[done] > crowd, sizes[done])
        if big.any():
            yield batch_of(buckets[:cut][big], classes[:cut][big], True)
        yield from pairs(buckets[:cut][~big], classes[:cut][~big])

    for batch in batches:
        buckets = np.concatenate([held_bucket, batch.column(0).to_numpy()])
        yield from settle(buckets, np.concatenate([held, batch.column(1).to_numpy()]), False)
    yield from settle(held_bucket, held, True)


def proposed(buckets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Different pairs a, b (a < b) of classes that share a bucket. buckets: bucket, class."""
    sorted_ = buckets.repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(sorted_.mapInArrow(lambda it: _paired(it, crowd), "a bigint, b bigint, crowded boolean"))
    hot = found.where("crowded").select(F.col("a").alias("bucket"), F.col("b").alias("class"))
    # every class of a crowded bucket is in one block and meets all blocks
    blocks = hot.groupBy("bucket").agg(F.ceil(F.count("*") / crowd).cast("int").alias("blocks"))
    both = hot.join(blocks, "bucket")
    one = both.select("bucket", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.col("class").alias("a"))
    other = both.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("class").alias("b"))
    met = one.join(other, ["bucket", "block"]).where("a < b").select("a", "b")
    return found.where("not crowded").select("a", "b").unionByName(met).distinct()


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest matches in n values with which the posterior probability of reaching the threshold is at
    least the tolerance, under a uniform prior: P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def _pruned(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Bayesian pruning in steps of STEP values, each step for the pairs that are left. a, b, and their sketches."""
    # bytes of different values are equal once in 256
    level = threshold + (1 - threshold) / 256
    limits = {n: least_matches(level, tolerance, n) for n in range(STEP, SKETCH + 1, STEP)}
    for batch in batches:
        one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        left, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for n, least in limits.items():
            matches[left] += (one[left, n - STEP : n] == other[left, n - STEP : n]).sum(axis=1)
            left = left[matches[left] >= least]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(left)) for i in (0, 1)], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough. a, b, and their sets."""
    for batch in batches:
        kept, scores = [], []
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = unpacked(x), unpacked(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - both
            # in whole numbers, the threshold is a short decimal
            if both * 1_000_000 >= round(threshold * 1_000_000) * either:
                kept.append(i)
                scores.append(both / either)
        rows = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(scores, pa.float64())],
            names=["a", "b", "similarity"],
        )


def near_duplicates(
    df: DataFrame,
    record_id: str,
    text: str,
    shingle: int = 5,
    threshold: float = 0.8,
    min_words: int = 5,
    recall: float = RECALL,
    tolerance: float = TOLERANCE,
    crowd: int = CROWD,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id, class; links has a, b (classes, a < b), similarity.

    Records of one class have the same shingles. The pairs of records follow by joining both tables.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    rows, bands = banding(threshold, recall)
    texts = df.where(F.col(text).isNotNull()).select(F.col(record_id).alias("id"), text)
    sets = materialize(spread(texts).mapInArrow(lambda it: _sets(it, shingle, min_words), "id string, class bigint, shingles binary"))
    members = sets.select("id", "class").distinct()
    own = sets.select("class", "shingles")
    pairs = materialize(proposed(own.mapInArrow(lambda it: _banded(it, rows, bands), "bucket bigint, class bigint"), crowd))

    def of_classes(some: DataFrame, read, schema: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
        """What read gives for the classes in some pairs, for either side of them."""
        ends = some.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        sent = df.sparkSession.sparkContext.broadcast(filter_of(ends))
        name = schema.split()[0]
        found = own.mapInArrow(lambda it: read(it, sent.value), f"class bigint, {schema}").groupBy("class").agg(F.first(name).alias(name))
        return found.toDF("a", "xa"), found.toDF("b", "xb")

    one, other = of_classes(pairs, _sketched, "sketch binary")
    seen = pairs.join(one, "a").join(other, "b").select("a", "b", "xa", "xb")
    likely = materialize(seen.mapInArrow(lambda it: _pruned(it, threshold, tolerance), "a bigint, b bigint"))
    one, other = of_classes(likely, _chosen, "shingles binary")
    whole = likely.join(one, "a").join(other, "b").select("a", "b", "xa", "xb")
    links = whole.mapInArrow(lambda it: _verified(it, threshold), "a bigint, b bigint, similarity double")
    return materialize(members), materialize(links)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b of all pairs of different ids in one class or in linked classes, the smaller first. A class of n
    records has n^2 / 2 pairs: for results that ask for pairs; members and links tell the same in their own size."""
    one, other = members.toDF("id_a", "a"), members.toDF("id_b", "b")
    within = one.join(other, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b")
    across = links.select("a", "b").join(one, "a").join(other, "b").where("id_a != id_b")
    ordered = across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return within.unionByName(ordered).distinct()


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = spark.read.parquet(f"{sf_dir}/source_unit.parquet")
    return near_duplicates(units, "data_id", "code", shingle=3, threshold=0.6, min_words=30)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id_a, data_id_b of units whose codes share 0.6 of their three-word shingles."""
    return record_pairs(*_units(spark, sf_dir)).toDF("data_id_a", "data_id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, class (the smallest data_id with the same shingles), links (similar other classes)."""
    members, links = _units(spark, sf_dir)
    first = members.groupBy("class").agg(F.min("id").alias("first"))
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").count()
    return (
        members.join(first, "class")
        .join(ends, "class", "left")
        .select(F.col("id").alias("data_id"), F.col("first").alias("class"), F.coalesce("count", F.lit(0)).alias("links"))
    )


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
_SETS = """u as (select data_id, regexp_extract_all(any_value(code), '[A-Za-z0-9_]+') as w
           from source_unit where code is not null group by data_id),
s as (select distinct data_id, lower(array_to_string(w[k:k+2], ' ')) as g
      from (select data_id, w, unnest(range(1, len(w) - 1)) as k from u where len(w) >= 30)),
n as (select data_id, count(*) as n from s group by data_id),
i as (select a.data_id as a, b.data_id as b, count(*) as common from s a join s b using (g) where a.data_id < b.data_id group by all),
p as (select i.a, i.b from i join n x on x.data_id = i.a join n y on y.data_id = i.b where common * 10 >= 6 * (x.n + y.n - common))"""
SQL = {
    "p4_found": f"with {_SETS} select a as data_id_a, b as data_id_b from p",
    "p4_classes": f"""
with {_SETS},
k as (select data_id, min(data_id) over (partition by md5(shown)) as class from (select data_id, string_agg(g, '|' order by g) as shown from s group by data_id)),
e as (select a, b from p union all select b, a from p),
l as (select e.a as class, count(*) as links from e join k x on x.data_id = e.a join k y on y.data_id = e.b where x.class = e.a and y.class = e.b group by e.a)
select k.data_id, k.class, coalesce(l.links, 0) as links from k left join l using (class)
""",
}
