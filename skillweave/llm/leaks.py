"""Evaluation texts leaking into training text (problem 9).

Every item is cut into windows of ``window`` words, every document likewise. Windows have a 64-bit SimHash of
their words. The fingerprint's bits are cut into radius + 2 blocks: two fingerprints that differ in at most
radius bits agree in two blocks, so the windows that share one of the keys made of two blocks are all those within
the radius and few others. Candidates are verified exactly by the weighted Jaccard similarity of their word pairs
(weights: characters).

Both sides meet in an exchange on the keys. One scan of the documents, whatever the number of items, leaves only
windows that pass a Bloom filter of the items' keys; the filter has a fixed largest size and is all that is
broadcast. With more items than it is made for it lets more windows pass, and nothing else changes.

Defined cases: a null, empty or short text (fewer than ``window`` words) holds nothing and is found nowhere.
A pair is reported once however often the passage occurs. Items with the same text are all reported. A
repeated doc_id counts as one document. Empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.bloom import filter_of, kept, passing
from skillweave.plans.materialize import materialize

MAX_WORDS = 1_000_000
BATCH_WORDS = 100_000
#: runs of letters and digits of any script
_RUNS = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    found = _RUNS(text)
    return "\n".join(found).lower().split("\n") if found else []


class _Words:
    """Codes of words with their hashes and the hashes' bits as +1 and -1."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.known = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.signs = np.zeros((1024, 64), np.int8)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > MAX_WORDS:
            self.__init__()
        codes = self.codes
        out = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        known, n = self.known, len(codes)
        if n > known:
            if n > len(self.hashes):
                size = 2 * n
                self.hashes = np.resize(self.hashes, size)
                self.signs = np.resize(self.signs, (size, 64))
            new = list(islice(reversed(codes), n - known))[::-1]
            self.hashes[known:n] = [xxhash.xxh3_64_intdigest(w) for w in new]
            bits = np.unpackbits(self.hashes[known:n].view(np.uint8).reshape(-1, 8), axis=1)
            self.signs[known:n] = bits.astype(np.int8) * 2 - 1
            self.known = n
        return out

    def bits(self, words: list[str]) -> np.ndarray:
        codes = self.of(words)
        return self.signs[codes]


def fingerprints(signs: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of rows; a bit is set where more words set it than not."""
    total, width = None, 0
    power, size = signs.astype(np.int16) if window > 127 else signs, 1
    rest = window
    while rest:
        if rest & 1:
            part = power[width : len(signs) - window + width + 1]
            total = part if total is None else total + part
            width += size
        rest >>= 1
        if rest:
            power, size = power[:-size] + power[size:], size * 2
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def shingle_similarity(a: list[str], b: list[str]) -> float:
    """Weighted Jaccard of the pairs of neighbouring words; a pair weighs its characters."""
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    weight = lambda p: len(p[0]) + len(p[1])
    both = sum(weight(p) * min(n, y[p]) for p, n in x.items())
    either = sum(weight(p) * max(x[p], y[p]) for p in x.keys() | y.keys())
    return both / either if either else 1.0


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """One row of 64-bit keys per choice of two of the fingerprints' radius + 2 blocks. Fingerprints that differ in at
    most radius bits agree in two blocks at least, so they share a key; others seldom do."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [(prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    out = np.empty((len(blocks) * (len(blocks) - 1) // 2, len(prints)), np.uint64)
    for number, (i, j) in enumerate(combinations(range(len(blocks)), 2)):
        out[number] = (blocks[i] << np.uint64(32)) ^ blocks[j] ^ np.uint64(number << 58)
    return out


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to item_id, passage (a window's words), print."""
    known = _Words()
    for batch in batches:
        ids, passages, prints = [], [], []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text or "")
            if len(words) < window:
                continue
            own = [" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
            ids += [item_id] * len(own)
            passages += own
            prints.append(fingerprints(known.bits(words), window))
        flat = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        columns = [pa.array(ids, pa.int64()), pa.array(passages, pa.string()), pa.array(flat.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "passage", "print"])


def _probe(batches: Iterator[pa.RecordBatch], known_keys: np.ndarray, window: int, radius: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the different doc_id, passage, print of the windows that share a key with an item's, as far as
    the filter tells."""
    known = _Words()

    def search(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
        words = [w for t in texts for w in t]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        prints = fingerprints(known.bits(words), window)
        inside = np.flatnonzero(owner[: len(prints)] == owner[window - 1 :])
        keys = block_keys(prints[inside], radius)
        hit = np.zeros(len(inside), bool)
        for row in keys:
            hit[passing(known_keys, row)] = True
        found = {(ids[owner[i]], " ".join(words[i : i + window])): p for i, p in zip(inside[hit].tolist(), prints[inside[hit]].view(np.int64).tolist())}
        docs, passages = zip(*found) if found else ((), ())
        columns = [pa.array(docs, pa.int64()), pa.array(passages, pa.string()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "passage", "print"])

    ids, texts, total = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text or "")
            if len(words) < window:
                continue
            ids.append(doc_id)
            texts.append(words)
            total += len(words)
            if total >= BATCH_WORDS:
                yield search(ids, texts)
                ids, texts, total = [], [], 0
    if texts:
        yield search(ids, texts)


def _keyed(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(passage, print) to key, passage, print, once per key."""
    for batch in batches:
        for row in block_keys(batch.column(1).to_numpy().view(np.uint64), radius):
            yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), *batch.columns], names=["key", "passage", "print"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        shown = [1.0 if a == b else shingle_similarity(a.split(" "), b.split(" ")) for a, b in pairs]
        kept = pa.array([i for i, x in enumerate(shown) if x >= similarity], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(shown, pa.float64()).take(kept)], names=["here", "there", "similarity"]
        )


def leaked_passages(
    docs: DataFrame, items: DataFrame, window: int = 12, radius: int = 2, similarity: float = 0.8
) -> DataFrame:
    """doc_id, item_id, similarity (of their most similar windows), verbatim (whether the document holds a window of the
    item word for word) of all pairs with windows whose fingerprints differ in at most radius bits and whose weighted
    word pairs are at least so similar. docs: doc_id, text. items: item_id, text."""
    if not 0 <= radius <= 9:
        raise ValueError("the radius must be from 0 to 9")
    spark = docs.sparkSession
    own = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    owners = materialize(own.mapInArrow(lambda it: _windows(it, window), "item_id bigint, passage string, print bigint"))
    wanted = materialize(owners.select("passage", "print").distinct())
    schema = "key bigint, passage string, print bigint"
    held = wanted.mapInArrow(lambda it: _keyed(it, radius), schema).toDF("key", "there", "q")
    sent = spark.sparkContext.broadcast(filter_of(held.select("key")))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.length("text") >= 2 * window - 1)
    found = texts.mapInArrow(lambda it: _probe(it, sent.value, window, radius), "doc_id bigint, passage string, print bigint")
    found = materialize(found)
    # each different passage is looked up and verified once, however many documents hold it
    asked = found.select("passage", "print").distinct().mapInArrow(lambda it: kept(_keyed(it, radius), sent.value), schema).toDF("key", "here", "p")
    near = asked.join(held, "key").where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius).select("here", "there").distinct()
    alike = materialize(near.mapInArrow(lambda it: _verified(it, similarity), "here string, there string, similarity double"))
    pairs = found.select("doc_id", F.col("passage").alias("here")).distinct().join(alike, "here")
    pairs = pairs.groupBy("doc_id", "there").agg(F.max("similarity").alias("similarity"), F.bool_or(F.col("here") == F.col("there")).alias("verbatim"))
    named = pairs.join(owners.select("item_id", F.col("passage").alias("there")).distinct(), "there")
    return named.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.bool_or("verbatim").alias("verbatim"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: documents with at least 12 consecutive words of an item; of the similar passages those that are
    the same word for word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = leaked_passages(docs, spark.read.parquet(f"{sf_dir}/eval_item.parquet"))
    return found.where("verbatim").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity of documents with passages like an item's, verbatim or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaked_passages(docs, spark.read.parquet(f"{sf_dir}/eval_item.parquet")).drop("verbatim")


QUERIES = {"p9_found": p9_found, "p9_near": p9_near}
SQL = {
    "p9_found": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item where text is not null),
dw as (select doc_id, array_to_string(w[k:k+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) > 11)),
iw as (select item_id, array_to_string(w[k:k+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) > 11))
select distinct doc_id, item_id from dw join iw using (g)
"""
}
