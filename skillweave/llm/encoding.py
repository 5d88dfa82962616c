"""Encoding of a whole corpus with a public tokenizer (problem 8).

A global shuffle of distinct words. Texts are cut into pre-tokens by the tokenizer's pattern. Per block of
documents the pre-tokens become positions in the block's word list (the explosion, pre-aggregated on the map
side). The words of all blocks meet in one shuffle, each distinct word is encoded once, its ids are joined
back to the blocks and the documents are put together by position. The ids of the FREQUENT words that most blocks
hold are broadcast for that, so that no word of the exchange is in more than a small part of the blocks. Decoding
joins the token-byte table, row by row.

Defined cases: a null or an empty text gives an empty list. Text that looks like a special token is ordinary
text. A repeated doc_id gives as many rows. A text of any length is one document; blocks end after the
document that fills them. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.plans.materialize import materialize

TOKENIZERS = os.environ.get("SKILLWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the vocabulary's pre-token pattern, with white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
BLOCK_CHARS = 4_000_000
#: words whose ids are broadcast, of at most FREQUENT_CHARS characters each: 10 MB at most
FREQUENT, FREQUENT_CHARS = 20_000, 64

_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("words", pa.list_(pa.string())),
    ]
)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import regex

    pieces = regex.compile(PATTERN).findall
    task, number = TaskContext.get().partitionId(), 0
    ids, lengths, codes, words, filled = [], [], [], {}, 0

    def block() -> pa.RecordBatch:
        row = [(task << 32) + number], [ids], [lengths], [np.concatenate(codes or [[]]).astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*row, [list(words)]], _BLOCK.types)], schema=_BLOCK)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = pieces(text) if text else []
            ids.append(doc_id)
            lengths.append(len(found))
            # setdefault counts on: a new word gets the next free code
            codes.append(np.array([words.setdefault(w, len(words)) for w in found], np.int32))
            filled += len(text or "") + 64
            if filled >= size:
                yield block()
                number += 1
                ids, lengths, codes, words, filled = [], [], [], {}, 0
    if ids:
        yield block()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    coder = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={})
    for batch in batches:
        ids = [coder.encode_ordinary(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, lengths = (batch.column(i)[row].values for i in (0, 1))
            codes = np.frombuffer(batch.column(2)[row].as_py(), "<i4")
            entries = batch.column(3)[row].values
            ids = pa.array([], pa.list_(pa.int32())) if entries is None else entries.field(1)
            flat, starts = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)
            sizes = starts[codes] if len(codes) else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(starts)])[codes] if len(codes) else sizes
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            # position k of the output lies in piece p at first[p] + k - ends[p]
            where = np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)
            bounds = ends[np.concatenate([[0], np.cumsum(lengths.to_numpy())]).astype(np.int64)]
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[where.astype(np.int64)] if len(where) else [], pa.int32()))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([doc_ids.slice(i, 1000), out.slice(i, 1000)], names=["doc_id", "ids"])


def encode_corpus(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_file: str = "", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id (bigint), ids (array of int) of every row of docs."""
    path = ranks_file or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    blocks = docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(
        lambda it: _blocks(it, block_chars),
        "block bigint, doc_ids array<bigint>, lengths array<int>, codes binary, words array<string>",
    )
    blocks = materialize(blocks)
    places = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    counted = places.groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(counted.mapInArrow(lambda it: _encode(it, path), "word string, n bigint, ids array<int>"))
    often = words.where(F.length("word") <= FREQUENT_CHARS).orderBy(F.desc("n"), "word").limit(FREQUENT).drop("n")
    often = F.broadcast(materialize(often))
    seldom = places.join(often.select("word"), "word", "left_anti").join(words.drop("n"), "word")
    found = places.join(often, "word").select("block", "pos", "ids").unionByName(seldom.select("block", "pos", "ids"))
    entries = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("entries"))
    whole = blocks.select("block", "doc_ids", "lengths", "codes").join(entries, "block", "left")
    return whole.select("doc_ids", "lengths", "codes", "entries").mapInArrow(_assemble, "doc_id bigint, ids array<int>")


@cache
def token_bytes(path: str) -> pa.Array:
    """The bytes of every token by its id; an id without a token has none."""
    known = ranks(path)
    table: list[bytes] = [b""] * (max(known.values()) + 1)
    for piece, i in known.items():
        table[i] = piece
    return pa.array(table, pa.binary())


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Joins ids and bytes by position: the pieces of a batch lie behind one another, a row's text is a stretch of them."""
    table = token_bytes(path)
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(table))
        pieces = table.take(pa.array(np.where(known, flat, 0).astype(np.int64)))
        sizes = np.where(known, pa.compute.binary_length(pieces).to_numpy(zero_copy_only=False), 0)
        whole = b"".join(p for p, k in zip(pieces.to_pylist(), known) if k)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        cuts = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_corpus(encoded: DataFrame, ranks_file: str = "") -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); rows of one doc_id stay apart. An empty or null list gives "", an
    id that is no token nothing. The token-byte table has as many rows as the vocabulary; each task reads it itself."""
    path = ranks_file or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    own = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return own.mapInArrow(lambda it: _decode(it, path), "doc_id bigint, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chars and digest of the text that decoding the ids gives back (null and empty texts give "")."""
    back = decode_corpus(p8_ids(spark, sf_dir))
    return back.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "select doc_id, cast(length(coalesce(text, '')) as int) as chars, md5(coalesce(text, '')) as digest from documents"}
