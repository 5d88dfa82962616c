"""Bloom filters of a fixed largest size, so that most rows without a partner never reach an exchange.

A filter is put together by the tasks, 64 bits a key and never more than 2^MOST_BITS bits, whatever the number of
keys; that is what is broadcast. With more keys than it is made for it lets more rows pass, and nothing else changes:
what passes is joined on the keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the largest filter is 32 MB
MOST_BITS = 28
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROUNDS = 3


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * ONE
    return (keys ^ (keys >> np.uint64(29))) * TWO


def _place(keys: np.ndarray, number: int, bits: int) -> np.ndarray:
    return (keys * (np.uint64(1), ONE, TWO)[number]) >> np.uint64(64 - bits)


def _masks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = mixed(batch.column(0).to_numpy().view(np.uint64))
        at = np.unique(np.concatenate([_place(keys, i, bits) for i in range(ROUNDS)]))
        words, which = np.unique(at >> np.uint64(6), return_inverse=True)
        masks = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(masks, which, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"])


def filter_of(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter of a bigint column, as 64-bit words; its size follows the number of rows."""
    bits = min(most_bits, max(16, int(64 * keys.count()).bit_length()))
    found = keys.mapInArrow(lambda it: _masks(it, bits), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def passing(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys (uint64) that may be in the filter; all that are in it, few others."""
    bits, keys = len(words).bit_length() + 5, mixed(keys)
    at = np.arange(len(keys))
    for number in range(ROUNDS):
        place = _place(keys[at], number, bits)
        at = at[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def kept(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose first column, a bigint, may be in the filter."""
    for batch in batches:
        yield batch.take(pa.array(passing(words, batch.column(0).to_numpy().view(np.uint64))))
