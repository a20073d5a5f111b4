"""Vectorised text kernels over Arrow batches, shared by the free-style operators.

A batch is cut into chunks of bounded text size; within a chunk the words are
dictionary encoded, so Python touches each distinct word once and numpy the rest.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def texts_of(column) -> pa.LargeStringArray:
    """The column as large strings with null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


@functools.cache
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def relax() -> None:
    """Give the memory of finished chunks back: workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Slices of at most ``size`` bytes of text (or one row) with their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            # only the slice is copied: a batch can hold many long texts
            yield batch.slice(at, to - at), texts_of(column.slice(at, to - at))
            at = to
            relax()


def split_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, distinct): the ``[^\\x20\\x09-\\x0D]+`` words of each text.

    Words offsets[i]:offsets[i + 1] of codes belong to text i."""
    # a space added at both ends makes every first and last item empty
    listed = pc.ascii_split_whitespace(texts)
    offsets = listed.offsets.to_numpy().astype(np.int64)
    words = listed.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets = before[offsets]
        words = words.filter(pa.array(keep))
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def hash_words(words: list[str], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(word_hash: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of n words; runs do not cross texts."""
    total = len(word_hash)
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hash[: total - n + 1].copy()
    for k in range(1, n):
        h *= MIX
        h += word_hash[k : total - n + 1 + k]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[: total - n + 1] == owner[n - 1 :]
    return mix(h[inside]), owner[: total - n + 1][inside]


def distinct_pairs(owner: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) in order, with counts; value has at most ``bits`` bits."""
    key, n = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | value.astype(np.uint64), return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1), n
