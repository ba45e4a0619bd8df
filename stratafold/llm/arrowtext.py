"""Columnar text helpers shared by the Arrow-batched operators.

A batch of texts is split into words once, in Arrow's C++ kernels, and
described by numpy arrays: which distinct word each token is, and where each
text's tokens begin. Per-word work is then done once per distinct word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratafold.session import ship

#: Bytes of text that one slice holds at most (a single longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Rows and bytes of one Arrow batch between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def bound_batches(spark) -> None:
    """Bound the Arrow batches by bytes as well as rows, so that long texts cannot make one batch huge; see that executors have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts as an Arrow string array, null as ''."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on and serves other operators."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, count) of consecutive runs of texts of about `limit` bytes; freed memory is given back after the last."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last - first
        first = last
    give_back()


@dataclass
class Words:
    """Tokens of a run of texts: `index` into `distinct` per token, `begin[i]:begin[i+1]` the tokens of text i."""

    distinct: pa.Array
    index: np.ndarray
    begin: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per token, by text."""
        return segment_sums(values, self.begin)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def segment_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums over begin[i]:begin[i+1]; 0 for an empty run."""
    out = np.zeros(len(begin) - 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(values, begin[full], dtype=out.dtype)
    return out


def words_of(texts: pa.Array) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, dictionary-encoded."""
    split = pc.ascii_split_whitespace(texts)
    begin = np.asarray(split.offsets.to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = begin - begin[0]
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # a text that begins or ends with white space, or has nothing else
        keep = index != empty
        begin = np.concatenate(([0], np.cumsum(keep)))[begin]
        index = index[keep]
        index -= index > empty
        distinct = pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return Words(distinct, index, begin)


class WordTable:
    """A row of numbers for each word, made once and remembered while the word keeps coming; `make` gives the rows of new words."""

    LIMIT = 300_000

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make = make
        self.known, self.rows = pa.array([], pa.string()), make([])
        self.met = np.empty(0, np.int64)
        self.turn = 0

    def of(self, distinct: pa.Array) -> np.ndarray:
        self.turn += 1
        if len(self.known) > self.LIMIT:  # the half that was met last stays
            keep = np.sort(np.argsort(-self.met, kind="stable")[: self.LIMIT // 2])
            self.known, self.rows, self.met = self.known.take(pa.array(keep)), self.rows[keep], self.met[keep]
        found = pc.index_in(distinct, self.known)
        slot = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            new = distinct.filter(pc.is_null(found))
            slot[slot < 0] = len(self.known) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, self.make(new.to_pylist())])
            self.known = pa.concat_arrays([self.known, new])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[slot] = self.turn
        return self.rows[slot]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each distinct word."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))
