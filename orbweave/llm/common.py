"""What the operators share: reading tables, and walking Arrow batches in blocks of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000


#: What Python workers are started with: Arrow's own allocators, and one for each thread, would keep what was freed.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 8_000_000) -> None:
    """From now on an Arrow batch of this session closes at `most` bytes (one longer row still goes whole), and Python workers give
    the memory of batches that they are done with back to the system."""
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null("" if kind == pa.large_string() else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most limit bytes of text or one row."""
    for batch in batches:
        _, ends = utf8(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that scatters them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table64(seed: int, n: int = 256) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _eights(data: np.ndarray) -> np.ndarray:
    """For each byte position the eight bytes from it on as one number (zeros beyond the end)."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _tail(length: np.ndarray) -> np.ndarray:
    """The mask that leaves the first bytes, at most eight, of a number."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.clip(length, 1, 8).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span of bytes, scattered anew every eight bytes; BLAKE2b for spans of more than 64.

    Equal spans have equal hashes. Hashes only propose: what removes, links or reports compares the bytes, or their digests.
    """
    view, length = _eights(data), ends - starts
    out = np.full(len(starts), seed, np.uint64)
    short = np.flatnonzero((length <= 64) & (length > 0))
    short = short[np.argsort(-length[short], kind="stable")]
    if len(short):  # a pass for each eight bytes over the spans that reach them
        s, n, h = starts[short], length[short], np.full(len(short), seed, np.uint64)
        for at in range(0, int(n[0]), 8):
            k = int(np.searchsorted(-n, -at, "left"))
            h[:k] = mix64((h[:k] * np.uint64(0x9E3779B97F4A7C15)) ^ (view[s[:k] + at] & _tail(n[:k] - at)))
        out[short] = h
    for i in np.flatnonzero(length > 64).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(out ^ (length.astype(np.uint64) << np.uint64(1)))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether each span of bytes from a equals the one of the same length from b."""
    view = _eights(data)
    order = np.argsort(-length, kind="stable")
    a, b, length = a[order], b[order], length[order]
    long = int(np.searchsorted(-length, -64, "left"))
    for x, y, n in zip(a[:long].tolist(), b[:long].tolist(), length[:long].tolist(), strict=True):
        if x != y and not np.array_equal(data[x : x + n], data[y : y + n]):
            return False
    a, b, length = a[long:], b[long:], length[long:]
    for at in range(0, int(length[0]) if len(length) else 0, 8):
        k = int(np.searchsorted(-length, -at, "left"))
        if np.any((view[a[:k] + at] ^ view[b[:k] + at]) & _tail(length[:k] - at)):
            return False
    return True


def exact_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each span of bytes, equal for equal spans alone, and a place where each number stands first.

    Spans are told apart by hash and then held against their number's first span, byte for byte; if two spans ever share a hash,
    all are numbered by their bytes.
    """
    numbers, unique = pd.factorize(span_hashes(data, starts, ends))
    example = _first_places(numbers, len(unique))
    length = ends - starts
    if not (np.array_equal(length, length[example][numbers]) and same_spans(data, starts, starts[example][numbers], length)):
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        numbers = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        example = _first_places(numbers, len(known))
    return numbers.astype(np.int64), example


def _first_places(numbers: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[numbers[::-1]] = np.arange(len(numbers))[::-1]
    return out


def row_key(doc_id: str, text: str) -> Column:
    """What a row is known by: the SHA-256 of its id (by kind and length, so none can pose as another) and text."""
    known = F.col(doc_id).cast("string")
    head = F.coalesce(F.concat(F.lit("v"), F.length(known).cast("string"), F.lit(":"), known), F.lit("n"))
    return F.unhex(F.sha2(F.concat(head, F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


#: Rows of keys that may be broadcast; with more, keys and rows are shuffled.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows (count it where that is cheap: a materialised table)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without(df: DataFrame, marks: DataFrame, on: Column, own: str) -> DataFrame:
    """The rows of df that marks (a materialised table with _ow_kept: 0 or 1) doesn't name, and of those it names with 1 one of each `own`."""
    joined = df.join(broadcast_if_small(marks), on, "left")
    stay = joined.filter("_ow_kept IS NULL")
    if marks.filter("_ow_kept = 1").limit(1).count():  # rows that repeat: partial aggregation leaves one of each in every task
        stay = stay.unionByName(joined.filter("_ow_kept = 1").dropDuplicates([own]))
    return stay
