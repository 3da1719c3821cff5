"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, whatever stands before; a chunk is known by its
SHA-256. The chunk store holds each different chunk once, and its identifiers are verified against the bytes: if one
identifier ever stood for two chunks, the job stops. A document is then its recipe, the ordered list of chunk
identifiers, and documents are equal when their recipes are. A text's bytes cross the network once, as chunks that
each task has already made distinct; afterwards only recipes move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import blocks, bounded_batches, table, table64, utf8, without

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 8192, 10


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, the ends of its chunks, from its start; MIN_CHUNK exceeds the hash's window, so no text sees another."""
    h = table64(7).astype(np.uint32)[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += older
    found = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ends, at = [], int(a)
        mine = found[np.searchsorted(found, a, "right") : np.searchsorted(found, b, "left")]
        while at < b:
            k = np.searchsorted(mine, at + MIN_CHUNK)
            at = int(min(mine[k] if k < len(mine) else b, at + MAX_CHUNK, b))
            ends.append(at - int(a))
        out.append(np.array(ends, np.int64))
    return out


def _chunks(texts: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    data, offsets = utf8(texts)
    raw = data.tobytes()
    for a, ends in zip(offsets[:-1].tolist(), cuts(data, offsets), strict=False):
        at, parts = 0, []
        for end in ends.tolist():
            parts.append(raw[a + at : a + end])
            at = end
        yield raw[a : a + at], parts


def chunk_store(df: DataFrame, text: str = "text") -> DataFrame:
    """Each different chunk once: chunk_id (SHA-256), chunk. Raises nothing by itself; see verify()."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = {p for _, parts in _chunks(block.column("text")) for p in parts}
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).digest() for p in found], pa.binary()), pa.array(list(found), pa.binary())], ["chunk_id", "chunk"])

    return df.select(F.col(text).alias("text")).mapInArrow(cut, "chunk_id binary, chunk binary").distinct()


def verify(store: DataFrame) -> None:
    """Stop if one identifier stands for two different chunks."""
    if store.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a chunk identifier stands for two different chunks")


def recipes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, recipe (chunk identifiers, 32 bytes each, in order), n_chunks, text_sha256, n_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = [(b"".join(hashlib.sha256(p).digest() for p in parts), len(parts), hashlib.sha256(whole).hexdigest(), len(whole)) for whole, parts in _chunks(block.column("text"))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.string(), pa.int64()), strict=True))], ["doc_id", "recipe", "n_chunks", "text_sha256", "n_bytes"])

    kind = dict(df.dtypes)[doc_id]
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, f"doc_id {kind}, recipe binary, n_chunks int, text_sha256 string, n_bytes long")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, n_bytes.

    Null and empty texts are equal. Of equal texts the row with the largest doc_id stays; a null doc_id stays only
    if its group has no other. Rows that repeat both doc_id and text share one fate: all are kept or none, and
    kept_rows() leaves one of them. An empty table gives an empty result; other columns are not read.
    """
    bounded_batches(df.sparkSession)
    verify(chunk_store(df, text))
    found = materialise(recipes(df, doc_id, text), "recipes")
    groups = found.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Rows find their group by the recipe's digest: short, and dealt out anew, so that a hot group's rows can be split.
    groups = groups.select(F.unhex(F.sha2("recipe", 256)).alias("digest"), F.col("recipe").alias("own"), "keep_id", "group_size")
    rows = found.withColumn("digest", F.unhex(F.sha2("recipe", 256)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return rows.join(groups, "digest").filter(F.col("recipe") == F.col("own")).select("doc_id", "keep_id", "group_size", kept, "text_sha256", "n_chunks", "n_bytes")


def kept_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns: one of each group of equal texts. Rows that stay don't move: only the
    marks of rows that go, and of rows that repeat one that stays, are held against df."""
    marks = exact_dedup(df, doc_id, text).groupBy(F.col("doc_id").alias("_ow_id"), F.col("text_sha256").alias("_ow_sha")).agg(F.max(F.col("kept").cast("int")).alias("_ow_kept"), F.count("*").alias("_ow_n"))
    marks = materialise(marks.filter("_ow_kept = 0 OR _ow_n > 1"), "marks")
    keyed = df.withColumn("_ow_key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return without(keyed, marks, (F.col("_ow_key") == F.col("_ow_sha")) & F.col(doc_id).eqNullSafe(F.col("_ow_id")), "_ow_key").select(*df.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
