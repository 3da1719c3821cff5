"""Sharding by vector bin packing.

Each group of equal texts has a size in three dimensions: bytes, tokens and rows. Every group is placed, from the largest
down, where the dot product of its size with the shards' residual capacity is highest, so bytes, tokens and rows
are balanced together. The driver places the heavy groups, those that hold more than 1/HEAVY of any dimension: fewer than 3 * HEAVY,
however large the corpus. All others are dealt by hash into batches of about BATCH groups, and each batch is packed by a
task of its own: its residual is what the heavy groups have left in each shard, scaled to the batch. Batches hold groups of all
sizes, and a batch's last and smallest groups even it out, so errors don't add up.

One rule for a group that alone holds more bytes than a shard may: it is cut, by row, into as many pieces as it fills shards,
since no shard could be near equal otherwise; the column pieces tells (1: whole). A group of many short rows is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import table

HEAVY, BATCH = 4096, 50_000
#: Rows that get their slots together, and the most such blocks a shard has.
SLOT_BLOCK, SLOT_BLOCKS = 20_000, 4096
DIMENSIONS = ["size", "tokens", "rows"]


def pack(items: np.ndarray, residual: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A shard for each item (a row of sizes): from the largest down, where the dot product with the residual is highest.

    residual, a row for each shard, is in shares of total and is used up; the items' order breaks ties.
    """
    parts = items / np.maximum(total, 1)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-parts.max(axis=1), kind="stable").tolist():
        out[i] = k = int((residual @ parts[i]).argmax())
        residual[k] -= parts[i]
    return out


def measured(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), tokens (runs without white space), text_crc32, _g (the group), _r (the row)."""
    own = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(own) + 1).cast("long").alias("size"),
        F.regexp_count(own, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(own.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(own.cast("binary"), 256)).alias("_g"),
        F.monotonically_increasing_id().alias("_r"),
    )


def shard(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, tokens, text_crc32, law (`bytes`), shard, slot (gapless from 0 in each shard), grown_shard (null), pieces.

    A null text counts as empty. Equal texts share a shard unless their group alone exceeds a shard's bytes (pieces over 1); repeated rows
    are rows of their own, each with its own slot. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    rows = materialise(measured(df, doc_id, text), "measured")
    groups = materialise(rows.groupBy("_g").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    first = groups.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    total = np.array([first[d] for d in DIMENSIONS], float)
    heavy = " OR ".join(f"{d} * {HEAVY} > {max(1, first[d])}" for d in DIMENSIONS)

    items, keys = [], []  # fewer than 3 * HEAVY groups, by the definition of heavy, and their pieces
    for r in groups.filter(heavy).orderBy("_g").collect():
        pieces = max(1, -(-r["size"] * shards // max(1, first["size"])))
        for piece in range(pieces):
            keys.append((bytes(r["_g"]), piece, pieces))
            items.append([r[d] / pieces for d in DIMENSIONS])
    residual = np.full((shards, len(DIMENSIONS)), 1 / shards)
    placed = pack(np.array(items, float).reshape(-1, len(DIMENSIONS)), residual, total).tolist()
    by_hand = spark.createDataFrame([(*key, k) for key, k in zip(keys, placed, strict=True)], "_g binary, _piece int, pieces int, shard int")

    left = np.maximum(residual, 0)
    left /= np.maximum(left.sum(axis=0), 1e-12)

    def settle(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("_g")  # the order of rows doesn't matter
        own = np.column_stack([batch.column(d).to_numpy() for d in DIMENSIONS]).astype(float)
        return pa.table({"_g": batch.column("_g"), "shard": pa.array(pack(own, left.copy(), own.sum(axis=0)).astype(np.int32))})

    batches = max(1, -(-first["n"] // BATCH))
    dealt = groups.filter(f"NOT ({heavy})").withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(batches)))
    light = dealt.groupBy("_b").applyInArrow(settle, "_g binary, shard int")

    cut = F.broadcast(by_hand.select("_g", "pieces").distinct())  # fewer than 3 * HEAVY rows
    whole = rows.join(cut, "_g", "left_anti").join(light, "_g").withColumn("pieces", F.lit(1))  # none of these groups is hot
    by_hand = F.broadcast(by_hand.drop("pieces"))
    pieces = rows.join(cut, "_g").withColumn("_piece", F.pmod(F.xxhash64("_r"), F.col("pieces")).cast("int")).join(by_hand, ["_g", "_piece"])
    columns = ["doc_id", "size", "tokens", "text_crc32", "_r", "shard", "pieces"]
    put = materialise(whole.select(*columns).unionByName(pieces.select(*columns)), "put")
    for spent in (rows, groups):
        discard(spent)

    count = min(SLOT_BLOCKS, max(1, first["rows"] // (SLOT_BLOCK * shards) + 1))
    put = put.withColumn("_block", F.pmod(F.xxhash64("_r"), F.lit(count)).cast("int"))
    filled = put.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = filled.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "_r")) - 1
    return (
        put.withColumn("_own", own)
        .join(F.broadcast(before), ["shard", "_block"])  # at most shards * SLOT_BLOCKS rows
        .select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "pieces")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)
