"""Training samples and what is measured of them: thinning, exact splits, band statistics, confusion and accuracy.

A samples table has ord (the order of collection), label, r, c, features (ARRAY) and source_id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BLOCKS = 1024


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible random order."""
    return F.xxhash64(F.lit(seed), *columns)


def category_codes(labels: DataFrame, column: str) -> DataFrame:
    """value, code: the rank from 1 of each value that isn't null, in order; taken over all rows, before any filter."""
    values = labels.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")))  # one row for each class


def thin(samples: DataFrame, grid: int, order: Column | None = None, seed: int = 42) -> DataFrame:
    """One sample for each label and square of grid cells: the first in a random (or the given) order."""
    if grid < 1:
        raise ValueError("grid_size must be >= 1.")
    if grid == 1:
        return samples
    order = seeded(seed, "ord") if order is None else order
    fields = [c for c in samples.columns if c != "label"]
    keys = [F.col("label"), F.floor(F.col("r") / grid).alias("_gr"), F.floor(F.col("c") / grid).alias("_gc")]
    best = samples.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(order, "ord")).alias("s"))  # partial: no square is gathered
    return best.select("label", "s.*").select(*samples.columns)


def ranked(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with rank, from 1 in each group by a 64-bit order: blocks of the order's range are ranked apart, and start after those before."""
    block = F.shiftright(F.col(order), 64 - int(math.log2(RANK_BLOCKS)))
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = counts.select(by, "_block", (F.sum("_n").over(Window.partitionBy(by).orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_block").orderBy(order, "ord"))
    return rows.withColumn("_own", own).join(before, [by, "_block"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def quotas(counts: dict[int, int], fraction: float) -> dict[int, int] | None:
    """Of each class, how many samples are held out: ceil(fraction * n) in all, by the largest remainder; None where a class would be
    missing on a side, so that the split can't be by class."""
    n = sum(counts.values())
    test = math.ceil(fraction * n)
    if min(counts.values()) < 2 or test < len(counts) or n - test < len(counts):
        return None
    share = {k: v * test / n for k, v in counts.items()}
    out = {k: math.floor(v) for k, v in share.items()}
    for k in sorted(share, key=lambda k: (out[k] - share[k], k))[: test - sum(out.values())]:
        out[k] += 1
    return out


def split(samples: DataFrame, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """Training and held-out samples, by class in exact numbers; all for training if fraction is 0 or less."""
    if fraction <= 0:
        return samples, None
    if fraction >= 1:
        raise ValueError("test_fraction must be between 0 and 1.")
    counts = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    own = quotas(counts, fraction) if len(counts) > 1 else None
    keyed = samples.withColumn("_order", seeded(seed, "ord"))
    if own is None:
        marked = ranked(keyed.withColumn("_all", F.lit(0)), "_all", "_order").withColumn("_held", F.col("rank") <= math.ceil(fraction * sum(counts.values())))
    else:
        quota = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
        marked = ranked(keyed, "label", "_order").withColumn("_held", F.col("rank") <= quota[F.col("label")])
    return marked.filter("NOT _held").select(*samples.columns), marked.filter("_held").select(*samples.columns)


def class_band_stats(samples: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """label, band (from 1), n, mean, std: population deviation; NaN counts as no value. With labels given, each of them has a row for
    every band: one without samples has n 0 and NaN."""
    each = samples.select("label", F.posexplode("features").alias("band", "v"))
    v = F.when(~F.isnan("v"), F.col("v").cast("double"))
    found = each.groupBy("label", (F.col("band") + 1).alias("band")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    if labels is None:
        return found
    bands = samples.agg(F.coalesce(F.max(F.size("features")), F.lit(0)).alias("k"))  # one row
    wanted = samples.sparkSession.createDataFrame([(int(x),) for x in labels], "label int").crossJoin(F.broadcast(bands)).select("label", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("band")).filter("band > 0")
    nan = F.lit(float("nan"))
    return wanted.join(found.withColumn("label", F.col("label").cast("int")), ["label", "band"], "left").select("label", "band", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), nan).otherwise(F.col("mean")).alias("mean"), F.when(F.col("n").isNull(), nan).otherwise(F.col("std")).alias("std"))


def label_preview(names: dict[int, str], most: int = 10) -> str:
    """The first codes and their labels, and dots if there are more."""
    return ", ".join(f"{k}:{v}" for k, v in list(names.items())[:most]) + (" ..." if len(names) > most else "")


def confusion(pairs: DataFrame, labels: Sequence[int]) -> DataFrame:
    """truth, and pred_<label> for each label, in the order given; a label without samples is a row of zeros."""
    found = pairs.groupBy("truth").pivot("pred", list(labels)).count()
    rows = pairs.sparkSession.createDataFrame([(int(x),) for x in labels], "truth int")
    return rows.join(found, "truth", "left").select("truth", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels])


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def misclassified(pairs: DataFrame) -> DataFrame:
    """The sources of wrong predictions, each once, in order."""
    return pairs.filter("truth <> pred").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"))


def at_samples(samples: DataFrame, raster: DataFrame, width: int, height: int, nodata: float = -1) -> tuple[DataFrame, DataFrame]:
    """truth and pred of the samples that lie in the raster and on a class, and how many were left out: outside, nodata."""
    inside = F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)
    found = samples.withColumn("_in", inside).join(raster.select("r", "c", "class"), ["r", "c"], "left")
    empty = F.col("class").isNull() | (F.col("class") == nodata) | F.isnan(F.col("class").cast("double"))
    lost = found.agg(F.count_if(~F.col("_in")).alias("outside"), F.count_if(F.col("_in") & empty).alias("nodata"))
    return found.filter(F.col("_in") & ~empty).select(F.col("label").alias("truth"), F.col("class").alias("pred"), "source_id"), lost
