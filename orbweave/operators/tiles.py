"""Tile grids, the scene-tile join, and what selected scenes give each tile.

A tiles table has tile_id, tx, ty (its place in the grid), xmin, ymin, xmax, ymax. Joins go by grid cell: a scene's box is spread over
the cells it can touch, the rest is an equi-join, and only pairs that share a cell are tested.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scoring as S


@dataclass(frozen=True)
class Grid:
    """A grid of square tiles from (x, y); nx and ny tiles, the last ones clipped to (xmax, ymax)."""

    x: float
    y: float
    xmax: float
    ymax: float
    size: float

    @property
    def nx(self) -> int:
        return max(1, math.ceil((self.xmax - self.x) / self.size))

    @property
    def ny(self) -> int:
        return max(1, math.ceil((self.ymax - self.y) / self.size))


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All tiles, x outer and y inner: a range that is cut among tasks."""
    i = spark.range(grid.nx * grid.ny)
    tx, ty = F.floor(F.col("id") / grid.ny).cast("int"), F.pmod(F.col("id"), F.lit(grid.ny)).cast("int")
    low = i.select("id", tx.alias("tx"), ty.alias("ty")).withColumns({"xmin": grid.x + F.col("tx") * grid.size, "ymin": grid.y + F.col("ty") * grid.size})
    return low.withColumns({"xmax": F.least(F.col("xmin") + grid.size, F.lit(grid.xmax)), "ymax": F.least(F.col("ymin") + grid.size, F.lit(grid.ymax))})


def tile_grid(spark: SparkSession, area: geo.Geometry, size: float) -> DataFrame:
    """The tiles that touch an area, numbered in grid order; an area that none touches is one tile, its envelope."""
    if size <= 0:
        raise ValueError("tile_size_m must be positive.")
    xmin, ymin, xmax, ymax = area.bounds()
    grid = Grid(xmin, ymin, xmax, ymax, size)
    touched = cells(spark, grid).filter(geo.touches_box(area)("xmin", "ymin", "xmax", "ymax"))
    if not touched.limit(1).count():
        touched = spark.createDataFrame([(0, 0, 0, xmin, ymin, xmax, ymax)], "id long, tx int, ty int, xmin double, ymin double, xmax double, ymax double")
    # Numbers without a window over all tiles: those of the columns of tiles before, then the place in the column.
    counts = touched.groupBy("tx").agg(F.count("*").alias("n"))
    before = counts.select("tx", (F.sum("n").over(Window.orderBy("tx")) - F.col("n")).alias("before"))  # a row for each column of tiles
    own = F.row_number().over(Window.partitionBy("tx").orderBy("ty")) - 1
    return touched.withColumn("own", own).join(before, "tx").select((F.col("before") + F.col("own")).cast("int").alias("tile_id"), "tx", "ty", "xmin", "ymin", "xmax", "ymax")


def _span(low: Column, high: Column, origin: float, size: float, n: int) -> Column:
    """The cells that an interval touches; an end on a border touches both sides."""
    first = F.greatest(F.lit(0), F.ceil((low - origin) / size).cast("int") - 1)
    last = F.least(F.lit(n - 1), F.floor((high - origin) / size).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def scene_tile_join(scenes: DataFrame, tiles: DataFrame, grid: Grid, exact: Column | None = None) -> DataFrame:
    """A row for each scene and tile that touch. scenes has xmin, ymin, xmax, ymax; `exact` may test more, of both sides' columns."""
    spread = scenes.withColumn("tx", F.explode(_span(F.col("xmin"), F.col("xmax"), grid.x, grid.size, grid.nx))).withColumn("ty", F.explode(_span(F.col("ymin"), F.col("ymax"), grid.y, grid.size, grid.ny)))
    t = tiles.select("tx", "ty", "tile_id", *[F.col(c).alias(f"tile_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    touch = (F.col("xmin") <= F.col("tile_xmax")) & (F.col("xmax") >= F.col("tile_xmin")) & (F.col("ymin") <= F.col("tile_ymax")) & (F.col("ymax") >= F.col("tile_ymin"))
    found = spread.join(t, ["tx", "ty"]).filter(touch)
    return found.filter(exact) if exact is not None else found


def tile_state(pairs: DataFrame, by: list[str]) -> DataFrame:
    """What the scenes of a scene-tile table give each tile: clear_obs, mean_azimuth, mean_elevation (null where unknown)."""
    w = F.greatest(F.col("clear_fraction"), F.lit(0.0))
    angle = F.radians(F.pmod(F.col("sun_azimuth"), F.lit(360.0)))
    known = F.when(F.col("sun_azimuth").isNotNull(), w)
    sums = pairs.groupBy(*by, "tile_id").agg(
        F.sum("clear_fraction").alias("clear_obs"),
        F.sum(F.cos(angle) * w).alias("ax"),
        F.sum(F.sin(angle) * w).alias("ay"),
        F.sum(known).alias("aw"),
        F.sum(F.col("sun_elevation") * w).alias("es"),
        F.sum(F.when(F.col("sun_elevation").isNotNull(), w)).alias("ew"),
    )
    return sums.select(*by, "tile_id", "clear_obs", S.mean_direction(F.col("ax"), F.col("ay"), F.col("aw")).alias("mean_azimuth"), F.when(F.col("ew") > 0, F.col("es") / F.col("ew")).alias("mean_elevation"))


def coverage_depth(state: DataFrame, tiles: DataFrame, by: list[str], groups: DataFrame, min_clear_obs: float) -> DataFrame:
    """For each group: the share of tiles that any scene covers, and of those seen clear min_clear_obs times or more; 1 without tiles."""
    n = tiles.agg(F.count("*").alias("tile_count"))
    seen = state.groupBy(*by).agg(F.count("*").alias("covered"), F.count_if(F.col("clear_obs") >= min_clear_obs).alias("deep"))
    joined = groups.join(seen, by, "left").crossJoin(F.broadcast(n))  # one row
    part = lambda c: F.when(F.col("tile_count") == 0, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.when(F.col("tile_count") > 0, F.col("tile_count")))
    return joined.select(*by, "tile_count", part("covered").alias("coverage"), part("deep").alias("depth"))


def scores(pairs: DataFrame, state: DataFrame, by: list[str], min_clear_obs: float = 3.0, azimuth_sigma: float = 20.0, elevation_sigma: float = 10.0, quality_weight: float = 0.35) -> DataFrame:
    """Each scene's score against the tiles' state: over the tiles that lack coverage or depth, (1 + what is lacking) times
    clear fraction, similarity of light and quality multiplier. Tiles without a state row have nothing yet."""
    joined = pairs.join(state, [*by, "tile_id"], "left")
    have = F.coalesce(F.col("clear_obs"), F.lit(0.0))
    lacking = F.greatest(F.lit(0.0), F.lit(min_clear_obs) - have)
    needs = F.col("clear_obs").isNull() | (have < min_clear_obs)
    light = S.similarity(F.col("sun_azimuth"), F.col("sun_elevation"), F.col("mean_azimuth"), F.col("mean_elevation"), azimuth_sigma, elevation_sigma)
    part = F.when(needs, (1.0 + lacking) * F.col("clear_fraction") * light * S.quality_multiplier(F.col("quality_score"), quality_weight)).otherwise(0.0)
    return joined.groupBy(*by, "ord", "item_id").agg(F.sum(part).alias("score"))
