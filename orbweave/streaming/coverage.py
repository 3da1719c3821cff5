"""Coverage as scenes arrive: the tiles' state kept up to date by a stream of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tiles as T


def tile_coverage(scenes: DataFrame, tiles: DataFrame, grid: T.Grid) -> DataFrame:
    """month, tile_id, scenes, clear_obs of a stream (or table) of scenes with month, clear_fraction and a box. The tiles are a static side;
    state is a row for each month and tile, and output goes in update mode."""
    pairs = T.scene_tile_join(scenes.select("month", "clear_fraction", "xmin", "ymin", "xmax", "ymax"), tiles, grid)
    return pairs.groupBy("month", "tile_id").agg(F.count("*").alias("scenes"), F.sum("clear_fraction").alias("clear_obs"))
