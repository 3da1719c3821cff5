"""Mosaics: strips masked by usability, brought to one coordinate system and grid, blended, and given NDVI.

Strips are brought to the common grid by bicubic interpolation and blended by a feather whose weight is the distance to the edge of a strip's data, over the
strips that have data in a cell.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as C
from ..operators import orders as O
from ..operators import raster as R
from ..session import materialise
from ..sources import raster as files

log = logging.getLogger("orbweave.mosaic")

#: Fixed value: the output cell, in units of the coordinate system.
CELL = 3.0
#: Fixed value: points between the corners of a strip's side when its bounds go through a coordinate system.
EDGE = 21


@dataclass(frozen=True)
class MosaicJob:
    inputs: Sequence[str]
    output: str
    udms: Sequence[str] | None = None
    workdir: str | None = None
    tmpdir: str | None = None
    ram: int = 131072
    jobs: int = 4
    skip_masking: bool = False
    sr_bands: int = 4
    ndvi: bool = False
    target_crs: str | None = None


@dataclass(frozen=True)
class ProjectionInfo:
    path: str
    crs: str
    label: str = field(default="")
    center_lonlat: tuple[float, float] = (0.0, 0.0)


def projection(path: str, grid: R.Grid) -> ProjectionInfo:
    """A strip's coordinate system and its centre: that of its bounds in degrees, which follow EDGE points more along each side; in its own units where that
    can't be computed."""
    if grid.crs is None:
        raise ValueError(f"{path} has no CRS.")
    a, b, x, d, e, y = grid.transform
    corners = [(x + a * i + b * j, y + d * i + e * j) for i in (0, grid.width) for j in (0, grid.height)]
    (left, right), (bottom, top) = [(min(v), max(v)) for v in zip(*corners, strict=True)]
    across, up = np.linspace(left, right, EDGE + 2), np.linspace(bottom, top, EDGE + 2)
    xs = np.concatenate([across, across, np.full(EDGE + 2, left), np.full(EDGE + 2, right)])
    ys = np.concatenate([np.full(EDGE + 2, bottom), np.full(EDGE + 2, top), up, up])
    try:
        lon, lat = C.transform(grid.crs, "EPSG:4326", xs, ys)
        if not (np.isfinite(lon).all() and np.isfinite(lat).all()):
            raise ValueError("outside the system's area")
        centre = float(lon.min() + lon.max()) / 2, float(lat.min() + lat.max()) / 2
    except ValueError:
        log.warning("The centre of %s can't be given in degrees.", path)
        centre = (left + right) / 2, (bottom + top) / 2
    return ProjectionInfo(path, grid.crs, C.label(grid.crs), centre)


def target_crs(spark: SparkSession, infos: Sequence[ProjectionInfo], asked: str | None = None) -> str:
    """The system asked for, else the most frequent one, else of those the one with a strip nearest to the mean centre."""
    if not infos:
        raise ValueError("No projection metadata available for mosaicking.")
    if asked:
        try:
            return f"EPSG:{C.code(asked)}"
        except ValueError as why:
            raise ValueError(f"Invalid target CRS '{asked}'.") from why
    rows = spark.createDataFrame([(i.label, *i.center_lonlat) for i in infos], "label string, lon double, lat double")
    winner = O.crs_choice(rows).first()["label"]
    return next(i.crs for i in infos if i.label == winner)


def blend(pixels: DataFrame, bands: Sequence[str], nodata: float = 0.0, by: str = "strip") -> DataFrame:
    """r, c, the bands and the number of strips: the mean of the strips that have data in a cell, weighted by the cell's distance to the nearest
    cell where the strip has none."""
    some = F.lit(False)
    for b in bands:
        some = some | (F.col(b) != nodata)
    there = pixels.filter(some)
    weighed = there.join(R.edge_distance(there, by).withColumnRenamed("edge", "w"), [by, "r", "c"])
    return weighed.groupBy("r", "c").agg(*[(F.sum(F.col("w") * F.col(b)) / F.sum("w")).alias(b) for b in bands], F.count("*").alias("strips"))


class MosaicWorkflow:
    def __init__(self, job: MosaicJob, spark: SparkSession) -> None:
        self.job, self.spark = job, spark

    def check(self) -> None:
        if self.job.ram <= 0:
            raise ValueError("ram must be positive.")
        if self.job.ndvi and self.job.sr_bands not in R.NDVI_BANDS:
            raise ValueError("sr_bands must be 4 or 8.")
        if not self.job.skip_masking and not self.job.udms:
            raise ValueError("UDMs are required unless masking is skipped.")

    def run(self) -> str:
        """Writes the mosaic and returns its path: a GeoTIFF, or Parquet where the name doesn't end in .tif."""
        self.check()
        strips = files.expand(self.job.inputs, both=False)
        if self.job.skip_masking:
            tables = [(s, *files.read(self.spark, s)) for s in strips]
        else:
            tables = [self._masked(s, u) for s, u in R.paired(strips, files.expand(self.job.udms, both=False))]
        pixels, grid = self.composite(sorted(tables, key=lambda t: t[0]))
        if self.job.ndvi:
            pixels = R.with_ndvi(pixels, self.job.sr_bands)
        n = len(pixels.first()["bands"]) if pixels.limit(1).count() else 0
        if self.job.output.lower().endswith((".tif", ".tiff")):
            files.write(pixels.select("r", "c", *[F.element_at("bands", k + 1).alias(f"b{k}") for k in range(n)]), self.job.output, grid, [f"b{k}" for k in range(n)], "float32")
        else:
            pixels.write.mode("overwrite").parquet(os.fspath(self.job.output))
        return self.job.output

    def _masked(self, strip: str, udm: str) -> tuple[str, DataFrame, R.Grid]:
        pixels, grid = files.read(self.spark, strip)
        mask, mask_grid = files.read(self.spark, udm)
        grid = repaired(grid, mask_grid)
        joined = pixels.join(mask.select("r", "c", F.element_at("bands", 1).alias("udm")), ["r", "c"], "left")
        return strip, joined.select("r", "c", F.when(F.col("udm") == 1, F.col("bands")).otherwise(F.transform("bands", lambda _: F.lit(0.0))).alias("bands")), grid

    def composite(self, tables: list[tuple[str, DataFrame, R.Grid]]) -> tuple[DataFrame, R.Grid]:
        """All strips on one grid of CELL units, blended."""
        crs = target_crs(self.spark, [projection(s, g) for s, _, g in tables], self.job.target_crs)
        xs, ys = [], []
        for _, _, g in tables:
            a, b, x, d, e, y = g.transform
            corners = [(x + a * i + b * j, y + d * i + e * j) for i in (0, g.width) for j in (0, g.height)]
            px, py = C.transform(g.crs, crs, *zip(*corners, strict=True))
            xs += px.tolist()
            ys += py.tolist()
        size = lambda v: max(1, round((max(v) - min(v)) / CELL))
        grid = R.Grid(size(xs), size(ys), (CELL, 0.0, min(xs), 0.0, -CELL, max(ys)), crs, (0.0,))
        strips = None
        for k, (_, pixels, g) in enumerate(tables):
            own = R.resampled(pixels, g, grid).select("r", "c", F.transform("bands", lambda x: x.cast("double")).alias("bands")).withColumn("strip", F.lit(k))
            strips = own if strips is None else strips.unionByName(own)
        strips = materialise(strips, "strips")
        n = strips.select(F.max(F.size("bands"))).first()[0] or 0
        names = [f"b{k}" for k in range(n)]
        wide = strips.select("strip", "r", "c", *[F.element_at("bands", k + 1).alias(f"b{k}") for k in range(n)])
        return blend(wide, names).select("r", "c", F.array(*names).alias("bands")), grid


def repaired(strip: R.Grid, mask: R.Grid) -> R.Grid:
    """The strip's place on earth, or where it has none its mask's; without either an error."""
    plain = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    for g in (strip, mask):
        if g.crs is not None and tuple(g.transform) != plain:
            return R.Grid(strip.width, strip.height, g.transform, g.crs, strip.nodata)
    raise ValueError("Neither the strip nor its UDM is georeferenced.")


def run_mosaic(job: MosaicJob, spark: SparkSession) -> str:
    return MosaicWorkflow(job, spark).run()
