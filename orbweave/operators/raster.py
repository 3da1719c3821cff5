"""Rasters as pixel tables: r, c and bands (ARRAY) or one column for each band.

A grid (crs, affine transform, width, height) is a small record on the driver. Everything by pixel is columns; what needs a neighbourhood
goes by blocks with a halo, one shuffle for any number of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs as C


@dataclass(frozen=True)
class Grid:
    """x = a * col + b * row + c and y = d * col + e * row + f, for the corner of a cell."""

    width: int
    height: int
    transform: tuple[float, float, float, float, float, float]
    crs: str | None = None
    nodata: tuple[float | None, ...] = ()

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        a, b, x, d, e, y = self.transform
        return x + (c + 0.5) * a + (r + 0.5) * b, y + (c + 0.5) * d + (r + 0.5) * e

    def inverse(self) -> tuple[float, float, float, float, float, float]:
        a, b, x, d, e, y = self.transform
        det = a * e - b * d
        if det == 0:
            raise ValueError("The transform can't be inverted.")
        return e / det, -b / det, (b * y - e * x) / det, -d / det, a / det, (d * x - a * y) / det

    def same(self, other: Grid) -> bool:
        return (self.width, self.height) == (other.width, other.height) and self.crs == other.crs and np.allclose(self.transform, other.transform)


def nodata_list(values: float | Iterable[float | None] | None, bands: int) -> list[float | None]:
    """One value for each band: one alone holds for all, missing ones are None, further ones are left out."""
    own = [None] if values is None else list(values) if isinstance(values, Iterable) and not isinstance(values, (str, bytes)) else [values]
    if len(own) == 1:
        own = own * bands
    return (own + [None] * bands)[:bands]


def band_list(wanted: Sequence[int] | None, total: int) -> list[int]:
    """Band numbers from 1, in the order asked for: some, each once, each there."""
    if wanted is None:
        return list(range(1, total + 1))
    out = [int(b) for b in wanted]
    if not out:
        raise ValueError("band_indices must not be empty.")
    if len(set(out)) < len(out):
        raise ValueError("band_indices must be unique.")
    if min(out) < 1 or max(out) > total:
        raise ValueError(f"band_indices must be between 1 and {total}.")
    return out


def select_bands(bands: Column, wanted: Sequence[int]) -> Column:
    return F.array(*[F.element_at(bands, b) for b in wanted])


def stack(rasters: Sequence[DataFrame], wanted: Sequence[int] | None = None, total: int | None = None) -> DataFrame:
    """Rasters on one grid as one: bands one after the other, then those asked for. A cell must be in all."""
    out = rasters[0].select("r", "c", F.col("bands").alias("b0"))
    for k, x in enumerate(rasters[1:], 1):
        out = out.join(x.select("r", "c", F.col("bands").alias(f"b{k}")), ["r", "c"])
    every = F.concat(*[F.col(f"b{k}") for k in range(len(rasters))])
    return out.select("r", "c", (every if wanted is None else select_bands(every, band_list(wanted, total or 10**6))).alias("bands"))


def is_nodata(bands: Column, nodata: Sequence[float | None]) -> Column:
    """Any band holds its nodata value; NaN is equal to itself, and a band without one never does."""
    tests = [F.element_at(bands, k + 1).cast("double").eqNullSafe(F.lit(float(v))) for k, v in enumerate(nodata) if v is not None]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def finite(p: Column) -> Column:
    """Every value is a number and finite."""
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def align(source: DataFrame, grid: Grid, template: Grid) -> DataFrame:
    """A raster on another grid: each template cell takes the source cell that its centre falls in. Cells outside have null bands.

    On the same grid nothing is done. Coordinates go through both coordinate systems, which must then be known.
    """
    if grid.same(template):
        return source
    at = _places(source.sparkSession, grid, template).select("r", "c", F.floor("u").cast("int").alias("sc"), F.floor("v").cast("int").alias("sr"))
    inside = at.filter(F.col("sc").between(0, grid.width - 1) & F.col("sr").between(0, grid.height - 1))
    found = inside.join(source.withColumnsRenamed({"r": "sr", "c": "sc"}), ["sr", "sc"]).drop("sr", "sc")
    return at.select("r", "c").join(found, ["r", "c"], "left")


def _places(spark: SparkSession, grid: Grid, template: Grid) -> DataFrame:
    """r, c, u, v: where each template cell's centre lies in a grid, as columns and rows from its corner."""
    if grid.crs is None or template.crs is None:
        raise ValueError("Rasters on different grids must all have a CRS so they can be aligned.")
    cells = spark.range(template.width * template.height).select(F.floor(F.col("id") / template.width).cast("int").alias("r"), F.pmod(F.col("id"), F.lit(template.width)).cast("int").alias("c"))
    x, y = template.centre(F.col("r"), F.col("c"))
    a, b, x0, d, e, y0 = grid.inverse()
    if C.code(grid.crs) == C.code(template.crs):
        return cells.select("r", "c", (a * x + b * y + x0).alias("u"), (d * x + e * y + y0).alias("v"))
    import pandas as pd

    to, of = grid.crs, template.crs

    @F.pandas_udf("u double, v double")
    def place(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        p, q = C.transform(of, to, x.to_numpy(), y.to_numpy())
        return pd.DataFrame({"u": a * p + b * q + x0, "v": d * p + e * q + y0})

    return cells.select("r", "c", place(x, y).alias("s")).select("r", "c", "s.u", "s.v")


def cubic(f: np.ndarray) -> np.ndarray:
    """The weights of the four neighbours in a row, two before and two after, of places f (0 to 1) between the middle two: Keys' kernel, a = -1/2."""
    t = np.stack([1 + f, f, 1 - f, 2 - f], axis=-1)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))


def resampled(source: DataFrame, grid: Grid, template: Grid, nodata: float = 0.0, shape: tuple[int, int] = (128, 128)) -> DataFrame:
    """A raster on another grid by bicubic interpolation: r, c, bands of the template cells whose centre falls in a cell with data.

    Of the sixteen cells around, those with data (a band other than nodata) share the weight, so nodata doesn't bleed in. Template cells go to the
    block of the source that they fall in; a block carries a halo of two cells, and a task holds one block.
    """
    if grid.same(template):
        return source.filter(F.exists("bands", lambda x: x != nodata))
    at = _places(source.sparkSession, grid, template).filter(F.col("u").between(0, grid.width - 1e-9) & F.col("v").between(0, grid.height - 1e-9))
    rows, cols = shape
    at = at.select("r", "c", "u", "v", F.floor(F.col("v") / rows).cast("int").alias("br"), F.floor(F.col("u") / cols).cast("int").alias("bc"))
    pixels = blocks(source.select("r", "c", F.transform("bands", lambda x: x.cast("double")).alias("bands")), grid.width, grid.height, shape, 2).select("br", "bc", "r", "c", "bands")

    def gather(key: tuple, cells: pa.Table, pixels: pa.Table) -> pa.Table:
        schema = pa.schema([("r", pa.int32()), ("c", pa.int32()), ("bands", pa.list_(pa.float64()))])
        if not cells.num_rows or not pixels.num_rows:
            return schema.empty_table()
        r, c = pixels.column("r").to_numpy(), pixels.column("c").to_numpy()
        values = np.array(pixels.column("bands").to_pylist(), float)
        r0, c0 = int(r.min()) - 2, int(c.min()) - 2
        held = np.zeros((int(r.max()) - r0 + 3, int(c.max()) - c0 + 3, values.shape[1]))
        some = np.zeros(held.shape[:2], bool)
        held[r - r0, c - c0] = values
        some[r - r0, c - c0] = (values != nodata).any(axis=1)
        u, v = cells.column("u").to_numpy(), cells.column("v").to_numpy()
        inside = (np.floor(v) >= r0) & (np.floor(v) < r0 + held.shape[0]) & (np.floor(u) >= c0) & (np.floor(u) < c0 + held.shape[1])
        inside[inside] = some[np.floor(v[inside]).astype(int) - r0, np.floor(u[inside]).astype(int) - c0]
        u, v = u[inside] - 0.5, v[inside] - 0.5
        i, j = np.floor(v).astype(int), np.floor(u).astype(int)
        wr, wc = cubic(v - i), cubic(u - j)
        total, out = np.zeros(len(u)), np.zeros((len(u), values.shape[1]))
        for dr in range(4):
            for dc in range(4):
                y, x = np.clip(i + dr - 1 - r0, 0, held.shape[0] - 1), np.clip(j + dc - 1 - c0, 0, held.shape[1] - 1)
                w = wr[:, dr] * wc[:, dc] * some[y, x]
                total += w
                out += w[:, None] * held[y, x]
        out /= np.where(np.abs(total) > 1e-9, total, 1)[:, None]
        own = cells.filter(pa.array(inside))
        return pa.table({"r": own.column("r").cast(pa.int32()), "c": own.column("c").cast(pa.int32()), "bands": pa.array(out.tolist(), pa.list_(pa.float64()))})

    return at.groupBy("br", "bc").cogroup(pixels.groupBy("br", "bc")).applyInArrow(gather, "r int, c int, bands array<double>")


def edge_distance(cells: DataFrame, by: str) -> DataFrame:
    """cells (by, r, c: those with data, each once) with edge: the distance, in cells, to the nearest cell without data, border and all.

    Exact, in two passes: along each column runs of data know their ends, and across each row the lower envelope of what these leave.
    """
    order = Window.partitionBy(by, "c").orderBy("r")
    runs = cells.select(by, "r", "c").withColumn("_run", F.col("r") - F.row_number().over(order))
    run = Window.partitionBy(by, "c", "_run")
    passed = runs.select(by, "r", "c", F.least(F.col("r") - F.min("r").over(run), F.max("r").over(run) - F.col("r")).cast("double").alias("g"))
    kind = dict(cells.dtypes)[by]

    def across(key: tuple, group: pa.Table) -> pa.Table:
        c = group.column("c").to_numpy()
        g = np.zeros(int(c.max() - c.min()) + 3)
        g[c - c.min() + 1] = group.column("g").to_numpy() + 1
        return pa.table({by: group.column(by), "r": group.column("r"), "c": group.column("c"), "edge": pa.array(np.sqrt(envelope(g * g, 1.0))[c - c.min() + 1])})

    types = dict(passed.dtypes)
    return passed.groupBy(by, "r").applyInArrow(across, f"{by} {kind}, r {types['r']}, c {types['c']}, edge double")


def paired(strips: Sequence[str], masks: Sequence[str]) -> list[tuple[str, str]]:
    """Strips and masks by place; there must be as many of each."""
    if len(strips) != len(masks):
        raise ValueError(f"Number of UDMs ({len(masks)}) must match number of strips ({len(strips)}).")
    return list(zip(strips, masks, strict=True))


def masked(pixels: DataFrame, bands: Sequence[str], usable: str = "udm") -> DataFrame:
    """Bands are 0, the nodata value, where the usability mask isn't 1."""
    return pixels.withColumns({b: F.when(F.col(usable) == 1, F.col(b)).otherwise(0.0) for b in bands})


#: The bands of red and near infrared, by how many there are.
NDVI_BANDS = {4: (3, 4), 8: (6, 8)}


def ndvi(red: Column, nir: Column, nodata: float | None = 0.0) -> Column:
    """(nir - red) / (nir + red): 0 where either is nodata or both differ by nothing and sum to nothing, the largest float where only the sum is 0."""
    d, s = nir - red, nir + red
    most = float(np.finfo("float32").max)
    value = F.when(s == 0, F.when(d == 0, 0.0).when(d > 0, most).otherwise(-most)).otherwise(F.try_divide(d, s))
    none = F.lit(False) if nodata is None else (red == nodata) | (nir == nodata)
    return F.when(none, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def with_ndvi(pixels: DataFrame, sr_bands: int, nodata: float | None = 0.0) -> DataFrame:
    """A pixel table with bands, and NDVI as one band more."""
    if sr_bands not in NDVI_BANDS:
        raise ValueError("sr_bands must be 4 or 8.")
    red, nir = NDVI_BANDS[sr_bands]
    return pixels.withColumn("bands", F.concat("bands", F.array(ndvi(F.element_at("bands", red).cast("double"), F.element_at("bands", nir).cast("double"), nodata))))


def argmax(p: Column) -> Column:
    """The place, from 0, of the first largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def class_raster(pixels: DataFrame, classes: Sequence[float], valid: Column, nodata: float = -1) -> DataFrame:
    """r, c, class: the value of the likeliest class, or nodata."""
    values = F.array(*map(F.lit, classes))
    return pixels.select("r", "c", F.when(valid, F.element_at(values, argmax(F.col("p")) + 1)).otherwise(F.lit(nodata)).alias("class"))


def binary_masks(pixels: DataFrame, classes: Sequence[float]) -> DataFrame:
    """r, c, and class_<value> for each class: 1 where the raster holds it, else 0."""
    return pixels.select("r", "c", *[F.coalesce((F.col("class") == v).cast("int"), F.lit(0)).alias(f"class_{v:g}") for v in classes])


def blocks(pixels: DataFrame, width: int, height: int, shape: tuple[int, int], overlap: int = 0) -> DataFrame:
    """Each pixel once for every block whose window holds it: br, bc (the block), inside (not only in the halo).

    A block's window starts overlap cells before it, but not before 0, and is 2 * overlap longer than the block, but ends with the raster.
    """
    if overlap < 0:
        raise ValueError("block_overlap must be >= 0.")

    def side(at: Column, n: int, size: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((at - 2 * overlap) / size).cast("int"))
        last = F.least(F.lit((n - 1) // size), F.floor((at + overlap) / size).cast("int"))

        def holds(k: Column) -> Column:
            begin = F.greatest(F.lit(0), k * size - overlap)
            own = F.least(F.lit(size), F.lit(n) - k * size)
            return (at >= begin) & (at < F.least(begin + own + 2 * overlap, F.lit(n)))

        return F.filter(F.sequence(first, last), holds)

    h, w = shape
    out = pixels.withColumn("br", F.explode(side(F.col("r"), height, h))).withColumn("bc", F.explode(side(F.col("c"), width, w)))
    return out.withColumn("inside", (F.floor(F.col("r") / h) == F.col("br")) & (F.floor(F.col("c") / w) == F.col("bc")))


def by_block(pixels: DataFrame, width: int, height: int, shape: tuple[int, int], overlap: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], value: str, kind: str) -> DataFrame:
    """r, c and `value`: kernel(p, valid) of each block with its halo, cut back to the block. pixels: r, c, p (an array of equal length), valid.

    p is NaN, and valid false, where a window has no pixel. The result has the pixels of the input."""
    spread = blocks(pixels.select("r", "c", "p", "valid"), width, height, shape, overlap)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        r, c = group.column("r").to_numpy(), group.column("c").to_numpy()
        top, left = int(r.min()), int(c.min())
        size = (int(r.max()) - top + 1, int(c.max()) - left + 1)
        lists = group.column("p").combine_chunks()
        p = np.full((*size, len(lists.values) // max(1, len(lists))), np.nan)
        p[r - top, c - left] = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)
        valid = np.zeros(size, bool)
        valid[r - top, c - left] = group.column("valid").to_numpy(zero_copy_only=False)
        out = kernel(p, valid)[r - top, c - left]
        inside = group.column("inside").to_numpy(zero_copy_only=False).astype(bool)
        values = pa.array(out[inside].astype("int32")) if kind == "int" else pa.array(list(out[inside]), pa.list_(pa.float64()))
        return pa.table({"r": pa.array(r[inside].astype("int32")), "c": pa.array(c[inside].astype("int32")), value: values})

    return spread.groupBy("br", "bc").applyInArrow(run, f"r int, c int, {value} {kind}")


def rasterized(polygons: DataFrame, grid: Grid) -> DataFrame:
    """A row for each polygon and cell whose centre lies in it: fid, label, r, c. polygons: fid, label, geometry (GeoJSON text, in the grid's coordinates).

    Null and empty geometries, and labels null or 0, give nothing; overlapping polygons give a cell twice. A polygon is scanned
    row by row, so a task holds one row of cells at a time.
    """
    import json

    from ..functions.geo import Geometry

    some = polygons.filter("label IS NOT NULL AND label <> 0 AND geometry IS NOT NULL")
    a, b, x0, d, e, y0 = grid.transform
    ia, ib, ix, id_, ie, iy = grid.inverse()
    kind = dict(polygons.dtypes)

    def scan(batches):
        for batch in batches:
            for fid, label, text in zip(*(batch.column(k).to_pylist() for k in ("fid", "label", "geometry")), strict=True):
                g = Geometry.read(json.loads(text))
                if g.empty:
                    continue
                xmin, ymin, xmax, ymax = g.bounds()
                xs, ys = np.array([xmin, xmin, xmax, xmax]), np.array([ymin, ymax, ymin, ymax])
                cols, rows = ia * xs + ib * ys + ix, id_ * xs + ie * ys + iy
                c1, c2 = max(0, int(np.floor(cols.min()))), min(grid.width - 1, int(np.ceil(cols.max())))
                r1, r2 = max(0, int(np.floor(rows.min()))), min(grid.height - 1, int(np.ceil(rows.max())))
                if c1 > c2 or r1 > r2:
                    continue
                c = np.arange(c1, c2 + 1)
                for r in range(r1, r2 + 1):
                    hit = c[g.holds(x0 + (c + 0.5) * a + (r + 0.5) * b, y0 + (c + 0.5) * d + (r + 0.5) * e)]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([fid] * len(hit), batch.schema.field("fid").type), pa.array([label] * len(hit), batch.schema.field("label").type), pa.array(np.full(len(hit), r, np.int32)), pa.array(hit.astype(np.int32))], ["fid", "label", "r", "c"])

    return some.select("fid", "label", "geometry").mapInArrow(scan, f"fid {kind['fid']}, label {kind['label']}, r int, c int")


def distance(features: DataFrame, grid: Grid) -> DataFrame:
    """r, c, distance: from each cell's centre to the nearest feature cell's, 0 on features. features: r, c.

    Exact, in two passes: down each column the nearest feature above and below, then across each row the lower envelope of the
    parabolas those stand for, in time proportional to the row.
    """
    a, b, _, d, e, _ = grid.transform
    if b or d:
        raise ValueError("Distance needs a grid without rotation or shear.")
    sx, sy = abs(a), abs(e)
    spark = features.sparkSession
    there = features.select("r", "c").distinct()
    if not there.limit(1).count():
        raise ValueError("No template cell lies on a feature.")
    cells = spark.range(grid.width * grid.height).select(F.floor(F.col("id") / grid.width).cast("int").alias("r"), F.pmod(F.col("id"), F.lit(grid.width)).cast("int").alias("c"))
    marked = cells.join(there.withColumn("f", F.col("r")), ["r", "c"], "left")
    down = Window.partitionBy("c").orderBy("r")
    above = F.last("f", True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("f", True).over(down.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("r") - above, below - F.col("r"))  # the smaller of those that are there
    passed = marked.select("r", "c", (gap * sy).cast("double").alias("g"))
    width = grid.width

    def across(key: tuple, group: pa.Table) -> pa.Table:
        c = group.column("c").to_numpy()
        g = np.full(width, np.inf)
        g[c] = np.nan_to_num(group.column("g").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
        out = np.sqrt(envelope(g * g, sx))
        return pa.table({"r": pa.array(np.full(len(c), key[0].as_py(), np.int32)), "c": pa.array(c.astype(np.int32)), "distance": pa.array(out[c].astype(np.float32).astype(np.float64))})

    return passed.groupBy("r").applyInArrow(across, "r int, c int, distance double")


def envelope(height: np.ndarray, step: float) -> np.ndarray:
    """At each place the least of height[k] + (step * (place - k))**2 over all k: the lower envelope of parabolas."""
    places = np.flatnonzero(np.isfinite(height)).tolist()
    if not places:
        return np.full(len(height), np.inf)
    h, s = height.tolist(), step * step
    low, cut = [places[0]], []
    for k in places[1:]:
        while True:
            j = low[-1]
            at = ((h[k] + s * k * k) - (h[j] + s * j * j)) / (2 * s * (k - j))
            if cut and at <= cut[-1]:
                low.pop()
                cut.pop()
            else:
                break
        low.append(k)
        cut.append(at)
    own = np.array(low)[np.searchsorted(np.array(cut), np.arange(len(height)), "left")] if cut else np.full(len(height), low[0])
    return height[own] + s * (np.arange(len(height)) - own) ** 2


def resized(grid: Grid, size: float) -> Grid:
    """A grid over the same area with square cells of another size."""
    a, b, x, d, e, y = grid.transform
    return replace(grid, width=max(1, round(grid.width * abs(a) / size)), height=max(1, round(grid.height * abs(e) / size)), transform=(size, 0.0, x, 0.0, -size, y))
