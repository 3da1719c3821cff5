"""Scores of scenes: quality from the metadata, and how well a scene's light fits what a tile has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import props as P


def view_score(angle: Column) -> Column:
    return F.exp(-F.pow(F.abs(angle) / 15.0, 2))


def gsd_score(gsd: Column) -> Column:
    """Null where gsd isn't positive."""
    return P.let(gsd, lambda g: F.when(g > 0, F.exp(-F.pow(F.greatest(F.lit(0.0), g - 3.0) / 1.5, 2))))


def weighted(parts: list[tuple[float, Column]], otherwise: float = 0.5) -> Column:
    """The weighted mean of the values that aren't null."""
    known = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), v.cast("double").alias("v")) for w, v in parts]), lambda x: x["v"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"))
    add = lambda a, x: F.struct((a["w"] + x["w"]).alias("w"), (a["v"] + x["w"] * x["v"]).alias("v"))
    return F.aggregate(known, zero, add, lambda a: F.when(a["w"] > 0, a["v"] / a["w"]).otherwise(F.lit(otherwise)))


def quality_score(props: Column) -> Column:
    """View angle and ground resolution, half each; 0.5 where neither is known."""
    return weighted([(0.5, view_score(P.number(P.pick(props, P.VIEW_ANGLE)))), (0.5, gsd_score(P.number(P.pick(props, P.GSD))))])


def order_quality_score(props: Column) -> Column:
    """The seven measures by which replacements are ranked."""

    def part(names):
        return P.percent(P.number(P.pick(props, names)))

    return weighted(
        [
            (0.2, part(P.VISIBLE_CONFIDENCE)),
            (0.2, part(P.CLEAR_CONFIDENCE)),
            (0.15, 1 - part(P.SHADOW)),
            (0.15, 1 - part(P.SNOW_ICE)),
            (0.1, 1 - part(P.HEAVY_HAZE)),
            (0.1, view_score(P.number(P.pick(props, P.VIEW_ANGLE)))),
            (0.1, gsd_score(P.number(P.pick(props, P.GSD)))),
        ]
    )


def quality_multiplier(quality: Column, weight: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 + F.lit(weight) * (quality - 0.5) * 2.0)


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two directions, from 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def mean_direction(x: Column, y: Column, weight: Column) -> Column:
    """The direction of a sum of weighted unit vectors, from 0 to 360; null where nothing was summed."""
    d = F.degrees(F.atan2(y, x))
    return F.when(weight > 0, F.when(d < 0, d + 360.0).otherwise(d))


def similarity(azimuth: Column, elevation: Column, mean_azimuth: Column, mean_elevation: Column, azimuth_sigma: float | None, elevation_sigma: float | None) -> Column:
    """How well a scene's sun fits a tile's mean sun; what isn't known on either side doesn't count."""
    out = F.lit(1.0)
    if azimuth_sigma and azimuth_sigma > 0:
        out = out * F.coalesce(F.exp(-F.pow(angle_between(azimuth, mean_azimuth) / azimuth_sigma, 2)), F.lit(1.0))
    if elevation_sigma and elevation_sigma > 0:
        out = out * F.coalesce(F.exp(-F.pow(F.abs(elevation - mean_elevation) / elevation_sigma, 2)), F.lit(1.0))
    return out
