"""Column builders over a scene's property map: alias lookup and typed readings.

A property map is MAP<STRING, STRING>, with nested values as JSON text. A property has several possible names; the first
that holds something other than null or '' counts, even if it can't be read as a number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names under which catalogs give each property, in order of preference.
CLEAR_PERCENT = ("clear_percent", "pl:clear_percent", "pl_clear_percent")
CLEAR_SHARE = ("clear_fraction", "pl:clear_fraction", "pl_clear_fraction")
CLEAR = CLEAR_PERCENT + CLEAR_SHARE
CLOUD = ("cloud_cover", "eo:cloud_cover", "eo_cloud_cover", "pl:cloud_cover", "pl_cloud_cover", "cloud_percent", "pl:cloud_percent", "pl_cloud_percent")
SUN_ELEVATION = ("sun_elevation", "view:sun_elevation", "view_sun_elevation")
SUN_AZIMUTH = ("sun_azimuth", "view:sun_azimuth", "view_sun_azimuth")
ACQUIRED = ("acquired", "datetime", "pl:acquired", "pl_acquired", "pl:acquired_datetime", "pl_acquired_datetime")
VIEW_ANGLE = ("view_angle", "view:off_nadir", "view_off_nadir")
GROUND_CONTROL = ("ground_control", "pl:ground_control", "pl_ground_control")
QUALITY_CATEGORY = ("quality_category", "pl:quality_category", "pl_quality_category")
PUBLISHING_STAGE = ("publishing_stage", "pl:publishing_stage", "pl_publishing_stage")
GSD = ("gsd", "pixel_resolution", "pl:pixel_resolution", "pl_pixel_resolution")
INSTRUMENT = ("instruments", "pl:instrument", "pl_instrument")
ORDER_INSTRUMENT = ("instruments", "instrument", "pl:instrument", "pl_instrument")
CONSTELLATION = ("constellation", "eo:constellation", "pl:constellation")
VISIBLE_CONFIDENCE = ("visible_confidence_percent", "pl:visible_confidence_percent", "pl_visible_confidence_percent")
CLEAR_CONFIDENCE = ("clear_confidence_percent", "pl:clear_confidence_percent", "pl_clear_confidence_percent")
SHADOW = ("shadow_percent", "pl:shadow_percent", "pl_shadow_percent")
SNOW_ICE = ("snow_ice_percent", "pl:snow_ice_percent", "pl_snow_ice_percent")
HEAVY_HAZE = ("heavy_haze_percent", "pl:heavy_haze_percent", "pl_heavy_haze_percent")
ANOMALOUS = ("anomalous_pixels", "pl:anomalous_pixels", "pl_anomalous_pixels")

PLAN_SNAPSHOT = {
    "instrument": INSTRUMENT,
    "constellation": CONSTELLATION,
    "cloud_cover": CLOUD,
    "clear_percent": CLEAR,
    "sun_elevation": SUN_ELEVATION,
    "sun_azimuth": SUN_AZIMUTH,
    "acquired": ACQUIRED,
    "view_angle": VIEW_ANGLE,
    "ground_control": GROUND_CONTROL,
    "quality_category": QUALITY_CATEGORY,
    "publishing_stage": PUBLISHING_STAGE,
    "gsd": GSD,
}
ORDER_SNAPSHOT = PLAN_SNAPSHOT | {
    "instrument": ORDER_INSTRUMENT,
    "visible_confidence_percent": VISIBLE_CONFIDENCE,
    "clear_confidence_percent": CLEAR_CONFIDENCE,
    "shadow_percent": SHADOW,
    "snow_ice_percent": SNOW_ICE,
    "heavy_haze_percent": HEAVY_HAZE,
    "anomalous_pixels": ANOMALOUS,
}

YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pick(props: Column, names: Sequence[str]) -> Column:
    """The first of the named properties that is neither null nor empty, as text.

    One look for each name, in a loop: looks written out side by side, two for each name of each property, make a method that
    the virtual machine never compiles.
    """
    return F.get(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: props[n]), lambda v: v != ""), F.lit(0))


def number(text: Column) -> Column:
    """Text as a double; null where it is none. JSON booleans count as 1 and 0."""
    return let(F.lower(F.trim(text)), lambda word: F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(word.try_cast("double")))


def boolean(text: Column) -> Column:
    """Text as a boolean; other numbers than 0 are true, and other words null."""
    return let(F.lower(F.trim(text)), lambda word: F.when(word.isin(*YES), True).when(word.isin(*NO), False).otherwise(word.try_cast("double") != 0))


def _clamped(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def share(v: Column) -> Column:
    """A fraction, or a percentage above 1, as a fraction from 0 to 1."""
    return let(v, lambda x: _clamped(F.when(x > 1, x / 100).otherwise(x)))


def percent(v: Column) -> Column:
    """A percentage of 1 or more, or a fraction below, as a fraction from 0 to 1."""
    return let(v, lambda x: _clamped(F.when(x >= 1, x / 100).otherwise(x)))


def clear_fraction(props: Column) -> Column:
    """How much of a scene is clear: its percentage, else its fraction, else what clouds leave."""
    return F.coalesce(percent(number(pick(props, CLEAR_PERCENT))), share(number(pick(props, CLEAR_SHARE))), 1 - share(number(pick(props, CLOUD))))


def values(text: Column) -> Column:
    """One value, or a JSON list of values, as a set of trimmed lower-case words."""
    many = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    words = F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(words, lambda x: x.isNotNull() & (x != "")))


def snapshot(props: Column, fields: dict[str, tuple[str, ...]] = PLAN_SNAPSHOT) -> Column:
    """The fixed set of properties that plans and orders carry, each under one name. Empty properties are left out once for all of them."""
    some = F.map_filter(props, lambda _, v: v != "")
    return F.struct(*[F.coalesce(*[some[n] for n in names]).alias(field) for field, names in fields.items()])
