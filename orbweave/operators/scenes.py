"""Filters and rankings of scenes. A scenes table has ord (the catalog's order), item_id and props (MAP<STRING, STRING>)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props as P
from ..functions import scoring as S


def normal_set(names: Sequence[str] | None) -> list[str]:
    """Trimmed, in lower case, without blanks and repeats, in order."""
    return list(dict.fromkeys(n.strip().lower() for n in names or () if n and n.strip()))


def off(name: str | None) -> str | None:
    """A category or stage; `none` switches its filter off."""
    return None if name is None or name.lower() == "none" else name


def pushed(catalog: DataFrame, sun_min: float | None = None, cloud_max: float | None = None, imagery_type: str | None = None, instruments: Sequence[str] | None = None) -> DataFrame:
    """What a catalog's own search checks, on its plain columns, so that it reaches the scan: sun_elevation, cloud_cover, imagery_type
    and instrument, each only if asked for."""
    tests = []
    if sun_min is not None:
        tests.append(F.col("sun_elevation") >= sun_min)
    if cloud_max is not None:
        tests.append(F.col("cloud_cover") <= cloud_max)
    if imagery_type:
        tests.append(F.col("imagery_type") == imagery_type)
    if instruments:
        tests.append(F.col("instrument").isin(*dict.fromkeys(instruments)))
    return reduce(DataFrame.filter, tests, catalog)


def cloud_ok(props: Column, most: float | None) -> Column:
    """Not cloudier than `most`; what has no readable cloud cover passes."""
    if most is None:
        return F.lit(True)
    v = P.number(P.pick(props, P.CLOUD))
    return ~F.coalesce((F.when(v > 1, v / 100).otherwise(v) > most) & ~F.isnan(v), F.lit(False))


def sun_ok(props: Column, least: float) -> Column:
    """The sun not lower than `least`; what has no readable elevation passes."""
    return ~F.coalesce(P.number(P.pick(props, P.SUN_ELEVATION)) < least, F.lit(False))


def instrument_ok(props: Column, instruments: Sequence[str] | None, names: Sequence[str] = P.INSTRUMENT) -> Column:
    """One of the scene's instruments is asked for; without a filter, or without a known instrument, true."""
    asked = normal_set(instruments)
    if not asked:
        return F.lit(True)
    own = P.pick(props, names)
    return own.isNull() | F.arrays_overlap(P.values(own), F.array(*map(F.lit, asked)))


def quality_ok(
    props: Column,
    require_ground_control: bool = False,
    quality_category: str | None = None,
    publishing_stage: str | None = None,
    max_view_angle: float | None = None,
    max_anomalous: float | None = None,
    max_shadow: float | None = None,
    max_snow_ice: float | None = None,
    max_heavy_haze: float | None = None,
    min_visible: float | None = None,
    min_clear: float | None = None,
) -> Column:
    """All the limits that are set hold; a scene that lacks the property fails its limit."""
    tests = []
    if require_ground_control:
        tests.append(P.boolean(P.pick(props, P.GROUND_CONTROL)))
    for names, wanted in ((P.QUALITY_CATEGORY, quality_category), (P.PUBLISHING_STAGE, publishing_stage)):
        if wanted:
            tests.append(F.lower(F.trim(P.pick(props, names))) == wanted.lower())
    if max_view_angle is not None:
        angle = P.number(P.pick(props, P.VIEW_ANGLE))
        tests.append((F.abs(angle) <= max_view_angle) | F.isnan(angle))
    if max_anomalous is not None:
        tests.append(P.number(P.pick(props, P.ANOMALOUS)) <= max_anomalous)
    for names, most in ((P.SHADOW, max_shadow), (P.SNOW_ICE, max_snow_ice), (P.HEAVY_HAZE, max_heavy_haze)):
        if most is not None:
            tests.append(P.percent(P.number(P.pick(props, names))) <= most)
    for names, least in ((P.VISIBLE_CONFIDENCE, min_visible), (P.CLEAR_CONFIDENCE, min_clear)):
        if least is not None:
            tests.append(P.percent(P.number(P.pick(props, names))) >= least)
    return reduce(Column.__and__, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def expected_constellations(scenes: DataFrame, instruments: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each group (or over all): the constellations of the scenes whose instrument is known and asked for, before any other filter."""
    known = scenes.filter(P.pick(F.col("props"), P.INSTRUMENT).isNotNull() & instrument_ok(F.col("props"), instruments))
    words = known.select(*by, F.explode(P.values(P.pick(F.col("props"), P.CONSTELLATION))).alias("word"))
    return words.groupBy(*by).agg(F.collect_set("word").alias("expected"))


def instrument_filter(scenes: DataFrame, instruments: Sequence[str] | None, by: Sequence[str] = ()) -> DataFrame:
    """Scenes of the instruments. With one instrument asked for, a scene without a known one stays only if its constellation is one
    of those of the group's matching scenes; with several it stays."""
    if not normal_set(instruments):
        return scenes
    fit = scenes.filter(instrument_ok(F.col("props"), instruments))
    if len(normal_set(instruments)) > 1:
        return fit
    expected = expected_constellations(scenes, instruments, by)  # a row for each group
    joined = fit.join(expected, list(by), "left") if by else fit.crossJoin(F.broadcast(expected))
    known = P.pick(F.col("props"), P.INSTRUMENT).isNotNull()
    overlap = F.coalesce(F.arrays_overlap(P.values(P.pick(F.col("props"), P.CONSTELLATION)), "expected"), F.lit(False))
    return joined.filter(known | overlap).drop("expected")


def candidates(scenes: DataFrame, min_clear_fraction: float = 0.8, **limits) -> DataFrame:
    """Scenes clear enough and within the quality limits, with what scoring needs: clear_fraction, sun_azimuth, sun_elevation, quality_score."""
    props = F.col("props")
    return (
        scenes.withColumn("clear_fraction", P.clear_fraction(props))
        .filter(F.col("clear_fraction") >= min_clear_fraction)
        .filter(quality_ok(props, **limits))
        .withColumns({"sun_azimuth": P.number(P.pick(props, P.SUN_AZIMUTH)), "sun_elevation": P.number(P.pick(props, P.SUN_ELEVATION)), "quality_score": S.quality_score(props)})
    )


def replacements(scenes: DataFrame, wanted: int, exclude: DataFrame | None = None, instruments: Sequence[str] | None = None, min_clear_fraction: float = 0.0, quality_weight: float = 0.35, by: Sequence[str] = (), **limits) -> DataFrame:
    """The `wanted` best scenes (of each group) that aren't excluded (a table with item_id): by clear fraction times the quality
    multiplier, then clear fraction, then the catalog's order."""
    props = F.col("props")
    found = scenes
    if exclude is not None:
        found = found.join(exclude.select("item_id").distinct(), "item_id", "left_anti")
    if normal_set(instruments):
        found = found.filter(P.pick(props, P.ORDER_INSTRUMENT).isNotNull() & instrument_ok(props, instruments, P.ORDER_INSTRUMENT))
    found = found.withColumn("clear_fraction", P.clear_fraction(props)).filter(F.col("clear_fraction") >= min_clear_fraction).filter(quality_ok(props, **limits))
    found = found.withColumn("combined", F.col("clear_fraction") * S.quality_multiplier(S.order_quality_score(props), quality_weight))
    best = Window.partitionBy(*by).orderBy(F.col("combined").desc(), F.col("clear_fraction").desc(), F.col("ord"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted)
