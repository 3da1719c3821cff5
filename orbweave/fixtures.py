"""Scenes, tiles, strips, orders and pixels derived from the star-schema tables, so that every operator can be run and checked on them.

Each fixture is SQL that Spark and DuckDB read alike but for two slots: {k}, the number in events.props, and {e1} to {e4}, elements of an embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"k": "get_json_object(props, '$.k')", **{f"e{i}": f"element_at(embedding, {i})" for i in range(1, 5)}}
DUCKDB = {"k": "json_extract_string(props, '$.k')", **{f"e{i}": f"embedding[{i}]" for i in range(1, 5)}}

SCENES = """
SELECT event_id AS ord, 'scene-' || CAST(event_id AS STRING) AS item_id, '2024-0' || CAST(1 + event_id % 3 AS STRING) AS month,
  CASE WHEN event_id % 20 = 1 THEN '' WHEN event_id % 20 = 2 THEN 'n/a' WHEN event_id % 4 = 0 THEN k END AS clear_percent,
  CASE WHEN event_id % 4 = 1 THEN k END AS pl_clear_percent,
  CASE WHEN event_id % 4 = 2 THEN CAST(CAST(k AS DOUBLE) / 100 AS STRING) END AS clear_fraction,
  CASE WHEN event_id % 7 <> 0 THEN value / 500 END AS cloud_cover,
  CASE WHEN event_id % 11 <> 0 THEN CAST(20 + (event_id * 7) % 50 AS DOUBLE) END AS sun_elevation,
  CASE WHEN event_id % 9 <> 0 THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS sun_azimuth,
  CASE WHEN event_id % 8 <> 0 THEN CAST((event_id * 13) % 41 - 20 AS DOUBLE) END AS view_angle,
  3 + CAST(user_id % 10 AS DOUBLE) / 10 AS gsd,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 < 2 THEN 'PSB.SD' WHEN event_id % 5 = 2 THEN 'PS2.SD' WHEN event_id % 5 = 3 THEN ' ps2 ' ELSE 'PS2' END AS instrument,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 < 2 THEN 'superdove' ELSE 'dove' END AS constellation,
  CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'YES' WHEN 2 THEN '0' WHEN 3 THEN 'false' WHEN 4 THEN 'maybe' END AS ground_control,
  CASE WHEN event_id % 10 < 8 THEN 'standard' ELSE 'Test' END AS quality_category,
  CAST(((user_id * 7919 + event_id) % 12) * 1000 - 250 AS DOUBLE) AS xmin, CAST(((event_id * 31) % 12) * 1000 - 250 AS DOUBLE) AS ymin,
  CAST(((user_id * 7919 + event_id) % 12) * 1000 + 750 + 1000 * (event_id % 3) AS DOUBLE) AS xmax, CAST(((event_id * 31) % 12) * 1000 + 750 + 1000 * (event_id % 3) AS DOUBLE) AS ymax
FROM (SELECT *, {k} AS k FROM events) e
"""
MORE = """
SELECT event_id AS ord, CASE WHEN event_id % 7 <> 0 THEN CAST((event_id * 3) % 101 AS DOUBLE) END AS visible_confidence_percent,
  CASE WHEN event_id % 8 <> 1 THEN CAST((event_id * 11) % 100 AS DOUBLE) / 100 END AS clear_confidence_percent, CASE WHEN event_id % 9 <> 2 THEN CAST((event_id * 5) % 40 AS DOUBLE) END AS shadow_percent,
  CASE WHEN event_id % 10 <> 3 THEN CAST(event_id % 5 AS DOUBLE) / 10 END AS snow_ice_percent, CASE WHEN event_id % 6 <> 4 THEN CAST((event_id * 7) % 30 AS DOUBLE) END AS heavy_haze_percent,
  CASE WHEN event_id % 5 <> 1 THEN CAST(event_id % 13 AS DOUBLE) END AS anomalous_pixels,
  CASE event_id % 4 WHEN 0 THEN 'finalized' WHEN 1 THEN ' Standard ' WHEN 2 THEN 'preview' END AS publishing_stage, '2024-01-0' || CAST(1 + event_id % 9 AS STRING) AS acquired
FROM events
"""
STRIPS = """
SELECT CAST(l_suppkey % 8 AS INT) AS strip, CAST(l_orderkey % 100 AS INT) AS r, CAST(l_partkey % 100 AS INT) AS c, min(l_tax * 1000) AS green, min(l_quantity) AS red,
  min(l_extendedprice / 1000) AS nir, CAST(max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INT) AS udm
FROM lineitem GROUP BY 1, 2, 3
"""
ITEMS = "SELECT CAST(year(o_orderdate) AS STRING) AS period, o_orderkey AS ord, 'item-' || CAST(o_orderkey AS STRING) AS id FROM orders"
STRIP_META = """
SELECT s_suppkey AS ord, 'EPSG:3263' || CAST(s_nationkey % 3 AS STRING) AS label, CAST((s_nationkey * 15) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 7) % 120 - 60 AS DOUBLE) AS lat FROM supplier
"""
TIED = "SELECT n_nationkey AS ord, 'EPSG:3263' || CAST(n_nationkey % 5 AS STRING) AS label, CAST((n_nationkey * 13) % 360 - 180 AS DOUBLE) AS lon, CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat FROM nation"
PIXELS = "SELECT CAST(floor(vec_id / 25) AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, embedding AS bands, CAST(label + 1 AS INT) AS label, vec_id % 17 = 0 AS nodata, vec_id FROM embeddings"
PROBS = """
SELECT r, c, label, nodata, x1 / (x1 + x2 + x3 + x4) AS p1, x2 / (x1 + x2 + x3 + x4) AS p2, x3 / (x1 + x2 + x3 + x4) AS p3, x4 / (x1 + x2 + x3 + x4) AS p4
FROM (SELECT CAST(floor(vec_id / 25) AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, CAST(label + 1 AS INT) AS label, vec_id % 17 = 0 AS nodata,
  exp(8 * CAST({e1} AS DOUBLE)) AS x1, exp(8 * CAST({e2} AS DOUBLE)) AS x2, exp(8 * CAST({e3} AS DOUBLE)) AS x3, exp(8 * CAST({e4} AS DOUBLE)) AS x4 FROM embeddings) t
"""
#: fid, label, ring: a rectangle, a triangle, a rectangle over the first with another label, one outside, one without a label.
POLYGONS = [
    (0, 1, [(2.0, 2.0), (8.0, 2.0), (8.0, 7.0), (2.0, 7.0), (2.0, 2.0)]),
    (1, 2, [(10.0, 1.0), (20.0, 3.0), (12.0, 15.0), (10.0, 1.0)]),
    (2, 3, [(5.0, 4.0), (11.0, 4.0), (11.0, 9.0), (5.0, 9.0), (5.0, 4.0)]),
    (3, 4, [(100.0, 100.0), (110.0, 100.0), (110.0, 110.0), (100.0, 110.0), (100.0, 100.0)]),
    (4, None, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)]),
]

_OF = {"SCENES": "events", "MORE": "events", "TIED": "nation", "STRIPS": "lineitem", "ITEMS": "orders", "STRIP_META": "supplier", "PIXELS": "embeddings", "PROBS": "embeddings"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture by its name above."""
    table = spark.read.parquet(f"{sf_dir}/{_OF[name]}.parquet")
    text = globals()[name]
    for slot, value in SPARK.items():
        text = text.replace(f"{{{slot}}}", value)
    return spark.sql(text.replace(f"FROM {_OF[name]}", "FROM {table}"), table=table)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with a property map: ord, item_id, month, box and props."""
    found = load(spark, sf_dir, "SCENES")
    names = {"pl_clear_percent": "pl:clear_percent", "sun_elevation": "view:sun_elevation", "sun_azimuth": "view:sun_azimuth", "view_angle": "view:off_nadir", "cloud_cover": "eo:cloud_cover", "instrument": "pl:instrument"}
    fields = ["clear_percent", "pl_clear_percent", "clear_fraction", "cloud_cover", "sun_elevation", "sun_azimuth", "view_angle", "gsd", "instrument", "constellation", "ground_control", "quality_category"]
    props = F.create_map(*[x for f in fields for x in (F.lit(names.get(f, f)), F.col(f).cast("string"))])
    # explode: a generator's rows are made once, where a projection would be copied into each expression over props
    return found.select("ord", "item_id", "month", "xmin", "ymin", "xmax", "ymax", F.explode(F.array(props)).alias("props"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes whose property map also has what MORE knows of them, under the names of one catalog."""
    more = load(spark, sf_dir, "MORE")
    names = {"shadow_percent": "pl:shadow_percent", "snow_ice_percent": "pl_snow_ice_percent", "publishing_stage": "pl:publishing_stage"}
    extra = F.create_map(*[x for f in more.columns if f != "ord" for x in (F.lit(names.get(f, f)), F.col(f).cast("string"))])
    return scenes(spark, sf_dir).join(more.select("ord", extra.alias("_more")), "ord").withColumn("props", F.map_concat("props", "_more")).drop("_more")


def sql(name: str) -> str:
    """A fixture's SQL for DuckDB."""
    text = globals()[name]
    for slot, value in DUCKDB.items():
        text = text.replace(f"{{{slot}}}", value)
    return text
