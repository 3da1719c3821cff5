"""A stream of scenes gives the same coverage as the table."""

from pyspark.sql import functions as F

from orbweave import fixtures
from orbweave.functions import props as P
from orbweave.operators import tiles as T
from orbweave.streaming.coverage import tile_coverage


def test_stream_equals_table(spark, tmp_path):
    grid = T.Grid(0.0, 0.0, 12000.0, 12000.0, 1000.0)
    tiles = T.cells(spark, grid).withColumn("tile_id", (F.col("tx") * grid.ny + F.col("ty")).cast("int"))
    rows = fixtures.scenes(spark, "/root/testdata/sf0.001").select("month", P.clear_fraction(F.col("props")).alias("clear_fraction"), "xmin", "ymin", "xmax", "ymax")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = tile_coverage(stream, tiles, grid).writeStream.outputMode("complete").format("memory").queryName("coverage").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    plain = lambda df: sorted((r["month"], r["tile_id"], r["scenes"], round(r["clear_obs"] or 0, 6)) for r in df.collect())
    assert plain(spark.table("coverage")) == plain(tile_coverage(table, tiles, grid))
