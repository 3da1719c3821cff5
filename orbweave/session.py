"""Session settings and the shared scratch space every multi-step job uses."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


#: Whether a finished execution's shuffle files are deleted at once, not when the driver's garbage is.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orbweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session, all in one process, may leave it unset and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("orbweave.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("orbweave.scratch.dir", found)
    return found


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/orbweave-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing. The shuffle files that
    it took are deleted at once."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbweave_path = path
    return out


def scratch_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that no Spark writer makes; the folder must be mounted, not a store. release() deletes them."""
    root = urlsplit(_root(spark))
    if root.scheme not in ("", "file"):
        raise ValueError(f"{root.scheme} is no mounted folder")
    folder = os.path.join(root.path, f"files-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return os.path.join(folder, name)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    path = getattr(df, "_orbweave_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table this application has materialised."""
    _delete(spark, _root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
