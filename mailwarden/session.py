"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A ``local[n]`` session. On a cluster the job's own session is used instead."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.mailwarden.scan.tasks", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may run without it; then a temporary folder is made once
    and remembered in the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("mailwarden.shared.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="mailwarden-")
    spark.conf.set("mailwarden.shared.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and read from there afterwards."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for intermediate tables."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder, without their partitioning.

    A join with a table that was grouped by the join key reuses the grouping's exchange, and AQE then has no shuffle of
    its own to split. Reading the groups back makes both sides plain exchanges, so a hot key is split. ``block`` bounds the
    bytes of a row group: a reader decodes 4,096 rows at a time, but of one row group, so wide rows need small ones.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
