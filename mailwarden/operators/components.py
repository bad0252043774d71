"""Connected components by alternating large-star / small-star steps.

Each step is a groupBy-min (combined map-side) and an equi-join. The least neighbours are written to the shared folder
before the join, so both of its sides are plain exchanges and AQE can split a hub that holds a third of all edges. The
number of rounds grows with the logarithm of the longest chain. Each round's tables are removed once the next is written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailwarden.session import scratch_path


class Tables:
    """Written tables of one run, removed when they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "components")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        *old, last = self.paths
        self.paths = old
        self.remove()
        self.paths = [last]

    def remove(self) -> None:
        for path in self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = []


def _large_star(edges: DataFrame, tables: Tables) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, tables: Tables) -> DataFrame:
    down = tables.write(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    least = tables.write(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id on an edge; the component is its smallest id."""
    tables = Tables(edges.sparkSession)
    current = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    current = tables.write(_small_star(current, tables))
    state = _fingerprint(current)
    while state[0]:
        following = tables.write(_small_star(_large_star(current, tables), tables))
        new_state = _fingerprint(following)
        tables.keep_last()
        current = following
        if new_state == state:
            break
        state = new_state
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.union(roots)
