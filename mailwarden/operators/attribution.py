"""Feature attribution and the audit of tokens that give away their source."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def linear_attribution(df: DataFrame, coefficients: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """Mean absolute contribution |coef * (x - mean)| per feature, ranked.

    One aggregation for the means of the background rows and one for the contributions, both over plain columns.
    """
    names = list(coefficients)
    means = (df if background is None else background).agg(*[F.avg(n).alias(n) for n in names]).first()
    sums = df.agg(*[F.avg(F.abs((F.col(n) - F.lit(means[n])) * F.lit(float(coefficients[n])))).alias(n) for n in names])
    return rank_importance(sums.unpivot([], names, "feature", "importance"))


def rank_importance(table: DataFrame) -> DataFrame:
    """Add a 1-based rank, largest first; the table has one row per feature."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def importance_table(spark, names: list[str], values: list[float]) -> DataFrame:
    """Fallback attribution: a fitted model's own importances or absolute coefficients."""
    rows = [(n, float(abs(v))) for n, v in zip(names, values)]
    return rank_importance(spark.createDataFrame(rows, "feature string, importance double"))


def token_source_lift(df: DataFrame, terms: Column, min_docs: int = 5, k: int = 20) -> DataFrame:
    """Tokens over-represented in a source: lift and chi-square against independence, top k per source.

    A token counts once per email. Counting per (token, source) comes first, so frequent tokens are combined
    map-side; the rank filter is applied per task before the shuffle.
    """
    present = df.select("dataset_id", F.explode(F.array_distinct(terms)).alias("token"))
    cell = present.groupBy("token", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    per_token = cell.groupBy("token").agg(F.sum("n").alias("n_token")).filter(F.col("n_token") >= min_docs)
    per_source = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_source"))
    whole = per_source.agg(F.sum("n_source").alias("n_all"))
    sized = per_source.withColumn("_k", F.lit(1)).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").drop("_k")
    joined = cell.join(per_token, "token").join(sized, "dataset_id")
    n, t, s, a = (F.col(c).cast("double") for c in ("n", "n_token", "n_source", "n_all"))
    spread = t * s * (a - t) * (a - s)
    chi2 = F.when(spread > 0, a * (n * a - t * s) * (n * a - t * s) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(0.0))
    scored = joined.select("dataset_id", "token", F.col("n").alias("n_docs"), "n_token",
                           (n * a / (t * s)).alias("lift"), chi2.alias("chi2"))
    order = Window.partitionBy("dataset_id").orderBy(F.desc("lift"), F.desc("n_docs"), "token")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
