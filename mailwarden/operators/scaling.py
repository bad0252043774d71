"""Feature scaling: parameters are fitted on the training rows only and applied as literals."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

METHODS = ("standard", "robust", "minmax")


def finite(df: DataFrame, features: list[str]) -> DataFrame:
    """NaN and null become 0, infinities become +-1e6."""
    def clean(name: str):
        c = F.col(name).cast("double")
        return (F.when(c.isNull() | F.isnan(c), F.lit(0.0))
                .when(c == float("inf"), F.lit(1e6))
                .when(c == float("-inf"), F.lit(-1e6))
                .otherwise(c).alias(name))
    return df.select(*[clean(c) if c in features else F.col(c) for c in df.columns])


def fit_scaler(train: DataFrame, features: list[str], method: str = "standard",
               accuracy: int = 100000) -> DataFrame:
    """Table (feature, center, scale) from one aggregation over the training rows.

    ``standard`` uses the population deviation. ``robust`` uses quartiles from a mergeable sketch, whose
    size does not grow with the data. A zero spread scales by 1, so constant columns become 0. The columns are
    unpivoted and combined map-side: a few aggregates over few keys compile, hundreds of wide ones do not.
    """
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    rows = finite(train.select(*features), features).unpivot([], features, "feature", "value")
    v = F.col("value")
    if method == "standard":
        center, spread = F.avg(v), F.stddev_pop(v)
    elif method == "minmax":
        center, spread = F.min(v), F.max(v) - F.min(v)
    else:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        center, spread = q[1], q[2] - q[0]
    fitted = rows.groupBy("feature").agg(center.alias("center"), spread.alias("scale"))
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def apply_scaler(df: DataFrame, params: DataFrame) -> DataFrame:
    """Scale with fitted parameters. The parameter table has one row per feature, so reading it is bounded."""
    fitted = {r["feature"]: (r["center"], r["scale"]) for r in params.collect()}
    if not fitted:
        raise RuntimeError("scaler is not fitted: the training rows were empty")
    out = finite(df, list(fitted))
    return out.select(*[
        ((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in fitted else F.col(c)
        for c in out.columns
    ])


def save_scaler(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
