"""Error slices, cross-source evaluation and the long report."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from mailwarden.functions.text import py_round
from mailwarden.operators.metrics import classification_metrics, ranking_metrics


def mark_errors(df: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("pred")
    return df.withColumn("error_type", F.when((y == 0) & (p == 1), "FALSE_POSITIVE")
                         .when((y == 1) & (p == 0), "FALSE_NEGATIVE").otherwise("CORRECT"))


def error_slices(marked: DataFrame) -> DataFrame:
    """Per source and overall (dataset_id null): totals, errors and rates."""
    fp, fn = F.col("error_type") == "FALSE_POSITIVE", F.col("error_type") == "FALSE_NEGATIVE"
    per_source = marked.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"),
        F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))
    rolled = per_source.rollup("dataset_id").agg(
        *[F.sum(c).alias(c) for c in ("total", "fp", "fn", "negatives", "positives")])
    return rolled.select(
        "dataset_id", "total", "fp", "fn",
        ((F.col("fp") + F.col("fn")) / F.col("total")).alias("error_rate"),
        (F.col("fp") / F.greatest("negatives", F.lit(1))).alias("fp_rate"),
        (F.col("fn") / F.greatest("positives", F.lit(1))).alias("fn_rate"))


def worst_errors(marked: DataFrame, k: int = 5) -> DataFrame:
    """The k most confident errors of each kind, subjects cut to 80 characters for display.

    A row_number filter is pushed below the shuffle by Spark, so each task forwards at most k rows per kind.
    """
    severity = F.when(F.col("error_type") == "FALSE_POSITIVE", -F.col("prob")).otherwise(F.col("prob"))
    order = Window.partitionBy("error_type").orderBy(severity, "sample_id")
    return (marked.filter("error_type <> 'CORRECT'").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("error_type", "rank", "sample_id", "dataset_id",
                    F.substring(F.coalesce("subject", F.lit("")), 1, 80).alias("subject"),
                    F.col("prob").alias("pred_prob")))


def transfer_scores(scored: DataFrame, has_probability: bool = True) -> DataFrame:
    """M_ij long: (train_source, eval_source, score), ROC-AUC or F1, 4 decimals, null with one class."""
    keys = ["train_source", "eval_source"]
    if has_probability:
        out = ranking_metrics(scored, keys).withColumn("score", F.col("roc_auc"))
    else:
        m = classification_metrics(scored, keys)
        both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
        out = m.withColumn("score", F.when(both, F.col("f1")))
    return out.select(*keys, py_round(F.col("score"), 4).alias("score"))


def transfer_matrix(long: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Square form: one row per training source, one column per evaluation source."""
    return long.groupBy("train_source").pivot("eval_source", sources).agg(F.first("score"))


def metric_summary(per_source: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """Mean, population deviation, min and max of each metric over sources; missing values skipped."""
    long = per_source.unpivot([key], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    usable = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.groupBy("metric").agg(
        py_round(F.avg("value"), 4).alias("mean"), py_round(F.stddev_pop("value"), 4).alias("std"),
        py_round(F.min("value"), 4).alias("min"), py_round(F.max("value"), 4).alias("max"))


def generalization_gap(inside: DataFrame, outside: DataFrame, metric: str, key: str) -> DataFrame:
    """inside - outside per key, 4 decimals."""
    a = inside.select(key, F.col(metric).alias("in_domain"))
    b = outside.select(key, F.col(metric).alias("out_domain"))
    return a.join(b, key).withColumn("gap", py_round(F.col("in_domain") - F.col("out_domain"), 4))


def report_long(sections: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(section, slice, metric, value) over any number of metric tables.

    ``keys`` names the slice column of a section; sections without one are a single slice.
    """
    parts = []
    for section, table in sections.items():
        key = keys.get(section)
        values = [c for c in table.columns if c != key]
        head = F.coalesce(F.col(key).cast("string"), F.lit("all")) if key else F.lit("all")
        wide = table.select(head.alias("slice"), *[F.col(c).cast("double").alias(c) for c in values])
        parts.append(wide.unpivot(["slice"], values, "metric", "value").withColumn("section", F.lit(section)))
    return reduce(DataFrame.unionByName, parts).select("section", "slice", "metric", "value")
