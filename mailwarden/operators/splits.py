"""Leakage-free splits by hashing the group key: no shuffle, stable when rows are appended."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailwarden.functions.hashing import seeded, unit
from mailwarden.operators.ranks import running_totals


def _side(u: Column, test_size: float, val_size: float) -> Column:
    return (F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train"))


def group_split(df: DataFrame, group_col: str = "unified_cluster_id", test_size: float = 0.15,
                val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``. Fractions are of groups; a null group is its own group, so no cluster spans splits."""
    key = F.coalesce(F.col(group_col), F.col("sample_id"))
    return df.withColumn("split", _side(unit(seeded(seed, key)), test_size, val_size))


def stratified_split(df: DataFrame, stratify_col: str = "label", test_size: float = 0.15,
                     val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Exact per-stratum quotas: rows are ranked by hash within their stratum.

    Two labels would mean two window tasks, so the rank is built from 65,536 hash bins per stratum.
    """
    stratum = F.coalesce(F.col(stratify_col).cast("string"), F.lit("missing"))
    keyed = df.withColumns({"_stratum": stratum, "_h": F.md5(seeded(seed, F.col("sample_id"))), "_one": F.lit(1)})
    placed = running_totals(keyed, ["_stratum"], F.substring("_h", 1, 4), [F.col("_h"), F.col("sample_id")],
                            {"_one": "_rank"}, totals={"_one": "_n"})
    n_test = F.round(F.col("_n") * F.lit(test_size))
    n_val = F.round(F.col("_n") * F.lit(val_size))
    side = (F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val")
            .otherwise("train"))
    return placed.withColumn("split", side).select(*df.columns, "split")


def split_profile(split: DataFrame) -> DataFrame:
    """Rows per split, label and source."""
    return split.groupBy("split", "dataset_id", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def split_label_matrix(split: DataFrame) -> DataFrame:
    """One row per split with a column per label class and the share of phishing among labelled rows."""
    n0, n1 = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), n0.alias("n_legitimate"), n1.alias("n_phishing"),
        (n1 / F.greatest(n0 + n1, F.lit(1))).alias("phishing_share"))


def loso_assign(df: DataFrame, val_size: float = 0.15, seed: int = 42,
                group_col: str | None = None) -> DataFrame:
    """Leave-one-source-out without multiplying the table.

    For fold f a row is ``test`` when ``dataset_id = f`` and ``inner_split`` otherwise, so one column
    holds every fold. With ``group_col`` the train/val choice follows the cluster and
    ``group_col`` lets :func:`loso_fold` drop training rows whose cluster also occurs in the held-out source.
    """
    key = F.coalesce(F.col(group_col), F.col("sample_id")) if group_col else F.col("sample_id")
    inner = F.when(unit(seeded(seed, F.lit("loso"), key)) < val_size, "val").otherwise("train")
    return (df.filter(F.trim(F.col("dataset_id")) != "")
            .withColumn("inner_split", inner).withColumnRenamed("dataset_id", "held_out_fold"))


def loso_fold(assigned: DataFrame, fold: str, group_col: str | None = None) -> DataFrame:
    """Rows of one fold with their ``split``. With ``group_col`` the training side loses leaking clusters."""
    is_test = F.col("held_out_fold") == fold
    out = assigned.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.col("inner_split")))
    if group_col is None:
        return out
    held = assigned.filter(is_test & F.col(group_col).isNotNull()).select(group_col).distinct()
    safe = out.filter(~is_test).join(held, group_col, "left_anti")
    return out.filter(is_test).unionByName(safe)


def loso_summary(assigned: DataFrame) -> DataFrame:
    """Per fold: train, val and test rows and the number of training sources.

    Rows are first counted per (source, inner split); folds are then formed on that small table.
    """
    counts = assigned.groupBy(F.col("held_out_fold").alias("source")).agg(
        F.count_if(F.col("inner_split") == "train").alias("tr"),
        F.count_if(F.col("inner_split") == "val").alias("va"),
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("tr").alias("all_tr"), F.sum("va").alias("all_va"),
                       F.count_if(F.col("tr") > 0).alias("sources_tr")).withColumn("_k", F.lit(1))     # one row
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(
        F.col("source").alias("fold"),
        (F.col("all_tr") - F.col("tr")).alias("n_train"),
        (F.col("all_va") - F.col("va")).alias("n_val"),
        F.col("n").alias("n_test"),
        (F.col("sources_tr") - (F.col("tr") > 0).cast("int")).alias("n_train_sources"))
