"""Dataset audits: one aggregation per report."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailwarden.functions.text import WORD, count, is_blank, nz, py_round
from mailwarden.functions.urls import AUDIT_URL


def dataset_summary(df: DataFrame, source: str = "dataset_id") -> DataFrame:
    """Per source: rows, columns, missing cells and their share of all cells (2 decimals)."""
    columns = [c for c in df.columns if c != source]
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    n = F.count(F.lit(1))
    return df.groupBy(source).agg(
        n.alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), missing.alias("total_missing"),
        py_round(missing / (n * len(df.columns)) * 100, 2).alias("missing_pct"))


def text_stats(df: DataFrame, column: str, source: str = "dataset_id") -> DataFrame:
    """Presence, emptiness, characters and words of a text column per source.

    Medians are exact; their buffers hold distinct lengths, which are bounded by the longest text.
    """
    c = F.col(column)
    prepared = df.select(source, c.isNotNull().alias("present"), is_blank(c).alias("blank"),
                         F.length(c).alias("chars"), F.when(c.isNotNull(), count(nz(c), WORD)).alias("words"))
    return prepared.groupBy(source).agg(
        F.count_if("present").alias("present"),
        F.count_if(~F.col("present")).alias("missing"),
        F.count_if("blank").alias("empty"),
        py_round(F.avg("chars"), 1).alias("char_mean"),
        py_round(F.percentile("chars", 0.5), 1).alias("char_median"),
        F.min("chars").alias("char_min"), F.max("chars").alias("char_max"),
        py_round(F.stddev_samp("chars"), 1).alias("char_std"),
        py_round(F.avg("words"), 1).alias("word_mean"),
        py_round(F.percentile("words", 0.5), 1).alias("word_median"),
        F.max("words").alias("word_max"))


def url_stats(df: DataFrame, column: str = "body", source: str = "dataset_id") -> DataFrame:
    """URL prevalence per source, over rows whose text is present."""
    counted = df.filter(F.col(column).isNotNull()).select(source, count(F.col(column), AUDIT_URL).alias("n"))
    with_url, rows = F.count_if(F.col("n") > 0), F.count(F.lit(1))
    return counted.groupBy(source).agg(
        with_url.alias("emails_with_urls"),
        py_round(with_url / rows * 100, 2).alias("emails_with_urls_pct"),
        py_round(F.avg("n"), 2).alias("url_count_mean"),
        F.max("n").alias("url_count_max"), F.sum("n").alias("total_urls_found"))


def missing_by_column(df: DataFrame, columns: list[str], source: str = "dataset_id") -> DataFrame:
    """(source, column, missing count, pct): counted wide in one pass, then turned long."""
    n = F.count(F.lit(1))
    wide = df.groupBy(source).agg(n.alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([source, "n_rows"], columns, "column_name", "n_missing").withColumn(
        "missing_pct", py_round(F.col("n_missing") / F.col("n_rows") * 100, 2))


def class_distribution(df: DataFrame, label: str = "label", source: str = "dataset_id") -> DataFrame:
    """Label counts per source and their share of all rows of the source, missing labels included."""
    counts = df.groupBy(source, label).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy(source).agg(F.sum("n_rows").alias("_total"))
    return (counts.filter(F.col(label).isNotNull()).join(totals, source)
            .withColumn("class_pct", py_round(F.col("n_rows") / F.col("_total") * 100, 2)).drop("_total"))


def metadata_availability(df: DataFrame, source: str = "dataset_id") -> DataFrame:
    """Whether a source carries any sender, receiver or date at all."""
    return df.groupBy(source).agg(
        *[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("sender", "receiver", "date")])
