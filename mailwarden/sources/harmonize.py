"""Schema discovery and harmonization of raw corpora into the canonical email table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailwarden import constants as K
from mailwarden.functions.text import strip


def discover_roles(columns: list[str]) -> dict[str, str | None]:
    """Role -> column, from names alone. Exact matches in candidate order first; the label and then the body
    fall back to a substring match in column order. Of names equal after lower-casing the last one wins."""
    by_name = {c.strip().lower(): c for c in columns}
    roles = {role: next((by_name[n] for n in names if n in by_name), None)
             for role, names in K.ROLE_CANDIDATES.items()}
    for role in ("label", "body"):
        if roles[role] is None:
            taken = roles["label"] if role == "body" else None
            roles[role] = next((c for c in columns if c != taken
                                and any(n in c.strip().lower() for n in K.ROLE_CANDIDATES[role])), None)
    return roles


def schema_profile(df: DataFrame, source: str) -> DataFrame:
    """(source, role, column, n_rows, n_missing): the discovered roles with their counts."""
    roles = {r: c for r, c in discover_roles(df.columns).items() if c}
    if not roles:
        raise ValueError(f"no known column in {source}")
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{r}") for r, c in roles.items()])
    return counts.select(F.lit(source).alias("source"), "n_rows", F.inline(F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(c).alias("column_name"), F.col(f"_{r}").alias("n_missing"))
        for r, c in roles.items()])))


def label_value(raw: Column) -> Column:
    """0, 1 or null. Known spellings first, then numbers truncated towards zero (0.7 -> 0, 1.9 -> 1)."""
    text = strip(raw.cast("string"))
    spelled = F.lower(text)
    # the guard keeps spellings such as "1d", which the cast would accept, ambiguous
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return (F.when(spelled.isin(K.LEGITIMATE_LABELS), F.lit(0))
            .when(spelled.isin(K.PHISHING_LABELS), F.lit(1))
            .when((number > -1) & (number < 1), F.lit(0))
            .when((number >= 1) & (number < 2), F.lit(1)))


def label_mapping(df: DataFrame, label: str, source: str) -> DataFrame:
    """Distinct raw labels of a source with their class and an ambiguity flag."""
    return (df.filter(F.col(label).isNotNull()).groupBy(source, F.col(label).cast("string").alias("raw_label"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("label", label_value(F.col("raw_label")))
            .withColumn("is_ambiguous", F.col("label").isNull()))


def sample_id(dataset: Column, row: Column) -> Column:
    return F.concat_ws("_", dataset, row.cast("string"))


def harmonize(df: DataFrame, source: str | Column, roles: dict[str, str | None] | None = None) -> DataFrame:
    """Project one raw corpus (with ``raw_row_id``) to the canonical columns.

    The text "nan" and absent roles become null; ``url_count_source`` is always null at this stage.
    """
    roles = roles or discover_roles([c for c in df.columns if c not in ("dataset_id", "raw_row_id")])
    if roles["label"] is None:
        raise ValueError(f"no label column found for {source}")
    dataset = F.lit(source) if isinstance(source, str) else source

    def text(role: str) -> Column:
        name = roles[role]
        return F.nullif(F.col(f"`{name}`").cast("string"), F.lit("nan")) if name else F.lit(None).cast("string")

    return df.select(
        sample_id(dataset, F.col("raw_row_id")).alias("sample_id"), dataset.alias("dataset_id"),
        text("subject").alias("subject"), text("body").alias("body"), text("sender").alias("sender"),
        text("receiver").alias("receiver"), text("date").alias("date"), text("url").alias("urls_raw"),
        F.lit(None).cast("int").alias("url_count_source"),
        label_value(F.col(f"`{roles['label']}`")).alias("label"),
        F.col("raw_row_id").cast("bigint").alias("raw_row_id"))


def harmonize_all(raw: dict[str, DataFrame]) -> DataFrame:
    """Union of the harmonized corpora."""
    return reduce(DataFrame.unionByName, [harmonize(df, name) for name, df in raw.items()])


def violations(df: DataFrame, known_sources: list[str] | None = None) -> DataFrame:
    """(rule, value, n): missing required columns, bad labels, unknown sources, repeated sample ids."""
    spark = df.sparkSession
    known = K.KNOWN_SOURCES if known_sources is None else known_sources
    parts = []
    absent = [c for c in K.REQUIRED_COLUMNS if c not in df.columns]
    if absent:
        parts.append(spark.createDataFrame([("missing_column", c, 1) for c in absent],
                                           "rule string, value string, n bigint"))
    if "label" in df.columns:
        parts.append(df.filter(F.col("label").isNotNull() & ~F.col("label").isin(0, 1))
                     .groupBy(F.lit("invalid_label").alias("rule"), F.col("label").cast("string").alias("value"))
                     .agg(F.count(F.lit(1)).alias("n")))
    if "dataset_id" in df.columns:
        allowed = spark.createDataFrame([(s,) for s in known], "dataset_id string")
        per_source = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_source.join(F.broadcast(allowed), "dataset_id", "left_anti")   # a short fixed list
                     .select(F.lit("unknown_source").alias("rule"), F.col("dataset_id").alias("value"), "n"))
    if "sample_id" in df.columns:
        parts.append(df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"))
                     .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).filter("n > 0")
                     .select(F.lit("duplicate_sample_id").alias("rule"), F.lit("all").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)
