"""Running totals over huge orderings without a one-task window.

A plain ``Window.partitionBy(group).orderBy(x)`` puts a whole group into one task. Here a monotone bin
of x splits every group: totals per bin are small and get the cumulative offset, and the inner window
runs per (group, bin).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_totals(df: DataFrame, groups: list[str], bin_col: Column, order: list[Column],
                   sums: dict[str, str], descending_bins: bool = False,
                   totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running totals of the columns in ``sums`` (source -> result name).

    ``totals`` adds whole-group totals of columns that are also in ``sums``; they come from the small per-bin table
    and cost no further join. ``bin_col`` must be monotone in ``order``. Feed it rows that are already aggregated
    per order key, so that ties are one row.
    """
    totals = totals or {}
    binned = df.withColumn("_bin", bin_col)
    per_bin = binned.groupBy(*groups, "_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    bin_order = F.col("_bin").desc() if descending_bins else F.col("_bin").asc()
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(
        *groups, "_bin", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(name) for c, name in totals.items()])
    inner = (Window.partitionBy(*groups, "_bin").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = binned.join(offsets, [*groups, "_bin"])
    return joined.select(
        *df.columns, *totals.values(),
        *[(F.col(f"_o_{c}") + F.sum(c).over(inner)).alias(name) for c, name in sums.items()])


def probability_bin(p: Column) -> Column:
    """Monotone bin of a probability on the log-odds scale: fine near 0 and 1, where scores pile up."""
    inside = F.least(F.greatest(p, F.lit(1e-18)), F.lit(1.0 - 1e-16))
    return F.floor(F.log(inside / (F.lit(1.0) - inside)) * 64).cast("int")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based rank of distinct keys in key order, binned by the first four characters of the (hex) key."""
    ranked = running_totals(df.withColumns({"_one": F.lit(1), "_g": F.lit(0)}), ["_g"],
                            F.substring(key, 1, 4), [F.col(key)], {"_one": "_rank"})
    return ranked.withColumn(name, F.col("_rank") - 1).drop("_rank", "_one", "_g")
