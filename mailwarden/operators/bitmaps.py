"""Bitmaps of fixed size: which rows cannot be among some values, told without a shuffle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from mailwarden.session import stored

#: Bits of a broadcast bitmap: 262,144 words at most.
BITS = 1 << 24


def _bit(columns: list[str], seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bits))


def bitmap(rows: DataFrame, columns: list[str], seed: int = 1, bits: int = BITS) -> DataFrame:
    """(_word, _set): a bit for every value of ``columns`` in words of 64, ``bits`` / 64 rows at most; written."""
    at = rows.select(_bit(columns, seed, bits).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_set"))
    return stored(words, "bitmap")


def flagged(rows: DataFrame, marks: DataFrame, columns: list[str], name: str, seed: int = 1, bits: int = BITS) -> DataFrame:
    """Adds ``name``: whether the row's bit is set; if not, its ``columns`` are not among the values of the bitmap.

    The bitmap is broadcast, as its size is fixed. It keeps wide rows out of a shuffle; the exact join of the rows that it
    lets through decides. A bitmap that fills up lets more rows through, and changes no result.
    """
    at = rows.withColumn("_at", _bit(columns, seed, bits)).withColumn("_word", F.expr("_at div 64"))
    is_set = F.expr("coalesce(shiftrightunsigned(_set, cast(_at % 64 as int)) & 1L, 0L) = 1L")
    return at.join(F.broadcast(marks), "_word", "left").withColumn(name, is_set).drop("_at", "_word", "_set")


def among(rows: DataFrame, values: DataFrame, column: str, narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows whose ``column`` is among ``values``, a table of that column without repeats; the others are not shuffled.
    ``narrowed`` makes smaller rows of those that the bitmap lets through, before they are shuffled."""
    near = flagged(rows, bitmap(values, [column]), [column], "_hit").filter("_hit").drop("_hit")
    near = near if narrowed is None else narrowed(near)
    # an inner join: a semi join would be moved below the bitmap
    return near.join(values.hint("merge"), column).select(*near.columns)
