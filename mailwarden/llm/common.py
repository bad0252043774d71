"""Helpers shared by the operators: written tables, hot-key joins, Arrow batches as Python rows, small file-system calls."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailwarden.operators.bitmaps import BITS, bitmap, flagged  # noqa: F401
from mailwarden.session import scratch_path

#: Bytes of text that a Python worker holds as one piece of work.
PIECE = 2 << 20
#: Bytes of a row group of written texts or token ids.
ROW_GROUP = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read by any executor, no lineage behind it. ``block`` bounds
    the bytes of a row group, which a task holds until it is full."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(large: DataFrame, small: DataFrame, key: str, salt_from: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join on ``key`` where one key may hold a large share of ``large`` and ``small`` has one row per key.

    ``salt_from`` deals the rows of a key over ``salts`` tasks; ``small``, narrow and far shorter, is repeated for each. It
    still grows with the input, so it is never broadcast: Spark would judge it by its size before it is repeated.
    """
    left = large.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE) -> Iterator[list[tuple]]:
    """Rows of Arrow batches (id, text, ...) in lists of at most ``limit`` bytes of text, or of one longer text.

    The text arrives as UTF-8 bytes; a null text stays None.
    """
    for batch in batches:
        columns = [batch.column(0), batch.column(1).cast(pa.binary())] + [batch.column(i) for i in range(2, batch.num_columns)]
        row, size, held = 0, 0, 0
        for i in range(batch.num_rows):
            size += len(columns[1][i].as_buffer() or b"") if columns[1][i].is_valid else 0
            if size >= limit or i - held >= 4095:
                yield list(zip(*(c.slice(row, i + 1 - row).to_pylist() for c in columns)))
                row, size, held = i + 1, 0, i + 1
        if row < batch.num_rows:
            yield list(zip(*(c.slice(row).to_pylist() for c in columns)))


def map_texts(df: DataFrame, columns: list, schema: str, work: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Apply ``work`` to pieces of rows (id, text bytes, ...) and return its rows; no shuffle."""
    from pyspark.sql.types import StructType

    kinds = _arrow(StructType.fromDDL(schema))

    def run(batches):
        for rows in pieces(batches):
            out = work(rows)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
