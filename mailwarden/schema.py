"""Canonical email schema."""
from __future__ import annotations

from pyspark.sql import types as T

CANONICAL_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType(), False),
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("subject", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("sender", T.StringType(), True),
    T.StructField("receiver", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("urls_raw", T.StringType(), True),
    T.StructField("url_count_source", T.IntegerType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("raw_row_id", T.LongType(), False),
])
