"""File sources and sinks: raw corpora as CSV, integrity manifest, split tables."""
from __future__ import annotations

import hashlib
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mailwarden.sources import csv_records

#: What a task holds of a file while its checksum is computed.
CHUNK = 1 << 24


def _opened(path: str):
    """A byte stream of a file as Spark names it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa_fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    found, inner = pa_fs.FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return found.open_input_stream(inner)


def file_checksums(files: DataFrame, chunk: int | None = None) -> DataFrame:
    """(path, length, md5) of the files named by (path, length), of any size.

    A digest has to read its file in order, so a file is one task's work; the task holds ``chunk`` bytes of it. Files are
    dealt to tasks one by one, since their sizes may differ by any factor.
    """
    chunk = chunk or CHUNK

    def run(batches):
        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.md5(usedforsecurity=False)
                with _opened(path) as stream:
                    while piece := stream.read(chunk):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "length", "md5"])

    # a stated number of tasks: by their few bytes, the names of all files would end in one
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "length").repartition(tasks, "path")
    return dealt.mapInArrow(run, "path string, length long, md5 string")


def file_integrity(spark: SparkSession, root: str, manifest: DataFrame | None = None,
                   min_bytes: int = 0) -> DataFrame:
    """(file, length, md5, is_usable) per file below ``root``; ``file`` is the path relative to it.

    ``manifest`` holds (file, expected_md5). A file that it names is usable only if the checksums agree; other files are
    checked against ``min_bytes`` alone. Every file that Spark lists (empty ones are not) is a row of the result, usable or not.
    """
    # the listing only: the content column is not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    folder = root.rstrip("/").rsplit("/", 1)[-1]
    name = F.substring_index(F.col("path"), f"/{folder}/", -1)
    found = file_checksums(files).select(name.alias("file"), "length", "md5")
    if manifest is None:
        return found.withColumn("is_usable", F.col("length") >= min_bytes)
    checked = found.join(manifest, "file", "left")
    matches = F.col("expected_md5").isNull() | F.coalesce(F.col("md5") == F.col("expected_md5"), F.lit(False))
    return checked.withColumn("is_usable", (F.col("length") >= min_bytes) & matches)


def _header(spark: SparkSession, path: str | list[str], encoding: str) -> list[str]:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding).columns


def text_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """utf-8 when every line is valid utf-8, otherwise latin-1 (which accepts any bytes)."""
    ok = spark.read.text(path).agg(F.bool_and(F.expr("is_valid_utf8(value)")).alias("ok")).first()["ok"]
    return "UTF-8" if ok is None or ok else "ISO-8859-1"


def number_rows(df: DataFrame) -> DataFrame:
    """0-based row number within each file, without moving rows.

    Spark's increasing ids are consecutive inside a partition; subtracting the smallest id of the
    (file, block) and adding the rows of earlier blocks gives file order. Only the per-block table is shuffled.
    """
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                             "_id": F.monotonically_increasing_id()})
    blocks = placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.join(offsets, ["_file", "_block"])
            .withColumn("raw_row_id", F.col("_id") - F.col("_first") + F.col("_before"))
            .drop("_file", "_block", "_id", "_first", "_before"))


def read_corpus(spark: SparkSession, path: str | list[str], source: str, encoding: str | None = None, follow: bool = False) -> DataFrame:
    """One raw corpus, of one file, a folder or some files, all columns as text, plus dataset_id and raw_row_id: the number of
    the row in its file, or with ``follow`` in all of them (``csv_records``).

    Lines with too many fields are skipped, short lines are padded with nulls. Files are read in blocks, also where fields
    hold line breaks (``csv_records``). The line end of the first line is that of all lines.
    """
    encoding = encoding or text_encoding(spark, path)
    names = _header(spark, path, encoding)
    first = spark.read.option("lineSep", "\n").text(path).head()
    crlf = first is not None and (first["value"] or "").endswith("\r")
    return csv_records.parsed(spark, path, names, encoding, crlf, follow).withColumn("dataset_id", F.lit(source))


def read_corpora(spark: SparkSession, root: str, sources: dict[str, str | list[str]], manifest: DataFrame | None = None,
                 min_bytes: int = 0) -> dict[str, DataFrame]:
    """Every usable configured corpus, of one file or several: missing or mismatching files, and those below ``min_bytes``,
    are left out."""
    usable = {r["file"] for r in file_integrity(spark, root, manifest, min_bytes)
              .filter("is_usable").select("file").collect()}      # one row per corpus file
    found = {name: [f"{root}/{f}" for f in ([own] if isinstance(own, str) else own) if f in usable] for name, own in sources.items()}
    return {name: read_corpus(spark, paths, name) for name, paths in found.items() if paths}


def union_corpora(raw: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), raw.values())


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def split_metadata(split: DataFrame) -> DataFrame:
    """Rows per split and label."""
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def save_splits(split: DataFrame, path: str) -> None:
    """Split tables as one partitioned parquet table, and their metadata as JSON next to it."""
    write_table(split, f"{path}/data", ["split"])
    split_metadata(split).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Only the folder of one split is read (partition pruning)."""
    return spark.read.parquet(f"{path}/data").filter(F.col("split") == split)
