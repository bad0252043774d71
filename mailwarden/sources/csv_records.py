"""CSV records from files that are cut into blocks, line breaks inside quotes included.

The text source splits a file into blocks, and every task sees whole lines. A line maps "inside quotes or not" at its start to
the same at its end, whatever it started with; such maps compose, so prefix windows inside each block, and over the one-row
summaries of the blocks of a file, give the true state at every line. Lines that start outside quotes start a record. Lines
are dealt by (file, block) once, and stay there: only the lines at the head of a block that finish a record of an earlier
block are moved.

Fields follow the usual rules: separated by commas, quoted as a whole, quotes inside doubled; a quote inside a field that
does not start with one is text. The encoding must keep ASCII bytes (UTF-8, ISO-8859-1 and the like). Empty lines between
records are skipped. A record, and the line numbers of a block, have to fit into a task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailwarden.session import stored

# possessive throughout: one pass per line, without recursion
_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'^{_FIELDS}"{_INSIDE}\z'
_STAYS = rf'^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?\z'
_PLACE = ["_file", "_block"]


def _lines(spark: SparkSession, path: str | list[str], encoding: str, crlf: bool) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    if crlf:
        value = F.regexp_replace(value, r"\r\z", "")
    return text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"), value.alias("_line"))


def _before(df: DataFrame, place: list[str], order: str, first: Column, second: Column) -> DataFrame:
    """Add ``_own0`` and ``_own1``: the state before each row when its group starts outside (0) or inside (1) of quotes.
    ``first`` and ``second`` are the states after the row from 0 and from 1."""
    window = Window.partitionBy(*place).orderBy(order)
    turn = ((first == 1) & (second == 0)).cast("int")
    df = df.withColumn("_turns", F.sum(turn).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(first == second, F.struct(first.alias("state"), F.col("_turns").alias("turns")))
    df = df.withColumns({"_fixed": F.last(fixed, True).over(window.rowsBetween(Window.unboundedPreceding, -1)),
                         "_turns": F.col("_turns") - turn})
    own = [F.pmod(F.coalesce(F.col("_fixed.state") - F.col("_fixed.turns"), F.lit(s)) + F.col("_turns"), F.lit(2)) for s in (0, 1)]
    return df.withColumns({"_own0": own[0], "_own1": own[1]}).drop("_turns", "_fixed")


def _after(state: Column) -> Column:
    return F.when(state == 0, F.col("_end0")).otherwise(F.col("_end1"))


def records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", crlf: bool = False) -> DataFrame:
    """(_file, _block, _id, record): the records of the files at ``path``, headers included, each where its first line is.
    ``_id`` rises with the position in a block; the rows are partitioned by (_file, _block)."""
    quoted = F.contains("_line", F.lit('"'))
    lines = _lines(spark, path, encoding, crlf).withColumns({
        "_end0": F.when(quoted, F.col("_line").rlike(_OPENS).cast("int")).otherwise(F.lit(0)),
        "_end1": F.when(quoted, F.col("_line").rlike(_STAYS).cast("int")).otherwise(F.lit(1))})
    by_id = Window.partitionBy(*_PLACE).orderBy("_id")
    # the states of all lines of a block depend on how it starts: a row per block, from narrow columns
    own = _before(lines, _PLACE, "_id", F.col("_end0"), F.col("_end1"))
    blocks = own.groupBy(*_PLACE).agg(
        F.max_by(_after(F.col("_own0")), "_id").alias("_end0"), F.max_by(_after(F.col("_own1")), "_id").alias("_end1"),
        F.max(F.when(F.col("_own0") == 0, F.col("_id"))).alias("_last0"), F.max(F.when(F.col("_own1") == 0, F.col("_id"))).alias("_last1"))
    blocks = _before(blocks, ["_file"], "_block", F.col("_end0"), F.col("_end1")).withColumn("_start", F.col("_own0"))
    blocks = blocks.withColumn("_last", F.when(F.col("_start") == 0, F.col("_last0")).otherwise(F.col("_last1")))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("_home", F.last(F.when(F.col("_last").isNotNull(), F.col("_block")), True).over(earlier))
                    .select(*_PLACE, "_start", "_last", "_home"), "csv_blocks")

    placed = own.join(blocks, _PLACE)
    starts = F.when(F.col("_start") == 0, F.col("_own0")).otherwise(F.col("_own1")) == 0
    placed = placed.withColumn("_record", F.max(F.when(starts, F.col("_id"))).over(by_id.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_line"))), lambda x: x["_line"]), "\n")
    # the head of a block goes to the last record of its home, through the blocks in between where they are all inside quotes
    heads = placed.filter("_record is null").groupBy("_file", F.col("_home").alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), "_id", "_line"))), lambda x: x["_line"]), "\n")
        .alias("_tail"))
    body = placed.filter("_record is not null").groupBy(*_PLACE, "_record").agg(joined.alias("record"), F.first("_last").alias("_last"))
    whole = body.join(heads, _PLACE, "left")
    tail = F.when((F.col("_record") == F.col("_last")) & F.col("_tail").isNotNull(), F.concat(F.lit("\n"), "_tail")).otherwise(F.lit(""))
    return whole.select(*_PLACE, F.col("_record").alias("_id"), F.concat("record", tail).alias("record")).filter("record <> ''")


def parsed(spark: SparkSession, path: str | list[str], names: list[str], encoding: str = "UTF-8", crlf: bool = False,
           follow: bool = False) -> DataFrame:
    """The fields of every record under ``names``, all text, and ``raw_row_id``, the 0-based number of the row in its file;
    with ``follow`` the numbers go on from file to file in the order of their names, the shorter ones first.

    The first record of each file is its header and no row. Records with more fields than names are left out and not
    counted, short ones are padded with nulls. The rows are written once.
    """
    extra = "_overflow"
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, extra])
    fields = F.from_csv("record", schema, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"})
    by_id = Window.partitionBy(*_PLACE).orderBy("_id")
    rows = records(spark, path, encoding, crlf).withColumn("_n", F.row_number().over(by_id))
    rows = rows.filter((F.col("_block") > 0) | (F.col("_n") > 1)).select(*_PLACE, "_id", fields.alias("_f"))
    rows = rows.filter(F.col(f"_f.{extra}").isNull()).select(*_PLACE, F.row_number().over(by_id).alias("_n"), "_f")
    rows = stored(rows, "csv_rows")
    counts = rows.groupBy(*_PLACE).agg(F.max("_n").alias("_rows"))
    order = Window.orderBy(F.length("_file"), "_file", "_block") if follow else Window.partitionBy("_file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*_PLACE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))      # a row per block
    return rows.join(offsets, _PLACE).select(
        "_f.*", (F.col("_before") + F.col("_n") - 1).alias("raw_row_id")).drop(extra)
