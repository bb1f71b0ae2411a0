"""CSV whose fields may hold line feeds, read in many tasks per file.

A reader that follows quotes from the start of a file needs one task per file. Here
files are split by bytes into blocks of physical lines, as plain text is:

1. each block's number of quotes, summed over the blocks before it, tells whether the
   block starts inside quotes (a prefix sum over one small row per block);
2. within a block, the running number of quotes tells at which lines a record starts;
   lines of one record are joined again;
3. what a block ends with inside quotes meets the first lines of the blocks after it (at most
   two pieces per block);
4. whole records go to Spark's own CSV parser (``from_csv``).

The first read moves no text, the second shuffles it once, block by block, over as many
tasks as there are blocks. A file needs quotes doubled inside quoted fields and none in
unquoted ones (as this library writes them); others are read with ``multi_line=True``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from georisk.plans.broadcast import bounded_broadcast
from georisk.session import shared_path

HEADERS = (True, False, "first")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their file, block and order within the block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), F.length(F.regexp_replace("value", '[^"]', "")).alias("quotes"))


def _joined(order: str | list[str], by: list[str], pieces: DataFrame, *more: Column) -> DataFrame:
    """``pieces`` of text grouped by ``by`` and put together with line feeds, in order."""
    piece = F.struct(*order, F.col("value"))
    texts = F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["value"])
    return pieces.groupBy(*by).agg(F.array_join(texts, "\n").alias("value"), *more)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, record, value, in_first): every record's text, line feeds inside quotes included.
    The first record of a file is record 1 of block 0; a record is numbered where it starts.
    ``in_first`` marks the first file (in order of path) that has any line."""
    place = shared_path(spark, "csv-blocks")
    (_lines(spark, path).groupBy("file", "block").agg(F.sum("quotes").alias("quotes")).write.parquet(place))
    counted = spark.read.parquet(place)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))
    blocks = bounded_broadcast(blocks, counted.count())

    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = _lines(spark, path).join(blocks, ["file", "block"])
    after = F.sum("quotes").over(upto) + F.col("inside")
    lines = lines.withColumn("after", after % 2)
    starts = (F.col("after") + F.col("quotes")) % 2 == 0  # not inside quotes before the line
    lines = lines.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(upto))
    found = _joined(["at"], ["file", "block", "record"], lines, F.max_by("after", "at").alias("open"))

    whole = found.where("record > 0 AND open = 0").select("file", "block", "record", "value")
    pieces = found.where("record = 0 OR open = 1")  # at most two of a block
    order = Window.partitionBy("file").orderBy("block", "record")
    pieces = pieces.withColumn("group", F.sum((F.col("record") > 0).cast("int")).over(order))
    rest = _joined(["block", "record"], ["file", "group"], pieces, F.min(F.struct("block", "record")).alias("first"))
    least = counted.agg(F.min("file")).first()[0]  # one path
    return whole.unionByName(rest.select("file", "first.*", "value")).withColumn("in_first", F.col("file").eqNullSafe(F.lit(least)))


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool | str = True, sep: str = ",",
                    comment: str | None = None, null_value: str = "", corrupt: str | None = None) -> DataFrame:
    """Records with a fixed schema, wherever their line feeds are.

    ``header``: True drops the first record of every file; "first" drops only that of the
    first file, in order of path, by its position; False drops none. Blank lines between
    records are skipped, as are records that begin with ``comment``. ``corrupt`` names the
    column of ``schema`` that gets the text of a record with a wrong number of fields.
    """
    if header not in HEADERS:
        raise ValueError(f"header must be one of {HEADERS}")
    found = records(spark, path).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")
    first = (F.col("block") == 0) & (F.col("record") == 1)
    if header == "first":
        found = found.where(~(first & F.col("in_first")))
    elif header:
        found = found.where(~first)
    if comment:
        found = found.where(~F.startswith("value", F.lit(comment)))
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": null_value, "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    return found.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
