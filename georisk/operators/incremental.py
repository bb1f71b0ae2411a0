"""Counts that grow with the files: a ledger of counted files and mergeable counts.

The store below ``root`` has two tables, both partitioned by batch:

* ``counts``: (Box, Date, DayPeriod, n) of the files that one batch counted. A Date fixes month and
  weekday, so counts per (Box, Date) and per slot are both sums over these rows, whose
  number is bounded by boxes x days x 4 a batch, whatever the number of incidents.
* ``ledger``: the files (path, length, modification time) of each batch.

A run lists the files, counts those that the ledger lacks, and writes first the counts, then
the ledger rows, both by overwriting the partition of its batch. A batch is named by its files,
so a repeated run overwrites its own partition; counts of a batch without ledger rows (a run that
was lost in between) are not read. A file that was replaced is an error, since its old counts
cannot be told apart from those of its batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.timefeatures import dow_num, month0
from georisk.sources import parquet as PQ
from georisk.sources.incidents import CELL_KEYS

LEDGER = "path string, length bigint, modified timestamp, batch string"
COUNTS = "Box int, Date date, DayPeriod int, n bigint, batch string"


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _put(df: DataFrame, root: str, name: str) -> None:
    """Replaces the partitions of the batches in ``df``, no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/{name}")


def files(spark: SparkSession, source: str) -> DataFrame:
    """(path, length, modified) of the files below ``source``; no contents are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(
        "path", "length", F.col("modificationTime").alias("modified"))


def pending(spark: SparkSession, source: str, root: str) -> DataFrame:
    """Files that no batch has counted. Raises if a counted file has changed."""
    known = _table(spark, root, "ledger", LEDGER).select(
        "path", F.col("length").alias("was"), F.col("modified").alias("then"), F.lit(True).alias("known"))
    found = files(spark, source).join(known, "path", "left")
    changed = (F.col("length") != F.col("was")) | (F.col("modified") != F.col("then"))
    # one expression, so that the check is no filter that another one could come before
    new = F.when(F.col("known").isNull(), True).when(changed, F.raise_error(F.concat(
        F.lit("counted file has changed: "), "path"))).otherwise(False)
    return found.where(new).select("path", "length", "modified")


def read_parquet_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return PQ.read_incidents(spark, paths, GridSpec())


def absorb(spark: SparkSession, source: str, root: str,
           read: Callable[[SparkSession, list[str]], DataFrame] = read_parquet_files) -> str | None:
    """Count the pending files of ``source`` into the store; the batch's name, or None without any.
    Only names of pending files come to the driver."""
    new = pending(spark, source, root).orderBy("path").collect()
    if not new:
        return None
    ledger = spark.createDataFrame([tuple(r) for r in new], "path string, length bigint, modified timestamp")
    batch = ledger.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", "modified"))), "\n"), 256)).first()[0]
    counts = read(spark, [r.path for r in new]).groupBy("Box", "Date", "DayPeriod").agg(F.count(F.lit(1)).alias("n"))
    _put(counts.withColumn("batch", F.lit(batch)), root, "counts")
    _put(ledger.withColumn("batch", F.lit(batch)), root, "ledger")
    return batch


def counted(spark: SparkSession, root: str) -> DataFrame:
    """(Box, Date, DayPeriod, n, batch) of all batches whose files are in the ledger."""
    done = _table(spark, root, "ledger", LEDGER).select("batch").distinct()
    return _table(spark, root, "counts", COUNTS).join(done, "batch", "left_semi")


def box_date_counts(spark: SparkSession, root: str) -> DataFrame:
    return counted(spark, root).groupBy("Box", "Date").agg(F.sum("n").alias("Count"))


def slot_counts(spark: SparkSession, root: str) -> DataFrame:
    """As :func:`georisk.operators.cells.box_agg` over everything counted."""
    day = F.col("Date").cast("timestamp_ntz")
    slots = counted(spark, root).select("Box", month0(day).alias("Month"), dow_num(day).alias("DayOfWeekNum"), "DayPeriod", "n")
    return slots.groupBy(*CELL_KEYS).agg(F.sum("n").alias("Count")).select("Count", *CELL_KEYS)
