"""Scoring requests: one timestamp text per line, any number of files and lines.

Batch counterpart of :mod:`georisk.streaming.requests`; the reference read only
the first line of one file, here every line is a request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``request`` string column, blank lines dropped."""
    lines = spark.read.text(path).withColumnRenamed("value", "request")
    return lines.filter(F.trim(F.col("request")) != "")
