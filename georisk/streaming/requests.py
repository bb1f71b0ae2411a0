"""Streaming scorer: request files dropped into a folder (one timestamp per line)
are scored for every box as they arrive.

This replaces the hand-off in which a notebook writes a timestamp file and a
separate job reads it: a file-source stream picks up each new file, and a
stream-static broadcast join against the pre-scored slot cube (all 336 slots x
n_boxes rows, a grid-derived bound) emits one row per request with the levels of
all boxes, or one per (request, box) if asked. The stream is stateless, so its checkpoint only records which files were done.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from georisk.functions.grid import GridSpec
from georisk.operators import score as S
from georisk.session import shared_path


def slot_cube(spark: SparkSession, grid: GridSpec, model: DecisionTreeClassificationModel | None = None,
              labelled: DataFrame | None = None) -> DataFrame:
    """Scores of every (slot, box), cached for the life of the stream."""
    return S.slot_cube(labelled=labelled, model=model, grid=grid, spark=spark).cache()


def request_stream(spark: SparkSession, folder: str, now: dt.datetime | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(folder).withColumnRenamed("value", "request")
    return S.request_features(lines.filter(F.trim(F.col("request")) != ""), "request", lenient=True, now=now)


def scored_stream(requests: DataFrame, cube: DataFrame, grid: GridSpec = GridSpec(), expand: bool = False) -> DataFrame:
    """One row per request with the levels of all boxes in box order, or with
    ``expand`` one row per request and box."""
    keys = ["request", "request_ts", "valid", *S.SLOT_KEYS]
    if expand:
        return S.score_requests(requests, cube, grid).select(*keys, "Box", "pred")
    return S.join_slots(requests, S.slot_levels(cube), S.N_SLOTS).select(*keys, "levels")


def start(spark: SparkSession, folder: str, out_path: str, cube: DataFrame, grid: GridSpec = GridSpec(),
          checkpoint: str | None = None, now: dt.datetime | None = None, fmt: str = "parquet",
          available_now: bool = False, expand: bool = False) -> StreamingQuery:
    """Start the scorer; output files land in ``out_path`` (append mode, exactly once
    via the file sink's log), progress in ``checkpoint`` (shared folder by default)."""
    df = scored_stream(request_stream(spark, folder, now), cube, grid, expand)
    w = (df.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint or shared_path(spark, "score-stream-ckpt")))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(out_path)
