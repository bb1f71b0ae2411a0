"""Slot counts per (Box, Month, DayOfWeekNum, DayPeriod), their risk labels and the
train/test split.

Scale note: the number of slots is bounded by the grid, not by the data
(``n_boxes * 12 * 7 * 4`` = 55,776 by default), and ``count`` aggregates are
combined map-side, so a hot box holding a third of all incidents costs one
hash-table entry per task before the shuffle. Everything downstream of
:func:`box_agg` is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.risk import LOW_BELOW, MEDIUM_BELOW, risk_level
from georisk.sources.incidents import CELL_KEYS

SPLIT_MODES = ("hash", "random")
# Fixed values for the layout-independent split: key weights 31, 17, 7, 1 and
# 10 buckets, of which the first 7 are training data (70/30). Random mode uses
# weights [0.7, 0.3] and seed 777 like the reference.
SPLIT_WEIGHTS = (31, 17, 7, 1)
SPLIT_BUCKETS = 10
TRAIN_BUCKETS = 7
RANDOM_SEED = 777


def slot_bound(grid: GridSpec = GridSpec()) -> int:
    """Upper bound on the number of slots, whatever the data size."""
    return grid.n_boxes * 12 * 7 * 4


def box_agg(incidents: DataFrame) -> DataFrame:
    """COUNT(*) AS Count per slot; partial + final hash aggregation."""
    return (incidents.groupBy(*CELL_KEYS)
            .agg(F.count(F.lit(1)).alias("Count"))
            .select("Count", *CELL_KEYS))


def label_cells(cells: DataFrame, low_below: int = LOW_BELOW, medium_below: int = MEDIUM_BELOW) -> DataFrame:
    return cells.withColumn("label", risk_level("Count", low_below, medium_below).cast("double"))


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def split_bucket() -> F.Column:
    w = SPLIT_WEIGHTS
    key = (F.col("Box") * w[0] + F.col("Month") * w[1] + F.col("DayOfWeekNum") * w[2]
           + F.col("DayPeriod") * w[3])
    return F.pmod(key, F.lit(SPLIT_BUCKETS))


def mark_split(cells: DataFrame) -> DataFrame:
    """Add ``split`` = 'train' / 'test' from the slot key alone (deterministic under
    any partitioning, executor loss or re-execution)."""
    return cells.withColumn(
        "split", F.when(split_bucket() < TRAIN_BUCKETS, F.lit("train")).otherwise(F.lit("test")))


def split_cells(cells: DataFrame, mode: str = "hash", seed: int = RANDOM_SEED) -> tuple[DataFrame, DataFrame]:
    """70/30 split. ``hash`` is layout independent; ``random`` is ``randomSplit``
    (result depends on how the input happens to be partitioned)."""
    if mode == "hash":
        b = split_bucket()
        return cells.filter(b < TRAIN_BUCKETS), cells.filter(b >= TRAIN_BUCKETS)
    if mode == "random":
        tr, te = cells.randomSplit([0.7, 0.3], seed)
        return tr, te
    raise ValueError(f"mode must be one of {SPLIT_MODES}")
