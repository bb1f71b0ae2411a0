"""Scoring: request timestamps → time slot → one risk level per box.

A score depends only on (Box, Month, DayOfWeekNum, DayPeriod), and there are
at most 12 * 7 * 4 = 336 slots. So the model (or the slot history) scores the
whole cube of slots x boxes once (336 * n_boxes rows, whatever the request
volume) and requests join it through a broadcast whose size bound is that same
grid-derived number: the request table is read once and never shuffled.
``distinct_slots`` serves reports over the slots that requests actually hit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.timefeatures import (
    REQUEST_TS_PATTERN,
    day_period,
    dow_num,
    month0,
    ntz_literal,
    parse_ts,
)
from georisk.operators import tree as T
from georisk.operators.cells import slot_bound
from georisk.plans.broadcast import bounded_broadcast

SLOT_KEYS = ["Month", "DayOfWeekNum", "DayPeriod"]
N_SLOTS = 12 * 7 * 4
# Requests that are not valid timestamps fall back to the current
# time in US Pacific time; the reference scorer predicts with the constant slot
# Month 8, DayOfWeekNum 2, DayPeriod 1 whatever the request says.
DEFAULT_ZONE = "America/Los_Angeles"
REFERENCE_SLOT = (8, 2, 1)


def now_in_zone(zone: str = DEFAULT_ZONE) -> Column:
    return F.convert_timezone(None, F.lit(zone), F.localtimestamp())


def valid_or_default(text: Column | str, pattern: str = REQUEST_TS_PATTERN,
                     now: dt.datetime | Column | None = None, zone: str = DEFAULT_ZONE) -> Column:
    """The parsed request, or ``now`` (default: current wall clock in ``zone``)."""
    if now is None:
        fallback = now_in_zone(zone)
    elif isinstance(now, Column):
        fallback = now
    else:
        fallback = ntz_literal(now)
    return F.coalesce(parse_ts(text, pattern, lenient=True), fallback)


def request_features(requests: DataFrame, text_col: str = "request", pattern: str = REQUEST_TS_PATTERN,
                     lenient: bool = True, now: dt.datetime | Column | None = None) -> DataFrame:
    """Adds request_ts, valid, Month, DayOfWeekNum, DayPeriod.

    Strict (``lenient=False``) raises on a malformed request, like the
    reference; lenient substitutes ``now``.
    """
    t = F.col(text_col)
    parsed = parse_ts(t, pattern, lenient=lenient)
    ts = valid_or_default(t, pattern, now) if lenient else parsed
    out = requests.withColumn("valid", parsed.isNotNull()).withColumn("request_ts", ts)
    r = F.col("request_ts")
    return out.select(*requests.columns, "request_ts", "valid", month0(r).alias("Month"),
                      dow_num(r).alias("DayOfWeekNum"), day_period(F.hour(r)).alias("DayPeriod"))


def with_fixed_slot(requests: DataFrame, slot: tuple[int, int, int] = REFERENCE_SLOT) -> DataFrame:
    """Replace the requests' slot by constants (reference-compatible scoring)."""
    cols = [c for c in requests.columns if c not in SLOT_KEYS]
    return requests.select(*cols, *[F.lit(v).alias(k) for k, v in zip(SLOT_KEYS, slot)])


def distinct_slots(requests: DataFrame) -> DataFrame:
    return requests.select(*SLOT_KEYS).distinct()


def all_slots(spark) -> DataFrame:
    """All 336 (Month, DayOfWeekNum, DayPeriod) combinations (the scoring cube's slots)."""
    return spark.range(N_SLOTS).select(*_slot_of(F.col("id")))


def _slot_of(number: Column) -> list[Column]:
    period, rest = number % 4, F.floor(number / 4)
    return [F.floor(rest / 7).cast("int").alias("Month"), (rest % 7 + 1).cast("int").alias("DayOfWeekNum"),
            period.cast("int").alias("DayPeriod")]


def cube_rows(spark, grid: GridSpec = GridSpec()) -> DataFrame:
    """Every (slot, box) by key arithmetic over a range, which Spark deals over all cores."""
    n = grid.n_boxes
    return spark.range(N_SLOTS * n).select(*_slot_of(F.floor(F.col("id") / n)), (F.col("id") % n).cast("int").alias("Box"))


def expand_boxes(slots: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    """Every slot row repeated for boxes 0..n_boxes-1 (a generator, no join, no shuffle)."""
    return slots.select(*slots.columns,
                        F.explode(F.sequence(F.lit(0), F.lit(grid.n_boxes - 1))).alias("Box"))


def score_slots_with_model(model: DecisionTreeClassificationModel, slots: DataFrame,
                           grid: GridSpec = GridSpec()) -> DataFrame:
    return score_rows_with_model(model, expand_boxes(slots, grid))


def score_rows_with_model(model: DecisionTreeClassificationModel, grid_rows: DataFrame) -> DataFrame:
    scored = T.predict(model, grid_rows)
    return scored.select(*SLOT_KEYS, "Box", F.col("prediction").cast("int").alias("pred"))


def score_slots_with_history(labelled: DataFrame, slots: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    """Predict a slot's own historical level (0 = Low where it never had an incident)."""
    return score_rows_with_history(labelled, expand_boxes(slots, grid), grid)


def score_rows_with_history(labelled: DataFrame, grid_rows: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    hist = bounded_broadcast(labelled.select("Box", *SLOT_KEYS, "label"), slot_bound(grid))
    return (grid_rows.join(hist, ["Box", *SLOT_KEYS], "left")
            .select(*SLOT_KEYS, "Box", F.coalesce(F.col("label"), F.lit(0.0)).cast("int").alias("pred")))


def slot_cube(labelled: DataFrame | None = None, model: DecisionTreeClassificationModel | None = None,
              grid: GridSpec = GridSpec(), spark=None) -> DataFrame:
    """Scores of every (slot, box) — 336 * n_boxes rows whatever the data size —
    by slot history (``labelled``) or by a tree (``model``). Requests are then
    served by one broadcast join, reading the request table once."""
    if labelled is not None:
        return score_rows_with_history(labelled, cube_rows(labelled.sparkSession, grid), grid)
    if model is not None:
        return score_rows_with_model(model, cube_rows(spark, grid))
    raise ValueError("give labelled slots or a model")


def slot_mean_risk(slot_scores: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    """Per slot: sum(pred) / (n_boxes - 1) (the reference's divisor) and the true mean."""
    return slot_scores.groupBy(*SLOT_KEYS).agg(
        (F.sum("pred") / F.lit(float(grid.n_boxes - 1))).alias("mean_risk_compat"),
        (F.sum("pred") / F.count(F.lit(1))).alias("mean_risk"),
        F.count(F.lit(1)).alias("boxes"))


def slot_levels(slot_scores: DataFrame) -> DataFrame:
    """Per slot: the levels of its boxes in box order (at most n_boxes values)."""
    pairs = F.array_sort(F.collect_list(F.struct("Box", "pred")))
    return slot_scores.groupBy(*SLOT_KEYS).agg(F.transform(pairs, lambda p: p["pred"]).alias("levels"))


def join_slots(requests: DataFrame, per_slot: DataFrame, row_bound: int) -> DataFrame:
    return requests.join(bounded_broadcast(per_slot, row_bound), SLOT_KEYS, "inner")


def score_requests(requests: DataFrame, slot_scores: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    """One row per (request, box)."""
    return join_slots(requests, slot_scores, N_SLOTS * grid.n_boxes)


def request_mean_risk(requests: DataFrame, slot_scores: DataFrame, grid: GridSpec = GridSpec()) -> DataFrame:
    return join_slots(requests, slot_mean_risk(slot_scores, grid), N_SLOTS)
