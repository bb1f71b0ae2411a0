"""Profiling aggregates over the incidents table (extent, ranges, weekday counts,
time span, per-(Box, Date) statistics, stage counts, previews, schema).

All are single aggregations: global ones become partial aggregates in every
task plus one tiny final task; grouped ones shuffle only their partial
results, whose size is bounded by the number of groups (7 weekdays,
boxes x days), never by the number of incidents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.sources.incidents import CELL_KEYS


def _n() -> F.Column:
    return F.count(F.lit(1))


def profile_extent(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.min("X").alias("min_x"), F.max("X").alias("max_x"),
                         F.min("Y").alias("min_y"), F.max("Y").alias("max_y"))


def profile_ranges(incidents: DataFrame) -> DataFrame:
    out = []
    for c, short in (("Box", "box"), ("Hour", "hour"), ("DayPeriod", "day_period"), ("Month", "month")):
        out += [F.min(c).alias(f"min_{short}"), F.max(c).alias(f"max_{short}")]
    return incidents.agg(*out)


def count_by(incidents: DataFrame, *cols: str) -> DataFrame:
    return incidents.groupBy(*cols).agg(_n().alias("n"))


def profile_time(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.min("Timestamp").alias("min_ts"), F.max("Timestamp").alias("max_ts"))


def box_date_counts(incidents: DataFrame) -> DataFrame:
    """COUNT(*) per (Box, Date); what Date means depends on the incidents' date mode."""
    return count_by(incidents, "Box", "Date")


def box_date_stats(counts: DataFrame) -> DataFrame:
    """Min / max / mean of the per-group counts (two-level aggregation)."""
    return counts.agg(F.min("n").alias("min_count"), F.max("n").alias("max_count"),
                      (F.sum("n") / F.count(F.lit(1))).alias("avg_count"),
                      F.count(F.lit(1)).alias("groups"))


def stage_counts(all_incidents: DataFrame) -> DataFrame:
    """Rows read, kept by the box filter, rejected, and number of non-empty slots,
    from one scan: slot keys of rejected rows are nulled so they form one group."""
    inb = F.col("in_bounds")
    keys = [F.when(inb, F.col(k)).alias(k) for k in CELL_KEYS]
    per_slot = all_incidents.groupBy(inb.alias("in_bounds"), *keys).agg(_n().alias("n"))
    return per_slot.agg(
        F.sum("n").alias("raw_rows"),
        F.sum(F.when(inb, F.col("n")).otherwise(F.lit(0))).alias("kept_rows"),
        F.sum(F.when(inb, F.lit(0)).otherwise(F.col("n"))).alias("rejected_rows"),
        F.count_if(inb).alias("cells"),
    )


PROFILE_SETS = [CELL_KEYS, ["Box", "Date"], ["DayOfWeek"], []]
PROFILE_KEYS = [*CELL_KEYS, "Date", "DayOfWeek"]


def profile_sets(all_incidents: DataFrame) -> DataFrame:
    """Everything the train job reports, from one scan and one exchange.

    Grouping sets: slots, (Box, Date), weekday names, and all rows. A task's partial
    result is bounded by slots + boxes x days + 7 + 1 rows, however its input is
    clustered. ``grouping`` is the bit code of the keys that a set leaves out; keys
    of rows outside the box are null, and only the set of all rows counts them.
    """
    inb = F.col("in_bounds")
    rows = all_incidents.select(*[F.when(inb, F.col(k)).alias(k) for k in PROFILE_KEYS], inb.alias("in_bounds"),
                                *[F.when(inb, F.col(c)).alias(f"v_{c}") for c in ("X", "Y", "Timestamp", "Hour", *CELL_KEYS)])
    aggs = [_n().alias("raw"), F.count_if("in_bounds").alias("n")]
    for c, short in (("X", "x"), ("Y", "y"), ("Timestamp", "ts"), ("Hour", "hour"), ("Box", "box"),
                     ("DayPeriod", "day_period"), ("Month", "month")):
        aggs += [F.min(f"v_{c}").alias(f"min_{short}"), F.max(f"v_{c}").alias(f"max_{short}")]
    sets = [[F.col(k) for k in keys] for keys in PROFILE_SETS]
    out = rows.groupingSets(sets, *PROFILE_KEYS).agg(F.grouping_id().cast("int").alias("grouping"), *aggs)
    return out.filter((F.col("n") > 0) | (F.col("grouping") == grouping_of([])))


def grouping_of(keys: list[str]) -> int:
    """The ``grouping`` code of the set that groups by ``keys``."""
    return sum(1 << i for i, k in enumerate(reversed(PROFILE_KEYS)) if k not in keys)


def profile_part(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.filter(F.col("grouping") == grouping_of(keys))


def sets_cells(sets: DataFrame) -> DataFrame:
    """The slot counts of :func:`georisk.operators.cells.box_agg`, from the grouping sets."""
    return profile_part(sets, CELL_KEYS).select(F.col("n").alias("Count"), *CELL_KEYS)


CUBE_KEYS = ["Box", "Date", "Hour", "Month", "DayOfWeekNum", "DayPeriod", "DayOfWeek"]


def profile_cube(incidents: DataFrame) -> DataFrame:
    """Count and extents per (Box, Date, Hour) and what depends on them: at most boxes x
    days x 24 rows, which reduces little; use :func:`profile_sets` for the totals."""
    return incidents.groupBy(*CUBE_KEYS).agg(
        _n().alias("n"), F.min("X").alias("min_x"), F.max("X").alias("max_x"),
        F.min("Y").alias("min_y"), F.max("Y").alias("max_y"),
        F.min("Timestamp").alias("min_ts"), F.max("Timestamp").alias("max_ts"))


def preview(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """First ``n`` rows in a fixed order (a top-k: per-task top-n, then one merge)."""
    return df.orderBy(*order).limit(n)


def schema_report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(position, column, type, nullable) rows of a DataFrame's schema."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, column, type, n_rows, n_nulls) for each column, from one aggregate
    over all rows; an empty table has zeros."""
    rows = [F.struct(F.lit(i).cast("long").alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"),
                     (F.col("n") - F.col(f"c{i}")).alias("n_nulls")) for i, f in enumerate(df.schema.fields)]
    counts = df.agg(_n().alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    return counts.select(F.inline(F.array(*rows)))
