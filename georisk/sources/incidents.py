"""The typed ``incidents`` table and the testdata fixture that derives it from ``lineitem``.

Both sources end in :func:`type_incidents`, so an incident read from CSV and one
derived from the driver's tables have the same 17-column schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.timefeatures import calendar_date, compat_date, dow_name, time_features

INCIDENT_COLUMNS = [
    "IncidntNum", "Category", "Descript", "DayOfWeek", "Date", "Timestamp", "PdDistrict",
    "Resolution", "Address", "X", "Y", "PdId", "Box", "Hour", "DayPeriod", "DayOfWeekNum", "Month",
]
CELL_KEYS = ["Box", "Month", "DayOfWeekNum", "DayPeriod"]

DATE_MODES = ("real", "compat")


def date_column(ts: Column, date_mode: str) -> Column:
    if date_mode == "real":
        return calendar_date(ts)
    if date_mode == "compat":
        return compat_date(ts)
    raise ValueError(f"date_mode must be one of {DATE_MODES}")


def type_incidents(base: DataFrame, grid: GridSpec = GridSpec(), date_mode: str = "real",
                   keep_out_of_bounds: bool = False) -> DataFrame:
    """Filter to the bounding box and derive Box and the time-slot features.

    ``base`` carries IncidntNum, Category, Descript, DayOfWeek, Timestamp
    (timestamp_ntz), PdDistrict, Resolution, Address, X, Y, PdId. With
    ``keep_out_of_bounds`` nothing is dropped and a boolean ``in_bounds``
    column is appended instead (for audits).
    """
    ts = F.col("Timestamp")
    feats = time_features(ts)
    inb = grid.in_bounds("X", "Y")
    df = base if keep_out_of_bounds else base.filter(inb)
    cols = [
        F.col("IncidntNum"), F.col("Category"), F.col("Descript"), F.col("DayOfWeek"),
        date_column(ts, date_mode).alias("Date"), ts.alias("Timestamp"), F.col("PdDistrict"),
        F.col("Resolution"), F.col("Address"), F.col("X"), F.col("Y"), F.col("PdId"),
        grid.box_id("X", "Y").alias("Box"),
        feats["Hour"].alias("Hour"), feats["DayPeriod"].alias("DayPeriod"),
        feats["DayOfWeekNum"].alias("DayOfWeekNum"), feats["Month"].alias("Month"),
    ]
    if keep_out_of_bounds:
        cols.append(inb.alias("in_bounds"))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Testdata fixture: incidents synthesised from lineitem (FIXTURES.md §5).
# Fixed values of the fixture definition: hash multipliers 7919, 13, 104729, 31,
# minute offsets (l_orderkey*37 + l_linenumber*211) % 1440, X = -122.516 + 0.18*u^6,
# Y = 37.7 + 0.12*w^4 (powers as repeated products, left to right).
# ---------------------------------------------------------------------------
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_incident_base(lineitem: DataFrame) -> DataFrame:
    """Raw incident fields for every lineitem row (no filter, no features)."""
    li = lineitem.select(*LINEITEM_COLUMNS)
    u = ((F.col("l_partkey") * 7919 + F.col("l_linenumber") * 13) % 1000).cast("double") / F.lit(1000.0)
    w = ((F.col("l_orderkey") * 104729 + F.col("l_suppkey") * 31) % 1000).cast("double") / F.lit(1000.0)
    minutes = ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 211) % 1440).cast("int")
    ts = F.col("l_shipdate") + F.make_dt_interval(mins=minutes)
    x = F.lit(-122.516) + F.lit(0.18) * u * u * u * u * u * u
    y = F.lit(37.7) + F.lit(0.12) * w * w * w * w
    return li.select(
        F.col("l_orderkey").alias("IncidntNum"),
        F.col("l_returnflag").alias("Category"),
        F.concat_ws(", ", F.col("l_returnflag"), F.col("l_linestatus")).alias("Descript"),
        dow_name(ts).alias("DayOfWeek"),
        ts.alias("Timestamp"),
        F.concat(F.lit("D"), (F.col("l_suppkey") % 10).cast("string")).alias("PdDistrict"),
        F.col("l_linestatus").alias("Resolution"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(" Block")).alias("Address"),
        x.alias("X"),
        y.alias("Y"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("PdId"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents_from_tables(spark: SparkSession, sf_dir: str, grid: GridSpec = GridSpec(),
                          date_mode: str = "real", keep_out_of_bounds: bool = False) -> DataFrame:
    base = lineitem_incident_base(read_table(spark, sf_dir, "lineitem"))
    return type_incidents(base, grid, date_mode, keep_out_of_bounds)


def publish(df: DataFrame, name: str = "incidents") -> DataFrame:
    """Expose a DataFrame to SQL (session-scoped view)."""
    df.createOrReplaceTempView(name)
    return df
