"""Typed incidents as Parquet: the form a large deployment keeps after converting
the CSV export once.

Written partitioned by ``Year`` (directory pruning for time ranges) with X and
Y as plain double columns, so a box query reads only the needed columns, skips
row groups by X/Y statistics (``GridSpec.prefilter`` reaches ``PushedFilters``)
and skips whole years by partition filters.

``layout="curve"`` orders rows along a space-filling curve (Morton) over X and Y instead
of by Box, whose ids run along X first: row groups then are narrow in both directions.
Counts and ranges of a table that holds only in-box rows come from the files' footers
(:func:`footer_profile`); what a write kept and rejected is counted while it writes
(:func:`write_in_box`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.sources.incidents import INCIDENT_COLUMNS, date_column

ROWS_PER_FILE = 5_000_000


LAYOUTS = ("box", "curve")
CURVE_BITS = 16
FOOTER_COLUMNS = ["X", "Y", "Box", "Hour", "Month"]


def _spread(v: Column) -> Column:
    """The 16 low bits of ``v`` with a zero bit between any two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def curve_key(grid: GridSpec = GridSpec(), x: str = "X", y: str = "Y") -> Column:
    """The position on the Morton curve over the grid's box, 16 bits a side; outside it, the nearest."""
    def cell(c: str, low: float, high: float) -> Column:
        share = (F.col(c) - F.lit(low)) / F.lit(high - low)
        return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit((1 << CURVE_BITS) - 1)).cast("bigint")

    across, up = cell(x, grid.min_x, grid.max_x), cell(y, grid.min_y, grid.max_y)
    return _spread(across).bitwiseOR(F.shiftleft(_spread(up), 1))


def write_incidents(incidents: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE,
                    layout: str = "box", grid: GridSpec = GridSpec()) -> None:
    """Partitioned by Year, range-partitioned by (Year, Box or curve position, PdId): few files
    per year, each with a narrow range of boxes (tight X/Y row-group statistics), and
    a hot box or place is split by its incident ids."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    place = F.col("Box") if layout == "box" else curve_key(grid)
    keyed = incidents.withColumn("Year", F.year("Timestamp")).withColumn("__place", place)
    (keyed.repartitionByRange("Year", "__place", "PdId").sortWithinPartitions("Year", "__place", "PdId").drop("__place")
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("Year").parquet(path))


def write_in_box(everything: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Writes the rows of ``everything`` (with ``in_bounds``) that lie in the box, partitioned by
    Year as they come, and returns raw_rows, kept_rows and rejected_rows, counted by the same pass."""
    seen = Observation()
    rows = everything.observe(seen, F.count(F.lit(1)).alias("raw_rows"), F.count_if("in_bounds").alias("kept_rows"),
                              F.count_if(~F.col("in_bounds")).alias("rejected_rows"))
    (rows.filter("in_bounds").drop("in_bounds").withColumn("Year", F.year("Timestamp")).sortWithinPartitions("Year")
     .write.mode(mode).partitionBy("Year").parquet(path))
    return {k: int(v) for k, v in seen.get.items()}


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row: the number of rows, and least and largest X, Y, Box, Hour and Month, of a table that
    holds only in-box rows. The session's copy used here reads Parquet through the connector that
    answers these aggregates from the files' footers, so no column is decoded."""
    own = spark.newSession()  # settings of its own; context, catalog and files are shared
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    ends = [f(c).alias(f"{n}_{c.lower()}") for c in FOOTER_COLUMNS for n, f in (("min", F.min), ("max", F.max))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *ends)


def read_incidents(spark: SparkSession, path: str | list[str], grid: GridSpec | None = None,
                   years: tuple[int, int] | None = None, date_mode: str = "real", lenient: bool = False) -> DataFrame:
    """Typed incidents; with ``grid`` only rows inside its box (exact float test
    plus the pushable double prefilter) and with that grid's box ids, whatever
    grid the file was written with; with ``years`` only those partitions.

    A row without coordinates or timestamp is an error, or dropped if ``lenient``,
    as in the CSV source.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if years is not None:
        df = df.filter(F.col("Year").between(years[0], years[1]))
    missing = F.col("Timestamp").isNull() | F.col("X").isNull() | F.col("Y").isNull()
    if lenient:
        df = df.filter(~missing)
    else:
        df = df.filter(F.when(missing, F.raise_error(F.lit(
            "incident row without coordinates or timestamp"))).otherwise(F.lit(True)))
    if grid is not None and lenient:
        df = df.filter(grid.prefilter("X", "Y") & grid.in_bounds("X", "Y"))
    elif grid is not None:
        # each bound lets nulls through, so that skipped row groups hide none from the check above
        for bound, c in grid.prefilter_bounds("X", "Y"):
            df = df.filter(bound | F.col(c).isNull())
        df = df.filter(F.coalesce(grid.in_bounds("X", "Y"), F.lit(True)))
    cols = {c: F.col(c) for c in INCIDENT_COLUMNS} | {"Date": date_column(F.col("Timestamp"), date_mode)}
    if grid is not None:
        cols["Box"] = grid.box_id("X", "Y")
    return df.select(*[v.alias(c) for c, v in cols.items()])
