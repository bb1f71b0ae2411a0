"""CSV sources and sinks.

* :func:`read_incidents_csv` — the incident export (13 columns, one header line
  per file, ``"``-quoted fields with doubled quotes) through Spark's CSV reader,
  typed by :func:`georisk.sources.incidents.type_incidents`.
* ``verbatim=True`` — line-oriented split on commas outside quotes that keeps the
  quote characters in the values, as the original line splitter does.
* :func:`write_csv` / :func:`read_csv` — general delimited output/input
  (delimiter, header, minimal or full quoting, comments, quoted newlines).
* :func:`write_scores` / :func:`read_scores` — the ``box,pred`` scoring file.

Scale: plain CSV is split by byte range across tasks; ``multi_line=True``
(quoted newlines) makes each file one task, so such exports are written as
many part files (one per partition) to keep the read parallel; a single large
file is read in many tasks by :func:`georisk.sources.quoted.read_quoted_csv`
(``multi_line="split"`` for incidents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk.functions.grid import GridSpec
from georisk.functions.timefeatures import INCIDENT_TS_PATTERN, format_ntz, parse_date_time
from georisk.sources.incidents import type_incidents
from georisk.sources.quoted import read_quoted_csv

# The incident CSV header (13 columns, in file order).
RAW_COLUMNS = ["IncidntNum", "Category", "Descript", "DayOfWeek", "Date", "Time", "PdDistrict",
               "Resolution", "Address", "X", "Y", "Location", "PdId"]
HEADER_LINE = ",".join(RAW_COLUMNS)
CORRUPT = "__corrupt"

RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)
SCORES_SCHEMA = "Box int, pred int"
ROWS_PER_FILE = 1_000_000


def _typed(raw: DataFrame, grid: GridSpec, date_mode: str, lenient: bool,
           keep_out_of_bounds: bool = False) -> DataFrame:
    """13 string columns and a record error (null if there is none) → the 17-column table.

    A record with the wrong number of fields, a missing or bad id, coordinate or
    date fails the job (strict, as the original does) or is dropped (lenient).
    The check is a filter over all of them, so it does not depend on the columns
    that a query selects. Numbers and timestamp go through an array of one struct,
    over which no filter moves: each is parsed once a record.
    """
    number = F.col("IncidntNum").try_cast("bigint")
    x, y = F.col("X").try_cast("double"), F.col("Y").try_cast("double")
    ts = parse_date_time("Date", "Time", lenient=True)
    typed = F.struct(number.alias("number"), x.alias("x"), y.alias("y"), ts.alias("ts"))
    raw = raw.withColumn("__typed", F.explode(F.array(typed)))
    number, x, y, ts = (F.col(f"__typed.{c}") for c in ("number", "x", "y", "ts"))
    bad = (F.col(CORRUPT).isNotNull() | number.isNull() | x.isNull() | y.isNull() | F.col("Date").isNull()
           | F.col("Time").isNull() | ts.isNull())
    if lenient:
        raw = raw.filter(~bad)
    else:
        raw = raw.filter(F.when(bad, F.raise_error(F.concat(F.lit("malformed incident record: "), F.coalesce(
            F.col(CORRUPT), F.concat_ws(",", *RAW_COLUMNS))))).otherwise(F.lit(True)))
    base = raw.select(
        number.alias("IncidntNum"), "Category", "Descript", "DayOfWeek",
        ts.alias("Timestamp"), "PdDistrict", "Resolution", "Address", x.alias("X"), y.alias("Y"), "PdId")
    return type_incidents(base, grid, date_mode, keep_out_of_bounds)


def read_raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool | str = False,
                 header: bool | str = True) -> DataFrame:
    """The 13 raw columns as strings, and the whole record in ``__corrupt`` if its number
    of fields is wrong; every file's header line is dropped. Records are always parsed
    whole, so that the error does not depend on the selected columns.

    ``multi_line``: True for quoted line feeds in one task per file, "split" for many;
    ``header="first"`` (with "split") drops only the first file's."""
    if multi_line == "split":
        return read_quoted_csv(spark, path, f"{RAW_SCHEMA}, {CORRUPT} string", header=header, corrupt=CORRUPT)
    if header not in (True, False):
        raise ValueError('header="first" needs multi_line="split"')
    return (spark.read.schema(f"{RAW_SCHEMA}, {CORRUPT} string")
            .option("header", header).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path))


def split_fields(line: F.Column) -> F.Column:
    """The fields of a line (without line feeds) between commas that an even number of
    quotes follows; quotes stay in the values. The pieces between quotes are joined
    again after commas outside quotes became line feeds, so the cost is linear: the pieces
    are made once, as a function's argument, not again for each of them."""
    def marked(pieces):
        return F.array_join(F.transform(pieces, lambda p, i: F.when(
            (F.size(pieces) - 1 - i) % 2 == 0, F.replace(p, F.lit(","), F.lit("\n"))).otherwise(p)), '"')

    return F.split(F.get(F.transform(F.array(F.split(line, '"', -1)), marked), 0), "\n", -1)


def split_verbatim(lines: DataFrame, col: str = "value") -> DataFrame:
    """Each text line's fields by :func:`split_fields` as the 13 raw columns, and the
    line in ``__corrupt`` if it has another number of them; header lines (equal to
    the header) are dropped in every file. The fields go through an array of one, so that
    a line is split once, whatever filters follow."""
    parts = lines.filter(F.col(col) != F.lit(HEADER_LINE)).select(
        F.col(col).alias("l"), F.explode(F.array(split_fields(F.col(col)))).alias("f"))
    wrong = F.when(F.size("f") != len(RAW_COLUMNS), F.col("l"))
    return parts.select(*[F.get("f", i).alias(c) for i, c in enumerate(RAW_COLUMNS)], wrong.alias(CORRUPT))


def read_incidents_csv(spark: SparkSession, path: str | list[str], grid: GridSpec = GridSpec(),
                       date_mode: str = "real", verbatim: bool = False, lenient: bool = False,
                       keep_out_of_bounds: bool = False, header: bool | str = True,
                       multi_line: bool | str = False) -> DataFrame:
    """Typed incidents. Strict (default) fails on a record with missing or extra
    fields, a bad number or a bad date; lenient drops such records."""
    raw = split_verbatim(spark.read.text(path)) if verbatim else read_raw_csv(spark, path, multi_line, header)
    return _typed(raw, grid, date_mode, lenient, keep_out_of_bounds)


def incidents_to_raw(incidents: DataFrame) -> DataFrame:
    """Render typed incidents back to the 13 raw string columns of the export."""
    return incidents.select(
        F.col("IncidntNum").cast("string").alias("IncidntNum"), "Category", "Descript", "DayOfWeek",
        format_ntz("Timestamp", INCIDENT_TS_PATTERN.split(" ")[0]).alias("Date"),
        format_ntz("Timestamp", INCIDENT_TS_PATTERN.split(" ")[1]).alias("Time"),
        "PdDistrict", "Resolution", "Address",
        F.col("X").cast("string").alias("X"), F.col("Y").cast("string").alias("Y"),
        F.concat(F.lit("("), F.col("Y").cast("string"), F.lit(", "), F.col("X").cast("string"),
                 F.lit(")")).alias("Location"),
        "PdId")


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", quote_all: bool = False,
              null_value: str = "", mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Delimited text: quotes doubled inside quoted fields, NULL → ``null_value``. Files are
    cut at ``rows_per_file``, since one with quoted line feeds is read by one task."""
    (df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("quoteAll", quote_all).option("nullValue", null_value).option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("lineSep", "\n")
     .csv(path))


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",",
             multi_line: bool = False, comment: str | None = None, null_value: str = "",
             preview: int | None = None) -> DataFrame:
    """Delimited input with a fixed schema. ``comment`` skips lines starting with
    it, blank lines are skipped, ``preview`` keeps only the first n records."""
    r = (spark.read.schema(schema).option("header", header).option("sep", sep)
         .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
         .option("nullValue", null_value))
    if comment:
        r = r.option("comment", comment)
    df = r.csv(path)
    return df.limit(preview) if preview else df


def write_scores(scores: DataFrame, path: str, single_file: bool = True) -> None:
    """``box,pred`` lines, no header, in box order. One file only when asked (a
    single request's 166 rows); otherwise range-partitioned part files that are
    still globally ordered by (part file, line)."""
    out = scores.select(F.col("Box").cast("int"), F.col("pred").cast("int")).orderBy("Box")
    if single_file:
        out = out.coalesce(1)
    out.write.mode("errorifexists").option("header", False).option("lineSep", "\n").csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES_SCHEMA).option("header", False).csv(path)
