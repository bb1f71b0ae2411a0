"""Data-quality audits: bounding-box rejects, malformed CSV lines, per-cell type
detection and cast failures. Each is one pass with partial aggregation; output
size is bounded by (#columns x #classes), not by the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed values for cell typing (same rules as the browser CSV reader):
# exactly "true" / "false" → boolean; a number matches
# ^\s*-?(\d*\.?\d+|\d+\.?\d*)(e[-+]?\d+)?\s*$ case-insensitively; anything else is a string.
FLOAT_PATTERN = r"(?i)^\s*-?(\d*\.?\d+|\d+\.?\d*)(e[-+]?\d+)?\s*$"
LINE_ERRORS = ("MissingQuotes", "TooManyFields", "TooFewFields")


def bbox_audit(all_incidents: DataFrame) -> DataFrame:
    """Rows inside / outside the bounding box."""
    return all_incidents.groupBy("in_bounds").agg(F.count(F.lit(1)).alias("n"))


def _count_char(s: F.Column, ch: str) -> F.Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def fields_outside_quotes(line: F.Column) -> F.Column:
    """Number of fields of a line with balanced quotes: commas left after removing
    every quoted segment, plus one. Linear in the line length; it equals the size
    of the split on commas outside quotes, whose look-ahead rescans the rest of
    the line at every comma (quadratic on long lines)."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return _count_char(bare, ",") + F.lit(1)


def line_status(line: F.Column, expected_fields: int) -> F.Column:
    """'OK' or the first error of a CSV line: an odd number of quote characters
    means an unterminated quoted field; otherwise the field count decides."""
    n_quotes = _count_char(line, '"')
    n_fields = fields_outside_quotes(line)
    return (F.when(n_quotes % 2 == 1, F.lit("MissingQuotes"))
            .when(n_fields > expected_fields, F.lit("TooManyFields"))
            .when(n_fields < expected_fields, F.lit("TooFewFields"))
            .otherwise(F.lit("OK")))


def malformed_rows(lines: DataFrame, expected_fields: int, col: str = "value",
                   skip_empty: bool = True) -> DataFrame:
    """Count text lines per status (see :func:`line_status`)."""
    df = lines.filter(F.col(col) != "") if skip_empty else lines
    return (df.select(line_status(F.col(col), expected_fields).alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


def malformed_records(spark: SparkSession, path: str, expected_fields: int) -> DataFrame:
    """Count the records of a header-less CSV per status. Records are read quote-aware,
    line feeds inside quotes included; a record with the wrong number of fields is
    classified from its text."""
    schema = ", ".join([*[f"f{i} string" for i in range(expected_fields)], "__corrupt string"])
    records = (spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"')
               .option("multiLine", True).option("mode", "PERMISSIVE").option("columnPruning", False)
               .option("columnNameOfCorruptRecord", "__corrupt").csv(path))
    status = F.when(F.col("__corrupt").isNull(), F.lit("OK")).otherwise(line_status(F.col("__corrupt"), expected_fields))
    # a query on the record error alone is refused, so a field takes part in the first count
    counts = records.groupBy(status.alias("status"), F.col("f0").isNull()).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("status").agg(F.sum("n").alias("n"))


def value_type(v: F.Column) -> F.Column:
    return (F.when(v.isNull(), F.lit("null"))
            .when(v.isin("true", "false"), F.lit("boolean"))
            .when(v.rlike(FLOAT_PATTERN), F.lit("number"))
            .otherwise(F.lit("string")))


TYPES = ("null", "boolean", "number", "string")


def _rows(entries: list[tuple]) -> F.Column:
    """Explode (name, value...) structs: one row per entry of a one-row aggregate."""
    return F.explode(F.array(*[F.struct(*vals) for vals in entries]))


def cell_type_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, detected type, n) over all cells of the given (string) columns.

    Each cell is classified once in a projection and all (column, type) counts
    come out of one aggregation (one partial row per task), instead of
    unpivoting every cell into its own row and shuffling those.
    """
    cols = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    typed = df.select(*[value_type(F.col(c).cast("string")).alias(f"t{i}") for i, c in enumerate(cols)])
    row = typed.agg(*[F.count_if(F.col(f"t{i}") == F.lit(t)).alias(f"n{i}_{t}")
                      for i in range(len(cols)) for t in TYPES])
    entries = [(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}_{t}").alias("n"))
               for i, c in enumerate(cols) for t in TYPES]
    return row.select(_rows(entries).alias("r")).select("r.*").filter(F.col("n") > 0)


def cast_audit(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Per column: non-null values, values the strict cast would reject
    (``try_cast`` gives NULL), and the target type. One aggregation."""
    aggs = []
    for i, (c, t) in enumerate(targets.items()):
        aggs += [F.count(F.col(c)).alias(f"n{i}"),
                 F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"bad{i}")]
    row = df.agg(*aggs)
    entries = [(F.lit(c).alias("column"), F.lit(t).alias("target_type"), F.col(f"n{i}").alias("n_values"),
                F.col(f"bad{i}").alias("n_rejected")) for i, (c, t) in enumerate(targets.items())]
    return row.select(_rows(entries).alias("r")).select("r.*")
