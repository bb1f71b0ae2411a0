"""Registered queries: name → (spark, sf_dir) → DataFrame, and the matching DuckDB oracle.

Every query reads the driver's tables in full (or what Spark derives from
them); none runs on made-up input, caps rows or samples.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georisk import oracle_sql as O
from georisk import tree_sql as TS
from georisk.functions.grid import GridSpec
from georisk.functions.timefeatures import REQUEST_TS_PATTERN, compat_date, format_ntz
from georisk.operators import cells as C
from georisk.operators import evaluate as E
from georisk.operators import heatmap as H
from georisk.operators import incremental as INC
from georisk.operators import profile as P
from georisk.operators import quality as Q
from georisk.operators import regions as R
from georisk.operators import score as S
from georisk.operators import tree as T
from georisk.session import shared_path
from georisk.sources import catalog as CAT
from georisk.sources import csv as CSV
from georisk.sources import parquet as PQ
from georisk.sources.quoted import read_quoted_csv
from georisk.sources.requests import read_requests
from georisk.sources.incidents import (
    CELL_KEYS,
    INCIDENT_COLUMNS,
    incidents_from_tables,
    lineitem_incident_base,
    publish,
    read_table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GRID = GridSpec()
NB = GRID.n_boxes


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def sql(*ctes: str, body: str) -> str:
    return O.with_ctes(*ctes, body=body)


def _incidents(spark: SparkSession, sf_dir: str, date_mode: str = "real") -> DataFrame:
    return incidents_from_tables(spark, sf_dir, GRID, date_mode)


def _all_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_tables(spark, sf_dir, GRID, keep_out_of_bounds=True)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_cells(C.box_agg(_incidents(spark, sf_dir)))


def _labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled slots cut from their lineage (a small table, at most
    ``slot_bound`` rows): joins against it never reach back into the scan."""
    return T.materialize(_labelled(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log: every event's time as request text."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", format_ntz("ts", REQUEST_TS_PATTERN).alias("request"))


def _mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with requests that are no timestamps: cut short, other text, a 13th month."""
    key, text = F.col("event_id") % 10, F.col("request")
    return _requests(spark, sf_dir).withColumn("request", F.when(key == 1, F.substring(text, 1, 16)).when(
        key == 2, F.concat(F.lit("at "), text)).when(key == 3, F.concat(F.substring(text, 1, 5), F.lit("13"), F.substring(
            text, 8, 12))).otherwise(text))


FIXED_NOW = dt.datetime(2015, 1, 1, 10, 0)


# ============================================================ scan, typing, filter
@register("incidents", sql(O.INCIDENTS_ALL, body=f"SELECT {O.INCIDENT_SELECT} FROM incidents"))
def q_incidents(spark, sf_dir):
    return _incidents(spark, sf_dir).select(*INCIDENT_COLUMNS)


@register("bbox_filter", sql(O.INCIDENTS_ALL, body="SELECT IncidntNum, PdId, X, Y FROM incidents"))
def q_bbox_filter(spark, sf_dir):
    return _incidents(spark, sf_dir).select("IncidntNum", "PdId", "X", "Y")


@register("bbox_audit", sql(O.INCIDENTS_ALL, body="SELECT in_bounds, COUNT(*) AS n FROM inc_all GROUP BY in_bounds"))
def q_bbox_audit(spark, sf_dir):
    return Q.bbox_audit(_all_incidents(spark, sf_dir))


@register("box_assign", sql(O.INCIDENTS_ALL, body="""
SELECT Box, CAST(trunc((Y - 37.7e0) / 0.01e0) AS INT) AS box_row,
       CAST(trunc((X - -122.516e0) / 0.01e0) AS INT) AS box_col, COUNT(*) AS n
FROM incidents GROUP BY ALL"""))
def q_box_assign(spark, sf_dir):
    inc = _incidents(spark, sf_dir)
    row = ((F.col("Y") - F.lit(GRID.min_y)) / F.lit(GRID.cell)).cast("int")
    col = ((F.col("X") - F.lit(GRID.min_x)) / F.lit(GRID.cell)).cast("int")
    return inc.groupBy("Box", row.alias("box_row"), col.alias("box_col")).agg(F.count(F.lit(1)).alias("n"))


@register("grid_extent", sql(O.INCIDENTS_ALL, body="""
SELECT (max_x - min_x) / 0.01e0 AS extent_x, (max_y - min_y) / 0.01e0 AS extent_y,
  CAST(trunc((min_y - 37.7e0) / 0.01e0) AS INT) * 15 + CAST(trunc((min_x - -122.516e0) / 0.01e0) AS INT) AS box_min_min,
  CAST(trunc((max_y - 37.7e0) / 0.01e0) AS INT) * 15 + CAST(trunc((min_x - -122.516e0) / 0.01e0) AS INT) AS box_min_max,
  CAST(trunc((min_y - 37.7e0) / 0.01e0) AS INT) * 15 + CAST(trunc((max_x - -122.516e0) / 0.01e0) AS INT) AS box_max_min,
  CAST(trunc((max_y - 37.7e0) / 0.01e0) AS INT) * 15 + CAST(trunc((max_x - -122.516e0) / 0.01e0) AS INT) AS box_max_max
FROM (SELECT MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y FROM incidents)"""))
def q_grid_extent(spark, sf_dir):
    """Extent in cells and corner box ids of the observed incident extent."""
    e = P.profile_extent(_incidents(spark, sf_dir))
    return e.select(((F.col("max_x") - F.col("min_x")) / F.lit(GRID.cell)).alias("extent_x"),
                    ((F.col("max_y") - F.col("min_y")) / F.lit(GRID.cell)).alias("extent_y"),
                    GRID.box_id("min_x", "min_y").alias("box_min_min"),
                    GRID.box_id("min_x", "max_y").alias("box_min_max"),
                    GRID.box_id("max_x", "min_y").alias("box_max_min"),
                    GRID.box_id("max_x", "max_y").alias("box_max_max"))


# Raw cells that do not fit their column, by key: no number, no coordinate, a missing
# coordinate, a truth value, and a missing district.
def _spoilt(raw: DataFrame) -> DataFrame:
    key = F.col("IncidntNum").cast("bigint")
    return raw.withColumns({
        "IncidntNum": F.when(key % 50 == 1, F.concat(F.lit("no-"), F.col("IncidntNum"))).otherwise(F.col("IncidntNum")),
        "X": F.when(key % 40 == 2, "west").when(key % 40 == 3, None).otherwise(F.col("X")),
        "Y": F.when(key % 60 == 4, F.concat(F.col("Y"), F.lit("N"))).otherwise(F.col("Y")),
        "Resolution": F.when(key % 30 == 5, "true").otherwise(F.col("Resolution")),
        "PdDistrict": F.when(key % 20 == 6, None).otherwise(F.col("PdDistrict")),
    })


SPOILT_SQL = """
spoilt AS (
  SELECT * REPLACE (
    CASE WHEN k % 50 = 1 THEN 'no-' || IncidntNum ELSE IncidntNum END AS IncidntNum,
    CASE WHEN k % 40 = 2 THEN 'west' WHEN k % 40 = 3 THEN NULL ELSE X END AS X,
    CASE WHEN k % 60 = 4 THEN Y || 'N' ELSE Y END AS Y,
    CASE WHEN k % 30 = 5 THEN 'true' ELSE Resolution END AS Resolution,
    CASE WHEN k % 20 = 6 THEN NULL ELSE PdDistrict END AS PdDistrict)
  FROM (SELECT *, CAST(IncidntNum AS BIGINT) AS k FROM raw)
)
"""

RAW_SQL = """
raw AS (
  SELECT CAST(IncidntNum AS VARCHAR) AS IncidntNum, Category, Descript, DayOfWeek,
    strftime("Timestamp", '%m/%d/%Y') AS "Date", strftime("Timestamp", '%H:%M') AS "Time",
    PdDistrict, Resolution, Address, CAST(X AS VARCHAR) AS X, CAST(Y AS VARCHAR) AS Y,
    '(' || CAST(Y AS VARCHAR) || ', ' || CAST(X AS VARCHAR) || ')' AS Location, PdId, "Timestamp"
  FROM inc_all
)
"""


def _raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem-derived incident as the 13 string columns of the export."""
    return CSV.incidents_to_raw(lineitem_incident_base(read_table(spark, sf_dir, "lineitem")))


@register("parse_timestamp", sql(O.INCIDENTS_ALL, RAW_SQL,
                                 body='SELECT PdId, "Date", "Time", "Timestamp" FROM raw'))
def q_parse_timestamp(spark, sf_dir):
    """Date 'MM/dd/yyyy' + Time 'HH:mm' strings of every row → timestamp_ntz."""
    from georisk.functions.timefeatures import parse_date_time
    raw = CSV.incidents_to_raw(lineitem_incident_base(read_table(spark, sf_dir, "lineitem")))
    return raw.select("PdId", "Date", "Time", parse_date_time("Date", "Time").alias("Timestamp"))


@register("compat_date", sql(O.INCIDENTS_ALL, body='SELECT PdId, "Timestamp", "Date", CompatDate FROM incidents'))
def q_compat_date(spark, sf_dir):
    inc = _incidents(spark, sf_dir)
    return inc.select("PdId", "Timestamp", "Date", compat_date("Timestamp").alias("CompatDate"))


@register("day_period", sql(O.INCIDENTS_ALL, body='SELECT "Hour", DayPeriod, COUNT(*) AS n FROM incidents GROUP BY ALL'))
def q_day_period(spark, sf_dir):
    return P.count_by(_incidents(spark, sf_dir), "Hour", "DayPeriod")


CELL_TYPE_SQL = r"""
typed AS (
  SELECT "column",
    CASE WHEN value = chr(1) THEN 'null' WHEN value IN ('true', 'false') THEN 'boolean'
         WHEN regexp_matches(value, '(?i)^\s*-?(\d*\.?\d+|\d+\.?\d*)(e[-+]?\d+)?\s*$') THEN 'number'
         ELSE 'string' END AS type
  FROM (UNPIVOT (SELECT COALESCE(COLUMNS(* EXCLUDE ("Timestamp", k)), chr(1)) FROM spoilt)
        ON IncidntNum, Category, Descript, DayOfWeek, "Date", "Time", PdDistrict, Resolution, Address,
           X, Y, Location, PdId
        INTO NAME "column" VALUE value)
)
"""


@register("cell_type_profile", sql(O.INCIDENTS_ALL, RAW_SQL, SPOILT_SQL, CELL_TYPE_SQL,
                                   body='SELECT "column", type, COUNT(*) AS n FROM typed GROUP BY ALL'))
def q_cell_type_profile(spark, sf_dir):
    """Cell types of every field of the raw incident records, some of them spoilt."""
    return Q.cell_type_profile(_spoilt(_raw_incidents(spark, sf_dir)), CSV.RAW_COLUMNS)


@register("cast_audit", sql(O.INCIDENTS_ALL, RAW_SQL, SPOILT_SQL, body="""
SELECT * FROM (
  SELECT 'IncidntNum' AS "column", 'bigint' AS target_type, COUNT(IncidntNum) AS n_values,
         COUNT(*) FILTER (WHERE IncidntNum IS NOT NULL AND TRY_CAST(IncidntNum AS BIGINT) IS NULL) AS n_rejected FROM spoilt
  UNION ALL
  SELECT 'X', 'double', COUNT(X), COUNT(*) FILTER (WHERE X IS NOT NULL AND TRY_CAST(X AS DOUBLE) IS NULL) FROM spoilt
  UNION ALL
  SELECT 'Y', 'double', COUNT(Y), COUNT(*) FILTER (WHERE Y IS NOT NULL AND TRY_CAST(Y AS DOUBLE) IS NULL) FROM spoilt
)"""))
def q_cast_audit(spark, sf_dir):
    raw = _spoilt(_raw_incidents(spark, sf_dir))
    return Q.cast_audit(raw, {"IncidntNum": "bigint", "X": "double", "Y": "double"})


# ============================================================ CSV sources / sinks
def _export_incidents_csv(spark, sf_dir) -> str:
    """The raw incident export in a new place of the shared folder."""
    path = shared_path(spark, "incidents-csv")
    CSV.write_csv(_raw_incidents(spark, sf_dir), path)
    return path


@register("csv_scan", sql(O.INCIDENTS_ALL, body=f"SELECT {O.INCIDENT_SELECT} FROM incidents"))
def q_csv_scan(spark, sf_dir):
    """Export every row as the 13-column incident CSV, read it back, type it."""
    return CSV.read_incidents_csv(spark, _export_incidents_csv(spark, sf_dir), GRID).select(*INCIDENT_COLUMNS)


@register("csv_split_verbatim", sql(O.INCIDENTS_ALL, body="""
SELECT IncidntNum, Category, '"' || Descript || '"' AS Descript, DayOfWeek, "Date", "Timestamp", PdDistrict,
  Resolution, Address, X, Y, PdId, Box, "Hour", DayPeriod, DayOfWeekNum, "Month" FROM incidents"""))
def q_csv_split_verbatim(spark, sf_dir):
    """Same export read line by line with the quote-keeping split."""
    path = _export_incidents_csv(spark, sf_dir)
    return CSV.read_incidents_csv(spark, path, GRID, verbatim=True).select(*INCIDENT_COLUMNS)


@register("parquet_roundtrip", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_parquet_roundtrip(spark, sf_dir):
    """Every incident (in or out of the box) written as year-partitioned Parquet,
    read back through the pushable box filter, counted per slot."""
    path = shared_path(spark, "incidents-parquet")
    PQ.write_incidents(_all_incidents(spark, sf_dir).drop("in_bounds"), path)
    return C.box_agg(PQ.read_incidents(spark, path, GRID))


@register("parquet_curve", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_parquet_curve(spark, sf_dir):
    """Every incident written along the space-filling curve, read back through the box filter, counted per slot."""
    path = shared_path(spark, "incidents-curve")
    PQ.write_incidents(_all_incidents(spark, sf_dir).drop("in_bounds"), path, layout="curve")
    return C.box_agg(PQ.read_incidents(spark, path, GRID))


def _schema_sql(table: str, columns: list[str]) -> str:
    one = """SELECT {i}::BIGINT AS position, '{c}' AS "column", CASE typeof(ANY_VALUE("{c}")) WHEN 'INTEGER' THEN 'int'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' ELSE lower(typeof(ANY_VALUE("{c}"))) END AS "type",
  COUNT(*) AS n_rows, COUNT(*) - COUNT("{c}") AS n_nulls FROM {t}"""
    return "\nUNION ALL\n".join(one.format(i=i, c=c, t=table) for i, c in enumerate(columns))


@register("schema_profile", sql(O.INCIDENTS_ALL, body=_schema_sql("incidents", INCIDENT_COLUMNS)))
def q_schema_profile(spark, sf_dir):
    """Columns of the typed incidents, with their types and nulls (the schema report, with counts)."""
    return P.schema_profile(_incidents(spark, sf_dir))


@register("footer_profile", sql(O.INCIDENTS_ALL, body="""
SELECT COUNT(*) AS n, MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y, MIN(Box) AS min_box, MAX(Box) AS max_box,
  MIN("Hour") AS min_hour, MAX("Hour") AS max_hour, MIN("Month") AS min_month, MAX("Month") AS max_month FROM incidents"""))
def q_footer_profile(spark, sf_dir):
    """Row count and ranges of the in-box table from its files' footers."""
    path = shared_path(spark, "incidents-in-box")
    PQ.write_in_box(_all_incidents(spark, sf_dir), path)
    return PQ.footer_profile(spark, path)


@register("observed_counts", sql(O.INCIDENTS_ALL, body="""
SELECT COUNT(*) AS raw_rows, COUNT(*) FILTER (WHERE in_bounds) AS kept_rows,
  COUNT(*) FILTER (WHERE NOT in_bounds) AS rejected_rows FROM inc_all"""))
def q_observed_counts(spark, sf_dir):
    """Raw, kept and rejected rows, counted while the in-box table is written."""
    seen = PQ.write_in_box(_all_incidents(spark, sf_dir), shared_path(spark, "incidents-in-box"))
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{k} bigint" for k in seen))


def _clustered(spark, sf_dir) -> DataFrame:
    return CAT.save_clustered(_incidents(spark, sf_dir), f"incidents_{uuid.uuid4().hex}")


@register("clustered_box_agg", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_clustered_box_agg(spark, sf_dir):
    """Slot counts of the clustered catalog table, without an exchange."""
    return C.box_agg(_clustered(spark, sf_dir))


@register("clustered_box_date_counts", sql(O.INCIDENTS_ALL, body="""
SELECT Box, "Date", COUNT(*) AS "Count" FROM incidents GROUP BY Box, "Date\""""))
def q_clustered_box_date_counts(spark, sf_dir):
    """Counts per (Box, Date) of the clustered catalog table, without an exchange."""
    return CAT.box_date_counts(_clustered(spark, sf_dir))


def _absorbed(spark, sf_dir) -> str:
    """A count store fed in two batches: files of even order keys, then those of odd ones as well."""
    source, root = shared_path(spark, "incident-files"), shared_path(spark, "count-store")
    rows = _all_incidents(spark, sf_dir).drop("in_bounds")
    for part in (0, 1):
        rows.filter(F.col("IncidntNum") % 2 == part).write.mode("append").parquet(source)
        INC.absorb(spark, source, root)
    return root


@register("incremental_slot_counts", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_incremental_slot_counts(spark, sf_dir):
    """Slot counts from the count store, after a second batch of files."""
    return INC.slot_counts(spark, _absorbed(spark, sf_dir))


@register("incremental_box_date_counts", sql(O.INCIDENTS_ALL, body="""
SELECT Box, "Date", COUNT(*) AS "Count" FROM incidents GROUP BY Box, "Date\""""))
def q_incremental_box_date_counts(spark, sf_dir):
    """Counts per (Box, Date) from the count store, after a second batch of files."""
    return INC.box_date_counts(spark, _absorbed(spark, sf_dir))


def _export_defects(spark, sf_dir) -> str:
    """The export as lines, some made wrong by their key: cut after Y, a field too many,
    a coordinate or a date that is none, no id."""
    raw = _raw_incidents(spark, sf_dir)
    key = F.col("IncidntNum").cast("bigint") % 50
    cells = {c: F.coalesce(F.col(c), F.lit("")) for c in CSV.RAW_COLUMNS}
    cells["X"] = F.when(key == 3, "west").otherwise(cells["X"])
    cells["Date"] = F.when(key == 4, "13/45/2015").otherwise(cells["Date"])
    cells["IncidntNum"] = F.when(key == 5, "x").otherwise(cells["IncidntNum"])
    quoted = [F.concat(F.lit('"'), cells[c], F.lit('"')) if c in ("Descript", "Location") else cells[c] for c in CSV.RAW_COLUMNS]
    short, whole = F.concat_ws(",", *quoted[:11]), F.concat_ws(",", *quoted)
    line = F.when(key == 1, short).when(key == 2, F.concat(whole, F.lit(",more"))).otherwise(whole)
    path = shared_path(spark, "incidents-defects")
    raw.select(line.alias("value")).write.option("header", False).text(path)
    return path


def _lenient(spark, path: str, verbatim: bool) -> DataFrame:
    return CSV.read_incidents_csv(spark, path, GRID, verbatim=verbatim, lenient=True, header=False)


SOUND = "IncidntNum % 50 NOT IN (1, 2, 3, 4, 5)"


@register("csv_lenient_box_agg", sql(O.INCIDENTS_ALL, body=f"""
SELECT COUNT(*) AS "Count", Box, "Month", DayOfWeekNum, DayPeriod FROM incidents WHERE {SOUND} GROUP BY ALL"""))
def q_csv_lenient_box_agg(spark, sf_dir):
    """Slots of a lenient read of an export with wrong records (it drops exactly those)."""
    return C.box_agg(_lenient(spark, _export_defects(spark, sf_dir), verbatim=False))


@register("csv_lenient_counts", sql(O.INCIDENTS_ALL, body=f"""
SELECT reader, n AS n_rows, n AS n_in_slots, n AS n_read_whole
FROM (SELECT COUNT(*) AS n FROM incidents WHERE {SOUND}), (VALUES ('csv'), ('verbatim')) v(reader)"""))
def q_csv_lenient_counts(spark, sf_dir):
    """The same number of rows whatever columns are read, by both readers of one export."""
    out, path = None, _export_defects(spark, sf_dir)
    for reader in ("csv", "verbatim"):
        df = _lenient(spark, path, verbatim=reader == "verbatim")
        whole = F.count(F.when(F.xxhash64(*INCIDENT_COLUMNS).isNotNull(), 1))
        parts = [df.agg(F.count(F.lit(1)).alias("n_rows")), C.box_agg(df).agg(F.coalesce(F.sum("Count"), F.lit(0)).alias("n_in_slots")),
                 df.agg(whole.alias("n_read_whole"))]
        row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).select(F.lit(reader).alias("reader"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


FINE = GridSpec(cell=0.0025).full_stride()


@register("parquet_other_grid", sql(O.INCIDENTS_ALL, body=f"""
SELECT COUNT(*) AS "Count", CAST(trunc((Y - 37.7e0) / 0.0025e0) AS INT) * {FINE.stride}
    + CAST(trunc((X - -122.516e0) / 0.0025e0) AS INT) AS Box, "Month", DayOfWeekNum, DayPeriod
FROM incidents GROUP BY ALL"""))
def q_parquet_other_grid(spark, sf_dir):
    """Written with the default grid's boxes, read and counted on a finer grid."""
    path = shared_path(spark, "incidents-parquet")
    PQ.write_incidents(_all_incidents(spark, sf_dir).drop("in_bounds"), path)
    return C.box_agg(PQ.read_incidents(spark, path, FINE))


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOC_NULL = "\\N"  # distinct from "", so NULL and empty text both survive the round trip


def _export_documents_csv(spark, sf_dir) -> str:
    path = shared_path(spark, "documents-csv")
    CSV.write_csv(read_table(spark, sf_dir, "documents").select(*DOC_COLUMNS), path, null_value=DOC_NULL)
    return path


@register("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    """Whole documents (quotes, commas, newlines in text) → CSV → back."""
    return CSV.read_csv(spark, _export_documents_csv(spark, sf_dir), DOC_SCHEMA, multi_line=True,
                        null_value=DOC_NULL)


@register("csv_quoted_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_csv_quoted_split(spark, sf_dir):
    """Whole documents (quotes, commas, line feeds in text) → CSV → back, block by block of each file."""
    path = shared_path(spark, "documents-csv")
    docs = read_table(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    CSV.write_csv(docs, path, null_value=DOC_NULL)
    return read_quoted_csv(spark, path, DOC_SCHEMA, null_value=DOC_NULL)


@register("csv_options", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_csv_options(spark, sf_dir):
    """All documents' metadata as semicolon-separated lines among comments and blank lines."""
    docs = read_table(spark, sf_dir, "documents")
    record = F.concat_ws(";", "doc_id", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")),
                         F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    lines = docs.select(F.explode(F.array(F.concat(F.lit("# next: "), F.col("doc_id").cast("string")), F.lit(""), record)).alias("value"))
    path = shared_path(spark, "documents-lines")
    lines.write.text(path)
    return CSV.read_csv(spark, path, "doc_id bigint, lang string, source string, n_chars bigint", header=False, sep=";", comment="#")


MALFORMED_SQL = """
SELECT 'documents' AS source, 'OK' AS status, COUNT(*) AS n FROM documents HAVING COUNT(*) > 0
UNION ALL
SELECT 'spoilt' AS source, CASE doc_id % 10 WHEN 1 THEN 'TooFewFields' WHEN 2 THEN 'TooManyFields'
  WHEN 3 THEN 'MissingQuotes' ELSE 'OK' END AS status, COUNT(*) AS n
FROM documents GROUP BY ALL"""


@register("malformed_rows", MALFORMED_SQL)
def q_malformed_rows(spark, sf_dir):
    """Whole documents as a well-formed CSV (quoted line feeds and all) hold no malformed
    record; the same documents on one line each, with a field dropped, a field added or
    a quote left open by their id, are counted by defect."""
    good = shared_path(spark, "documents-csv")
    docs = read_table(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    CSV.write_csv(docs, good, header=False, quote_all=True, null_value=DOC_NULL)
    audited = Q.malformed_records(spark, good, len(DOC_COLUMNS))
    flat = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\r\n]+", " ")
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
             for c in (F.col("doc_id"), flat, F.col("lang"), F.col("source"), F.col("n_chars"))]
    key, whole = F.col("doc_id") % 10, F.concat_ws(",", *cells)
    line = (F.when(key == 1, F.concat_ws(",", *cells[:-1])).when(key == 2, F.concat(whole, F.lit(',"more"')))
            .when(key == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole))
    spoilt = shared_path(spark, "documents-spoilt")
    docs.select(line.alias("value")).write.text(spoilt)
    lines = Q.malformed_rows(spark.read.text(spoilt), len(DOC_COLUMNS))
    return audited.select(F.lit("documents").alias("source"), "status", "n").unionByName(
        lines.select(F.lit("spoilt").alias("source"), "status", "n"))


# ============================================================ profiles
@register("profile_extent", sql(O.INCIDENTS_ALL, body="""
SELECT MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y FROM incidents"""))
def q_profile_extent(spark, sf_dir):
    return P.profile_extent(_incidents(spark, sf_dir))


@register("profile_ranges", sql(O.INCIDENTS_ALL, body="""
SELECT MIN(Box) AS min_box, MAX(Box) AS max_box, MIN("Hour") AS min_hour, MAX("Hour") AS max_hour,
  MIN(DayPeriod) AS min_day_period, MAX(DayPeriod) AS max_day_period,
  MIN("Month") AS min_month, MAX("Month") AS max_month FROM incidents"""))
def q_profile_ranges(spark, sf_dir):
    return P.profile_ranges(_incidents(spark, sf_dir))


@register("count_by_dow_name", sql(O.INCIDENTS_ALL, body="SELECT DayOfWeek, COUNT(*) AS n FROM incidents GROUP BY DayOfWeek"))
def q_count_by_dow_name(spark, sf_dir):
    return P.count_by(_incidents(spark, sf_dir), "DayOfWeek")


@register("count_by_dow_num", sql(O.INCIDENTS_ALL, body="SELECT DayOfWeekNum, COUNT(*) AS n FROM incidents GROUP BY DayOfWeekNum"))
def q_count_by_dow_num(spark, sf_dir):
    return P.count_by(_incidents(spark, sf_dir), "DayOfWeekNum")


@register("profile_time", sql(O.INCIDENTS_ALL, body='SELECT MIN("Timestamp") AS min_ts, MAX("Timestamp") AS max_ts FROM incidents'))
def q_profile_time(spark, sf_dir):
    return P.profile_time(_incidents(spark, sf_dir))


@register("box_date_counts", sql(O.INCIDENTS_ALL, body='SELECT Box, "Date", COUNT(*) AS n FROM incidents GROUP BY Box, "Date"'))
def q_box_date_counts(spark, sf_dir):
    return P.box_date_counts(_incidents(spark, sf_dir))


@register("box_date_counts_compat", sql(O.INCIDENTS_ALL, body="""
SELECT Box, CompatDate AS "Date", COUNT(*) AS n FROM incidents GROUP BY Box, CompatDate"""))
def q_box_date_counts_compat(spark, sf_dir):
    return P.box_date_counts(_incidents(spark, sf_dir, "compat"))


def _stats_sql(date_col: str) -> str:
    return sql(O.INCIDENTS_ALL, body=f"""
SELECT MIN(n) AS min_count, MAX(n) AS max_count, SUM(n) / COUNT(*) AS avg_count, COUNT(*) AS groups
FROM (SELECT COUNT(*) AS n FROM incidents GROUP BY Box, {date_col})""")


@register("box_date_stats", _stats_sql('"Date"'))
def q_box_date_stats(spark, sf_dir):
    return P.box_date_stats(P.box_date_counts(_incidents(spark, sf_dir)))


@register("box_date_stats_compat", _stats_sql("CompatDate"))
def q_box_date_stats_compat(spark, sf_dir):
    return P.box_date_stats(P.box_date_counts(_incidents(spark, sf_dir, "compat")))


@register("profile_cube", sql(O.INCIDENTS_ALL, body="""
SELECT Box, "Date", "Hour", "Month", DayOfWeekNum, DayPeriod, DayOfWeek, COUNT(*) AS n,
  MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y,
  MIN("Timestamp") AS min_ts, MAX("Timestamp") AS max_ts
FROM incidents GROUP BY ALL"""))
def q_profile_cube(spark, sf_dir):
    """Counts and extents per box and hour (a report of its own; the train job uses the smaller sets)."""
    return P.profile_cube(_incidents(spark, sf_dir))


_SET_COLUMNS = [("X", "x"), ("Y", "y"), ('"Timestamp"', "ts"), ('"Hour"', "hour"), ("Box", "box"),
                ("DayPeriod", "day_period"), ('"Month"', "month")]


@register("train_profile", sql(O.INCIDENTS_ALL, body=f"""
SELECT CAST(GROUPING(Box, "Month", DayOfWeekNum, DayPeriod, "Date", DayOfWeek) AS INTEGER) AS "grouping", Box, "Month", DayOfWeekNum,
  DayPeriod, "Date", DayOfWeek, COUNT(*) + CASE WHEN GROUPING(Box, DayOfWeek) = 3 THEN
    (SELECT COUNT(*) FROM inc_all WHERE NOT in_bounds) ELSE 0 END AS raw, COUNT(*) AS n,
  {", ".join(f"MIN({c}) AS min_{n}, MAX({c}) AS max_{n}" for c, n in _SET_COLUMNS)}
FROM incidents GROUP BY GROUPING SETS ((Box, "Month", DayOfWeekNum, DayPeriod), (Box, "Date"), (DayOfWeek), ())"""))
def q_train_profile(spark, sf_dir):
    """All that the train job reports about its input, from one scan and one exchange."""
    out = P.profile_sets(_all_incidents(spark, sf_dir))
    return out.select("grouping", *P.PROFILE_KEYS, "raw", "n", *[f"{m}_{n}" for _, n in _SET_COLUMNS for m in ("min", "max")])


@register("stage_counts", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT COUNT(*) AS raw_rows, COUNT(*) FILTER (WHERE in_bounds) AS kept_rows,
  COUNT(*) FILTER (WHERE NOT in_bounds) AS rejected_rows, (SELECT COUNT(*) FROM cells) AS cells
FROM inc_all"""))
def q_stage_counts(spark, sf_dir):
    return P.stage_counts(_all_incidents(spark, sf_dir))


# ============================================================ SQL-string entry point
SLOT_LIST = ", ".join(CELL_KEYS)
BOX_AGG_SQL = f"SELECT count(1) AS `Count`, {SLOT_LIST} FROM incidents GROUP BY {SLOT_LIST}"
EXTENT_SQL = "SELECT MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y FROM incidents"


@register("box_agg_sql", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_box_agg_sql(spark, sf_dir):
    """The flagship through ``spark.sql`` on the published ``incidents`` view."""
    publish(_incidents(spark, sf_dir), "incidents")
    return spark.sql(BOX_AGG_SQL)


@register("profile_extent_sql", sql(O.INCIDENTS_ALL, body="""
SELECT MIN(X) AS min_x, MAX(X) AS max_x, MIN(Y) AS min_y, MAX(Y) AS max_y FROM incidents"""))
def q_profile_extent_sql(spark, sf_dir):
    publish(_incidents(spark, sf_dir), "incidents")
    return spark.sql(EXTENT_SQL)


# ============================================================ slots and labels
@register("box_agg", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM cells"))
def q_box_agg(spark, sf_dir):
    return C.box_agg(_incidents(spark, sf_dir))


@register("preview", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT * FROM cells ORDER BY "Count" DESC, Box, "Month", DayOfWeekNum, DayPeriod LIMIT 5"""))
def q_preview(spark, sf_dir):
    """Top-5 slots by count (the five-row preview, in a fixed order)."""
    cells = C.box_agg(_incidents(spark, sf_dir))
    return P.preview(cells, [F.col("Count").desc(), *CELL_KEYS], 5)


@register("risk_label", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM labelled"))
def q_risk_label(spark, sf_dir):
    return _labelled(spark, sf_dir)


@register("label_counts", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT label, COUNT(*) AS n FROM labelled GROUP BY label"))
def q_label_counts(spark, sf_dir):
    return C.label_counts(_labelled(spark, sf_dir))


@register("train_test_split", sql(O.INCIDENTS_ALL, O.CELLS, body="SELECT * FROM split_cells"))
def q_train_test_split(spark, sf_dir):
    return C.mark_split(_labelled(spark, sf_dir))


@register("features", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT *, CAST(Box AS DOUBLE) AS f_Box, CAST("Month" AS DOUBLE) AS f_Month,
  CAST(DayOfWeekNum AS DOUBLE) AS f_DayOfWeekNum, CAST(DayPeriod AS DOUBLE) AS f_DayPeriod FROM labelled"""))
def q_features(spark, sf_dir):
    return T.feature_columns(T.assemble(_labelled(spark, sf_dir)))


# ============================================================ metrics (baseline predictor, exact)
BASELINE_SQL = """
train AS (SELECT * FROM split_cells WHERE split = 'train'),
test AS (SELECT * FROM split_cells WHERE split = 'test'),
per_box AS (
  SELECT Box, CAST(CASE WHEN SUM("Count") / COUNT(*) < 5 THEN 0 WHEN SUM("Count") / COUNT(*) < 30 THEN 1
                        ELSE 2 END AS DOUBLE) AS box_level
  FROM train GROUP BY Box),
preds AS (SELECT t.*, COALESCE(p.box_level, 0e0) AS prediction FROM test t LEFT JOIN per_box p USING (Box)),
per_class AS (
  SELECT CAST(c AS INT) AS class,
    COUNT(*) FILTER (WHERE label = c AND prediction = c) AS tp,
    COUNT(*) FILTER (WHERE prediction = c) AS predicted,
    COUNT(*) FILTER (WHERE label = c) AS actual
  FROM range(0, 3) r(c) LEFT JOIN preds ON TRUE GROUP BY c),
pr AS (
  SELECT class, tp, predicted, actual,
    CASE WHEN predicted = 0 THEN 'NaN'::DOUBLE ELSE tp / predicted END AS precision,
    CASE WHEN actual = 0 THEN 'NaN'::DOUBLE ELSE tp / actual END AS recall
  FROM per_class)
"""
METRIC_CTES = (O.INCIDENTS_ALL, O.CELLS, BASELINE_SQL)


def _baseline_preds(spark, sf_dir) -> DataFrame:
    return E.baseline_predictions(C.mark_split(_labelled(spark, sf_dir)))


@register("baseline_predictions", sql(*METRIC_CTES, body="SELECT * EXCLUDE (split) FROM preds"))
def q_baseline_predictions(spark, sf_dir):
    return _baseline_preds(spark, sf_dir)


@register("confusion_matrix", sql(*METRIC_CTES, body="""
SELECT CAST(i AS DOUBLE) AS label, CAST(j AS DOUBLE) AS prediction,
  (SELECT COUNT(*) FROM preds WHERE preds.label = i AND preds.prediction = j) AS n
FROM range(0, 3) a(i), range(0, 3) b(j)"""))
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_baseline_preds(spark, sf_dir))


@register("test_error", sql(*METRIC_CTES, body="""
SELECT n_wrong, n_test, CASE WHEN n_test = 0 THEN 'NaN'::DOUBLE ELSE n_wrong / n_test END AS test_error
FROM (SELECT COUNT(*) FILTER (WHERE label <> prediction) AS n_wrong, COUNT(*) AS n_test FROM preds)"""))
def q_test_error(spark, sf_dir):
    return E.test_error(_baseline_preds(spark, sf_dir))


@register("precision_recall", sql(*METRIC_CTES, body="SELECT * FROM pr"))
def q_precision_recall(spark, sf_dir):
    return E.precision_recall(_baseline_preds(spark, sf_dir))


@register("macro_metrics", sql(*METRIC_CTES, body="""
SELECT (p0 + p1 + p2) / 3e0 AS macro_precision, (r0 + r1 + r2) / 3e0 AS macro_recall FROM (
  SELECT MAX(precision) FILTER (WHERE class = 0) AS p0, MAX(precision) FILTER (WHERE class = 1) AS p1,
         MAX(precision) FILTER (WHERE class = 2) AS p2, MAX(recall) FILTER (WHERE class = 0) AS r0,
         MAX(recall) FILTER (WHERE class = 1) AS r1, MAX(recall) FILTER (WHERE class = 2) AS r2 FROM pr)"""))
def q_macro_metrics(spark, sf_dir):
    return E.macro_metrics(_baseline_preds(spark, sf_dir))


# ============================================================ scoring (history predictor, exact)
REQUESTS_SQL = f"""
requests AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS request, date_trunc('second', ts) AS request_ts,
    TRUE AS valid, CAST(month(ts) - 1 AS INT) AS "Month", CAST(isodow(ts) AS INT) AS DayOfWeekNum,
    CAST(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 0 WHEN hour(ts) < 12 THEN 1
         WHEN hour(ts) < 18 THEN 2 ELSE 3 END AS INT) AS DayPeriod
  FROM events),
slots AS (SELECT DISTINCT "Month", DayOfWeekNum, DayPeriod FROM requests),
boxes AS (SELECT CAST(range AS INT) AS Box FROM range(0, {NB})),
slot_scores AS (
  SELECT s."Month", s.DayOfWeekNum, s.DayPeriod, b.Box, CAST(COALESCE(l.label, 0) AS INT) AS pred
  FROM slots s CROSS JOIN boxes b
  LEFT JOIN labelled l ON l.Box = b.Box AND l."Month" = s."Month" AND l.DayOfWeekNum = s.DayOfWeekNum
                       AND l.DayPeriod = s.DayPeriod)
"""
SCORE_CTES = (O.INCIDENTS_ALL, O.CELLS, REQUESTS_SQL)


def _request_features(spark, sf_dir) -> DataFrame:
    return S.request_features(_requests(spark, sf_dir))


def _history_slot_scores(spark, sf_dir, req: DataFrame) -> DataFrame:
    return S.score_slots_with_history(_labelled_table(spark, sf_dir), S.distinct_slots(req), GRID)


MIXED_SQL = """
mixed AS (
  SELECT event_id, ts, CASE event_id % 10 WHEN 1 THEN substr(t, 1, 16) WHEN 2 THEN 'at ' || t
    WHEN 3 THEN substr(t, 1, 5) || '13' || substr(t, 8, 12) ELSE t END AS request, event_id % 10 NOT IN (1, 2, 3) AS valid
  FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)),
taken AS (
  SELECT event_id, request, valid, CASE WHEN valid THEN date_trunc('second', ts) ELSE TIMESTAMP '2015-01-01 10:00:00' END AS request_ts
  FROM mixed),
featured AS (
  SELECT *, CAST(month(request_ts) - 1 AS INT) AS "Month", CAST(isodow(request_ts) AS INT) AS DayOfWeekNum,
    CAST(CASE WHEN hour(request_ts) >= 22 OR hour(request_ts) < 6 THEN 0 WHEN hour(request_ts) < 12 THEN 1
         WHEN hour(request_ts) < 18 THEN 2 ELSE 3 END AS INT) AS DayPeriod FROM taken)
"""


@register("score_time_features", sql(MIXED_SQL, body="""
SELECT event_id, request, request_ts, valid, "Month", DayOfWeekNum, DayPeriod FROM featured"""))
def q_score_time_features(spark, sf_dir):
    """Slots of valid and invalid requests; the latter count as a fixed 'now' and are marked."""
    return S.request_features(_mixed_requests(spark, sf_dir), now=FIXED_NOW)


@register("valid_or_default_ts", sql(MIXED_SQL, body="SELECT event_id, request, request_ts FROM taken"))
def q_valid_or_default_ts(spark, sf_dir):
    """Request text → timestamp, falling back to a fixed 'now' for invalid text."""
    req = _mixed_requests(spark, sf_dir)
    return req.select("event_id", "request", S.valid_or_default("request", now=FIXED_NOW).alias("request_ts"))


@register("request_files", sql(MIXED_SQL, body="""
SELECT request, request_ts, valid, "Month", DayOfWeekNum, DayPeriod, COUNT(*) AS n FROM featured GROUP BY ALL"""))
def q_request_files(spark, sf_dir):
    """Request files with blank lines between valid and invalid ones, read and counted by slot."""
    lines = _mixed_requests(spark, sf_dir).select(F.explode(F.array(
        F.col("request"), F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "   "))).alias("value"))
    path = shared_path(spark, "requests")
    lines.filter(F.col("value").isNotNull()).write.text(path)
    feats = S.request_features(read_requests(spark, path), now=FIXED_NOW)
    return feats.groupBy(*feats.columns).agg(F.count(F.lit(1)).alias("n"))


@register("score_requests_by_slot", sql(*SCORE_CTES, body="""
SELECT r.event_id, r."Month", r.DayOfWeekNum, r.DayPeriod, m.levels
FROM requests r JOIN (
  SELECT "Month", DayOfWeekNum, DayPeriod, string_agg(pred, '' ORDER BY Box) AS levels FROM slot_scores GROUP BY ALL
) m USING ("Month", DayOfWeekNum, DayPeriod)"""))
def q_score_requests_by_slot(spark, sf_dir):
    """One row per request: its slot and the levels of all boxes in box order."""
    cube = S.slot_cube(labelled=_labelled_table(spark, sf_dir), grid=GRID)
    scored = S.join_slots(_request_features(spark, sf_dir), S.slot_levels(cube), S.N_SLOTS)
    return scored.select("event_id", *S.SLOT_KEYS, F.array_join("levels", "").alias("levels"))


@register("score_grid", sql(*SCORE_CTES, body="SELECT * FROM slot_scores"))
def q_score_grid(spark, sf_dir):
    """Every box for every distinct request slot, scored by slot history."""
    req = _request_features(spark, sf_dir)
    return _history_slot_scores(spark, sf_dir, req)


@register("score_requests", sql(*SCORE_CTES, body="""
SELECT r.event_id, r."Month", r.DayOfWeekNum, r.DayPeriod, s.Box, s.pred
FROM requests r JOIN slot_scores s USING ("Month", DayOfWeekNum, DayPeriod)"""))
def q_score_requests(spark, sf_dir):
    """One row per (request, box)."""
    cube = S.slot_cube(labelled=_labelled_table(spark, sf_dir), grid=GRID)
    scored = S.score_requests(_request_features(spark, sf_dir), cube, GRID)
    return scored.select("event_id", *S.SLOT_KEYS, "Box", "pred")


@register("mean_risk", sql(*SCORE_CTES, body=f"""
SELECT r.event_id, r."Month", r.DayOfWeekNum, r.DayPeriod, m.mean_risk_compat, m.mean_risk, m.boxes
FROM requests r JOIN (
  SELECT "Month", DayOfWeekNum, DayPeriod, SUM(pred) / {float(NB - 1)}e0 AS mean_risk_compat,
         SUM(pred) / COUNT(*) AS mean_risk, COUNT(*) AS boxes
  FROM slot_scores GROUP BY ALL) m USING ("Month", DayOfWeekNum, DayPeriod)"""))
def q_mean_risk(spark, sf_dir):
    cube = S.slot_cube(labelled=_labelled_table(spark, sf_dir), grid=GRID)
    out = S.request_mean_risk(_request_features(spark, sf_dir), cube, GRID)
    return out.select("event_id", *S.SLOT_KEYS, "mean_risk_compat", "mean_risk", "boxes")


@register("heatmap_layout", sql(*SCORE_CTES, body=f"""
SELECT *, Box AS position, CAST(ceil(Box / {float(H.PAGE_WIDTH)}e0) AS INT) AS "row",
  CAST(CASE WHEN Box % {H.PAGE_WIDTH} = 0 THEN {H.PAGE_WIDTH} ELSE Box % {H.PAGE_WIDTH} END AS INT) AS col,
  CASE pred WHEN 0 THEN '{H.COLOURS[0]}' WHEN 1 THEN '{H.COLOURS[1]}' WHEN 2 THEN '{H.COLOURS[2]}' END AS colour
FROM slot_scores WHERE Box > 0"""))
def q_heatmap_layout(spark, sf_dir):
    req = _request_features(spark, sf_dir)
    return H.layout(_history_slot_scores(spark, sf_dir, req), H.PAGE_WIDTH, compat=True)


# ============================================================ tree model
# The tree on exact box bins; its oracle grows the same tree level by level in SQL.
def _tree_sql(body: str, *ctes: str, rows: str = "labelled") -> str:
    parts = [O.INCIDENTS_ALL, O.CELLS, TS.grown(rows), *ctes]
    return "WITH RECURSIVE " + ",\n".join(c.strip().rstrip(",") for c in parts) + "\n" + body


TRAIN_ROWS = "(SELECT * FROM split_cells WHERE split = 'train')"


def _trained(spark, sf_dir):
    labelled = T.materialize(_labelled(spark, sf_dir))
    return labelled, T.train_tree(labelled)


def _binned_tree(spark, sf_dir) -> R.BinnedTree:
    return R.train(T.materialize(_labelled(spark, sf_dir)))


def _is_level(c: str) -> F.Column:
    return F.col(c).isin(0, 1, 2).alias("is_level")


def _nodes(spark, sf_dir) -> DataFrame:
    _, model = _trained(spark, sf_dir)
    return T.saved_nodes(spark, T.save_model(model, shared_path(spark, "model")))


@register("train_tree", _tree_sql(TS.NODES))
def q_train_tree(spark, sf_dir):
    """The node table of the tree on all slots, with its splits."""
    return R.node_table(spark, _binned_tree(spark, sf_dir).nodes)


@register("train_tree_on_split", _tree_sql(TS.NODES, rows=TRAIN_ROWS))
def q_train_tree_on_split(spark, sf_dir):
    """The node table of the tree on the training slots."""
    return R.node_table(spark, _split_tree(spark, sf_dir)[0].nodes)


@register("tree_regions", _tree_sql(TS.REGIONS))
def q_tree_regions(spark, sf_dir):
    """Each leaf of the tree on all slots as a box interval and sets of months, weekdays, periods."""
    return R.region_table(spark, R.regions(_binned_tree(spark, sf_dir).nodes))


@register("train_tree_checks", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT COUNT(*) FILTER (WHERE label = 0) AS class_0, COUNT(*) FILTER (WHERE label = 1) AS class_1,
  COUNT(*) FILTER (WHERE label = 2) AS class_2, TRUE AS children_add_up, TRUE AS depth_in_bounds FROM labelled"""))
def q_train_tree_checks(spark, sf_dir):
    """Checks of the saved tree's node table: class counts of the root, children's counts add up to
    their parent's, and there are at most 2**6 - 1 nodes."""
    nodes = _nodes(spark, sf_dir)
    classes = ["class_0", "class_1", "class_2"]
    inner = nodes.filter("leftChild >= 0")
    root = [F.sum(F.when(F.col("id") == 0, F.col(c))).alias(c) for c in classes]
    kids = inner.select("id", F.explode(F.array("leftChild", "rightChild")).alias("kid")).join(
        nodes.select(F.col("id").alias("kid"), *classes), "kid").groupBy("id").agg(*[F.sum(c).alias(f"k{c}") for c in classes])
    same = F.lit(True)
    for c in classes:
        same = same & (F.col(c) == F.col(f"k{c}"))
    checked = nodes.join(kids, "id", "left").withColumn("same", F.coalesce(same, F.lit(True)))
    return checked.agg(*root, F.bool_and("same").alias("children_add_up"), (F.count(F.lit(1)) < 2 ** (T.MAX_DEPTH + 1)).alias(
        "depth_in_bounds"))


def _predicted_one(spark, sf_dir) -> DataFrame:
    probe = spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(CELL_KEYS, (72, 8, 2, 1))])
    return R.predict(_binned_tree(spark, sf_dir), probe)


PROBE_SQL = f"""
probe AS (SELECT {", ".join(f'CAST({v} AS INTEGER) AS "{k}"' for k, v in zip(CELL_KEYS, (72, 8, 2, 1)))})"""


@register("predict_one", _tree_sql(
    'SELECT Box, "Month", DayOfWeekNum, DayPeriod, CAST(prediction AS DOUBLE) AS prediction FROM told',
    PROBE_SQL, TS.predicted("probe", 'Box, "Month", DayOfWeekNum, DayPeriod')))
def q_predict_one(spark, sf_dir):
    """The tree on all slots applied to the slot (Box 72, Month 8, DayOfWeekNum 2, DayPeriod 1)."""
    return _predicted_one(spark, sf_dir).select(*CELL_KEYS, "prediction")


@register("predict_one_checks", """
SELECT CAST(72 AS INTEGER) AS Box, CAST(8 AS INTEGER) AS "Month", CAST(2 AS INTEGER) AS DayOfWeekNum,
  CAST(1 AS INTEGER) AS DayPeriod, TRUE AS is_level""")
def q_predict_one_checks(spark, sf_dir):
    """Whether the prediction of ``predict_one`` is a level."""
    return _predicted_one(spark, sf_dir).select(*CELL_KEYS, _is_level("prediction"))


def _split_tree(spark, sf_dir) -> tuple[R.BinnedTree, DataFrame]:
    labelled = T.materialize(_labelled(spark, sf_dir))
    train, test = C.split_cells(labelled, "hash")
    return R.train(train), test


def _eval_preds(spark, sf_dir) -> DataFrame:
    tree, test = _split_tree(spark, sf_dir)
    return R.predict(tree, test)


_TOLD = TS.predicted("(SELECT * FROM split_cells WHERE split = 'test')", '"Count", Box, "Month", DayOfWeekNum, DayPeriod, label')


@register("evaluate_tree", _tree_sql(
    'SELECT "Count", Box, "Month", DayOfWeekNum, DayPeriod, label, CAST(prediction AS DOUBLE) AS prediction FROM told',
    _TOLD, rows=TRAIN_ROWS))
def q_evaluate_tree(spark, sf_dir):
    """The tree of the training slots applied to every test slot."""
    return _eval_preds(spark, sf_dir).select("Count", *CELL_KEYS, "label", "prediction")


@register("tree_confusion", _tree_sql("""
SELECT CAST(l.v AS DOUBLE) AS label, CAST(p.v AS DOUBLE) AS prediction, COUNT(told.label) AS n
FROM range(0, 3) l(v), range(0, 3) p(v) LEFT JOIN told ON told.label = l.v AND told.prediction = p.v GROUP BY ALL""", _TOLD, rows=TRAIN_ROWS))
def q_tree_confusion(spark, sf_dir):
    """The confusion matrix of the training slots' tree on the test slots."""
    return E.confusion_matrix(_eval_preds(spark, sf_dir)).select("label", "prediction", "n")


@register("tree_metrics", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT COUNT(*) AS n_test, COUNT(*) AS confusion_total, TRUE AS error_is_consistent, TRUE AS macro_is_consistent
FROM split_cells WHERE split = 'test'"""))
def q_tree_metrics(spark, sf_dir):
    """Metrics of the tree: the matrix sums to the test slots, the error is what lies off its
    diagonal, and the macro averages are the means of the per-class values."""
    preds = T.materialize(_eval_preds(spark, sf_dir))
    m = E.metrics_summary(preds)
    c = E.confusion_matrix(preds).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))
                                                                      .otherwise(0)).alias("hits"))
    pr = E.precision_recall(preds).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))

    def near(a: str, b: F.Column) -> F.Column:
        return (F.abs(F.col(a) - b) < 1e-9) | (F.isnan(a) & F.isnan(b))

    error = F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide("hits", "total"))
    return m.crossJoin(c).crossJoin(pr).select(  # one row each
        "n_test", F.col("total").alias("confusion_total"), near("test_error", error).alias("error_is_consistent"),
        (near("macro_precision", F.col("p")) & near("macro_recall", F.col("r"))).alias("macro_is_consistent"))


@register("score_all_boxes", _tree_sql(
    'SELECT "Month", DayOfWeekNum, DayPeriod, Box, prediction AS pred FROM told', REQUESTS_SQL,
    TS.predicted(f"(SELECT * FROM slots, (SELECT CAST(range AS INTEGER) AS Box FROM range(0, {NB})))", 'Box, "Month", DayOfWeekNum, DayPeriod')))
def q_score_all_boxes(spark, sf_dir):
    """The tree applied to every box of every distinct request slot."""
    tree = _binned_tree(spark, sf_dir)
    slots = S.expand_boxes(S.distinct_slots(_request_features(spark, sf_dir)), GRID)
    return slots.select(*S.SLOT_KEYS, "Box", R.prediction(tree.nodes).alias("pred"))


def _reference_slot_scores(spark, sf_dir):
    tree = _binned_tree(spark, sf_dir)
    slot = S.expand_boxes(S.with_fixed_slot(spark.range(1).select()), GRID)
    return slot.select(*S.SLOT_KEYS, "Box", R.prediction(tree.nodes).alias("pred"))


@register("score_reference_slot", _tree_sql(
    'SELECT "Month", DayOfWeekNum, DayPeriod, Box, prediction AS pred FROM told',
    TS.predicted(f"""(SELECT CAST(8 AS INTEGER) AS "Month", CAST(2 AS INTEGER) AS DayOfWeekNum, CAST(1 AS INTEGER) AS DayPeriod,
      CAST(range AS INTEGER) AS Box FROM range(0, {NB}))""", 'Box, "Month", DayOfWeekNum, DayPeriod')))
def q_score_reference_slot(spark, sf_dir):
    """What the reference scorer outputs: all boxes at the constant slot (8, 2, 1)."""
    return _reference_slot_scores(spark, sf_dir).orderBy("Box").select(*S.SLOT_KEYS, "Box", "pred")


@register("score_reference_slot_checks", f"""
SELECT CAST(8 AS INTEGER) AS "Month", CAST(2 AS INTEGER) AS DayOfWeekNum, CAST(1 AS INTEGER) AS DayPeriod,
  CAST(range AS INTEGER) AS Box, TRUE AS is_level FROM range(0, {NB})""")
def q_score_reference_slot_checks(spark, sf_dir):
    """Keys of ``score_reference_slot``, and whether each score is a level."""
    return _reference_slot_scores(spark, sf_dir).orderBy("Box").select(*S.SLOT_KEYS, "Box", _is_level("pred"))


@register("risk_csv_roundtrip", f"SELECT CAST({NB} AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS mismatches")
def q_risk_csv_roundtrip(spark, sf_dir):
    """``box,pred`` file for the reference slot, written as one file, read back and compared."""
    scores = T.materialize(_reference_slot_scores(spark, sf_dir))
    path = shared_path(spark, "useroutput-csv")
    CSV.write_scores(scores, path, single_file=True)
    back = CSV.read_scores(spark, path).withColumnRenamed("pred", "back")
    wrong = ~F.col("pred").eqNullSafe(F.col("back"))
    return scores.select("Box", "pred").join(back, "Box", "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(wrong).alias("mismatches"))


@register("model_roundtrip", sql(O.INCIDENTS_ALL, O.CELLS, body="""
SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS disagreements FROM split_cells WHERE split = 'test'"""))
def q_model_roundtrip(spark, sf_dir):
    """Save the tree, load it, score the test slots with both."""
    labelled, model = _trained(spark, sf_dir)
    loaded = T.load_model(T.save_model(model, shared_path(spark, "model")))
    _, te = C.split_cells(labelled, "hash")
    a = T.predict(model, te).withColumnRenamed("prediction", "saved")
    b = T.predict(loaded, a)
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("saved") != F.col("prediction")).alias("disagreements"))
