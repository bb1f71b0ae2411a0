"""DuckDB SQL fragments that restate the Spark queries independently (the
correctness oracle). They run on the driver's pre-registered views
(``lineitem``, ``events``, ...), never on anything Spark produced.

Dialect notes: DuckDB rounds in ``CAST(double AS INT)`` where Spark truncates,
so every truncation is ``trunc()`` first; literals carry ``e0`` so they are
DOUBLE, not DECIMAL; ``isodow`` is 1 = Monday; ``dayofweek`` is 0 = Sunday.
"""

# Incidents derived from lineitem, every row, with the in-bounds flag (FIXTURES.md §5).
INCIDENTS_ALL = """
inc_base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    l_shipdate + to_minutes(CAST((l_orderkey*37 + l_linenumber*211) % 1440 AS INT)) AS ts,
    -122.516e0 + 0.18e0 * u*u*u*u*u*u AS X,
    37.7e0 + 0.12e0 * w*w*w*w AS Y
  FROM (SELECT *,
      CAST((l_partkey*7919 + l_linenumber*13) % 1000 AS DOUBLE) / 1000e0 AS u,
      CAST((l_orderkey*104729 + l_suppkey*31) % 1000 AS DOUBLE) / 1000e0 AS w
    FROM lineitem)
),
inc_all AS (
  SELECT l_orderkey AS IncidntNum, l_returnflag AS Category,
    concat_ws(', ', l_returnflag, l_linestatus) AS Descript,
    dayname(ts) AS DayOfWeek, CAST(ts AS DATE) AS "Date",
    make_date(1900 + dayofweek(ts), month(ts), 1) + CAST(year(ts) - 1901 AS INT) AS CompatDate,
    ts AS "Timestamp",
    'D' || CAST(l_suppkey % 10 AS VARCHAR) AS PdDistrict, l_linestatus AS Resolution,
    CAST(l_partkey AS VARCHAR) || ' Block' AS Address, X, Y,
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS PdId,
    CAST(trunc((Y - 37.7e0) / 0.01e0) AS INT) * 15 + CAST(trunc((X - -122.516e0) / 0.01e0) AS INT) AS Box,
    CAST(hour(ts) AS INT) AS "Hour",
    CAST(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 0 WHEN hour(ts) < 12 THEN 1
         WHEN hour(ts) < 18 THEN 2 ELSE 3 END AS INT) AS DayPeriod,
    CAST(isodow(ts) AS INT) AS DayOfWeekNum,
    CAST(month(ts) - 1 AS INT) AS "Month",
    (CAST(CAST(X AS FLOAT) AS DOUBLE) BETWEEN -122.516e0 AND -122.360e0
     AND CAST(CAST(Y AS FLOAT) AS DOUBLE) BETWEEN 37.700e0 AND 37.809e0) AS in_bounds
  FROM inc_base
),
incidents AS (SELECT * FROM inc_all WHERE in_bounds)
"""

INCIDENT_SELECT = """IncidntNum, Category, Descript, DayOfWeek, "Date", "Timestamp", PdDistrict,
  Resolution, Address, X, Y, PdId, Box, "Hour", DayPeriod, DayOfWeekNum, "Month\""""

CELLS = """
cells AS (
  SELECT COUNT(*) AS "Count", Box, "Month", DayOfWeekNum, DayPeriod
  FROM incidents GROUP BY Box, "Month", DayOfWeekNum, DayPeriod
),
labelled AS (
  SELECT *, CAST(CASE WHEN "Count" < 5 THEN 0 WHEN "Count" < 30 THEN 1 ELSE 2 END AS DOUBLE) AS label
  FROM cells
),
split_cells AS (
  SELECT *, CASE WHEN ((Box*31 + "Month"*17 + DayOfWeekNum*7 + DayPeriod) % 10) < 7
                 THEN 'train' ELSE 'test' END AS split
  FROM labelled
)
"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body
