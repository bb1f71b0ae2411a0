"""DuckDB SQL that grows the risk tree level by level: the oracle of the tree queries.

Each level counts classes by (node, feature, value), lists the candidate splits of every
node, and keeps the one with the largest gini gain (ties: the first feature, then the first
split). Boxes are cut as :func:`georisk.operators.regions.box_cuts` says; months and weekdays
are ordered by their impurity and cut there; periods are parted by subsets. Nodes are named by
their path of L and R, so sorting by path numbers them parents first.
"""

from __future__ import annotations

DEPTH = 5
BINS = 32


def _gini(p: str) -> str:
    n = f"({p}0 + {p}1 + {p}2)"
    return " - ".join(["1e0", *[f"({p}{c} / {n}) * ({p}{c} / {n})" for c in range(3)]])


def _level(i: int) -> str:
    """best{i}: the split of every node of level i that has one; r{i+1}: rows one level below."""
    left, right = "l", "(n{c} - l{c})"
    lw, rw = "(l0 + l1 + l2)", "(n0 + n1 + n2 - l0 - l1 - l2)"
    rights = {c: right.format(c=c) for c in range(3)}
    right_gini = " - ".join(["1e0", *[f"({rights[c]} / {rw}) * ({rights[c]} / {rw})" for c in range(3)]])
    sums = ", ".join(f"CAST(sum(c{c}) AS DOUBLE) AS l{c}" for c in range(3))
    running = ", ".join(f"CAST(sum(c{c}) OVER w AS DOUBLE) AS l{c}" for c in range(3))
    lists = ", ".join(f"c{c}" for c in range(3))
    return f"""
open{i} AS MATERIALIZED (
  SELECT path, {", ".join(f"CAST(count(*) FILTER (WHERE label = {c}) AS DOUBLE) AS n{c}" for c in range(3))} FROM r{i}
  WHERE length(path) = {i} GROUP BY path),
hist{i} AS MATERIALIZED (
  SELECT path, f, v, {", ".join(f"CAST(count(*) FILTER (WHERE label = {c}) AS DOUBLE) AS c{c}" for c in range(3))}
  FROM (SELECT path, label, unnest([0, 1, 2, 3]) AS f, unnest([bin, "Month", DayOfWeekNum, DayPeriod]) AS v FROM r{i} WHERE length(path) = {i})
  GROUP BY path, f, v),
cand{i} AS (
  SELECT path, f, v AS pos, CAST(v AS VARCHAR) AS cats, {running} FROM hist{i} WHERE f = 0 WINDOW w AS (PARTITION BY path ORDER BY v)
  UNION ALL
  SELECT path, f, row_number() OVER w AS pos, string_agg(CAST(v AS VARCHAR), ',') OVER w AS cats, {running}
  FROM (SELECT path, f, v, {lists}, {_gini('c')} AS impurity FROM hist{i} WHERE f IN (1, 2))
  WINDOW w AS (PARTITION BY path, f ORDER BY impurity, v ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT path, f, code AS pos, NULL AS cats, {sums} FROM hist{i}, range(1, 8) t(code)
  WHERE f = 3 AND (CAST(code AS INTEGER) >> v) & 1 = 1 GROUP BY path, f, code),
gained{i} AS (
  SELECT *, {_gini('n')} - {lw} / (n0 + n1 + n2) * ({_gini(left)}) - {rw} / (n0 + n1 + n2) * ({right_gini}) AS gain
  FROM cand{i} JOIN open{i} USING (path) WHERE l0 + l1 + l2 > 0 AND n0 + n1 + n2 > l0 + l1 + l2),
best{i} AS MATERIALIZED (
  SELECT path, f, pos, cats, gain FROM gained{i} JOIN open{i} USING (path) WHERE {_gini('open%d.n' % i)} > 2.3e-16
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, pos) = 1 AND gain > 0),
r{i + 1} AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN b.path IS NULL THEN r.path
    WHEN {goes_left('b', 'bin <= b.pos')} THEN r.path || 'L' ELSE r.path || 'R' END AS path)
  FROM r{i} r LEFT JOIN best{i} b ON b.path = r.path)"""


def goes_left(split: str, box: str) -> str:
    """Whether a row with columns bin or Box, Month, DayOfWeekNum, DayPeriod goes left."""
    held = "list_contains(string_split({s}.cats, ','), CAST({c} AS VARCHAR))"
    return (f"CASE {split}.f WHEN 0 THEN {box} WHEN 1 THEN {held.format(s=split, c='\"Month\"')} "
            f"WHEN 2 THEN {held.format(s=split, c='DayOfWeekNum')} ELSE (CAST({split}.pos AS INTEGER) >> DayPeriod) & 1 = 1 END")


def grown(rows: str) -> str:
    """CTEs up to ``nodes`` (path, id, prediction, f, pos, cats, threshold, gain, class counts) of the
    tree on ``rows``, a relation with Box, Month, DayOfWeekNum, DayPeriod and label."""
    levels = ",".join(_level(i) for i in range(DEPTH))
    named = ", ".join(f"count(*) FILTER (WHERE label = {c}) AS class_{c}" for c in range(3))
    splits = " UNION ALL ".join(f"SELECT path, f, pos, cats, gain FROM best{i}" for i in range(DEPTH))
    pruned = ",".join(f"""
live{i} AS MATERIALIZED (
  SELECT s.* FROM live{i + 1} s LEFT JOIN (
    SELECT a.path[:-2] AS path FROM every a JOIN every b ON b.path = a.path[:-2] || 'R' AND a.prediction = b.prediction
    WHERE length(a.path) = {i + 1} AND a.path[-1:] = 'L' AND a.path NOT IN (SELECT path FROM live{i + 1})
      AND b.path NOT IN (SELECT path FROM live{i + 1})) same ON same.path = s.path AND length(s.path) = {i}
  WHERE same.path IS NULL)""" for i in reversed(range(DEPTH)))
    return f"""
box_counts AS MATERIALIZED (
  SELECT Box, sum(n) OVER (ORDER BY Box) AS total, row_number() OVER (ORDER BY Box) AS i, lag(Box) OVER (ORDER BY Box) AS low
  FROM (SELECT Box, count(*) AS n FROM {rows} GROUP BY Box)),
walk(i, cut, target) AS (
  SELECT CAST(1 AS BIGINT), CAST(NULL AS DOUBLE), (SELECT max(total) / CAST({BINS} AS DOUBLE) FROM box_counts)
  UNION ALL
  SELECT b.i, CASE WHEN abs(a.total - w.target) < abs(b.total - w.target) THEN (b.low + b.Box) / 2e0 END,
    w.target + CASE WHEN abs(a.total - w.target) < abs(b.total - w.target) THEN (SELECT max(total) / CAST({BINS} AS DOUBLE) FROM box_counts) ELSE 0 END
  FROM walk w JOIN box_counts a ON a.i = w.i JOIN box_counts b ON b.i = w.i + 1),
cuts AS MATERIALIZED (
  SELECT cut, row_number() OVER (ORDER BY cut) - 1 AS bin FROM (
    SELECT cut FROM walk WHERE cut IS NOT NULL AND (SELECT count(*) FROM box_counts) > {BINS}
    UNION ALL SELECT (low + Box) / 2e0 FROM box_counts WHERE low IS NOT NULL AND (SELECT count(*) FROM box_counts) <= {BINS})),
r0 AS MATERIALIZED (
  SELECT '' AS path, Box, CAST((SELECT count(*) FROM cuts WHERE cut < t.Box) AS INTEGER) AS bin, "Month", DayOfWeekNum, DayPeriod, label
  FROM {rows} t),{levels},
splits AS MATERIALIZED ({splits}),
counted AS (
  SELECT p.path, {named} FROM (SELECT path[:k] AS path, label FROM (SELECT path, label, unnest(range(0, length(path) + 1)) AS k FROM r{DEPTH})) p
  GROUP BY p.path),
every AS MATERIALIZED (
  SELECT *, CASE WHEN class_0 >= class_1 AND class_0 >= class_2 THEN 0 WHEN class_1 >= class_2 THEN 1 ELSE 2 END AS prediction FROM counted),
live{DEPTH} AS MATERIALIZED (SELECT * FROM splits),{pruned},
kept AS (
  SELECT e.*, row_number() OVER (ORDER BY e.path) - 1 AS id FROM every e
  WHERE NOT EXISTS (SELECT 1 FROM range(0, length(e.path)) k(k) WHERE e.path[:k.k] NOT IN (SELECT path FROM live0))),
nodes AS MATERIALIZED (
  SELECT k.*, s.f, s.pos, s.cats, s.gain, c.cut AS threshold FROM kept k LEFT JOIN live0 s USING (path)
  LEFT JOIN cuts c ON s.f = 0 AND c.bin = s.pos)"""


def predicted(probe: str, keep: str) -> str:
    """CTEs up to ``told``: ``keep`` columns of ``probe`` and the prediction of the node its walk ends in."""
    steps = ",".join(f"""
w{i + 1} AS (SELECT w.* REPLACE (CASE WHEN n.f IS NULL THEN w.path WHEN {goes_left('n', 'Box <= n.threshold')} THEN w.path || 'L'
  ELSE w.path || 'R' END AS path) FROM w{i} w JOIN nodes n ON n.path = w.path)""" for i in range(DEPTH))
    return f"""
w0 AS (SELECT *, '' AS path FROM {probe}),{steps},
told AS (SELECT {keep}, n.prediction FROM w{DEPTH} w JOIN nodes n ON n.path = w.path)"""


#: The node table's columns.
NODES = """
SELECT CAST(n.id AS INTEGER) AS id, n.prediction, coalesce(n.gain, -1e0) AS gain, CAST(coalesce(l.id, -1) AS INTEGER) AS leftChild,
  CAST(coalesce(r.id, -1) AS INTEGER) AS rightChild,
  CASE n.f WHEN 0 THEN 'Box' WHEN 1 THEN 'Month' WHEN 2 THEN 'DayOfWeekNum' WHEN 3 THEN 'DayPeriod' END AS feature, n.threshold,
  CASE WHEN n.f IN (1, 2) THEN array_to_string(list_sort(list_transform(string_split(n.cats, ','), lambda x: CAST(x AS INTEGER))), ',')
    WHEN n.f = 3 THEN array_to_string(list_filter([0, 1, 2], lambda x: (CAST(n.pos AS INTEGER) >> x) & 1 = 1), ',') END AS categories,
  n.class_0, n.class_1, n.class_2
FROM nodes n LEFT JOIN nodes l ON n.f IS NOT NULL AND l.path = n.path || 'L' LEFT JOIN nodes r ON n.f IS NOT NULL AND r.path = n.path || 'R'"""

_SETS = ", ".join(f"""(SELECT coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') FROM range(0, {arity}) t(v) WHERE NOT EXISTS (
    SELECT 1 FROM nodes a WHERE a.f = {f} AND length(a.path) < length(n.path) AND starts_with(n.path, a.path)
      AND (n.path[length(a.path) + 1] = 'L') <> {held})) AS "{name}\"""" for f, name, arity, held in (
    (1, "Month", 12, "list_contains(string_split(a.cats, ','), CAST(v AS VARCHAR))"),
    (2, "DayOfWeekNum", 8, "list_contains(string_split(a.cats, ','), CAST(v AS VARCHAR))"),
    (3, "DayPeriod", 4, "((CAST(a.pos AS INTEGER) >> CAST(v AS INTEGER)) & 1 = 1)")))
#: One row per leaf.
REGIONS = f"""
SELECT CAST(n.id AS INTEGER) AS id, n.prediction AS level, n.class_0 + n.class_1 + n.class_2 AS slots,
  (SELECT max(a.threshold) FROM nodes a WHERE a.f = 0 AND starts_with(n.path, a.path || 'R')) AS box_above,
  (SELECT min(a.threshold) FROM nodes a WHERE a.f = 0 AND starts_with(n.path, a.path || 'L')) AS box_upto, {_SETS}
FROM nodes n WHERE n.f IS NULL"""
