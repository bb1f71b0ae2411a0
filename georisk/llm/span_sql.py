"""DuckDB SQL for spans of leftmost non-overlapping matches."""

from __future__ import annotations


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans_sql(kinds: list[tuple[str, str, str, int]], by_kind: bool) -> str:
    """``kinds``: name, pattern, condition on ``v`` (the value of the given group).

    Matches and the text between them alternate, so the lengths of both give
    each match's place.
    """
    parts = [f"""
SELECT doc_id, {i} AS k, '{name}' AS kind, {name}_m.b AS b, {name}_m.e AS e FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
      'b': CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT),
      'e': CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS BIGINT),
      'v': vs[i]}})) AS {name}_m
  FROM (SELECT doc_id, regexp_extract_all(t, {_quoted(pattern)}) AS ms, regexp_extract_all(t, {_quoted(pattern)}, {group}) AS vs,
               string_split_regex(t, {_quoted(pattern)}) AS ps
        FROM d WHERE regexp_matches(t, {_quoted(pattern)}))
) WHERE {condition.replace('@v', name + '_m.v')}""" for i, (name, pattern, condition, group) in enumerate(kinds)]
    order = "k, b" if by_kind else "b, k"
    counts = ", ".join(f"COUNT(k) FILTER (WHERE k = {i}) AS n_{name}" for i, (name, *_) in enumerate(kinds))
    joined = f"coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY {order}), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts}, sha256({joined}) AS base_sha256, {joined} AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
