"""Plan inspection helpers used by tests and the bench to keep plans honest:
filters reach the scan, only needed columns are read, no Python evaluation in
the hot path, the expected number of shuffles."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def count_exchanges(df: DataFrame) -> int:
    """Shuffle exchanges in the physical plan (broadcasts excluded)."""
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition"
                          r"|Exchange RoundRobinPartitioning", plan_text(df, "simple")))


def has_python_eval(df: DataFrame) -> bool:
    return bool(re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
                          plan_text(df, "simple")))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan_text(df, "formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: (\[[^\n]*\])", plan_text(df, "formatted"))
