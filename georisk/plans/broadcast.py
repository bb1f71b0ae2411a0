"""Broadcast only behind a proven size bound.

A side is broadcast when a bound that does not depend on the data volume
(e.g. the number of grid boxes or slots) is below ``max_rows``; otherwise it is
left to the planner (sort-merge / shuffled hash join, AQE may still convert it
at run time from real statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, row_bound: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if row_bound <= max_rows else df
