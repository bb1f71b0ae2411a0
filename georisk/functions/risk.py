"""Risk levels from slot counts, and the predictor-independent metric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: count < 5 → 0 Low, count < 30 → 1 Medium,
# otherwise 2 High; three classes.
LOW_BELOW = 5
MEDIUM_BELOW = 30
N_CLASSES = 3
LEVEL_NAMES = ("Low", "Medium", "High")


def risk_level(count: Column | str, low_below: int = LOW_BELOW, medium_below: int = MEDIUM_BELOW) -> Column:
    c = F.col(count) if isinstance(count, str) else count
    return F.when(c < low_below, F.lit(0)).when(c < medium_below, F.lit(1)).otherwise(F.lit(2))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NaN for 0/0 (the reference's behaviour, which poisons a
    macro average on purpose) instead of an ANSI divide-by-zero error."""
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num.cast("double") / den.cast("double"))
