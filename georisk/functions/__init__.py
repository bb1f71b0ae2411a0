"""Column-returning building blocks: no Python UDFs, all codegen-able."""

from georisk.functions.grid import GridSpec
from georisk.functions.risk import risk_level, safe_ratio
from georisk.functions.timefeatures import (
    calendar_date,
    compat_date,
    day_period,
    dow_name,
    dow_num,
    hour_of,
    month0,
    parse_date_time,
    parse_ts,
    time_features,
)

__all__ = [
    "GridSpec", "risk_level", "safe_ratio", "calendar_date", "compat_date", "day_period",
    "dow_name", "dow_num", "hour_of", "month0", "parse_date_time", "parse_ts", "time_features",
]
