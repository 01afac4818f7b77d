"""Calendar fields and day counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# output column -> field of the start time; weekday counts from Monday = 0
TIME_PARTS = {
    "TransactionHour": F.hour,
    "TransactionDayOfMonth": F.dayofmonth,
    "TransactionDayOfWeek": F.weekday,
    "TransactionMonth": F.month,
    "TransactionYear": F.year,
}


def with_time_parts(df: DataFrame, time: str = "TransactionStartTime") -> DataFrame:
    return df.withColumns({name: part(F.col(time)) for name, part in TIME_PARTS.items()})


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Full 24-hour periods between two TIMESTAMP_NTZ values, rounded down (also
    below zero). An interval between naive times knows no time zone."""
    elapsed = later - earlier
    days = F.extract(F.lit("DAY"), elapsed)
    return (days - (elapsed < F.make_dt_interval(days)).cast("int")).cast("bigint")
