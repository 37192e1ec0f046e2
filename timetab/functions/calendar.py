"""Calendar features of a timestamp and day differences to an anchor date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(time: str) -> dict[str, Column]:
    """ISO weekday (Monday is 1), day of month and year, month, year, and minute and hour of the day."""
    t = F.col(time)
    return {
        "day_of_week": F.weekday(t) + 1,
        "day_of_month": F.day(t),
        "day_of_year": F.dayofyear(t),
        "month": F.month(t),
        "year": F.year(t),
        "minute_of_day": F.hour(t) * 60 + F.minute(t),
        "hour_of_day": F.hour(t),
    }


def add_calendar(df: DataFrame, time: str, names: Sequence[str] | None = None) -> DataFrame:
    columns = calendar(time)
    return df.withColumns({n: columns[n] for n in (names or columns)})


def from_epoch_seconds(c: str) -> Column:
    return F.timestamp_seconds(F.col(c))


def days_from(anchor: str, c: str) -> Column:
    """Whole days from the anchor date to ``c``; negative before the anchor."""
    return F.datediff(F.col(c), F.col(anchor)).cast("float")


def mean_days_from(anchor: str, mean_epoch_days: str) -> Column:
    """The same for a mean date held as fractional epoch days; whole days, cut toward zero."""
    gap = F.col(mean_epoch_days) - F.unix_date(F.col(anchor).cast("date"))
    return F.when(gap < 0, F.ceil(gap)).otherwise(F.floor(gap)).cast("float")
