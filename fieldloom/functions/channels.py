"""Column functions on channel names (``band_YYYYMMDD``) and month-days (``MMDD``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_year(mmdd: Column) -> Column:
    """Day of a leap year; null for what is no date."""
    return F.dayofyear(F.try_to_date(F.concat(F.lit("2000"), mmdd), "yyyyMMdd"))


def band_of(channel: Column) -> Column:
    return F.split(channel, "_")[0]


def date_of(channel: Column) -> Column:
    return F.split(channel, "_")[1]


def mmdd_of(channel: Column) -> Column:
    return F.substring(date_of(channel), 5, 4)
