"""Days of year, eight-day slots, dates across years, local days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(day: Column) -> Column:
    """Eight-day slot of the year, 0 to 45."""
    return F.least(F.floor((F.dayofyear(day) - 1) / 8), F.lit(45)).cast("int")


def slot_ordinal(day: Column) -> Column:
    """Slots since year 0: 46 a year, so that neighbours differ by 1 across New Year."""
    return (F.year(day) * 46 + slot(day)).cast("int")


def leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def same_date(day: Column, year: Column) -> Column:
    """The date in another year; February 29 is the 28th in a common year."""
    d = F.when((F.month(day) == 2) & (F.dayofmonth(day) == 29) & ~leap(year), F.lit(28)).otherwise(F.dayofmonth(day))
    return F.make_date(year.cast("int"), F.month(day), d)


def local_day(ts: Column, hours: int) -> Column:
    """The calendar day of a UTC instant at a fixed offset; an hour-ending total takes one hour more."""
    return F.to_date(ts + F.expr(f"interval {hours} hours") if hours >= 0 else ts - F.expr(f"interval {-hours} hours"))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def burn_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)
