"""Column functions of surface meteorology; temperatures in degrees Celsius, pressures in kPa unless named otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation_pressure(t: Column) -> Column:
    """Tetens: kPa at t."""
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def vapour_deficit(t: Column, dew: Column) -> Column:
    """Saturation deficit, never negative."""
    return F.greatest(saturation_pressure(t) - saturation_pressure(dew), F.lit(0.0))


def relative_humidity(t: Column, dew: Column) -> Column:
    """Percent, within 0 and 100."""
    return F.least(F.greatest(F.lit(100.0) * saturation_pressure(dew) / saturation_pressure(t), F.lit(0.0)), F.lit(100.0))


def specific_humidity(dew: Column, pressure_hpa: Column) -> Column:
    """Grams per kilogram from the dew point and the pressure in hPa."""
    ea = saturation_pressure(dew) * F.lit(10.0)
    return F.lit(1000.0) * F.lit(0.622) * ea / (pressure_hpa - F.lit(0.378) * ea)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def plausible(t: Column, dew: Column, pressure_hpa: Column, tolerance: float) -> Column:
    """Whether the dew point is at most `tolerance` above t and the pressure exceeds the vapour's; null counts as not."""
    return F.coalesce((dew <= t + F.lit(tolerance)) & (pressure_hpa > saturation_pressure(dew) * F.lit(10.0)), F.lit(False))


def solar_passage_hour(local_hour: float, lon: Column) -> Column:
    """UTC hour of a satellite that passes at a local solar hour."""
    return F.lit(local_hour) - lon / F.lit(15.0)
