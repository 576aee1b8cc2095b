"""Quality words: bit fields and the predicates on them. A missing word counts as 0, the best."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(word: Column, first: int, count: int) -> Column:
    """The value of `count` bits from bit `first`."""
    return F.shiftright(F.coalesce(word.cast("long"), F.lit(0)), first).bitwiseAND(F.lit((1 << count) - 1))


def leaf_area_ok(word: Column, strict: bool = False) -> Column:
    """No clouds and the main method, saturated or not; strict: the main method unsaturated."""
    return field(word, 5, 3) == 0 if strict else (field(word, 3, 2) == 0) & (field(word, 5, 3) <= 1)


def reflectance_ok(state: Column, quality: Column, zenith: Column, aerosol: int = 2, steepest: float = 35.0) -> Column:
    """Clear sky, no shadow, little aerosol, no internal cloud, best band quality, near nadir."""
    clear = (field(state, 0, 2) == 0) & (field(state, 2, 1) == 0) & (field(state, 6, 2) <= aerosol) & (field(state, 10, 1) == 0)
    return clear & (field(quality, 0, 2) <= 1) & F.coalesce(zenith <= steepest, F.lit(False))


def burned(day: Column, quality: Column) -> Column:
    """A burn day of 1 to 366 with bit 0 of the quality word."""
    return F.coalesce(day.between(1, 366), F.lit(False)) & (field(quality, 0, 1) == 1)


def surface_temperature_ok(word: Column) -> Column:
    """Produced with good or other quality, and an error of at most 2 K."""
    return (field(word, 0, 2) <= 1) & (field(word, 6, 2) <= 1)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0."""
    return F.when(a + b != 0, (a - b) / (a + b))
