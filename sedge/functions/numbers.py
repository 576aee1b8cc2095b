"""Rounding for comparisons, bins, blocks, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge[i-1], edge[i]] that x falls in; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, name in zip(edges, labels, strict=False):
        out = out.when(x <= e, F.lit(name))
    return out.otherwise(F.lit(labels[len(edges)]))


def block_key(lat: Column, lon: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(lat / size).cast("string"), F.floor(lon / size).cast("string"))


def seed_of(*parts: Column) -> Column:
    """A seed of joined parts: the first four bytes of their SHA-256, little endian."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    order = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(order, 16, 10).cast("long")


def coverage(value: Column, valid: Column, whole: Column, least: float) -> Column:
    """The value where the valid part is enough of the whole."""
    return F.when(valid >= F.lit(least) * whole, value)
