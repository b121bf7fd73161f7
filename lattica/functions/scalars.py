"""Scalar functions of values, as Columns."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_value(value: Column, base: float | None = None, normalization: float = 0.0, least_positive: Column | None = None) -> Column:
    """Logarithm (natural by default). A positive normalization is added first; with 0 only positive values have one;
    with a negative one, zeros take the least positive value's, less that much more."""
    scale = 1.0 if base is None else log(base)
    if normalization > 0:
        return F.ln(value + normalization) / scale
    positive = F.when(value > 0, F.ln(F.when(value > 0, value)) / scale)
    if normalization == 0:
        return positive
    return F.coalesce(positive, F.ln(least_positive) / scale + normalization)


def logistic(gap: Column, location: float, slope: float) -> Column:
    return 1 / (1 + F.exp(slope * (location - gap)))


def cover_diameter(points: Column, area: Column, fraction: float) -> Column:
    """The diameter at which so many discs cover that fraction of an area."""
    return F.sqrt(area * fraction / points) * (2 / pi**0.5)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
