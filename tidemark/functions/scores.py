"""Arithmetic on classifier scores and risk values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """NaN as null, so that averages and maxima skip it."""
    return F.when(~F.isnan(col), col)


def raw_risk(severe: Column | str = "prob_severe", moderate: Column | str = "prob_moderate") -> Column:
    severe = F.col(severe) if isinstance(severe, str) else severe
    moderate = F.col(moderate) if isinstance(moderate, str) else moderate
    return F.lit(2.0) * severe + moderate


def non_depressed_estimate(avg_severe: Column, avg_moderate: Column) -> Column:
    return F.lit(1.0) - (avg_severe + avg_moderate)


def softmax(logits: Column) -> Column:
    """Probabilities from an array of logits, shifted by the largest for stability."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v.cast("double") - top.cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(exps, lambda v: v / total)


def argmax(values: Column) -> Column:
    """0-based position of the largest value, first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def point_line_distance(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of (x0, y0) from the line through the other two points; 0 if they coincide."""
    dx, dy = x2 - x1, y2 - y1
    length = F.sqrt(dy * dy + dx * dx)
    area = F.abs(dy * x0 - dx * y0 + x2 * y1 - y2 * x1)
    return F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(area, length))
