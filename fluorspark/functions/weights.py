"""Robust weight functions and the Weibull distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TUKEY_CUT = 36.0


def cauchy(squared: Column) -> Column:
    """Weight of a squared standardised distance."""
    return 1 / (1 + 0.5 * squared)


def cauchy_whole(squared: Column) -> Column:
    """The variant without the half, which brightness fitting uses."""
    return 1 / (1 + squared)


def tukey_biweight(squared: Column) -> Column:
    return F.when(squared < TUKEY_CUT, F.pow(1 - squared / TUKEY_CUT, 2)).otherwise(0.0)


def pweibull(x: Column, shape: float, scale: float, *, upper: bool = False, log: bool = False) -> Column:
    hazard = F.pow(F.greatest(x, F.lit(0.0)) / scale, F.lit(shape))
    if upper:
        return -hazard if log else F.exp(-hazard)
    below = -F.expm1(-hazard)
    return F.log(below) if log else below


def qweibull(p: Column, shape: float, scale: float, *, upper: bool = False, log: bool = False) -> Column:
    p = F.exp(p) if log else p
    tail = F.log(p) if upper else F.log1p(-p)
    return F.when(p.between(0, 1), scale * F.pow(-tail, F.lit(1 / shape))).otherwise(float("nan"))


def dweibull(x: Column, shape: float, scale: float, *, log: bool = False) -> Column:
    z = x / scale
    out = F.log(F.lit(shape / scale)) + (shape - 1) * F.log(z) - F.pow(z, F.lit(shape))
    return F.when(x > 0, out if log else F.exp(out)).otherwise(float("-inf") if log else 0.0)
