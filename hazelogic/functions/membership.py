"""Membership functions as Column expressions: they stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
SIGMA_FLOOR = 1e-6
PDF_SIGMA_FLOOR = 1e-10
TRIANGLE_HALF_WIDTH = 2.33293
TRIANGLE_HALF_WIDTH_MSE = 2.37547
LEAST_LOWER_SCALE = 0.1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def gaussian(x: Column, mu, sigma) -> Column:
    """exp(-z^2 / 2) with sigma kept above its floor."""
    z = (x - _c(mu)) / F.greatest(_c(sigma), F.lit(SIGMA_FLOOR))
    return F.exp(-0.5 * z * z)


def trapezoid(x: Column, a, b, c, d) -> Column:
    """1 on [b, c], ramps strictly inside (a, b) and (c, d); a ramp without width is a step."""
    a, b, c, d = map(_c, (a, b, c, d))
    up, down = (x - a) / (b - a), (d - x) / (d - c)
    return F.when((x >= b) & (x <= c), 1.0).when((x > a) & (x < b), up).when((x > c) & (x < d), down).otherwise(0.0)


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    """Peak at b; an infinite a or c is a shoulder of ones on that side."""
    left = F.lit(1.0) if math.isinf(a) else F.when(x > a, (x - a) / (b - a)).otherwise(0.0) if b > a else F.lit(0.0)
    right = F.lit(1.0) if math.isinf(c) else F.when(x < c, (c - x) / (c - b)).otherwise(0.0) if c > b else F.lit(0.0)
    return F.when(x == b, 1.0).when(x < b, left).otherwise(right)


def functional(x: Column, mu, sigma, kind: str = "gaussian") -> Column:
    """Gaussian, or the triangle of about the same spread."""
    if kind == "gaussian":
        return gaussian(x, mu, sigma)
    if kind != "triangular":
        raise ValueError(f"unknown membership kind: {kind}")
    width = F.greatest(_c(sigma), F.lit(SIGMA_FLOOR)) * TRIANGLE_HALF_WIDTH
    return F.greatest(F.lit(0.0), 1.0 - F.abs(x - _c(mu)) / width)


def trapezoid_pdf(x: Column, a, b, c, d) -> Column:
    """The trapezoid over its area; 0 without area."""
    area = ((_c(d) - _c(a)) + (_c(c) - _c(b))) / 2.0
    return F.when(area > 0, trapezoid(x, a, b, c, d) / area).otherwise(0.0)


def triangle_pdf(x: Column, a: float, b: float, c: float) -> Column:
    return triangle(x, a, b, c) / F.lit((c - a) / 2.0) if c > a else F.lit(0.0)


def normal_pdf(x: Column, mu, sigma) -> Column:
    s = F.greatest(_c(sigma), F.lit(PDF_SIGMA_FLOOR))
    z = (x - _c(mu)) / s
    return F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi))


def widen_sigma(sigma: Column, w: float) -> tuple[Column, Column]:
    """Upper and lower sigma of an interval type-2 membership."""
    return sigma * (1.0 + w), sigma * max(LEAST_LOWER_SCALE, 1.0 - w)


def alpha_cut(principal: Column, outer: Column, alpha: Column) -> Column:
    """A parameter at level alpha, between the outer bound (0) and the principal (1)."""
    return outer + alpha * (principal - outer)


def support(mu: Column, sigma: Column, k: float = 3.0) -> tuple[Column, Column]:
    return mu - k * sigma, mu + k * sigma
