"""Membership functions as values: Gaussians, trapezoids and triangles with type-2 bounds.

A `Shape` gives its membership as a Column; its transforms (widening, alpha
cuts, triangles, supports) are arithmetic on a few numbers on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column

from hazelogic.functions import membership

#: Least deviation or leg that a widened membership starts from.
LEAST_SPREAD = 1e-4


@dataclass(frozen=True)
class Shape:
    """`gaussian` (mu, sigma), `trapezoid` (a, b, c, d) or `triangle` (a, b, c; infinite ends are shoulders)."""

    kind: str
    params: tuple[float, ...]

    def __post_init__(self):
        if len(self.params) != {"gaussian": 2, "trapezoid": 4, "triangle": 3}.get(self.kind):
            raise ValueError(f"{self.kind} does not take {len(self.params)} parameters")

    def at(self, x: Column) -> Column:
        return getattr(membership, self.kind)(x, *self.params)

    def _scaled(self, by: float) -> Shape:
        p = self.params
        leg = lambda n: max(n, LEAST_SPREAD) * by
        if self.kind == "gaussian":
            return Shape("gaussian", (p[0], leg(p[1])))
        if math.isinf(p[0]) or math.isinf(p[-1]):
            raise ValueError("a shoulder has no leg to widen")
        if self.kind == "trapezoid":
            return Shape("trapezoid", (p[1] - leg(p[1] - p[0]), p[1], p[2], p[2] + leg(p[3] - p[2])))
        return Shape("triangle", (p[1] - leg(p[1] - p[0]), p[1], p[1] + leg(p[2] - p[1])))

    def widened(self, w: float) -> It2:
        """Interval type-2 bounds: the spread times 1 + w above and max(0.1, 1 - w) below, the peak fixed."""
        return It2(self._scaled(1 + w), self._scaled(max(membership.LEAST_LOWER_SCALE, 1 - w)))

    def general(self, w: float) -> Gt2:
        """General type-2 bounds around the shape itself."""
        both = self.widened(w)
        return Gt2(both.upper, both.lower, self)

    def towards(self, other: Shape, alpha: float) -> Shape:
        """Every parameter moved the share `alpha` of the way to `other`'s; infinite ones of `other` pass through."""
        return Shape(self.kind, tuple(q if math.isinf(q) else p + alpha * (q - p) for p, q in zip(self.params, other.params, strict=True)))

    def support(self, k: float = 3.0) -> tuple[float, float]:
        """The ends of the shape; of a Gaussian mu -/+ k sigma."""
        return (self.params[0] - k * self.params[1], self.params[0] + k * self.params[1]) if self.kind == "gaussian" else (self.params[0], self.params[-1])

    def as_triangle(self, half_width: float = membership.TRIANGLE_HALF_WIDTH) -> Shape:
        """The triangle nearest to a Gaussian; other shapes stay."""
        if self.kind != "gaussian":
            return self
        mu, sigma = self.params
        width = half_width * max(sigma, membership.SIGMA_FLOOR)
        return Shape("triangle", (mu - width, mu, mu + width))

    def near(self, other: Shape, rtol: float = 1e-2, atol: float = 1e-3) -> bool:
        """Whether all parameters are close to `other`'s, whose size the relative part is of."""
        close = lambda p, q: p == q or abs(p - q) <= atol + rtol * abs(q)
        return self.kind == other.kind and all(close(p, q) and not math.isnan(p + q) or p == q for p, q in zip(self.params, other.params, strict=True))


@dataclass(frozen=True)
class It2:
    """An interval type-2 membership."""

    upper: Shape
    lower: Shape

    def at(self, x: Column) -> tuple[Column, Column]:
        return self.upper.at(x), self.lower.at(x)


@dataclass(frozen=True)
class Gt2:
    """A general type-2 membership with a triangular secondary grade."""

    upper: Shape
    lower: Shape
    principal: Shape

    def alpha_cut(self, alpha: float) -> It2:
        """The plane at level alpha: the bounds at 0, the principal membership at 1."""
        return It2(self.upper.towards(self.principal, alpha), self.lower.towards(self.principal, alpha))


def gaussian(mu: float, sigma: float) -> Shape:
    return Shape("gaussian", (float(mu), float(sigma)))


def trapezoid(a: float, b: float, c: float, d: float) -> Shape:
    return Shape("trapezoid", (float(a), float(b), float(c), float(d)))


def triangle(a: float, b: float, c: float) -> Shape:
    return Shape("triangle", (float(a), float(b), float(c)))
