"""Fuzzy AND, OR and NOT in five families, for two columns and as closed-form folds.

Every family is associative, so a fold is a sum, product, minimum or maximum of
transformed terms; no term is repeated in the expression, and the same forms
work as aggregates over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("min_max", "probability", "luk", "hamacher", "einstein")
DENOMINATOR_GUARD = 1e-12


def resolve(family: str = "probability", t_norm: str | None = None, t_conorm: str | None = None, allow_mixed: bool = False) -> tuple[str, str]:
    """The families of AND and OR; mixing them must be asked for."""
    pair = t_norm or family, t_conorm or family
    for f in pair:
        if f not in FAMILIES:
            raise ValueError(f"unknown norm family: {f}")
    if pair[0] != pair[1] and not allow_mixed:
        raise ValueError(f"mixed norm families {pair} need allow_mixed")
    return pair


def t_norm(x: Column, y: Column, family: str = "probability") -> Column:
    if family == "min_max":
        return F.least(x, y)
    if family == "probability":
        return x * y
    if family == "luk":
        return F.greatest(F.lit(0.0), x + y - 1.0)
    if family == "hamacher":
        den = x + y - x * y
        return F.when(F.abs(den) <= DENOMINATOR_GUARD, 0.0).otherwise(x * y / den)
    if family == "einstein":
        return x * y / (2.0 - (x + y - x * y))
    raise ValueError(f"unknown norm family: {family}")


def t_conorm(x: Column, y: Column, family: str = "probability") -> Column:
    if family == "min_max":
        return F.greatest(x, y)
    if family == "probability":
        return x + y - x * y
    if family == "luk":
        return F.least(F.lit(1.0), x + y)
    if family == "hamacher":
        den = 1.0 - x * y
        return F.when(F.abs(den) <= DENOMINATOR_GUARD, 1.0).otherwise((x + y - 2.0 * x * y) / den)
    if family == "einstein":
        return (x + y) / (1.0 + x * y)
    raise ValueError(f"unknown norm family: {family}")


def complement(x: Column) -> Column:
    return 1.0 - x


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _product(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, cols)


def fold_and(cols: list[Column], family: str = "probability") -> Column:
    """AND over any number of columns; the identity 1 for none."""
    if not cols:
        return F.lit(1.0)
    if family == "min_max":
        return F.least(*cols) if len(cols) > 1 else cols[0]
    if family == "probability":
        return _product(cols)
    if family == "luk":
        return F.greatest(F.lit(0.0), _sum(cols) - float(len(cols) - 1))
    if family == "hamacher":
        zero = reduce(lambda a, b: a | b, [c <= 0 for c in cols])
        return F.when(zero, 0.0).otherwise(1.0 / (1.0 + _sum([(1.0 - c) / c for c in cols])))
    if family == "einstein":
        p, q = _product(cols), _product([2.0 - c for c in cols])
        return 2.0 * p / (q + p)
    raise ValueError(f"unknown norm family: {family}")


def fold_or(cols: list[Column], family: str = "probability") -> Column:
    """OR over any number of columns; the identity 0 for none."""
    if not cols:
        return F.lit(0.0)
    if family == "min_max":
        return F.greatest(*cols) if len(cols) > 1 else cols[0]
    if family == "probability":
        return 1.0 - _product([1.0 - c for c in cols])
    if family == "luk":
        return F.least(F.lit(1.0), _sum(cols))
    if family == "hamacher":
        one = reduce(lambda a, b: a | b, [c >= 1 for c in cols])
        s = _sum([c / (1.0 - c) for c in cols])
        return F.when(one, 1.0).otherwise(s / (1.0 + s))
    if family == "einstein":
        p, q = _product([1.0 + c for c in cols]), _product([1.0 - c for c in cols])
        return (p - q) / (p + q)
    raise ValueError(f"unknown norm family: {family}")


def agg_and(x: Column, family: str = "probability") -> Column:
    """AND as an aggregate over rows."""
    forms: dict[str, Callable[[], Column]] = {
        "min_max": lambda: F.min(x),
        "probability": lambda: F.product(x),
        "luk": lambda: F.greatest(F.lit(0.0), F.sum(x) - (F.count(x) - 1)),
        "hamacher": lambda: F.when(F.min(x) <= 0, 0.0).otherwise(1.0 / (1.0 + F.sum(F.when(x > 0, (1.0 - x) / x).otherwise(0.0)))),
        "einstein": lambda: 2.0 * F.product(x) / (F.product(2.0 - x) + F.product(x)),
    }
    return forms[family]()


def agg_or(x: Column, family: str = "probability") -> Column:
    """OR as an aggregate over rows."""
    s = F.sum(F.when(x < 1, x / (1.0 - x)).otherwise(0.0))
    forms: dict[str, Callable[[], Column]] = {
        "min_max": lambda: F.max(x),
        "probability": lambda: 1.0 - F.product(1.0 - x),
        "luk": lambda: F.least(F.lit(1.0), F.sum(x)),
        "hamacher": lambda: F.when(F.max(x) >= 1, 1.0).otherwise(s / (1.0 + s)),
        "einstein": lambda: (F.product(1.0 + x) - F.product(1.0 - x)) / (F.product(1.0 + x) + F.product(1.0 - x)),
    }
    return forms[family]()
