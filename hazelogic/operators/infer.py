"""Inference: firing strengths, classes, probabilities, TSK values, intervals, anomalies.

A fitted model is small (features x labels x memberships), so scoring is a
projection whose constants come from the model: no join and no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.functions import membership, norms, shapes
from hazelogic.functions.shapes import Shape

ZERO_FIRING = 1e-6
#: Most rows of a model that are collected to the driver.
MAX_MODEL = 100_000


class Model:
    """Memberships by feature and label, with labels in order: Gaussians as (mu, sigma), or shapes."""

    def __init__(self, cells: dict[tuple[str, str], list[tuple[float, float] | Shape]]):
        self.cells = cells
        self.features = sorted({f for f, _ in cells})
        self.labels = sorted({x for _, x in cells})

    @classmethod
    def of(cls, fits: DataFrame, label: str) -> Model:
        """From a table with feature, label, mu and sigma."""
        rows = fits.select("feature", F.col(label).alias("label"), "mu", "sigma").limit(MAX_MODEL + 1).collect()
        if len(rows) > MAX_MODEL:
            raise ValueError(f"a model has at most {MAX_MODEL} memberships")
        cells: dict = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.feature, r.label, r.mu)):
            cells[r.feature, r.label].append((r.mu, r.sigma))
        return cls(dict(cells))

    def widened(self, scale: float) -> Model:
        return Model({k: [(m, s * scale) for m, s in v] for k, v in self.cells.items()})

    def shapes(self) -> dict[tuple[str, str], list[Shape]]:
        """All memberships as shapes."""
        return {k: [p if isinstance(p, Shape) else shapes.gaussian(*p) for p in v] for k, v in self.cells.items()}

    def mapped(self, f: Callable[[Shape], Shape]) -> Model:
        """The model of every membership's image, such as its triangle."""
        return Model({k: [f(p) for p in v] for k, v in self.shapes().items()})

    def with_more(self, cells: dict[tuple[str, str], list[tuple[float, float] | Shape]]) -> Model:
        """The model with further memberships at the end of their cells."""
        return Model({k: [*self.cells.get(k, []), *cells.get(k, [])] for k in {**self.cells, **cells}})


def firing(model: Model, t_norm: str = "probability", t_conorm: str | None = None, skip_missing: bool = False, columns: list[str] | None = None) -> Column:
    """Array of firing strengths in label order: OR inside a cell, AND across features."""
    present = model.features if columns is None else [f for f in model.features if f in columns]
    if len(present) < len(model.features) and not skip_missing:
        raise ValueError(f"missing features: {sorted(set(model.features) - set(present))}")
    both = norms.resolve(t_norm, t_norm, t_conorm or t_norm, allow_mixed=True)
    part = lambda f, p: p.at(F.col(f).cast("double")) if isinstance(p, Shape) else membership.gaussian(F.col(f).cast("double"), *p)
    cell = lambda f, x: norms.fold_or([part(f, p) for p in model.cells.get((f, x), [])], both[1])
    return F.array(*[norms.fold_and([cell(f, x) for f in present], both[0]) for x in model.labels])


def with_anomaly(strengths: Column, threshold: float, n: int, t_conorm: str = "probability") -> Column:
    """The strengths with one more: the complement of the OR over all, each moved by the threshold."""
    moved = [F.least(F.greatest(F.get(strengths, F.lit(i)) + threshold, F.lit(0.0)), F.lit(1.0)) for i in range(n)]
    return F.concat(strengths, F.array(norms.complement(norms.fold_or(moved, t_conorm))))


def classify(strengths: Column, labels: list[str]) -> Column:
    """The label of the largest strength; the first of ties."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(strengths, F.array_max(strengths)).cast("int"))


def probabilities(strengths: Column, n: int) -> Column:
    """Strengths over their sum; uniform where nothing fires."""
    return _with_total(strengths, lambda s, t: F.when(t == 0, F.array_repeat(F.lit(1.0 / n), n)).otherwise(F.transform(s, lambda x: x / t)))


def _with_total(strengths: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(strengths, their sum), each computed once a row: lambda variables hold them."""
    once = lambda x, g: F.get(F.transform(F.array(x), g), F.lit(0))
    return once(strengths, lambda s: once(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), lambda t: f(s, t)))


def normalised(strengths: Column) -> Column:
    """Strengths over their sum; all zero where hardly anything fires."""
    return _with_total(strengths, lambda s, t: F.transform(s, lambda x: F.when(t <= ZERO_FIRING, 0.0).otherwise(x / t)))


ORDERS = {"0th": 0, "1st": 1, "2nd": 2, "3rd": 3, "full-2nd": 2}


def basis(x: Column, order: int, kind: str = "raw") -> list[Column]:
    """Consequent terms of a feature up to an order, as powers or Legendre polynomials."""
    if kind == "raw":
        return [F.pow(x, F.lit(k)) if k > 1 else x for k in range(1, order + 1)]
    forms = [x, (3 * x * x - 1) / 2, (5 * x * x * x - 3 * x) / 2]
    return forms[:order]


def consequent_terms(features: list[str], order: str = "2nd", kind: str = "raw", pairs: list[tuple[str, str]] | None = None, centres: list[list[float]] | None = None, gamma: float = 1.0, radius: float | None = None) -> list[Column]:
    """The terms that a rule's value is linear in, beside its constant.

    Orders 0th to 3rd take powers of each feature one order after another,
    full-2nd the second order and the products of `pairs` (all by default).
    Kind `rbf` takes exp(-gamma distance^2) to each centre, 0 beyond `radius`.
    """
    x = [F.col(f).cast("double") for f in features]
    if kind == "rbf":
        d2 = [sum(((v - c) * (v - c) for v, c in zip(x[1:], centre[1:], strict=True)), (x[0] - centre[0]) * (x[0] - centre[0])) for centre in centres or []]
        return [F.exp(-gamma * d) if radius is None else F.when(d <= radius * radius, F.exp(-gamma * d)).otherwise(0.0) for d in d2]
    by_order = [basis(v, ORDERS[order], kind) for v in x]
    out = [terms[k] for k in range(ORDERS[order]) for terms in by_order]
    if order == "full-2nd":
        chosen = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]] if pairs is None else pairs
        out += [F.col(a).cast("double") * F.col(b) for a, b in chosen]
    return out


def rule_values(means: list[float], corrections: list[list[float]], terms: list[Column]) -> list[Column]:
    """Each rule's value: its mean and the terms times its corrections."""
    return [sum((t * float(c) for t, c in zip(terms, own, strict=True)), F.lit(float(m))) for m, own in zip(means, corrections, strict=True)]


def midpoints(lower: Column, upper: Column) -> Column:
    """Type-reduced strength of each rule: the middle of its interval."""
    return F.zip_with(lower, upper, lambda a, b: (a + b) / 2)


def tsk_value(weights: Column, values: list[Column]) -> Column:
    """Sum of normalised strength times rule value."""
    return F.aggregate(F.zip_with(weights, F.array(*values), lambda w, v: w * v), F.lit(0.0), lambda a, x: a + x)


def fast_interval(lower: Column, upper: Column, values: list[Column]) -> tuple[Column, Column]:
    """Ends of a type-2 prediction without a switch-point search."""
    a, b = tsk_value(normalised(lower), values), tsk_value(normalised(upper), values)
    return F.least(a, b), F.greatest(a, b)


def karnik_mendel(values: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact ends of the centroid interval for rows x rules, by trying every switch point at once."""
    order = np.argsort(values, axis=1, kind="stable")
    y, lo, hi = (np.take_along_axis(x, order, axis=1) for x in (values, lower, upper))
    pad = lambda x: np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
    a, b, c, d = pad(hi), pad(lo), pad(hi * y), pad(lo * y)
    rest = lambda x: x[:, -1:] - x
    with np.errstate(divide="ignore", invalid="ignore"):
        left = (c + rest(d)) / (a + rest(b))
        right = (d + rest(c)) / (b + rest(a))
    silent = hi.sum(axis=1) <= ZERO_FIRING
    ends = np.where(np.isfinite(left), left, np.inf).min(axis=1), np.where(np.isfinite(right), right, -np.inf).max(axis=1)
    return np.where(silent, 0.0, ends[0]), np.where(silent, 0.0, ends[1])


def km_interval(df: DataFrame, key: list[str], values: str, lower: str, upper: str) -> DataFrame:
    """The key columns with y_l and y_r of three array columns of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, lo, hi = (np.stack(b.column(len(key) + i).to_numpy(zero_copy_only=False)).astype(float) for i in range(3))
            left, right = karnik_mendel(y, lo, hi)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(left), pa.array(right)], names=[*key, "y_l", "y_r"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, values, lower, upper).mapInArrow(run, f"{schema}, y_l double, y_r double")


def alpha_levels(n: int) -> list[float]:
    return [(k + 1) / n for k in range(n)]


def combine_planes(planes: list[tuple[float, Column]]) -> Column:
    """Mean of the planes' values, weighted by their alpha."""
    return sum((v * a for a, v in planes[1:]), planes[0][1] * planes[0][0]) / sum(a for a, _ in planes)


def log_evidence(model: Model, log_prior: dict[str, float], floor: dict[str, float]) -> Column:
    """Array in label order: log prior plus the log of each feature's mean density over its Gaussians.

    With one Gaussian a cell this is naive Bayes.
    """
    out = []
    for x in model.labels:
        total = F.lit(log_prior[x])
        for f in model.features:
            parts = []
            for m, s in model.cells[f, x]:
                var = s * s + floor.get(f, 0.0)
                parts.append(-F.pow(F.col(f) - m, 2) / (2 * var) - 0.5 * float(np.log(2 * np.pi * var)))
            top = F.greatest(*parts) if len(parts) > 1 else parts[0]
            total = total + (top if len(parts) == 1 else top + F.log(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top)) / len(parts)))
        out.append(total)
    return F.array(*out)


def softmax(scores: Column) -> Column:
    once = lambda x, g: F.get(F.transform(F.array(x), g), F.lit(0))
    raised = once(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return _with_total(raised, lambda e, t: F.transform(e, lambda x: x / t))


def surprisal(memberships: list[Column], trim: int = 0) -> Column:
    """Sum of -log membership, without the `trim` largest terms."""
    terms = F.sort_array(F.array(*[-F.log(F.greatest(F.least(m, F.lit(1.0)), F.lit(2.2250738585072014e-308))) for m in memberships]))
    return F.aggregate(F.slice(terms, 1, len(memberships) - trim), F.lit(0.0), lambda a, x: a + x)
