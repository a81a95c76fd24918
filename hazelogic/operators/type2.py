"""Type-2 models: bounds of every membership, firing by alpha plane, intervals, and estimators.

A type-2 model is a type-1 model with an upper and a lower bound, and for
general type-2 a secondary grade that narrows both towards the principal model
plane by plane. All planes of a row are one projection, so a table is read
once; ends of intervals come from one Arrow pass over those arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from hazelogic.operators import evaluate, fit, infer, tsk
from hazelogic.operators.infer import Model


@dataclass(frozen=True)
class Type2:
    """Bounds of a model; `principal` makes it general type-2."""

    upper: Model
    lower: Model
    principal: Model | None = None

    @classmethod
    def of(cls, model: Model, width: float | dict[tuple[str, str], list[float]], general: bool = False) -> Type2:
        """Every membership widened by `width`, or each by its own of a dict like the model's cells."""
        own = lambda k, i: width if not isinstance(width, dict) else width[k][i]
        both = {k: [p.widened(own(k, i)) for i, p in enumerate(v)] for k, v in model.shapes().items()}
        return cls(Model({k: [b.upper for b in v] for k, v in both.items()}), Model({k: [b.lower for b in v] for k, v in both.items()}), Model(model.shapes()) if general else None)

    @property
    def labels(self) -> list[str]:
        return self.upper.labels

    def plane(self, alpha: float) -> Type2:
        """The interval model at level alpha."""
        if self.principal is None:
            raise ValueError("an interval type-2 model has no planes")
        cut = lambda side: Model({k: [p.towards(q, alpha) for p, q in zip(v, self.principal.cells[k], strict=True)] for k, v in side.cells.items()})
        return Type2(cut(self.upper), cut(self.lower))


def it2_firing(model: Type2, t_norm: str = "probability") -> tuple[Column, Column, Column]:
    """Arrays of upper, lower and type-reduced strengths in label order."""
    upper, lower = infer.firing(model.upper, t_norm), infer.firing(model.lower, t_norm)
    return upper, lower, infer.midpoints(lower, upper)


def gt2_rule_firing(model: Type2, planes: int = 5, t_norm: str = "probability") -> list[tuple[float, Column, Column]]:
    """alpha, upper and lower strengths of each plane."""
    return [(a, *it2_firing(model.plane(a), t_norm)[:2]) for a in infer.alpha_levels(planes)]


def gt2_firing(model: Type2, planes: int = 5, t_norm: str = "probability") -> Column:
    """Crisp strengths in label order: the planes' type-reduced ones, weighted by alpha."""
    levels = infer.alpha_levels(planes)
    scaled = lambda c, a: F.transform(c, lambda x: x * a)
    parts = [scaled(it2_firing(model.plane(a), t_norm)[2], a / sum(levels)) for a in levels]
    total = parts[0]
    for p in parts[1:]:  # every plane is worked out once
        total = F.zip_with(total, p, lambda x, y: x + y)
    return total


def intervals(df: DataFrame, key: list[str], values: list[Column], firing: list[tuple[float, Column, Column]]) -> DataFrame:
    """The key columns with y_l and y_r: each plane's centroid interval, weighted by alpha.

    An interval type-2 model is one plane. The key may be any columns.
    """
    rows = df.select(*key, F.array(*values).alias("v"), F.array(*[u for _, u, _ in firing]).alias("u"), F.array(*[low for _, _, low in firing]).alias("l"))
    alphas = np.array([a for a, _, _ in firing])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat = lambda c, depth: np.asarray((c.flatten() if depth == 1 else c.flatten().flatten()).to_numpy(zero_copy_only=False), float)
            y = flat(b.column(len(key)), 1).reshape(n, -1)
            up, low = (flat(b.column(len(key) + 1 + i), 2).reshape(n, len(alphas), -1) for i in (0, 1))
            ends = [infer.karnik_mendel(y, low[:, k], up[:, k]) for k in range(len(alphas))]
            left, right = (sum(a * e[i] for a, e in zip(alphas, ends, strict=True)) / alphas.sum() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(left), pa.array(right)], names=[*key, "y_l", "y_r"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInArrow(run, f"{schema}, y_l double, y_r double")


# ------------------------------------------------------------ estimators


@dataclass
class Type2Classifier:
    """A type-1 fit, widened; `planes` above 0 makes it general type-2."""

    features: list[str]
    label: str
    width: float = 0.2
    planes: int = 0
    t_norm: str = "probability"
    model: Type2 | None = field(default=None, repr=False)

    def fit(self, df: DataFrame, model: Model | None = None) -> Type2Classifier:
        """From the type-1 `model`, or one Gaussian a feature and label of `df`; null labels take no part."""
        fits = model or Model.of(fit.normal_fit(df.where(F.col(self.label).isNotNull()), self.features, self.label), self.label)
        self.model = Type2.of(fits, self.width, self.planes > 0)
        return self

    def strengths(self) -> Column:
        return gt2_firing(self.model, self.planes, self.t_norm) if self.planes else it2_firing(self.model, self.t_norm)[2]

    def probabilities(self) -> Column:
        return infer.probabilities(self.strengths(), len(self.model.labels))

    def predict(self) -> Column:
        return infer.classify(self.strengths(), self.model.labels)


@dataclass
class Type2Regressor:
    """A TSK regressor whose antecedents are widened after the fit; predicts values and intervals.

    With `calibrate` a share of the rows, chosen by a hash of `key`, is held
    out and a margin taken from them that covers 1 - `alpha`.
    """

    features: list[str]
    target: str
    key: list[str]
    width: float = 0.2
    planes: int = 0
    buckets: int = 4
    order: str = "1st"
    l2: float = 1e-6
    calibrate: float = 0.0
    alpha: float = 0.1
    base: tsk.TskRegressor | None = field(default=None, repr=False)
    model: Type2 | None = field(default=None, repr=False)
    margin: float = 0.0

    def fit(self, df: DataFrame) -> Type2Regressor:
        held = F.pmod(F.xxhash64(*self.key), F.lit(1000)) < self.calibrate * 1000
        rows = df.where(~held) if self.calibrate else df
        self.base = tsk.TskRegressor(self.features, self.target, self.buckets, self.order, self.l2).fit(rows)
        self.model = Type2.of(self.base.model, self.width, self.planes > 0)
        if self.calibrate:
            own = self._ends(df.where(held & F.col(self.target).isNotNull()), [*self.key, self.target])
            found = evaluate.conformal_margin(own, F.col(self.target), F.col("y_l"), F.col("y_r"), self.alpha).first()
            self.margin = (found[0] or 0.0) if found else 0.0
        return self

    def _firing(self) -> list[tuple[float, Column, Column]]:
        return gt2_rule_firing(self.model, self.planes) if self.planes else [(1.0, *it2_firing(self.model)[:2])]

    def _ends(self, df: DataFrame, key: list[str]) -> DataFrame:
        return intervals(df, key, self.base.values(), self._firing())

    def intervals(self, df: DataFrame) -> DataFrame:
        """The key with y_l, y_r (moved out by the margin) and their middle y."""
        ends = self._ends(df, self.key)
        return ends.select(*self.key, (F.col("y_l") - self.margin).alias("y_l"), (F.col("y_r") + self.margin).alias("y_r"), ((F.col("y_l") + F.col("y_r")) / 2).alias("y"))

    def predict_fast(self) -> Column:
        """The middle of the interval that needs no switch points, as a Column."""
        out = [(a, infer.fast_interval(low, up, self.base.values())) for a, up, low in self._firing()]
        return infer.combine_planes([(a, (x + y) / 2) for a, (x, y) in out])


def widths_like(model: Model, vector: np.ndarray) -> dict[tuple[str, str], list[float]]:
    """Widths of a vector by cell, in the order of sorted cells."""
    it = iter(map(float, vector))
    return {k: [next(it) for _ in model.cells[k]] for k in sorted(model.cells)}


