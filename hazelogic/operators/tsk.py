"""TSK regression: rules by output bucket, consequents solved in closed form.

For fixed firing strengths the prediction is linear in each rule's mean and
corrections. The design of a row is its normalised strengths times [1, terms];
its Gram matrix is summed in the tasks and by position between them, so one
pass solves all coefficients whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.operators import features as scoring
from hazelogic.operators import fit, infer
from hazelogic.operators.infer import Model
from hazelogic.operators.partial import at_places


def design(strengths: Column, terms: list[Column]) -> Column:
    """The row's design as one array: for each rule its normalised strength times [1, terms]."""
    phi = F.array(F.lit(1.0), *terms)
    return F.flatten(F.transform(infer.normalised(strengths), lambda w: F.transform(phi, lambda p: w * p)))


def blend_weights(strengths: Column, n: int) -> Column:
    """Normalised strengths, all alike where hardly any rule fires."""
    return F.when(F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x) <= infer.ZERO_FIRING, F.array_repeat(F.lit(1.0 / n), n)).otherwise(infer.normalised(strengths))


def optimise(df: DataFrame, strengths: Column, terms: list[Column], y: Column, n: int, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Means and corrections of least squared error and ridge where silent rows blend all rules alike.

    The objective is convex in the coefficients, so one solve reaches what an
    iterative search would tend to.
    """
    phi = F.array(F.lit(1.0), *terms)
    x = F.flatten(F.transform(blend_weights(strengths, n), lambda w: F.transform(phi, lambda p: w * p)))
    xx, xy, _ = gram(df, x, y)
    return solve(xx, xy, n, l2)


def gram(df: DataFrame, x: Column, y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X, X'y and y'y of an array column and a target; rows with a null or NaN take no part.

    Tasks send their sums by position once; the driver gets one number for each.
    """
    rows = df.select(x.alias("x"), y.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("w").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                v = np.column_stack([np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1), b.column(1).to_numpy()])
                total = total + (v * b.column(2).to_numpy()[:, None]).T @ v
        if not np.isscalar(total):
            yield at_places(total)

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    if not got.num_rows:
        raise ValueError("no row to solve from")
    g = np.zeros(got.num_rows)
    g[got.column("i").to_numpy()] = got.column("v").to_numpy()
    g = g.reshape(int(round(got.num_rows**0.5)), -1)
    return g[:-1, :-1], g[:-1, -1], float(g[-1, -1])


def solve(xx: np.ndarray, xy: np.ndarray, rules: int, l2: float = 1e-6, pinned: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and corrections (rules x terms) of the ridge minimum; constants aren't penalised.

    `pinned` holds given rules' means exactly: their share moves to the right
    side and the rest is solved for what remains.
    """
    block = len(xx) // rules
    penalty = np.full(len(xx), l2)
    penalty[::block] = 0.0
    fixed = {r * block: v for r, v in (pinned or {}).items() if np.isfinite(v)}
    free = np.array([i for i in range(len(xx)) if i not in fixed], int)
    beta = np.zeros(len(xx))
    for i, v in fixed.items():
        beta[i] = v
    right = (xy - xx @ beta)[free]
    beta[free] = np.linalg.lstsq(xx[np.ix_(free, free)] + np.diag(penalty[free]), right, rcond=None)[0]
    coefficients = beta.reshape(rules, block)
    return coefficients[:, 0], coefficients[:, 1:]


@dataclass
class TskRegressor:
    """Buckets of the target, Gaussians by feature and bucket, consequents by ridge.

    `pin` holds the first and last rule's mean at the least and greatest bucket
    mean. `predict` and `values` are Columns over the features.
    """

    features: list[str]
    target: str
    buckets: int = 4
    order: str = "1st"
    l2: float = 1e-6
    pin: bool = False
    kind: str = "raw"
    method: str = "uniform"
    t_norm: str = "probability"
    model: Model | None = field(default=None, repr=False)
    means: np.ndarray | None = field(default=None, repr=False)
    corrections: np.ndarray | None = field(default=None, repr=False)

    def terms(self) -> list[Column]:
        return infer.consequent_terms(self.features, self.order, self.kind)

    def fit(self, df: DataFrame, model: Model | None = None) -> TskRegressor:
        """Rows of null target take no part; a bucket without rows makes no rule."""
        rows = df.where(F.col(self.target).isNotNull() & ~F.isnan(F.col(self.target).cast("double")))
        cut, centres = scoring.output_partition(rows, self.target, self.buckets, self.method)
        cut = cut.withColumn("__rule", F.lpad(F.col("bucket").cast("string"), 6, "0"))
        self.model = model or Model.of(fit.normal_fit(cut, self.features, "__rule"), "__rule")
        return self.resolve(rows, centres)

    def resolve(self, df: DataFrame, centres: list[float] | None = None) -> TskRegressor:
        """Consequents for the present antecedents."""
        n = len(self.model.labels)
        xx, xy, _ = gram(df, design(infer.firing(self.model, self.t_norm), self.terms()), F.col(self.target))
        ends = {}
        if self.pin and centres and n > 1:
            ends = {k: centres[int(self.model.labels[k])] for k in (0, n - 1) if self.model.labels[k].isdigit() and int(self.model.labels[k]) < len(centres)}
        self.means, self.corrections = solve(xx, xy, n, self.l2, ends)
        return self

    def values(self) -> list[Column]:
        return infer.rule_values(list(self.means), [list(c) for c in self.corrections], self.terms())

    def predict(self) -> Column:
        return infer.tsk_value(infer.normalised(infer.firing(self.model, self.t_norm)), self.values())
