"""Experts: linear models behind the leaves of a soft tree, and binary experts behind a classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.operators import fit, infer, refine, rulebase, trees, tsk
from hazelogic.operators.infer import Model
from hazelogic.operators.partial import PLACES, at_places, sum_places

#: A leaf's expert learns from rows whose share in the leaf is at least this.
LEAST_SHARE = 0.2


def leaf_shares(tree: trees.Node, family: str = "probability") -> Column:
    """Array over leaves of firing over its sum; uniform where no leaf fires."""
    n = len(tree.leaves())
    return infer.probabilities(trees.leaf_firing(tree, family), n)


@dataclass
class TreeExperts:
    """A soft tree grown on the target, with a ridge model of its own behind every leaf.

    A leaf learns from rows whose share in it is at least `LEAST_SHARE`, or is
    the largest of the row, weighted by that share; a leaf of fewer than
    `least_rows` such rows predicts their mean, or the mean of all.
    """

    features: list[str]
    target: str
    order: str = "1st"
    l2: float = 1e-6
    least_rows: int = 10
    options: dict = field(default_factory=dict)
    tree: trees.Node | None = field(default=None, repr=False)
    beta: np.ndarray | None = field(default=None, repr=False)

    def terms(self) -> list[Column]:
        return infer.consequent_terms(self.features, self.order)

    def fit(self, df: DataFrame) -> TreeExperts:
        """One pass for all leaves after the tree is grown; rows with nulls or NaNs take no part."""
        self.tree = trees.grow(df, self.features, self.target, **self.options)
        n = len(self.tree.leaves())
        rows = df.select(leaf_shares(self.tree).alias("r"), F.array(F.lit(1.0), *self.terms(), F.col(self.target).cast("double")).alias("v"))
        rows = rows.where(~F.exists("v", lambda v: v.isNull() | F.isnan(v)))
        p = len(self.terms()) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, (p + 1) ** 2 + 1))
            for b in batches:
                if b.num_rows:
                    r, v = (np.asarray(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (0, 1))
                    w = np.where((r >= LEAST_SHARE) | (r == r.max(axis=1, keepdims=True)), r, 0.0)
                    total[:, :-1] += np.einsum("nk,ni,nj->kij", w, v, v).reshape(n, -1)
                    total[:, -1] += (w > 0).sum(axis=0)
            yield at_places(total)

        flat = sum_places(rows.mapInArrow(run, PLACES), n * ((p + 1) ** 2 + 1)).reshape(n, -1)
        all_mass, all_y = flat[:, 0].sum(), flat[:, p].sum()
        self.beta = np.zeros((n, p))
        for k in range(n):
            g = flat[k, :-1].reshape(p + 1, p + 1)
            if flat[k, -1] >= self.least_rows:
                means, more = tsk.solve(g[:p, :p], g[:p, p], 1, self.l2)
                self.beta[k] = np.append(means, more)
            else:
                self.beta[k, 0] = g[0, p] / g[0, 0] if g[0, 0] > 0 else all_y / all_mass if all_mass > 0 else 0.0
        return self

    def predict(self) -> Column:
        values = infer.rule_values(list(self.beta[:, 0]), [list(b[1:]) for b in self.beta], self.terms())
        return trees.blend(leaf_shares(self.tree), values)


# ------------------------------------------------------------ cascades


@dataclass
class Cascade:
    """A classifier with binary experts for the pairs of labels it confuses most.

    Confusions are counted out of fold; every expert is a model of two labels
    that may move rows from the one to the other where it prefers that by a
    margin, chosen so that training rows gain and never lose.
    """

    features: list[str]
    label: str
    key: list[str]
    folds: int = 3
    pairs: int = 2
    model: Model | None = field(default=None, repr=False)
    experts: list[tuple[str, str, Model, float]] = field(default_factory=list, repr=False)

    def _model(self, df: DataFrame) -> Model:
        return Model.of(fit.normal_fit(df, self.features, self.label), self.label)

    def confusions(self, df: DataFrame) -> list[tuple[str, str, int]]:
        """(predicted, true, rows) of wrong out-of-fold predictions, most first; folds by a hash of the key."""
        fold = F.pmod(F.xxhash64(*self.key), F.lit(self.folds))
        models = [self._model(df.where(fold != k)) for k in range(self.folds)]
        p = F.coalesce(*[F.when(fold == k, infer.classify(infer.firing(m), m.labels)) for k, m in enumerate(models)])
        wrong = df.select(p.alias("p"), F.col(self.label).alias("t")).where("p <> t").groupBy("p", "t").count()
        return [(r.p, r.t, r["count"]) for r in sorted(wrong.collect(), key=lambda r: (-r["count"], r.p, r.t))]  # labels squared at most

    def fit(self, df: DataFrame) -> Cascade:
        rows = df.where(F.col(self.label).isNotNull())
        self.model, self.experts = self._model(rows), []
        for start, to, _ in self.confusions(rows)[: self.pairs]:
            own = self._model(rows.where(F.col(self.label).isin(start, to)))
            now = rows.withColumn("__now", self.predict())
            here = now.where(F.col("__now") == start)
            gain = F.when(F.col(self.label) == to, 1).when(F.col(self.label) == start, -1).otherwise(0)
            best = rulebase.best_threshold(here, self._doubt(own, to), gain).first()
            if best and best.net > 0:
                self.experts.append((start, to, own, best.threshold))
        return self

    @staticmethod
    def _doubt(own: Model, to: str) -> Column:
        """1 less the expert's probability of the label it moves to."""
        return 1 - F.get(infer.probabilities(infer.firing(own), len(own.labels)), F.lit(own.labels.index(to)))

    def predict(self) -> Column:
        base = infer.classify(infer.firing(self.model), self.model.labels)
        # the threshold is the last value moved, so the test includes it
        steps = [(start, to, F.lit(1.0), F.when(self._doubt(own, to) <= t, 0.0).otherwise(1.0), 0.5, 0.5) for start, to, own, t in self.experts]
        return rulebase.cascade(base, steps)


# ------------------------------------------------------------ one-class and plain classifiers


@dataclass
class OneClass:
    """Gaussians of normal rows; a row is an outlier (-1) where its score lies below the offset.

    `score`: surprisal (of the memberships, the `trim` largest terms left out)
    or complement (of their product). The offset is the quantile of
    `contamination` of the training scores, or their least without it.
    """

    features: list[str]
    score: str = "surprisal"
    trim: int = 0
    contamination: float | None = None
    params: dict[str, tuple[float, float]] = field(default_factory=dict)
    offset: float = 0.0

    def fit(self, df: DataFrame) -> OneClass:
        got = df.agg(*[g(F.col(f).cast("double")) for f in self.features for g in (F.avg, F.stddev_pop)]).first()
        self.params = {f: (got[2 * i] or 0.0, max(got[2 * i + 1] or 0.0, 1e-6)) for i, f in enumerate(self.features)}
        scores = df.select(self.score_samples().alias("s"))
        found = [scores.agg(F.min("s")).first()[0]] if self.contamination is None else fit.quantiles(scores, "s", [self.contamination])
        self.offset = found[0] if found and found[0] is not None else 0.0
        return self

    def score_samples(self) -> Column:
        """The anomaly, negated: higher is more normal."""
        from hazelogic.functions import membership

        m = [membership.gaussian(F.col(f).cast("double"), *self.params[f]) for f in self.features]
        if self.score == "surprisal":
            return -infer.surprisal(m, self.trim)
        if self.score != "complement":
            raise ValueError(f"unknown score: {self.score}")
        product = F.lit(1.0)
        for v in m:
            product = product * v
        return product - 1

    def predict(self) -> Column:
        return F.when(self.score_samples() < self.offset, -1).otherwise(1)


@dataclass
class FuzzyClassifier:
    """Gaussian memberships by feature and label; optionally refined, or calibrated to log-evidence."""

    features: list[str]
    label: str
    t_norm: str = "probability"
    refine_with: str | None = None
    calibrated: bool = False
    model: Model | None = field(default=None, repr=False)
    prior: dict[str, float] = field(default_factory=dict, repr=False)
    floor: dict[str, float] = field(default_factory=dict, repr=False)

    def fit(self, df: DataFrame, **options) -> FuzzyClassifier:
        rows = df.where(F.col(self.label).isNotNull())
        self.model = Model.of(fit.normal_fit(rows, self.features, self.label), self.label)
        if self.calibrated:
            self.prior = {r[self.label]: r.log_prior for r in fit.class_prior(rows, self.label).collect()}
            self.floor = {r.feature: r.floor for r in fit.variance_floor(rows, self.features).collect()}
        elif self.refine_with:
            self.model, _ = refine.refine_classifier(rows, self.model, self.label, self.refine_with, **options)
        return self

    def probabilities(self) -> Column:
        if self.calibrated:
            return infer.softmax(infer.log_evidence(self.model, self.prior, self.floor))
        return infer.probabilities(infer.firing(self.model, self.t_norm), len(self.model.labels))

    def predict(self) -> Column:
        return infer.classify(self.probabilities(), self.model.labels)
