"""Estimators made of others: bags of classifiers, few-shot logistic scores, trees with fit and predict, several outputs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.operators import infer, rulebase, scaling, trees

#: Draws of a member that lacks a label before it is taken as it is.
TRIES = 5


# ------------------------------------------------------------ bagging


def poisson_weight(key: list[str], *salt: Column, most: int = 8) -> Column:
    """How often a bootstrap takes a row: Poisson of mean 1, a function of key and salt alone.

    A bootstrap of n rows in n draws tends to it as n grows, and no row needs
    to know of another; `most` cuts what happens once in a million rows.
    """
    u = F.pmod(F.xxhash64(*salt, *key), F.lit(2**52)) / float(2**52)
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    return sum(((u >= float(s)).cast("int") for s in shares[1:]), (u >= float(shares[0])).cast("int"))


def _weighted_fits(df: DataFrame, features: list[str], label: str, key: list[str], draws: dict[int, int], seed: int, centre: dict[str, float]) -> list:
    """`member, label` and for each feature the weight, sum and sum of squares about `centre`; one shuffle for all members."""
    member = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in draws.items()]))
    rows = df.where(F.col(label).isNotNull()).select("*", member.alias("__b"))
    rows = rows.withColumn("__w", poisson_weight(key, F.lit(seed), F.col("__b.m"), F.col("__b.t"))).where("__w > 0")
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double") - centre[f]
        w = F.when(x.isNotNull() & ~F.isnan(x), F.col("__w"))
        aggs += [F.sum(w).alias(f"n{i}"), F.sum(w * x).alias(f"s{i}"), F.sum(w * x * x).alias(f"q{i}")]
    return rows.groupBy(F.col("__b.m").alias("m"), F.col(label).alias("label")).agg(*aggs).collect()  # members x labels


def bag(df: DataFrame, features: list[str], label: str, key: list[str], members: int = 10, columns: float = 1.0, seed: int = 42) -> list[infer.Model]:
    """`members` Gaussian classifiers, each of its own bootstrap of rows and its own share of the features.

    `key` names the columns that tell rows apart; reruns agree. A member that
    misses a label is drawn again, `TRIES` times at most. Rows of null label
    and null or NaN values take no part; without labelled rows there are no
    members.
    """
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().limit(infer.MAX_MODEL + 1).collect())
    if len(labels) * len(features) > infer.MAX_MODEL:
        raise ValueError(f"a model has at most {infer.MAX_MODEL} memberships")
    if not labels:
        return []
    means = df.agg(*[F.avg(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))).alias(f"m{i}") for i, f in enumerate(features)]).first()
    centre = {f: m or 0.0 for f, m in zip(features, means, strict=True)}
    rng, n = np.random.default_rng(seed), max(1, round(columns * len(features)))
    own = [sorted(rng.choice(len(features), n, replace=False).tolist()) for _ in range(members)]
    found: dict[int, dict] = {}
    draws = dict.fromkeys(range(members), 0)
    while draws:
        got: dict[int, dict] = {m: {} for m in draws}
        for r in _weighted_fits(df, features, label, key, draws, seed, centre):
            got[r.m][r.label] = r
        found |= got
        draws = {m: t + 1 for m, t in draws.items() if len(got[m]) < len(labels) and t < TRIES}
    out = []
    for m in range(members):
        cells = {}
        for x, r in found[m].items():
            for i in own[m]:
                if weight := r[f"n{i}"]:
                    mean = r[f"s{i}"] / weight
                    cells[features[i], x] = [(centre[features[i]] + mean, max(math.sqrt(max(r[f"q{i}"] / weight - mean * mean, 0.0)), 1e-6))]
        out.append(infer.Model(cells))
    return out


def bag_probabilities(models: list[infer.Model], labels: list, family: str = "probability") -> Column:
    """Mean probabilities of the members over `labels`; a member gives 0 to a label it never saw."""
    each = []
    for m in models:
        p = infer.probabilities(infer.firing(m, family), len(m.labels))
        each.append(F.array(*[F.get(p, F.lit(m.labels.index(x))) if x in m.labels else F.lit(0.0) for x in labels]))
    return rulebase.soft_vote(each, len(labels))


# ------------------------------------------------------------ few-shot logistic


def few_shot(df: DataFrame, features: list[str], positive: Column, c: float = 1.0) -> Column:
    """The score (0 to 1) of a balanced L2 logistic model on whitened features.

    Whitening is the shrunk covariance of all rows. Each class weighs half in
    all; the penalty is |w|^2 / 2 against `c` times the summed loss. Rows of
    null `positive` or a null or NaN feature don't train. With one class only
    there is nothing to separate, which is refused.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = [F.col(f).cast("double") for f in features]
    sound = df.where(positive.isNotNull())
    for v in x:
        sound = sound.where(v.isNotNull() & ~F.isnan(v))
    mean, matrix, _ = scaling.shrunk_whitening(sound, features)
    z = F.array(*scaling.whitened(features, mean, matrix))
    n, k = sound.agg(F.count("*"), F.coalesce(F.sum(positive.cast("long")), F.lit(0))).first()
    if not 0 < k < n:
        raise ValueError("few-shot scores need rows of both classes")
    weight = F.when(positive, n / (2 * k)).otherwise(n / (2 * (n - k)))
    rows = sound.select(array_to_vector(z).alias("z"), positive.cast("double").alias("y"), weight.alias("w"))
    got = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1.0 / (c * n), standardization=False, maxIter=200, tol=1e-9).fit(rows)
    terms = [F.get(z, F.lit(i)) * float(w) for i, w in enumerate(got.coefficients)]
    return 1 / (1 + F.exp(-sum(terms, F.lit(float(got.intercept)))))


# ------------------------------------------------------------ estimators


@dataclass
class TreeRegressor:
    """A soft regression tree; `alpha` above 0 prunes it. Further options are those of `trees.grow`."""

    features: list[str]
    target: str
    alpha: float = 0.0
    options: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> TreeRegressor:
        tree = trees.grow(df, self.features, self.target, **self.options)
        self.tree_ = trees.prune(tree, self.alpha) if self.alpha > 0 else tree
        self.values_ = trees.leaf_values(df, self.tree_, self.target)
        return self

    def predict(self) -> Column:
        return trees.predict(self.tree_, self.values_)


@dataclass
class TreeClassifier:
    """A soft classification tree; labels in order."""

    features: list[str]
    target: str
    criterion: str = "ambiguity"
    options: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> TreeClassifier:
        rows = df.where(F.col(self.target).isNotNull())
        self.labels_ = sorted(r[0] for r in rows.select(self.target).distinct().limit(infer.MAX_MODEL + 1).collect())
        if len(self.labels_) > infer.MAX_MODEL:
            raise ValueError(f"a tree takes at most {infer.MAX_MODEL} labels")
        self.tree_ = trees.grow(rows, self.features, self.target, self.criterion, **self.options)
        self.shares_ = trees.leaf_classes(rows, self.tree_, self.target, self.labels_)
        return self

    def predict_proba(self) -> Column:
        return trees.predict_proba(self.tree_, self.shares_)

    def predict(self) -> Column:
        return infer.classify(self.predict_proba(), self.labels_)


@dataclass
class MultiOutput:
    """One regressor for each output; `make(target)` gives one with fit and predict."""

    make: Callable[[str], object]
    targets: list[str]

    def fit(self, df: DataFrame) -> MultiOutput:
        self.models_ = {t: self.make(t).fit(df) for t in self.targets}
        return self

    def predict(self) -> list[Column]:
        """A column for each output, named as it is."""
        return [m.predict().alias(t) for t, m in self.models_.items()]
