"""Distances between label distributions of a feature, and lift of feature products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazelogic.operators import fit
from hazelogic.operators.features import jensen_shannon

#: Points of the grid that densities are compared on.
GRID = 100


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def grid_shares(mu: Column, sigma: Column, lo: Column, hi: Column) -> Column:
    """A normal density on an even grid over [lo, hi], scaled to sum to 1."""
    at = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: lo + (hi - lo) * k / (GRID - 1))
    dens = F.transform(at, lambda x: F.exp(-0.5 * F.pow((x - mu) / sigma, 2.0)))
    total = _total(dens)
    return F.transform(dens, lambda d: d / total)


def label_wasserstein(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """`feature, a, b, distance` for each pair of labels: the area between their distribution functions.

    One shuffle counts values by feature and label. Running sums go over blocks
    of distinct values, so no feature is one task's window: counts of earlier
    blocks are added from a table of blocks.
    """
    names = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(101).collect())
    if len(names) > 100:
        raise ValueError("pairs of at most 100 labels")
    counts = fit.melt(df, features, label).groupBy("feature", "value").agg(*[F.count(F.when(F.col(label) == x, 1)).alias(f"n{i}") for i, x in enumerate(names)])
    ends = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    block = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256)).otherwise(0)
    cells = counts.join(ends, "feature").withColumn("block", block)  # one row a feature
    own, ns = Window.partitionBy("feature", "block").orderBy("value"), [f"n{i}" for i in range(len(names))]
    blocks = cells.groupBy("feature", "block").agg(F.min("value").alias("first"), *[F.sum(n).alias(n) for n in ns])
    before = Window.partitionBy("feature").orderBy("block")  # at most 257 rows a feature
    base = blocks.select("feature", "block", F.lead("first").over(before).alias("ahead"), *[(F.sum(n).over(before) - F.col(n)).alias(f"b_{n}") for n in ns], *[F.sum(n).over(Window.partitionBy("feature")).alias(f"t_{n}") for n in ns])
    run = cells.select("feature", "block", "value", F.lead("value").over(own).alias("next"), *[F.sum(n).over(own).alias(n) for n in ns]).join(base, ["feature", "block"])
    cdf = {n: (F.col(n) + F.col(f"b_{n}")) / F.nullif(F.col(f"t_{n}"), F.lit(0)) for n in ns}
    dx = F.coalesce("next", "ahead") - F.col("value")
    pairs = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), (F.abs(cdf[f"n{i}"] - cdf[f"n{j}"]) * dx).alias("d")) for i, j in itertools.combinations(range(len(names)), 2)]
    if not pairs:
        return run.select("feature", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("distance")).where("false")
    return run.select("feature", F.explode(F.array(*pairs)).alias("p")).groupBy("feature", "p.a", "p.b").agg(F.coalesce(F.sum("p.d"), F.lit(0.0)).alias("distance"))


def pair_distances(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """`feature, a, b` with bhattacharyya, wasserstein, jensen_shannon, overlap and composite.

    The composite is the mean of the arithmetic and the geometric mean of the
    four, Wasserstein distances in pooled deviations squashed by w / (1 + w).
    """
    fits = fit.normal_fit(df, features, label)
    ends = fit.melt(df, features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    shares = fits.join(ends, "feature").select("feature", label, "sigma", grid_shares(F.col("mu"), F.col("sigma"), F.col("lo"), F.col("hi")).alias("p"))
    a = shares.select("feature", F.col(label).alias("a"), F.col("p").alias("pa"), F.col("sigma").alias("sa"))
    b = shares.select("feature", F.col(label).alias("b"), F.col("p").alias("pb"), F.col("sigma").alias("sb"))
    pairs = a.join(b, "feature").where("a < b").join(label_wasserstein(df, features, label), ["feature", "a", "b"])
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
    pairs = pairs.select(
        "feature", "a", "b",
        (1 - _total(F.zip_with("pa", "pb", lambda x, y: F.sqrt(x * y)))).alias("bhattacharyya"),
        F.when(pooled > 1e-10, F.col("distance") / pooled).otherwise(F.col("distance")).alias("wasserstein"),
        jensen_shannon(F.col("pa"), F.col("pb")).alias("jensen_shannon"),
        (1 - _total(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)))).alias("overlap"),
    )
    four = [F.greatest(F.col("bhattacharyya"), F.lit(0.0)), F.col("jensen_shannon"), F.greatest(F.col("overlap"), F.lit(0.0)), F.col("wasserstein") / (1 + F.col("wasserstein"))]
    mean, geo = sum(four[1:], four[0]) / 4, F.pow(four[0] * four[1] * four[2] * four[3], 0.25)
    return pairs.withColumn("composite", (mean + geo) / 2)


def interaction_lift(df: DataFrame, features: list[str], label: str, method: str = "wasserstein", max_pairs: int = 2000) -> DataFrame:
    """`feature_a, feature_b, lift`: separation by the product of two features beyond the better of them.

    All products are scored in the same shuffle. Constant features are left
    out; more than `max_pairs` pairs are refused; positive lifts are scaled so
    that the largest is 1.
    """
    spread = df.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    live = [f for f in features if (spread[f] or 0.0) > 1e-10]
    pairs = list(itertools.combinations(live, 2))
    if len(pairs) > max_pairs:
        raise ValueError(f"{len(pairs)} pairs exceed max_pairs={max_pairs}")
    wide = df.select(label, *[F.col(f).cast("double").alias(f) for f in live], *[(F.col(f).cast("double") * F.col(g)).alias(f"__p{i}") for i, (f, g) in enumerate(pairs)])
    names = [*live, *[f"__p{i}" for i in range(len(pairs))]]
    scores = pair_distances(wide, names, label).groupBy("feature").agg(F.sum(method).alias("s")).collect()  # one row a column
    s = {r.feature: r.s for r in scores}
    lifts = [(f, g, s[f"__p{i}"] - max(s[f], s[g])) for i, (f, g) in enumerate(pairs) if f"__p{i}" in s]
    top = max((x[2] for x in lifts), default=0.0)
    lifts = [(f, g, x / top if top > 0 else x) for f, g, x in sorted(lifts, key=lambda x: (-x[2], x[0], x[1]))]
    return df.sparkSession.createDataFrame(lifts, "feature_a string, feature_b string, lift double")


def top_interactions(lifts: DataFrame, n: int) -> DataFrame:
    """The best pairs of positive lift."""
    return lifts.where("lift > 0").orderBy(F.desc("lift"), "feature_a", "feature_b").limit(n)


def rescued(selected: list[str], interactions: list[tuple[str, str]], ranking: list[str]) -> list[str]:
    """Selected features with those of kept interactions, in ranking order."""
    want = set(selected) | {f for p in interactions for f in p}
    return [f for f in ranking if f in want]


def moments(df: DataFrame, columns: list[Column], target: Column, fold: Column | None = None) -> dict[int, np.ndarray]:
    """Gram matrix of [1, columns, target] for each fold, by one pass of partial sums."""
    rows = df.select((F.lit(0) if fold is None else fold).cast("int").alias("f"), F.array(F.lit(1.0), *[c.cast("double") for c in columns], target.cast("double")).alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    p = len(columns) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                f, v = b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False))
                for k in np.unique(f):
                    x = v[f == k]
                    total[int(k)] = total.get(int(k), 0) + x.T @ x
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p * p, k), pa.int32()), pa.array(np.arange(p * p)), pa.array(t.ravel())], names=["f", "i", "v"])

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "f int, i long, v double").groupBy("f", "i").agg(F.sum("v").alias("v")).collect():  # a number a fold and place
        out.setdefault(r.f, np.zeros(p * p))[r.i] = r.v
    return {k: v.reshape(p, p) for k, v in out.items()}


def lasso_path(gram: np.ndarray, alphas: np.ndarray, sweeps: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate descent on standardised columns from a Gram matrix: (coefficients by alpha, means, deviations)."""
    n = gram[0, 0]
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd[sd < 1e-12] = 1.0
    q, c = (cov / np.outer(sd, sd))[1:-1, 1:-1], cov[1:-1, -1] / sd[1:-1]
    beta, out = np.zeros(len(c)), []
    for alpha in alphas:
        for _ in range(sweeps):
            old = beta.copy()
            for j in range(len(c)):
                rho = c[j] - q[j] @ beta + q[j, j] * beta[j]
                beta[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / q[j, j] if q[j, j] > 1e-12 else 0.0
            if np.abs(beta - old).max(initial=0.0) < tol:
                break
        out.append(beta.copy())
    return np.array(out), mean, sd


def lasso_screen(df: DataFrame, features: list[str], target: str, folds: int = 5, n_alphas: int = 50) -> DataFrame:
    """`feature_a, feature_b, weight` of cross terms that a cross-validated lasso keeps.

    Columns are x, x² and products of standardised features; folds go by a hash
    of the values, and one pass gathers every fold's Gram matrix.
    """
    got = df.agg(*[g(F.col(f).cast("double")) for f in features for g in (F.avg, F.stddev_pop)]).first()
    z = [(F.col(f).cast("double") - (got[2 * i] or 0.0)) / (got[2 * i + 1] or 1.0) for i, f in enumerate(features)]
    cross = list(itertools.combinations(range(len(features)), 2))
    grams = moments(df, [*z, *[x * x for x in z], *[z[i] * z[j] for i, j in cross]], F.col(target), F.pmod(F.xxhash64(*features, target), F.lit(folds)))
    empty = "feature_a string, feature_b string, weight double"
    if not grams:
        return df.sparkSession.createDataFrame([], empty)
    total = sum(grams.values())
    n = total[0, 0]
    mean = total[0] / n
    c = (total / n - np.outer(mean, mean))[1:-1, -1] / np.sqrt(np.maximum(np.diag(total / n - np.outer(mean, mean))[1:-1], 1e-24))
    alphas = np.geomspace(max(np.abs(c).max(initial=0.0), 1e-12), max(np.abs(c).max(initial=0.0), 1e-12) * 1e-3, n_alphas)
    error = np.zeros(n_alphas)
    for g in grams.values():
        if len(grams) == 1 or (total - g)[0, 0] < 2:
            continue
        betas, m, sd = lasso_path(total - g, alphas)
        for k, b in enumerate(betas):
            w = np.concatenate([[-(m[-1] - (b / sd[1:-1]) @ m[1:-1])], -b / sd[1:-1], [1.0]])
            error[k] += w @ g @ w
    best = lasso_path(total, alphas[: int(error.argmin()) + 1])[0][-1]
    kept = best[2 * len(features) :]
    rows = [(features[i], features[j], float(w)) for (i, j), w in zip(cross, kept, strict=True) if abs(w) > 1e-8]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -abs(r[2])), empty)
