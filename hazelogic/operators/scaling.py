"""Scalers and time windows. A scaler is fitted by one aggregate and applied as a projection."""

from __future__ import annotations

import math
from collections.abc import Callable

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Synthetic rows made from one row at a time.
BLOCK = 10_000


def log1p_floor(df: DataFrame, column: str, to: str) -> DataFrame:
    """log1p of what exceeds the minimum."""
    least = df.agg(F.min(column)).first()[0]
    return df.withColumn(to, F.log1p(F.greatest(F.col(column) - F.lit(least), F.lit(0.0))))


def inverse_log1p(x: Column, least: float) -> Column:
    return F.expm1(x) + least


def min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rescales to [low, high]; a constant column goes to the low end, and nothing is clipped."""
    got = df.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    for i, c in enumerate(columns):
        a, b = got[2 * i], got[2 * i + 1]
        span = None if a is None else b - a
        df = df.withColumn(f"{c}_scaled", (F.col(c) - a) / span * (high - low) + low if span else F.when(F.col(c).isNotNull(), F.lit(low)))
    return df


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centres and divides by the population deviation; a constant column becomes 0."""
    got = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    for i, c in enumerate(columns):
        m, s = got[2 * i], got[2 * i + 1]
        df = df.withColumn(f"{c}_z", (F.col(c) - m) / s if s else F.when(F.col(c).isNotNull(), F.lit(0.0)))
    return df


@dataclass(frozen=True)
class Scaler:
    """Shift and size of each column: a scaled value is (x - shift) / size * span + low."""

    shift: dict[str, float]
    size: dict[str, float]
    low: float = 0.0
    span: float = 1.0

    def transform(self, column: str) -> Column:
        """A column without spread goes to the low end."""
        x, size = F.col(column).cast("double"), self.size[column]
        return (x - self.shift[column]) / size * self.span + self.low if size else F.when(x.isNotNull(), F.lit(self.low))

    def inverse(self, scaled: Column, column: str) -> Column:
        return (scaled - self.low) / self.span * self.size[column] + self.shift[column]


def fit_min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Scaler:
    got = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    ends = {c: (got[2 * i] or 0.0, got[2 * i + 1] or 0.0) for i, c in enumerate(columns)}
    return Scaler({c: a for c, (a, _) in ends.items()}, {c: b - a for c, (a, b) in ends.items()}, low, high - low)


def fit_z_score(df: DataFrame, columns: list[str]) -> Scaler:
    got = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return Scaler({c: got[2 * i] or 0.0 for i, c in enumerate(columns)}, {c: got[2 * i + 1] or 0.0 for i, c in enumerate(columns)})


def memory_windows(df: DataFrame, value: str, by: str, order: list[str], window: int = 3, memory: int = 2) -> DataFrame:
    """time_step, short (mean of the last `window` rows) and long (mean of the `memory` rows before)."""
    own = Window.partitionBy(by).orderBy(*order)
    return df.withColumns({
        "time_step": F.row_number().over(own) - 1,
        "short": F.avg(value).over(own.rowsBetween(-(window - 1), 0)),
        "long": F.avg(value).over(own.rowsBetween(-(window + memory - 1), -window)),
    })


def next_deltas(df: DataFrame, value: str, by: str, order: list[str]) -> DataFrame:
    """Adds the step to the next row of a trajectory; its last row goes."""
    own = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("delta", F.lead(value).over(own) - F.col(value)).where("delta is not null")


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Means, population covariance, rows, and the mean of squared norms to the fourth of centred rows.

    Two passes: the second, for shrinkage, needs the means. Rows with a null or NaN are left out.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.where(~F.exists(F.array(*rows.columns), lambda v: v.isNull() | F.isnan(v)))
    p = len(columns)
    first = rows.agg(F.count("*"), *[F.avg(f"c{i}") for i in range(p)]).first()
    mean = np.array([m or 0.0 for m in first[1:]])
    d = [F.col(f"c{i}") - float(m) for i, m in enumerate(mean)]
    at = [(i, j) for i in range(p) for j in range(i, p)]
    norm = sum((x * x for x in d[1:]), d[0] * d[0])
    got = rows.agg(F.avg(norm * norm), *[F.avg(d[i] * d[j]) for i, j in at]).first()
    cov = np.zeros((p, p))
    for (i, j), v in zip(at, got[1:], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return mean, cov, first[0], got[0] or 0.0


def pca_whitening(df: DataFrame, columns: list[str], n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means and a matrix (columns x components) to unit variance, largest component first; signs are fixed."""
    mean, cov, rows, _ = covariance(df, columns)
    values, vectors = np.linalg.eigh(cov * rows / max(rows - 1, 1))
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return mean, vectors / np.sqrt(np.maximum(values, 1e-12))


def shrunk_whitening(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, inverse root of the Ledoit-Wolf covariance, and its shrinkage."""
    mean, cov, n, fourth = covariance(df, columns)
    p = len(columns)
    mu = float(np.trace(cov)) / p
    delta = float(((cov - mu * np.eye(p)) ** 2).sum()) / p
    beta = min((fourth - float((cov**2).sum())) / max(n, 1) / p, delta)
    rate = 0.0 if delta <= 0 else max(beta, 0.0) / delta
    values, vectors = np.linalg.eigh((1 - rate) * cov + rate * mu * np.eye(p))
    return mean, vectors @ np.diag(np.maximum(values, 1e-12) ** -0.5) @ vectors.T, rate


def whitened(columns: list[str], mean: np.ndarray, matrix: np.ndarray) -> list[Column]:
    """The components of a row, as expressions."""
    d = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean, strict=True)]
    return [sum((x * float(w) for x, w in zip(d[1:], row[1:], strict=True)), d[0] * float(row[0])) for row in matrix.T]


def rollout(df: DataFrame, by: str, order: list[str], value: str, step: Callable[[Column, Column, Column], Column], n: int, window: int = 3, memory: int = 2) -> DataFrame:
    """`by, step, value`: `n` autoregressive steps after the last rows of every trajectory.

    `step(current, short, long)` is the next change, of the current value, the
    mean of the last `window` values and that of the `memory` before (null
    without any). Each trajectory keeps its last `window + memory` rows only.
    """
    last = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    tail = df.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= window + memory)
    state = tail.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("h"))  # window + memory rows at most
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))

    def ahead(h: Column) -> Column:
        m = F.size(h)
        short = F.slice(h, F.greatest(m - window + 1, F.lit(1)), window)
        start = F.greatest(m - window - memory + 1, F.lit(1))
        long = F.slice(h, start, F.greatest(m - window - start + 1, F.lit(0)))
        return F.concat(h, F.array(F.element_at(h, -1) + step(F.element_at(h, -1), mean(short), mean(long))))

    out = state.select(by, F.size("h").alias("n0"), F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.col("h"), lambda h, _: ahead(h)).alias("h"))
    return out.select(by, F.posexplode(F.slice("h", F.col("n0") + 1, n)).alias("step", "value"))


def oversample(df: DataFrame, label: str, features: list[str], fits: DataFrame, seed: int = 42) -> DataFrame:
    """Synthetic rows that bring labels below the mean count up to it, drawn from each label's Gaussians.

    `fits` has feature, the label column, mu and sigma (one part a cell). The
    draws are functions of label, number and seed, so reruns agree.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    want = counts.join(F.broadcast(counts.agg(F.avg("n").alias("m"))))  # one row
    need = want.select(label, (F.floor("m") - F.col("n")).alias("k")).where("k > 0")
    # blocks of numbers first, spread over tasks: no task holds a label's whole range
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / BLOCK)))
    need = need.select(label, "k", block.alias("b")).repartition(F.col(label), F.col("b"))
    wide = fits.groupBy(label).agg(*[F.max(F.when(F.col("feature") == f, F.struct("mu", "sigma"))).alias(f"g_{f}") for f in features])
    rows = need.join(wide, label).select("*", F.explode(F.sequence(F.col("b") * BLOCK + 1, F.least((F.col("b") + 1) * BLOCK, F.col("k")))).alias("i"))

    def draw(f: str) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(f), F.lit(j), F.col(label), F.col("i")), F.lit(2**52)) + 1) / float(2**52 + 1) for j in (0, 1)]
        return F.col(f"g_{f}.mu") + F.col(f"g_{f}.sigma") * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])

    return rows.select(label, *[draw(f).alias(f) for f in features])
