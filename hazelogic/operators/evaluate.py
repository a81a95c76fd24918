"""Evaluation and consequent solves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazelogic.operators import fit


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def top_k_accuracy(df: DataFrame, truth: str, scores: str, labels: list[str], most: int) -> DataFrame:
    """Accuracy for k = 1..most; of equal scores the later label ranks first."""
    at = F.array_position(F.array(*map(F.lit, labels)), F.col(truth)).cast("int") - 1
    own = F.get(F.col(scores), at)
    ahead = F.size(F.filter(F.col(scores), lambda x, i: (x > own) | ((x == own) & (i > at))))
    one = df.agg(*[F.avg((ahead < k).cast("double")).alias(str(k)) for k in range(1, most + 1)])
    return one.unpivot([], [str(k) for k in range(1, most + 1)], "k", "accuracy").withColumn("k", F.col("k").cast("int"))


def threshold_sweep(df: DataFrame, score: Column, positive: Column, thresholds: list[float]) -> DataFrame:
    """False-positive and false-negative rates at each threshold, in one pass."""
    pos, neg = F.count(F.when(positive, 1)), F.count(F.when(~positive, 1))
    parts = []
    for t in thresholds:
        fp, fn = F.count(F.when(~positive & (score >= t), 1)), F.count(F.when(positive & (score < t), 1))
        parts.append(F.struct(F.lit(t).alias("threshold"), F.when(neg > 0, fp / neg).alias("fpr"), F.when(pos > 0, fn / pos).alias("fnr")))
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def regression_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    err = truth - predicted
    return df.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), (1 - F.sum(err * err) / (F.var_pop(truth) * F.count(truth))).alias("r2"))


def conformal_margin(df: DataFrame, y: Column, lo: Column, hi: Column, alpha: float = 0.1) -> DataFrame:
    """The margin that makes intervals cover 1 - alpha of held-out rows."""
    miss = df.select(F.greatest(lo - y, y - hi, F.lit(0.0)).alias("m"))
    n = miss.count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    found = fit.quantiles(miss, "m", [level])
    return df.sparkSession.createDataFrame([(found[0] if found else None,)], "margin double")


def gram(df: DataFrame, design: list[Column], target: Column) -> DataFrame:
    """Sums of products of a design and its target (row i, column j; target last)."""
    cols = [*design, target]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(cols[i] * cols[j]).alias("v")) for i, j in pairs]).alias("g"))
    return one.select(F.explode("g").alias("g")).select("g.*")


def ridge_solve(df: DataFrame, design: list[Column], target: Column, l2: float = 0.0, free: tuple[int, ...] = (0,)) -> np.ndarray:
    """Coefficients of a ridge regression; `free` terms aren't penalised. One pass over the data."""
    n = len(design)
    g = np.zeros((n + 1, n + 1))
    for r in gram(df, design, target).collect():  # (n + 1)(n + 2) / 2 numbers
        g[r.i, r.j] = g[r.j, r.i] = r.v or 0.0
    penalty = np.diag([0.0 if i in free else l2 for i in range(n)])
    return np.linalg.lstsq(g[:n, :n] + penalty, g[:n, n], rcond=None)[0]
