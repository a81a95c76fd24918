"""Feature scoring, selection, encoding and output buckets."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazelogic.operators import fit


def wasserstein(df: DataFrame, value: str, side: Column) -> DataFrame:
    """The area between two empirical distribution functions, split by a boolean.

    Values are counted first; running sums go over blocks of distinct values.
    A side without rows gives 0.
    """
    from hazelogic.operators import interactions

    two = df.where(side.isNotNull()).select(F.col(value), F.when(side, "u").otherwise("v").alias("side"))
    return interactions.label_wasserstein(two, [value], "side").agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("distance"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the natural-log divergence of two arrays of shares."""
    floor = 1e-300
    term = lambda a, b: F.when(a > 0, a * F.log(F.greatest(a, F.lit(floor)) / F.greatest((a + b) / 2, F.lit(floor)))).otherwise(0.0)
    half = lambda x, y: F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda s, t: s + t)
    return F.sqrt(F.greatest((half(p, q) + half(q, p)) / 2, F.lit(0.0)))


def differentiation(df: DataFrame, features: list[str], label: str, method: str = "composite") -> DataFrame:
    """`feature, score`: the sum over pairs of labels of bhattacharyya, wasserstein or composite distances."""
    from hazelogic.operators import interactions

    return interactions.pair_distances(df, features, label).groupBy("feature").agg(F.sum(method).alias("score"))


def take_top(ranked: DataFrame, top_p: float = 0.95, top_n: int = -1) -> DataFrame:
    """Of ranked features the first `top_n`, or without it those that score at least 1 - top_p."""
    return ranked.where(F.col("rank") <= top_n if top_n > 0 else F.col("score") >= 1 - top_p)


def rank_features(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Finite scores over the largest, with their rank; ties go by name."""
    finite = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature")  # one row a feature
    ranked = finite.withColumn("rank", F.row_number().over(order)).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(F.lit(0))))
    return ranked.where(F.col("rank") <= top) if top else ranked


def encode(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the index of a value among its sorted distinct values; null has none.

    Distinct values are sorted by range and numbered partition by partition.
    """
    kind = df.schema[column].dataType.simpleString()
    names = df.select(F.col(column).alias("v")).distinct().where("v is not null").orderBy("v")
    index = df.sparkSession.createDataFrame(names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), f"__v {kind}, `{to}` long")
    return df.join(index.withColumn(to, F.col(to).cast("int")), df[column] == index["__v"], "left").drop("__v")


def variance_ranking(df: DataFrame, features: list[str]) -> DataFrame:
    one = df.agg(*[F.var_samp(f).alias(f) for f in features])
    return one.unpivot([], features, "feature", "variance")


def output_buckets(df: DataFrame, value: str, n: int) -> tuple[DataFrame, list[float]]:
    """Adds `bucket` (equal widths, closed on the right) and returns the edges."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    edges = [lo + (hi - lo) * k / n for k in range(n + 1)]
    at = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges[2:-1]), F.when(F.col(value) > edges[1], 1).otherwise(0)) if n > 1 else F.lit(0)
    return df.withColumn("bucket", at), edges


#: Buckets of fewer rows give a rule that is fitted on almost nothing.
STARVED = 5


def output_partition(df: DataFrame, value: str, n: int, method: str = "uniform", pin: bool | None = None) -> tuple[DataFrame, list[float]]:
    """Adds `bucket` and returns the buckets' means.

    `uniform` cuts equal widths, `quantile` equal counts (edges that coincide
    are merged). Means of empty buckets are filled in linearly from their
    neighbours; with `pin` (the default for quantiles) the first and last are
    the least and the greatest value. A bucket of fewer than `STARVED` rows warns.
    """
    if method not in ("uniform", "quantile"):
        raise ValueError(f"unknown method: {method}")
    ends = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    lo, hi = ends if ends[0] is not None else (0.0, 0.0)
    edges = [lo + (hi - lo) * k / n for k in range(1, n)] if method == "uniform" else sorted(set(fit.quantiles(df, value, [k / n for k in range(1, n)])))
    at = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0)) if hi > lo else F.lit(0)
    cut = df.withColumn("bucket", at.cast("int"))
    seen = {r.bucket: (r.m, r.n) for r in cut.where(F.col(value).isNotNull()).groupBy("bucket").agg(F.avg(value).alias("m"), F.count("*").alias("n")).collect()}  # n rows at most
    thin = [k for k in range(n) if seen.get(k, (0, 0))[1] < STARVED]
    if thin and seen:
        warnings.warn(f"buckets {thin} hold fewer than {STARVED} rows; transform the target before the fit", stacklevel=2)
    known = sorted(seen)
    means = [float(x) for x in np.interp(range(n), known, [seen[k][0] for k in known])] if known else [0.0] * n
    if pin if pin is not None else method == "quantile":
        means[0], means[-1] = float(lo), float(hi)
    return cut, means


def log_columns(df: DataFrame, columns: list[str], chosen: list[str | int] | None = None, decades: float = 3.0) -> list[str]:
    """Columns to take the logarithm of: those chosen by name or position, else those found to span the decades.

    A name or position that is not there raises.
    """
    if chosen is None:
        return [r.feature for r in log_scale_columns(df, columns, decades).where("log_scaled").collect()]
    out = []
    for c in chosen:
        if isinstance(c, int) and not -len(columns) <= c < len(columns) or isinstance(c, str) and c not in columns:
            raise ValueError(f"no such column: {c}")
        out.append(columns[c] if isinstance(c, int) else c)
    return out


def log_scale_columns(df: DataFrame, features: list[str], decades: float = 3.0) -> DataFrame:
    """Which features span at least so many decades of magnitude."""
    size = lambda f: F.when(F.col(f) != 0, F.abs(F.col(f).cast("double")))
    one = df.agg(*[F.log10(F.max(size(f)) / F.min(size(f))).alias(f) for f in features])
    return one.unpivot([], features, "feature", "decades").withColumn("log_scaled", F.coalesce(F.col("decades") >= decades, F.lit(False)))
