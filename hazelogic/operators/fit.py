"""Fitting membership functions with aggregations over feature tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row per feature value: the kept columns, feature and value; no nulls or NaNs."""
    long = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keep), features, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def normal_fit(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mean and population deviation of every feature for every label, in one shuffle."""
    fits = melt(df, features, label).groupBy("feature", label).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"), F.count("*").alias("n"))
    return fits.withColumn("sigma", F.greatest("sigma", F.lit(1e-6)))


def class_prior(df: DataFrame, label: str) -> DataFrame:
    """Log share of each label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(total).select(label, "n", F.log(F.col("n") / F.col("total")).alias("log_prior"))  # one row


def variance_floor(df: DataFrame, features: list[str], share: float = 1e-9) -> DataFrame:
    """The least variance a feature is given: a share of its own."""
    return melt(df, features).groupBy("feature").agg((F.var_pop("value") * share).alias("floor"))


#: Bins of a pass that narrows order statistics down.
BINS = 2048


def order_statistics(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values that stand at `places` (from 0) in ascending order; nulls and NaNs don't count.

    A pass counts values in `BINS` bins of each open interval and goes on in the
    bins that hold a place, until these hold one value: the driver and no task
    ever get more than bins.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    first = rows.agg(F.min("x"), F.max("x")).first()
    found: dict[int, float] = {}
    todo = {(first[0], first[1], 0): sorted(set(places))} if first[0] is not None else {}
    while todo:
        spans = list(todo)
        at = F.coalesce(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), i) for i, (lo, hi, _) in enumerate(spans)])
        low = F.element_at(F.array(*[F.lit(s[0]) for s in spans]), F.col("at") + 1)
        wide = F.element_at(F.array(*[F.lit(max(s[1] - s[0], 1e-300)) for s in spans]), F.col("at") + 1)
        bins = rows.withColumn("at", at).where("at is not null").withColumn("bin", F.least(F.floor((F.col("x") - low) / wide * BINS), F.lit(BINS - 1)))
        counts = sorted(bins.groupBy("at", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: (r.at, r.bin))
        new: dict = {}
        for i, s in enumerate(spans):
            seen = s[2]
            for r in (r for r in counts if r.at == i):
                inside = [k for k in todo[s] if seen <= k < seen + r.n]
                if r.lo == r.hi:
                    found.update(dict.fromkeys(inside, r.lo))
                elif inside:
                    new[r.lo, r.hi, seen] = inside
                seen += r.n
        todo = new
    return [found[k] for k in places]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours; none for a column without values."""
    n = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)").count()
    if not n:
        return []
    at = [q * (n - 1) for q in shares]
    places = [k for p in at for k in (math.floor(p), min(math.floor(p) + 1, n - 1))]
    v = order_statistics(df, value, places)
    return [v[2 * i] + (p - math.floor(p)) * (v[2 * i + 1] - v[2 * i]) for i, p in enumerate(at)]


def mixture_bic(df: DataFrame, value: str, parts: list[tuple[float, float, float]]) -> DataFrame:
    """BIC of a mixture of (mu, sigma, weight): n, log-likelihood and criterion."""
    x = F.col(value)
    floor = df.agg(F.var_pop(value) * 1e-6).first()[0] or 0.0
    density = F.lit(0.0)
    for mu, sigma, weight in parts:
        s = math.sqrt(sigma * sigma + floor)
        density = density + F.exp(-0.5 * F.pow((x - mu) / s, 2)) * (weight / (s * math.sqrt(2 * math.pi)))
    sums = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.sum(F.log(F.greatest(density, F.lit(1e-300)))).alias("log_likelihood"))
    return sums.withColumn("bic", (3 * len(parts) - 1) * F.log("n") - 2 * F.col("log_likelihood"))


def histogram(df: DataFrame, value: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Counts of equal-width bins between the minimum and maximum of each group."""
    key = [by] if by else []
    rows = df.select(*key, F.col(value).cast("double").alias("x")).where("x is not null")
    ends = rows.groupBy(*key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = rows.join(ends, key) if key else rows.join(ends)  # one row a label: Spark checks its size
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.groupBy(*key, at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def histogram_trapezoids(df: DataFrame, value: str, bins: int = 10, merge: int = 2, by: str | None = None) -> DataFrame:
    """A trapezoid over each run of filled bins; gaps of up to `merge - 1` bins are bridged.

    The plateau is the run; the ramps reach one bin further out.
    """
    key = [by] if by else []
    own = Window.partitionBy(*(F.col(k) for k in key)).orderBy("bin") if key else Window.partitionBy(F.lit(0)).orderBy("bin")
    h = histogram(df, value, bins, by)  # at most `bins` rows a group
    start = (F.col("bin") - F.lag("bin").over(own) > merge) | F.lag("bin").over(own).isNull()
    runs = h.withColumn("run", F.sum(start.cast("int")).over(own)).groupBy(*key, "run", "lo", "hi").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum("n").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    b, c = F.col("lo") + F.col("first") * width, F.col("lo") + (F.col("last") + 1) * width
    return runs.select(*key, "run", (b - width).alias("a"), b.alias("b"), c.alias("c"), (c + width).alias("d"), "n")


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: list[float], by: str) -> DataFrame:
    """Quantiles of a weighted sample: midpoints of the cumulative weight, interpolated.

    Weights are summed by value first, so a hot value is one row.
    """
    sums = df.groupBy(by, F.col(value).alias("x")).agg(F.sum(weight).alias("w")).where("w > 0")
    own = Window.partitionBy(by)
    at = sums.withColumn("mid", (F.sum("w").over(own.orderBy("x")) - F.col("w") / 2) / F.sum("w").over(own))
    ahead = own.orderBy("x")
    at = at.withColumns({"x1": F.lead("x").over(ahead), "m1": F.lead("mid").over(ahead), "x0": F.lag("x").over(ahead)})
    out = []
    for i, q in enumerate(shares):
        inside = F.when((F.col("mid") <= q) & (F.col("m1") > q), F.col("x") + (q - F.col("mid")) / (F.col("m1") - F.col("mid")) * (F.col("x1") - F.col("x")))
        ends = F.when(F.col("x0").isNull() & (F.col("mid") > q), F.col("x")).when(F.col("x1").isNull() & (F.col("mid") <= q), F.col("x"))
        out.append(F.max(F.coalesce(inside, ends)).alias(f"q{i}"))
    return at.groupBy(by).agg(*out)
