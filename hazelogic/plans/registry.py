"""Queries over the shared tables, one or more for each operator, with DuckDB SQL for each.

Computed values are rounded on both sides, as engines differ in the last bits
of exponentials and of long sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazelogic.functions import membership as mf
from hazelogic.functions import norms
from hazelogic.operators import evaluate, features, fit, infer, rules, scaling
from hazelogic.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


def lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "lineitem", *KEY, *more)


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, infer.Model]:
    df = lines(spark, d, *FEATURES, "l_returnflag")
    return df, infer.Model.of(fit.normal_fit(df, FEATURES, "l_returnflag"), "l_returnflag")


# ------------------------------------------------------------ firing first: the flagship

_LONG = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS label, unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem"
_FITS = f"SELECT feature, label, avg(value) AS mu, greatest(stddev_pop(value), 1e-6) AS sigma, count(*) AS n FROM ({_LONG}) GROUP BY ALL"
_CELLS = f"SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, f.label, f.feature, exp(-0.5 * pow((x.value - f.mu) / f.sigma, 2)) AS g FROM ({_LONG}) x JOIN ({_FITS}) f ON x.feature = f.feature"
_FIRE = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, product(g) AS s FROM ({_CELLS}) GROUP BY ALL"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(max(s) FILTER (label = 'A'), 6) AS s_a, round(max(s) FILTER (label = 'N'), 6) AS s_n, round(max(s) FILTER (label = 'R'), 6) AS s_r FROM ({_FIRE}) GROUP BY ALL")
def i1_firing_strengths(spark, d):
    df, m = fitted(spark, d)
    s = df.select(*KEY, infer.firing(m).alias("s"))
    return s.select(*KEY, *[r(F.get("s", F.lit(i))).alias(f"s_{x.lower()}") for i, x in enumerate(m.labels)])


def _firing(family: str, fold: str):
    sql = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(min(v), 5) AS least, round(max(v), 5) AS most FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, {fold} AS v FROM ({_CELLS}) GROUP BY ALL) GROUP BY ALL"

    def f(spark, d):
        df, m = fitted(spark, d)
        s = df.select(*KEY, infer.firing(m, family).alias("s"))
        return s.select(*KEY, r(F.array_min("s"), 5).alias("least"), r(F.array_max("s"), 5).alias("most"))

    f.__name__ = f"i1_firing_{family}"
    query(sql)(f)


_firing("min_max", "min(g)")
_firing("luk", "greatest(0, sum(g) - (count(*) - 1))")
_firing("hamacher", "CASE WHEN min(g) <= 0 THEN 0 ELSE 1 / (1 + sum((1 - g) / g)) END")
_firing("einstein", "2 * product(g) / (product(2 - g) + product(g))")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(product(1 - least(greatest(s + 0.05, 0), 1)), 6) AS anomaly FROM ({_FIRE}) GROUP BY ALL")
def i2_anomaly_column(spark, d):
    df, m = fitted(spark, d)
    s = df.select(*KEY, infer.with_anomaly(infer.firing(m), 0.05, len(m.labels)).alias("s"))
    return s.select(*KEY, r(F.element_at("s", -1)).alias("anomaly"))


@query(f"SELECT label, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY s DESC, label) AS k FROM ({_FIRE})) WHERE k = 1 GROUP BY ALL")
def i3_classify(spark, d):
    df, m = fitted(spark, d)
    s = df.select(infer.firing(m).alias("s"))
    return s.select(infer.classify(F.col("s"), m.labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(max(s) FILTER (label = 'A') / sum(s), 6) AS p_a, round(max(s) FILTER (label = 'N') / sum(s), 6) AS p_n, round(max(s) FILTER (label = 'R') / sum(s), 6) AS p_r FROM ({_FIRE}) GROUP BY ALL")
def i5_class_probabilities(spark, d):
    df, m = fitted(spark, d)
    p = df.select(*KEY, infer.firing(m).alias("s")).select(*KEY, infer.probabilities(F.col("s"), len(m.labels)).alias("p"))
    return p.select(*KEY, *[r(F.get("p", F.lit(i))).alias(f"p_{x.lower()}") for i, x in enumerate(m.labels)])


_RULE = "CASE label WHEN 'A' THEN 1 + 2 * l_discount WHEN 'N' THEN 2 - l_tax ELSE 3 + l_discount * l_tax END"


def _rule_values(x: Column, y: Column) -> list[Column]:
    return [1 + 2 * x, 2 - y, 3 + x * y]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN sum(s) <= 1e-6 THEN 0 ELSE sum(s * v) / sum(s) END, 6) AS y FROM (SELECT f.*, {_RULE} AS v FROM ({_FIRE}) f JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)) GROUP BY ALL")
def i9_tsk_prediction(spark, d):
    """Normalised firing (I6), consequent terms (I7, I8) and their weighted sum."""
    df, m = fitted(spark, d)
    s = df.select(*KEY, "l_discount", "l_tax", infer.normalised(infer.firing(m)).alias("w"))
    return s.select(*KEY, r(infer.tsk_value(F.col("w"), _rule_values(F.col("l_discount"), F.col("l_tax")))).alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((3 * x * x - 1) / 2, 6) AS legendre_2, round((5 * x * x * x - 3 * x) / 2, 6) AS legendre_3, round(x * x, 6) AS raw_2 FROM (SELECT *, l_discount * 8 AS x FROM lineitem)")
def i7_consequent_basis(spark, d):
    x = F.col("l_discount") * 8
    two = infer.basis(x, 3, "legendre")
    return lines(spark, d, "l_discount").select(*KEY, r(two[1]).alias("legendre_2"), r(two[2]).alias("legendre_3"), r(infer.basis(x, 2)[1]).alias("raw_2"))


_IT2 = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, product(exp(-0.5 * pow((value - mu) / (sigma * 1.2), 2))) AS hi, product(exp(-0.5 * pow((value - mu) / (sigma * 0.8), 2))) AS lo FROM (SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, x.value, f.label, f.mu, f.sigma FROM ({_LONG}) x JOIN ({_FITS}) f ON x.feature = f.feature) GROUP BY ALL"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, round((hi + lo) / 2, 6) AS strength FROM ({_IT2})")
def i10_it2_firing(spark, d):
    df, m = fitted(spark, d)
    s = df.select(*KEY, infer.firing(m.widened(1.2)).alias("hi"), infer.firing(m.widened(0.8)).alias("lo"))
    mid = F.zip_with("hi", "lo", lambda a, b: (a + b) / 2)
    return s.select(*KEY, F.explode(F.arrays_zip(F.array(*map(F.lit, m.labels)).alias("label"), mid.alias("v"))).alias("e")).select(*KEY, "e.label", r(F.col("e.v")).alias("strength"))


@query(f"""WITH t AS (SELECT i.*, {_RULE} AS v FROM ({_IT2}) i JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)),
p AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, sum(hi) OVER w AS ch, sum(lo) OVER w AS cl, sum(hi * v) OVER w AS chv, sum(lo * v) OVER w AS clv,
 sum(hi) OVER a AS th, sum(lo) OVER a AS tl, sum(hi * v) OVER a AS thv, sum(lo * v) OVER a AS tlv FROM t WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY v, label), a AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN max(th) <= 1e-6 THEN 0 ELSE round(least(min(tlv / tl), min((chv + tlv - clv) / (ch + tl - cl))), 5) END AS y_l, CASE WHEN max(th) <= 1e-6 THEN 0 ELSE round(greatest(max(thv / th), max((clv + thv - chv) / (cl + th - ch))), 5) END AS y_r
FROM p GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def i12_karnik_mendel(spark, d):
    df, m = fitted(spark, d)
    values = F.array(*_rule_values(F.col("l_discount"), F.col("l_tax")))
    s = df.select(*KEY, values.alias("v"), infer.firing(m.widened(0.8)).alias("lo"), infer.firing(m.widened(1.2)).alias("hi"))
    return infer.km_interval(s, KEY, "v", "lo", "hi").select(*KEY, r(F.col("y_l"), 5).alias("y_l"), r(F.col("y_r"), 5).alias("y_r"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(a, b), 6) AS y_l, round(greatest(a, b), 6) AS y_r FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN sum(lo) <= 1e-6 THEN 0 ELSE sum(lo * v) / sum(lo) END AS a, CASE WHEN sum(hi) <= 1e-6 THEN 0 ELSE sum(hi * v) / sum(hi) END AS b FROM (SELECT i.*, {_RULE} AS v FROM ({_IT2}) i JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)) GROUP BY ALL)")
def i13_fast_interval(spark, d):
    df, m = fitted(spark, d)
    s = df.select(*KEY, "l_discount", "l_tax", infer.firing(m.widened(0.8)).alias("lo"), infer.firing(m.widened(1.2)).alias("hi"))
    lo, hi = infer.fast_interval(F.col("lo"), F.col("hi"), _rule_values(F.col("l_discount"), F.col("l_tax")))
    return s.select(*KEY, r(lo).alias("y_l"), r(hi).alias("y_r"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.25 * l_quantity * 0.25 + 0.5 * l_quantity * 0.5 + 0.75 * l_quantity * 0.75 + l_quantity) / 2.5, 6) AS v FROM lineitem")
def i14_combine_planes(spark, d):
    x = F.col("l_quantity")
    return lines(spark, d, "l_quantity").select(*KEY, r(infer.combine_planes([(a, x * a) for a in infer.alpha_levels(4)])).alias("v"))


@query(f"""WITH f AS ({_FITS}), pr AS (SELECT l_returnflag AS label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM lineitem GROUP BY ALL),
e AS (SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, f.label, any_value(lp) - sum(pow(x.value - f.mu, 2) / (2 * f.sigma * f.sigma) + 0.5 * ln(2 * pi() * f.sigma * f.sigma)) AS s FROM ({_LONG}) x JOIN f ON x.feature = f.feature JOIN pr ON pr.label = f.label GROUP BY x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, f.label)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(max(s) FILTER (label = 'A'), 5) AS e_a, round(1 / sum(exp(s - m)), 5) AS p_top FROM (SELECT *, max(s) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS m FROM e) GROUP BY ALL""")
def i16_log_evidence(spark, d):
    df, m = fitted(spark, d)
    prior = {x.l_returnflag: x.log_prior for x in fit.class_prior(df, "l_returnflag").collect()}
    s = df.select(*KEY, infer.log_evidence(m, prior, {}).alias("s"))
    return s.select(*KEY, r(F.get("s", F.lit(0)), 5).alias("e_a"), r(F.array_max(infer.softmax(F.col("s"))), 5).alias("p_top"))


_MU = "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"


@query(f"SELECT event_id, round(0.5 * pow((value - m) / s, 2), 5) AS surprisal FROM events, {_MU}")
def i17_one_class_surprisal(spark, d):
    ev = table(spark, d, "events", "event_id", "value")
    m, s = ev.agg(F.avg("value"), F.stddev_pop("value")).first()
    return ev.select("event_id", r(infer.surprisal([mf.gaussian(F.col("value"), m, s)]), 5).alias("surprisal"))


# ------------------------------------------------------------ membership functions


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(-0.5 * pow((l_quantity - 25) / 8, 2)), 6) AS g, round(greatest(0, 1 - abs(l_quantity - 25) / (8 * 2.33293)), 6) AS t FROM lineitem")
def m1_m4_gaussian(spark, d):
    x = F.col("l_quantity")
    return lines(spark, d, "l_quantity").select(*KEY, r(mf.gaussian(x, 25, 8)).alias("g"), r(mf.functional(x, 25, 8, "triangular")).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN q BETWEEN 20 AND 30 THEN 1 WHEN q > 10 AND q < 20 THEN (q - 10) / 10 WHEN q > 30 AND q < 46 THEN (46 - q) / 16 ELSE 0 END, 6) AS v, CASE WHEN q BETWEEN 20 AND 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS step FROM (SELECT *, l_quantity AS q FROM lineitem)")
def m2_trapezoid(spark, d):
    x = F.col("l_quantity")
    return lines(spark, d, "l_quantity").select(*KEY, r(mf.trapezoid(x, 10, 20, 30, 46)).alias("v"), mf.trapezoid(x, 20, 20, 30, 30).alias("step"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN q = 20 THEN 1 WHEN q < 20 AND q > 10 THEN (q - 10) / 10 WHEN q > 20 AND q < 36 THEN (36 - q) / 16 ELSE 0 END, 6) AS v, round(CASE WHEN q <= 20 THEN 1 WHEN q < 36 THEN (36 - q) / 16 ELSE 0 END, 6) AS shoulder FROM (SELECT *, l_quantity AS q FROM lineitem)")
def m3_triangle(spark, d):
    x = F.col("l_quantity")
    return lines(spark, d, "l_quantity").select(*KEY, r(mf.triangle(x, 10, 20, 36)).alias("v"), r(mf.triangle(x, float("-inf"), 20, 36)).alias("shoulder"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN q BETWEEN 20 AND 30 THEN 1 WHEN q > 10 AND q < 20 THEN (q - 10) / 10 WHEN q > 30 AND q < 46 THEN (46 - q) / 16 ELSE 0 END / 23, 6) AS trap, round(exp(-0.5 * pow((q - 25) / 8, 2)) / (8 * sqrt(2 * pi())), 6) AS norm FROM (SELECT *, l_quantity AS q FROM lineitem)")
def m5_m6_densities(spark, d):
    x = F.col("l_quantity")
    return lines(spark, d, "l_quantity").select(*KEY, r(mf.trapezoid_pdf(x, 10, 20, 30, 46)).alias("trap"), r(mf.normal_pdf(x, 25, 8)).alias("norm"))


@query(f"SELECT feature, label, round(sigma * 1.3, 4) AS upper_sigma, round(sigma * 0.7, 4) AS lower_sigma, round(sigma * 1.3 + 0.5 * (sigma - sigma * 1.3), 4) AS cut_sigma, round(mu - 3 * sigma, 4) AS lo, round(mu + 3 * sigma, 4) AS hi, round(mu - 2.33293 * sigma, 4) AS tri_a FROM ({_FITS})")
def m7_m12_widen_cut_support(spark, d):
    """Widened bounds, an alpha cut, supports and the triangle of each fitted Gaussian."""
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    s, m = F.col("sigma"), F.col("mu")
    up, lo = mf.widen_sigma(s, 0.3)
    a, b = mf.support(m, s)
    return f.select("feature", F.col("l_returnflag").alias("label"), r(up, 4).alias("upper_sigma"), r(lo, 4).alias("lower_sigma"), r(mf.alpha_cut(s, up, F.lit(0.5)), 4).alias("cut_sigma"), r(a, 4).alias("lo"), r(b, 4).alias("hi"), r(m - mf.TRIANGLE_HALF_WIDTH * s, 4).alias("tri_a"))


# ------------------------------------------------------------ norms

_XY = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 8 AS x, l_tax * 10 AS y FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(x, y), 6) AS min_max, round(x * y, 6) AS probability, round(greatest(0, x + y - 1), 6) AS luk,
round(CASE WHEN abs(x + y - x * y) <= 1e-12 THEN 0 ELSE x * y / (x + y - x * y) END, 6) AS hamacher, round(x * y / (2 - (x + y - x * y)), 6) AS einstein, round(1 - x, 6) AS complement FROM ({_XY})""")
def n1_n3_t_norms(spark, d):
    xy = lines(spark, d, "l_discount", "l_tax").select(*KEY, (F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 10).alias("y"))
    return xy.select(*KEY, *[r(norms.t_norm(F.col("x"), F.col("y"), f)).alias(f) for f in norms.FAMILIES], r(norms.complement(F.col("x"))).alias("complement"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(x, y), 6) AS min_max, round(x + y - x * y, 6) AS probability, round(least(1, x + y), 6) AS luk,
round(CASE WHEN abs(1 - x * y) <= 1e-12 THEN 1 ELSE (x + y - 2 * x * y) / (1 - x * y) END, 6) AS hamacher, round((x + y) / (1 + x * y), 6) AS einstein FROM ({_XY})""")
def n2_t_conorms(spark, d):
    xy = lines(spark, d, "l_discount", "l_tax").select(*KEY, (F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 10).alias("y"))
    return xy.select(*KEY, *[r(norms.t_conorm(F.col("x"), F.col("y"), f)).alias(f) for f in norms.FAMILIES])


@query("""SELECT l_orderkey, round(min(x), 6) AS and_min_max, round(product(x), 6) AS and_probability, round(greatest(0, sum(x) - (count(*) - 1)), 6) AS and_luk,
round(CASE WHEN min(x) <= 0 THEN 0 ELSE 1 / (1 + sum(CASE WHEN x > 0 THEN (1 - x) / x ELSE 0 END)) END, 6) AS and_hamacher, round(2 * product(x) / (product(2 - x) + product(x)), 6) AS and_einstein,
round(max(x), 6) AS or_min_max, round(1 - product(1 - x), 6) AS or_probability, round(least(1, sum(x)), 6) AS or_luk,
round(CASE WHEN max(x) >= 1 THEN 1 ELSE sum(x / (1 - x)) / (1 + sum(x / (1 - x))) END, 6) AS or_hamacher, round((product(1 + x) - product(1 - x)) / (product(1 + x) + product(1 - x)), 6) AS or_einstein
FROM (SELECT l_orderkey, l_discount * 8 AS x FROM lineitem) GROUP BY l_orderkey""")
def n_folds_as_aggregates(spark, d):
    x = F.col("x")
    rows = table(spark, d, "lineitem", "l_orderkey", "l_discount").select("l_orderkey", (F.col("l_discount") * 8).alias("x"))
    return rows.groupBy("l_orderkey").agg(*[r(norms.agg_and(x, f)).alias(f"and_{f}") for f in norms.FAMILIES], *[r(norms.agg_or(x, f)).alias(f"or_{f}") for f in norms.FAMILIES])


# ------------------------------------------------------------ fits


@query(f"SELECT feature, label, round(mu, 4) AS mu, round(sigma, 4) AS sigma, n FROM ({_FITS})")
def f1_f7_normal_fits(spark, d):
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    return f.select("feature", F.col("l_returnflag").alias("label"), r(F.col("mu"), 4).alias("mu"), r(F.col("sigma"), 4).alias("sigma"), "n")


@query("SELECT n, round(ll, 2) AS log_likelihood, round(5 * ln(n) - 2 * ll, 2) AS bic FROM (SELECT count(*) AS n, sum(ln(greatest(0.4 * exp(-0.5 * pow((x - 15) / s1, 2)) / (s1 * sqrt(2 * pi())) + 0.6 * exp(-0.5 * pow((x - 35) / s2, 2)) / (s2 * sqrt(2 * pi())), 1e-300))) AS ll FROM (SELECT l_quantity AS x, sqrt(81 + v * 1e-6) AS s1, sqrt(100 + v * 1e-6) AS s2 FROM lineitem, (SELECT var_pop(l_quantity) AS v FROM lineitem)))")
def f4_mixture_bic(spark, d):
    got = fit.mixture_bic(table(spark, d, "lineitem", "l_quantity"), "l_quantity", [(15, 9, 0.4), (35, 10, 0.6)])
    return got.select("n", r(F.col("log_likelihood"), 2).alias("log_likelihood"), r(F.col("bic"), 2).alias("bic"))


_HIST = "SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n, lo, hi FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY ALL"


@query(f"SELECT bin, n FROM ({_HIST})")
def f8_histogram(spark, d):
    return fit.histogram(table(spark, d, "orders", "o_totalprice"), "o_totalprice").select("bin", "n")


@query(f"SELECT round(lo + (min(bin) - 1) * w, 2) AS a, round(lo + min(bin) * w, 2) AS b, round(lo + (max(bin) + 1) * w, 2) AS c, round(lo + (max(bin) + 2) * w, 2) AS d, sum(n)::BIGINT AS n FROM (SELECT *, (hi - lo) / 10 AS w, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS run FROM (SELECT *, bin - lag(bin) OVER (ORDER BY bin) AS gap FROM ({_HIST}))) GROUP BY run, lo, w")
def f8_histogram_trapezoids(spark, d):
    got = fit.histogram_trapezoids(table(spark, d, "orders", "o_totalprice"), "o_totalprice")
    return got.select(*[r(F.col(c), 2).alias(c) for c in "abcd"], "n")


@query("""WITH s AS (SELECT l_returnflag AS label, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL),
m AS (SELECT label, x, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY label) AS mid FROM s WINDOW o AS (PARTITION BY label ORDER BY x)),
n AS (SELECT *, lead(x) OVER o AS x1, lead(mid) OVER o AS m1 FROM m WINDOW o AS (PARTITION BY label ORDER BY x))
SELECT label, round(max(CASE WHEN mid <= 0.25 AND m1 > 0.25 THEN x + (0.25 - mid) / (m1 - mid) * (x1 - x) END), 4) AS q0, round(max(CASE WHEN mid <= 0.5 AND m1 > 0.5 THEN x + (0.5 - mid) / (m1 - mid) * (x1 - x) END), 4) AS q1 FROM n GROUP BY label""")
def f14_weighted_quantiles(spark, d):
    got = fit.weighted_quantiles(table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", [0.25, 0.5], "l_returnflag")
    return got.select(F.col("l_returnflag").alias("label"), r(F.col("q0"), 4).alias("q0"), r(F.col("q1"), 4).alias("q1"))


@query("SELECT l_returnflag AS label, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER ()), 6) AS log_prior FROM lineitem GROUP BY l_returnflag")
def f16_class_prior(spark, d):
    return fit.class_prior(table(spark, d, "lineitem", "l_returnflag"), "l_returnflag").select(F.col("l_returnflag").alias("label"), "n", r(F.col("log_prior")).alias("log_prior"))


# ------------------------------------------------------------ feature scores


@query("""WITH c AS (SELECT l_quantity AS x, count(*) FILTER (l_returnflag = 'A') AS u, count(*) FILTER (l_returnflag <> 'A') AS v FROM lineitem GROUP BY ALL),
k AS (SELECT sum(u) OVER (ORDER BY x) / sum(u) OVER () AS fu, sum(v) OVER (ORDER BY x) / sum(v) OVER () AS fv, lead(x) OVER (ORDER BY x) - x AS dx FROM c)
SELECT round(sum(abs(fu - fv) * dx), 6) AS distance FROM k""")
def s1_wasserstein(spark, d):
    got = features.wasserstein(table(spark, d, "lineitem", "l_quantity", "l_returnflag"), "l_quantity", F.col("l_returnflag") == "A")
    return got.select(r(F.col("distance")).alias("distance"))


@query("""WITH g AS (SELECT i, exp(-0.5 * pow((i - 40) / 10.0, 2)) AS a, exp(-0.5 * pow((i - 60) / 15.0, 2)) AS b FROM range(100) t(i)),
n AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM g)
SELECT round(sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2), 6) AS distance FROM n""")
def s2_jensen_shannon(spark, d):
    grid = F.sequence(F.lit(0), F.lit(99))
    shares = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, t: s + t))
    two = spark.range(1).select(F.transform(grid, lambda i: mf.gaussian(i.cast("double"), 40, 10)).alias("a"), F.transform(grid, lambda i: mf.gaussian(i.cast("double"), 60, 15)).alias("b"))
    return two.select(shares(F.col("a")).alias("p"), shares(F.col("b")).alias("q")).select(r(features.jensen_shannon(F.col("p"), F.col("q"))).alias("distance"))


_SCORE = f"SELECT a.feature, sum(abs(a.mu - b.mu) / sqrt((a.sigma * a.sigma + b.sigma * b.sigma) / 2)) AS score FROM ({_FITS}) a JOIN ({_FITS}) b ON a.feature = b.feature AND a.label < b.label GROUP BY a.feature"


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def s9_encode(spark, d):
    return features.encode(table(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, round(unnest([var_samp(l_quantity), var_samp(l_discount), var_samp(l_tax)]), 6) AS variance FROM lineitem")
def s11_variance_ranking(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return features.variance_ranking(table(spark, d, "lineitem", *cols), cols).select("feature", r(F.col("variance")).alias("variance"))


@query("SELECT bucket, count(*) AS n, round(avg(p), 2) AS mean FROM (SELECT p, (p > lo + w)::INT + (p > lo + 2 * w)::INT + (p > lo + 3 * w)::INT AS bucket FROM (SELECT o_totalprice AS p, min(o_totalprice) OVER () AS lo, (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) / 4 AS w FROM orders)) GROUP BY bucket")
def s12_output_buckets(spark, d):
    rows, _ = features.output_buckets(table(spark, d, "orders", "o_totalprice"), "o_totalprice", 4)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 2).alias("mean"))


# ------------------------------------------------------------ preprocessing


@query("SELECT unnest(['value', 'user_id']) AS feature, round(unnest([log10(max(abs(value)) FILTER (value <> 0) / min(abs(value)) FILTER (value <> 0)), log10(max(user_id) FILTER (user_id <> 0) / min(user_id) FILTER (user_id <> 0))]), 6) AS decades FROM events")
def p1_log_features(spark, d):
    return features.log_scale_columns(table(spark, d, "events", "value", "user_id"), ["value", "user_id"]).select("feature", r(F.col("decades")).alias("decades"))


@query("SELECT event_id, round(ln(1 + greatest(value - (SELECT min(value) FROM events), 0)), 6) AS v FROM events")
def p2_log1p(spark, d):
    return scaling.log1p_floor(table(spark, d, "events", "event_id", "value"), "value", "v").select("event_id", r(F.col("v")).alias("v"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def p3_min_max(spark, d):
    return scaling.min_max(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r(F.col("c_acctbal_scaled")).alias("scaled"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def p4_z_score(spark, d):
    return scaling.z_score(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r(F.col("c_acctbal_z")).alias("z"))


@query("SELECT event_id, (row_number() OVER o - 1)::INT AS time_step, round(avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS short, round(avg(value) OVER (o ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING), 6) AS long FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)")
def p7_memory_windows(spark, d):
    got = scaling.memory_windows(table(spark, d, "events", "event_id", "user_id", "ts", "value"), "value", "user_id", ["ts", "event_id"])
    return got.select("event_id", "time_step", r(F.col("short")).alias("short"), r(F.col("long")).alias("long"))


@query("SELECT event_id, round(nxt - value, 6) AS delta FROM (SELECT event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def p8_next_deltas(spark, d):
    return scaling.next_deltas(table(spark, d, "events", "event_id", "user_id", "ts", "value"), "value", "user_id", ["ts", "event_id"]).select("event_id", r(F.col("delta")).alias("delta"))


# ------------------------------------------------------------ rules and trees

_RANKED = f"SELECT feature, label, mu, sigma, row_number() OVER (PARTITION BY feature ORDER BY label) AS k FROM ({_FITS})"


@query(f"SELECT a.feature, a.label FROM ({_RANKED}) a WHERE NOT EXISTS (SELECT 1 FROM ({_RANKED}) b WHERE b.feature = a.feature AND b.k < a.k AND abs(b.mu - a.mu) <= 1e-3 + 1e-2 * abs(a.mu) AND abs(b.sigma - a.sigma) <= 1e-3 + 1e-2 * abs(a.sigma))")
def b1_b3_dedup(spark, d):
    """Near memberships of a feature, whatever their label."""
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    own = f.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("l_returnflag"))).withColumn("one", F.lit("all"))
    return rules.dedup_memberships(own, "one").select("feature", F.col("l_returnflag").alias("label"))


@query(f"SELECT feature, round(min(mu - 3 * sigma), 3) AS lo, round(max(mu + 3 * sigma), 3) AS hi, count(*) AS members FROM ({_FITS}) GROUP BY feature")
def b5_convex_clauses(spark, d):
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag").withColumn("one", F.lit("all"))
    return rules.convex_clauses(f, "one").select("feature", r(F.col("lo"), 3).alias("lo"), r(F.col("hi"), 3).alias("hi"), "members")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN q <= 10 THEN 1 ELSE greatest(0, (25 - q) / 15) END, 6) AS low, round(CASE WHEN q <= 25 THEN greatest(0, (q - 10) / 15) ELSE greatest(0, (40 - q) / 15) END, 6) AS mid, round(CASE WHEN q <= 40 THEN greatest(0, (q - 25) / 15) ELSE 1 END, 6) AS high FROM (SELECT *, l_quantity AS q FROM lineitem)")
def b7_ruspini_partition(spark, d):
    terms = rules.ruspini_terms(F.col("l_quantity"), [10, 25, 40])
    return lines(spark, d, "l_quantity").select(*KEY, *[r(t).alias(n) for n, t in zip(("low", "mid", "high"), terms, strict=True)])


@query("SELECT label, t_q, t_d, count(*) AS n FROM (SELECT l_returnflag AS label, CASE WHEN l_quantity <= 17.5 THEN 1 WHEN l_quantity <= 32.5 THEN 2 ELSE 3 END AS t_q, CASE WHEN l_discount <= 0.055 THEN 1 ELSE 2 END AS t_d FROM lineitem) GROUP BY ALL")
def b9_term_tuples(spark, d):
    terms = {"q": rules.ruspini_terms(F.col("l_quantity"), [10, 25, 40]), "d": rules.ruspini_terms(F.col("l_discount"), [0.01, 0.1])}
    got = rules.term_tuples(table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount"), "l_returnflag", terms)
    return got.select(F.col("l_returnflag").alias("label"), "t_q", "t_d", "n")


_SOFT = "SELECT y, unnest([CASE WHEN q <= 10 THEN 1 ELSE greatest(0, (40 - q) / 30) END, CASE WHEN q <= 40 THEN greatest(0, (q - 10) / 30) ELSE 1 END]) AS w, unnest([1, 2]) AS term FROM (SELECT l_quantity AS q, l_extendedprice / 1000 AS y FROM lineitem)"


@query(f"SELECT round((v - sum(q - s * s / w) / sum(w)) / v, 6) AS gain FROM (SELECT term, sum(w) AS w, sum(w * y) AS s, sum(w * y * y) AS q FROM ({_SOFT}) GROUP BY term), (SELECT var_pop(l_extendedprice / 1000) AS v FROM lineitem) GROUP BY v")
def h1_variance_reduction(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_extendedprice").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return rules.variance_reduction(df, "y", rules.ruspini_terms(F.col("l_quantity"), [10, 40])).select(r(F.col("gain")).alias("gain"))


@query("""WITH t AS (SELECT l_returnflag AS c, unnest([CASE WHEN q <= 10 THEN 1 ELSE greatest(0, (40 - q) / 30) END, CASE WHEN q <= 40 THEN greatest(0, (q - 10) / 30) ELSE 1 END]) AS w, unnest([1, 2]) AS term FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem)),
m AS (SELECT term, c, sum(w) AS w FROM t GROUP BY ALL), p AS (SELECT term, w, w / sum(w) OVER (PARTITION BY term) AS p FROM m),
ch AS (SELECT sum(x * h) / sum(x) AS child FROM (SELECT sum(w) AS x, sum(-p * log2(p)) AS h FROM p GROUP BY term)),
pa AS (SELECT sum(-p * log2(p)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag))
SELECT round(h - child, 6) AS gain FROM pa, ch""")
def h2_information_gain(spark, d):
    got = rules.information_gain(table(spark, d, "lineitem", "l_quantity", "l_returnflag"), "l_returnflag", rules.ruspini_terms(F.col("l_quantity"), [10, 40]))
    return got.select(r(F.col("gain")).alias("gain"))


# ------------------------------------------------------------ evaluation and solves


@query("SELECT l_returnflag AS truth, CASE WHEN l_quantity > 25 THEN 'N' ELSE 'A' END AS predicted, count(*) AS n FROM lineitem GROUP BY ALL")
def e3_confusion(spark, d):
    df = table(spark, d, "lineitem", "l_returnflag", "l_quantity").withColumn("p", F.when(F.col("l_quantity") > 25, "N").otherwise("A"))
    return evaluate.confusion(df, "l_returnflag", "p")


@query(f"SELECT k, round(avg((ahead < k)::INT), 6) AS accuracy FROM (SELECT count(*) FILTER (f.label <> o.label AND (f.s > o.s OR (f.s = o.s AND f.label > o.label))) AS ahead FROM ({_FIRE}) f JOIN (SELECT f.* FROM ({_FIRE}) f JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE label = l_returnflag) o USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey), (SELECT unnest([1, 2, 3]) AS k) GROUP BY k")
def e1_top_k_accuracy(spark, d):
    df, m = fitted(spark, d)
    got = evaluate.top_k_accuracy(df.withColumn("s", infer.firing(m)), "l_returnflag", "s", m.labels, 3)
    return got.select("k", r(F.col("accuracy")).alias("accuracy"))


@query("SELECT t AS threshold, round(count(*) FILTER (toxic = 0 AND n_chars >= t) / count(*) FILTER (toxic = 0), 6) AS fpr, round(count(*) FILTER (toxic = 1 AND n_chars < t) / count(*) FILTER (toxic = 1), 6) AS fnr FROM documents JOIN labels USING (doc_id), (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS t) GROUP BY t")
def e2_threshold_sweep(spark, d):
    df = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "toxic"), "doc_id")
    got = evaluate.threshold_sweep(df, F.col("n_chars"), F.col("toxic") == 1, [500.0, 1000.0, 2000.0])
    return got.select("threshold", r(F.col("fpr")).alias("fpr"), r(F.col("fnr")).alias("fnr"))


@query("SELECT round(avg(e * e), 6) AS mse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice / 10000 AS y, l_extendedprice / 10000 - l_quantity / 10 AS e FROM lineitem)")
def r6_regression_metrics(spark, d):
    got = evaluate.regression_metrics(table(spark, d, "lineitem", "l_extendedprice", "l_quantity"), F.col("l_extendedprice") / 10000, F.col("l_quantity") / 10)
    return got.select(*[r(F.col(c)).alias(c) for c in ("mse", "mae", "r2")])


@query("""WITH m AS (SELECT greatest(lo - y, y - hi, 0) AS m FROM (SELECT l_extendedprice / 1000 AS y, l_quantity - 5 AS lo, l_quantity + 5 AS hi FROM lineitem)),
o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k, lead(m) OVER (ORDER BY m) AS nxt, count(*) OVER () AS n FROM m),
p AS (SELECT *, least(1.0, ceil((n + 1) * 0.9) / n) * (n - 1) AS pos FROM o)
SELECT round(m + (pos - k) * (coalesce(nxt, m) - m), 6) AS margin FROM p WHERE k = floor(pos)""")
def r7_conformal_margin(spark, d):
    df = table(spark, d, "lineitem", "l_extendedprice", "l_quantity")
    return evaluate.conformal_margin(df, F.col("l_extendedprice") / 1000, F.col("l_quantity") - 5, F.col("l_quantity") + 5).select(r(F.col("margin")).alias("margin"))


@query("SELECT round(regr_intercept(l_extendedprice / 1000, l_quantity), 5) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS slope FROM lineitem")
def r1_least_squares(spark, d):
    df = table(spark, d, "lineitem", "l_extendedprice", "l_quantity")
    beta = evaluate.ridge_solve(df, [F.lit(1.0), F.col("l_quantity")], F.col("l_extendedprice") / 1000)
    return spark.createDataFrame([(round(float(beta[0]), 5), round(float(beta[1]), 5))], "intercept double, slope double")


_TERMS = ["1.0", "l_quantity / 50", "l_discount * 10", "l_extendedprice / 100000"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(sum({_TERMS[i]} * {_TERMS[j]}), 2) AS v FROM lineitem" for i in range(4) for j in range(i, 4)) + ")")
def r1_gram(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice")
    cols = [F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_extendedprice") / 100000]
    return evaluate.gram(df, cols[:3], cols[3]).select("i", "j", r(F.col("v"), 2).alias("v"))
