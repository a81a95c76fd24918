"""Queries of shapes, type-2 inference, consequent solves, experts and refinement, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazelogic.functions import shapes
from hazelogic.operators import experts, features, fit, infer, refine, rulebase, rules, scaling, trees, tsk, type2
from hazelogic.plans.registry import _FITS, _LONG, FEATURES, KEY, fitted, lines, query, r
from hazelogic.sources import table

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# ------------------------------------------------------------ shapes


def _trap(a: float, b: float, c: float, d: float) -> str:
    return f"CASE WHEN q BETWEEN {b} AND {c} THEN 1 WHEN q > {a} AND q < {b} THEN (q - {a}) / ({b} - {a}) WHEN q > {c} AND q < {d} THEN ({d} - q) / ({d} - {c}) ELSE 0 END"


def _tri(a: float, b: float, c: float) -> str:
    return f"CASE WHEN q = {b} THEN 1 WHEN q > {a} AND q < {b} THEN (q - {a}) / ({b} - {a}) WHEN q > {b} AND q < {c} THEN ({c} - q) / ({c} - {b}) ELSE 0 END"


# legs times 1.25 and 0.75; at alpha 0.5 half way back to the shape
@query(f"""SELECT {_K}, round({_trap(7.5, 20, 30, 50)}, 6) AS trap_upper, round({_trap(12.5, 20, 30, 42)}, 6) AS trap_lower, round({_trap(8.75, 20, 30, 48)}, 6) AS trap_cut_upper, round({_trap(11.25, 20, 30, 44)}, 6) AS trap_cut_lower,
round({_tri(7.5, 20, 45)}, 6) AS tri_upper, round({_tri(12.5, 20, 35)}, 6) AS tri_lower, round({_tri(8.75, 20, 42.5)}, 6) AS tri_cut_upper, round({_tri(11.25, 20, 37.5)}, 6) AS tri_cut_lower,
round(exp(-0.5 * pow((q - 25) / 10.0, 2)), 6) AS gauss_upper, round(exp(-0.5 * pow((q - 25) / 9.0, 2)), 6) AS gauss_cut_upper FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def m7_m10_type2_shapes(spark, d):
    """Widened bounds and an alpha plane of all three shapes."""
    x, out = F.col("l_quantity"), []
    for name, shape in (("trap", shapes.trapezoid(10, 20, 30, 46)), ("tri", shapes.triangle(10, 20, 40)), ("gauss", shapes.gaussian(25, 8))):
        whole = shape.general(0.25)
        out += [(f"{name}_upper", whole.alpha_cut(0).upper), (f"{name}_lower", whole.alpha_cut(0).lower), (f"{name}_cut_upper", whole.alpha_cut(0.5).upper), (f"{name}_cut_lower", whole.alpha_cut(0.5).lower)]
    out = [(n, s) for n, s in out if n not in ("gauss_lower", "gauss_cut_lower")]
    return lines(spark, d, "l_quantity").select(*KEY, *[r(s.at(x)).alias(n) for n, s in out])


@query(f"SELECT feature, label, round(mu - 2.33293 * sigma, 4) AS a, round(mu, 4) AS b, round(mu + 2.33293 * sigma, 4) AS c FROM ({_FITS})")
def m11_triangles_of_a_model(spark, d):
    _, m = fitted(spark, d)
    made = m.mapped(lambda s: s.as_triangle())
    return spark.createDataFrame([(f, x, *[round(p, 4) for p in s.params]) for (f, x), v in made.cells.items() for s in v], "feature string, label string, a double, b double, c double")


# ------------------------------------------------------------ firing with several memberships a cell


_TWO = {("l_quantity", "A"): [(10.0, 6.0), (30.0, 8.0)], ("l_quantity", "N"): [(20.0, 5.0), (45.0, 9.0)], ("l_discount", "A"): [(0.02, 0.02), (0.08, 0.01)], ("l_discount", "N"): [(0.05, 0.03)]}


def _g(x: str, mu: float, sigma: float) -> str:
    return f"exp(-0.5 * pow(({x} - {mu}) / {sigma}, 2))"


def _or(family: str, parts: list[str]) -> str:
    if len(parts) == 1:
        return parts[0]
    a, b = parts
    return {"probability": f"({a} + {b} - {a} * {b})", "min_max": f"greatest({a}, {b})", "luk": f"least(1, {a} + {b})", "einstein": f"(({a} + {b}) / (1 + {a} * {b}))"}[family]


def _and(family: str, a: str, b: str) -> str:
    return {"probability": f"{a} * {b}", "min_max": f"least({a}, {b})", "luk": f"greatest(0, {a} + {b} - 1)", "einstein": f"{a} * {b} / (2 - ({a} + {b} - {a} * {b}))"}[family]


def _two_parts(family: str):
    cell = {k: _or(family, [_g(k[0], *p) for p in v]) for k, v in _TWO.items()}
    sql = f"SELECT {_K}, " + ", ".join(f"round({_and(family, cell['l_quantity', x], cell['l_discount', x])}, 6) AS s_{x.lower()}" for x in "AN") + " FROM lineitem"

    def f(spark, d):
        m = infer.Model(_TWO)
        s = lines(spark, d, "l_quantity", "l_discount").select(*KEY, infer.firing(m, family).alias("s"))
        return s.select(*KEY, *[r(F.get("s", F.lit(i))).alias(f"s_{x.lower()}") for i, x in enumerate(m.labels)])

    f.__name__ = f"i1_two_parts_{family}"
    query(sql)(f)


for _family in ("probability", "min_max", "luk", "einstein"):
    _two_parts(_family)


@query(f"""WITH e AS (SELECT {_K}, ln(0.5) + ln(({" + ".join(f"exp(-pow(l_quantity - {m}, 2) / (2 * {s} * {s})) / ({s} * sqrt(2 * pi()))" for m, s in _TWO["l_quantity", "A"])}) / 2) AS a, ln(0.5) + ln(({" + ".join(f"exp(-pow(l_quantity - {m}, 2) / (2 * {s} * {s})) / ({s} * sqrt(2 * pi()))" for m, s in _TWO["l_quantity", "N"])}) / 2) AS n FROM lineitem)
SELECT {_K}, round(a, 5) AS e_a, round(1 / (1 + exp(n - a)), 5) AS p_a FROM e""")
def i16_evidence_of_mixtures(spark, d):
    m = infer.Model({k: v for k, v in _TWO.items() if k[0] == "l_quantity"})
    s = lines(spark, d, "l_quantity").select(*KEY, infer.log_evidence(m, {"A": -0.6931471805599453, "N": -0.6931471805599453}, {}).alias("s"))
    return s.select(*KEY, r(F.get("s", F.lit(0)), 5).alias("e_a"), r(F.get(infer.softmax(F.col("s")), F.lit(0)), 5).alias("p_a"))


# ------------------------------------------------------------ type-2 by planes

_PLANES = (1 / 3, 2 / 3, 1.0)
_BOTH = f"SELECT x.{', x.'.join(_K.split(', '))}, x.value, f.label, f.mu, f.sigma FROM ({_LONG}) x JOIN ({_FITS}) f ON x.feature = f.feature"


def _strength(scale: float) -> str:
    return f"product(exp(-0.5 * pow((value - mu) / (sigma * {scale!r}), 2)))"


_PLANED = f"SELECT {_K}, label, " + ", ".join(f"{_strength(1.3 - 0.3 * a)} AS hi{i}, {_strength(0.7 + 0.3 * a)} AS lo{i}" for i, a in enumerate(_PLANES)) + f" FROM ({_BOTH}) GROUP BY ALL"


@query(f"SELECT {_K}, label, round(({' + '.join(f'{a!r} * (hi{i} + lo{i}) / 2' for i, a in enumerate(_PLANES))}) / 2.0, 6) AS strength FROM ({_PLANED})")
def i15_gt2_firing(spark, d):
    """Crisp strengths of a general type-2 model over three planes."""
    df, m = fitted(spark, d)
    whole = type2.Type2.of(m, 0.3, general=True)
    s = df.select(*KEY, type2.gt2_firing(whole, 3).alias("s"))
    return s.select(*KEY, F.explode(F.arrays_zip(F.array(*map(F.lit, m.labels)).alias("label"), F.col("s").alias("v"))).alias("e")).select(*KEY, "e.label", r(F.col("e.v")).alias("strength"))


_VALUE = "CASE label WHEN 'A' THEN 1 + 2 * l_discount WHEN 'N' THEN 2 - l_tax ELSE 3 + 0.5 * l_discount - l_tax END"


def _km_sql(hi: str, lo: str) -> str:
    return f"""SELECT {_K}, CASE WHEN max(th) <= 1e-6 THEN 0 ELSE least(min(tlv / tl), min((chv + tlv - clv) / (ch + tl - cl))) END AS y_l, CASE WHEN max(th) <= 1e-6 THEN 0 ELSE greatest(max(thv / th), max((clv + thv - chv) / (cl + th - ch))) END AS y_r FROM (
SELECT {_K}, sum({hi}) OVER w AS ch, sum({lo}) OVER w AS cl, sum({hi} * v) OVER w AS chv, sum({lo} * v) OVER w AS clv, sum({hi}) OVER a AS th, sum({lo}) OVER a AS tl, sum({hi} * v) OVER a AS thv, sum({lo} * v) OVER a AS tlv FROM t WINDOW w AS (PARTITION BY {_K} ORDER BY v, label), a AS (PARTITION BY {_K})) GROUP BY ALL"""


@query(f"""WITH t AS (SELECT i.*, {_VALUE} AS v FROM ({_PLANED}) i JOIN lineitem USING ({_K}))
SELECT {_K}, round(sum(a * y_l) / 2, 5) AS y_l, round(sum(a * y_r) / 2, 5) AS y_r FROM ({" UNION ALL ".join(f"SELECT {a!r} AS a, * FROM ({_km_sql(f'hi{i}', f'lo{i}')})" for i, a in enumerate(_PLANES))}) GROUP BY ALL""")
def i15_gt2_intervals(spark, d):
    """Karnik-Mendel ends of three planes, weighted by alpha, with consequents as an operator (I8)."""
    df, m = fitted(spark, d)
    values = infer.rule_values([1.0, 2.0, 3.0], [[2.0, 0.0], [0.0, -1.0], [0.5, -1.0]], infer.consequent_terms(["l_discount", "l_tax"], "1st"))
    got = type2.intervals(df, KEY, values, type2.gt2_rule_firing(type2.Type2.of(m, 0.3, general=True), 3))
    return got.select(*KEY, r(F.col("y_l"), 5).alias("y_l"), r(F.col("y_r"), 5).alias("y_r"))


@query(f"SELECT label, count(*) AS n FROM (SELECT {_K}, first(label ORDER BY s DESC, label) AS label FROM (SELECT {_K}, label, ({_strength(1.2)} + {_strength(0.8)}) / 2 AS s FROM ({_BOTH}) GROUP BY ALL) GROUP BY ALL) GROUP BY label")
def h13_it2_classifier(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    c = type2.Type2Classifier(FEATURES, "l_returnflag", 0.2).fit(df)
    return df.select(c.predict().alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT label, count(*) AS n FROM (SELECT {_K}, first(label ORDER BY s DESC, label) AS label FROM (SELECT {_K}, label, {' + '.join(f'{a!r} * (hi{i} + lo{i})' for i, a in enumerate(_PLANES))} AS s FROM ({_PLANED})) GROUP BY ALL) GROUP BY label")
def h13_gt2_classifier(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    c = type2.Type2Classifier(FEATURES, "l_returnflag", 0.3, planes=3).fit(df)
    return df.select(c.predict().alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query()
def h13_it2_regressor(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    got = type2.Type2Regressor(["l_quantity", "l_discount"], "y", KEY, calibrate=0.2).fit(df).intervals(df)
    return got.select(*KEY, *[r(F.col(c), 3).alias(c) for c in ("y_l", "y_r", "y")])


@query()
def h13_gt2_regressor(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    got = type2.Type2Regressor(["l_quantity", "l_discount"], "y", KEY, planes=3).fit(df).intervals(df)
    return got.select(*KEY, *[r(F.col(c), 3).alias(c) for c in ("y_l", "y_r", "y")])


# ------------------------------------------------------------ consequents

_TERMS = "l_quantity, l_discount, l_quantity * l_quantity, l_discount * l_discount, l_quantity * l_discount".split(", ")


@query("SELECT " + _K + ", round(2 + " + " + ".join(f"{c} * ({t})" for c, t in zip((0.1, -3.0, 0.01, 5.0, 0.2), _TERMS, strict=True)) + ", 6) AS value FROM lineitem")
def i7_i8_full_second_order(spark, d):
    values = infer.rule_values([2.0], [[0.1, -3.0, 0.01, 5.0, 0.2]], infer.consequent_terms(["l_quantity", "l_discount"], "full-2nd"))
    return lines(spark, d, "l_quantity", "l_discount").select(*KEY, r(values[0]).alias("value"))


@query(f"SELECT {_K}, round(exp(-0.5 * (pow(q - 0.2, 2) + pow(x - 0.5, 2))), 6) AS near_low, round(CASE WHEN pow(q - 0.8, 2) + pow(x - 0.5, 2) <= 0.09 THEN exp(-0.5 * (pow(q - 0.8, 2) + pow(x - 0.5, 2))) ELSE 0 END, 6) AS near_high FROM (SELECT *, l_quantity / 50 AS q, l_discount * 10 AS x FROM lineitem)")
def i7_rbf_terms(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount").select(*KEY, (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("x"))
    a = infer.consequent_terms(["q", "x"], kind="rbf", centres=[[0.2, 0.5]], gamma=0.5)[0]
    b = infer.consequent_terms(["q", "x"], kind="rbf", centres=[[0.8, 0.5]], gamma=0.5, radius=0.3)[0]
    return df.select(*KEY, r(a).alias("near_low"), r(b).alias("near_high"))


_W = "SELECT l_extendedprice / 1000 AS y, a / (a + b) AS u, b / (a + b) AS v FROM (SELECT *, exp(-0.5 * pow((l_quantity - 15) / 10.0, 2)) AS a, exp(-0.5 * pow((l_quantity - 35) / 12.0, 2)) AS b FROM lineitem) WHERE a + b > 1e-6"


@query(f"SELECT round((suy * svv - svy * suv) / (suu * svv - suv * suv), 4) AS mean_0, round((svy * suu - suy * suv) / (suu * svv - suv * suv), 4) AS mean_1, round((svy - 10 * suv) / svv, 4) AS mean_1_pinned FROM (SELECT sum(u * u) AS suu, sum(v * v) AS svv, sum(u * v) AS suv, sum(u * y) AS suy, sum(v * y) AS svy FROM ({_W}))")
def r1_tsk_solve(spark, d):
    """Two rules of constant value, solved freely and with the first mean pinned at 10."""
    m = infer.Model({("l_quantity", "0"): [(15.0, 10.0)], ("l_quantity", "1"): [(35.0, 12.0)]})
    xx, xy, _ = tsk.gram(table(spark, d, "lineitem", "l_quantity", "l_extendedprice"), tsk.design(infer.firing(m), []), F.col("l_extendedprice") / 1000)
    free, _ = tsk.solve(xx, xy, 2, 0.0)
    held, _ = tsk.solve(xx, xy, 2, 0.0, {0: 10.0})
    return spark.createDataFrame([(round(float(free[0]), 4), round(float(free[1]), 4), round(float(held[1]), 4))], "mean_0 double, mean_1 double, mean_1_pinned double")


@query()
def h14_tsk_regressor(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    return df.select(*KEY, r(tsk.TskRegressor(["l_quantity", "l_discount"], "y", order="2nd", l2=1e-3).fit(df).predict(), 3).alias("value"))


@query(f"SELECT {_K}, round(mean_0 * u + mean_1 * v, 4) AS value FROM (SELECT *, CASE WHEN a + b > 1e-6 THEN a / (a + b) ELSE 0.5 END AS u, CASE WHEN a + b > 1e-6 THEN b / (a + b) ELSE 0.5 END AS v FROM (SELECT *, exp(-0.5 * pow((l_quantity - 15) / 2.0, 2)) AS a, exp(-0.5 * pow((l_quantity - 20) / 2.0, 2)) AS b FROM lineitem)), (SELECT (suy * svv - svy * suv) / (suu * svv - suv * suv) AS mean_0, (svy * suu - suy * suv) / (suu * svv - suv * suv) AS mean_1 FROM (SELECT sum(u * u) AS suu, sum(v * v) AS svv, sum(u * v) AS suv, sum(u * y) AS suy, sum(v * y) AS svy FROM (SELECT l_extendedprice / 1000 AS y, CASE WHEN a + b > 1e-6 THEN a / (a + b) ELSE 0.5 END AS u, CASE WHEN a + b > 1e-6 THEN b / (a + b) ELSE 0.5 END AS v FROM (SELECT *, exp(-0.5 * pow((l_quantity - 15) / 2.0, 2)) AS a, exp(-0.5 * pow((l_quantity - 20) / 2.0, 2)) AS b FROM lineitem))))")
def r3_uniform_blend(spark, d):
    """Consequents of least squared error where rows that no rule fires for blend all rules alike."""
    m = infer.Model({("l_quantity", "0"): [(15.0, 2.0)], ("l_quantity", "1"): [(20.0, 2.0)]})
    df = lines(spark, d, "l_quantity", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    means, more = tsk.optimise(df, infer.firing(m), [], F.col("y"), 2, l2=0.0)
    weights = tsk.blend_weights(infer.firing(m), 2)
    return df.select(*KEY, r(infer.tsk_value(weights, infer.rule_values(list(means), [list(c) for c in more], [])), 4).alias("value"))


# ------------------------------------------------------------ scores, buckets, scalers


_PAIR = f"""SELECT feature, sum(1 - bc) AS score FROM (SELECT x.feature, x.label AS a, y.label AS b, sum(sqrt(x.p * y.p)) AS bc FROM s x JOIN s y ON x.feature = y.feature AND x.k = y.k AND x.label < y.label GROUP BY ALL) GROUP BY feature"""
_SHARES = f"""WITH e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM ({_LONG}) GROUP BY 1), g AS (SELECT f.feature, f.label, k, exp(-0.5 * pow((lo + (hi - lo) * k / 99 - mu) / sigma, 2)) AS p FROM ({_FITS}) f JOIN e USING (feature), range(100) t(k)), s AS (SELECT feature, label, k, p / sum(p) OVER (PARTITION BY feature, label) AS p FROM g)"""


@query(f"{_SHARES} SELECT feature, round(score / max(score) OVER (), 4) AS score, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM ({_PAIR})")
def s4_s5_feature_ranking(spark, d):
    got = features.differentiation(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag", "bhattacharyya")
    return features.rank_features(got).select("feature", r(F.col("score"), 4).alias("score"), "rank")


@query(f"{_SHARES} SELECT feature FROM (SELECT feature, score / max(score) OVER () AS s FROM ({_PAIR})) WHERE s >= 0.5")
def s6_top_features(spark, d):
    got = features.differentiation(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag", "bhattacharyya")
    return features.take_top(features.rank_features(got), top_p=0.5).select("feature")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
k AS (SELECT (p > a)::INT + (p > b)::INT + (p > c)::INT AS bucket, p, lo, hi FROM (SELECT o_totalprice AS p FROM orders), q)
SELECT bucket, count(*) AS n, round(CASE bucket WHEN 0 THEN any_value(lo) WHEN 3 THEN any_value(hi) ELSE avg(p) END, 2) AS centre FROM k GROUP BY bucket""")
def s12_quantile_buckets(spark, d):
    rows, means = features.output_partition(table(spark, d, "orders", "o_totalprice"), "o_totalprice", 4, "quantile")
    centre = F.element_at(F.array(*map(F.lit, means)), F.col("bucket") + 1)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r(F.first(centre), 2).alias("centre"))


@query("SELECT c_custkey, round((c_acctbal - lo) / (hi - lo) * 2 - 1, 6) AS scaled, round(c_acctbal, 4) AS back, round((c_acctbal - m) / s, 6) AS z, round(c_acctbal, 4) AS z_back FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def p3_p4_inverses(spark, d):
    df = table(spark, d, "customer", "c_custkey", "c_acctbal")
    a, b = scaling.fit_min_max(df, ["c_acctbal"], -1.0, 1.0), scaling.fit_z_score(df, ["c_acctbal"])
    x, z = a.transform("c_acctbal"), b.transform("c_acctbal")
    return df.select("c_custkey", r(x).alias("scaled"), r(a.inverse(x, "c_acctbal"), 4).alias("back"), r(z).alias("z"), r(b.inverse(z, "c_acctbal"), 4).alias("z_back"))


@query(f"SELECT {_K}, round((pow(x, 2) * cyy - 2 * x * y * cxy + pow(y, 2) * cxx) / (cxx * cyy - cxy * cxy), 5) AS d2 FROM (SELECT *, l_quantity - mx AS x, l_tax - my AS y FROM lineitem, (SELECT avg(l_quantity) AS mx, avg(l_tax) AS my, var_samp(l_quantity) AS cxx, var_samp(l_tax) AS cyy, covar_samp(l_quantity, l_tax) AS cxy FROM lineitem))")
def p5_pca_whitening(spark, d):
    """Squared lengths of whitened rows are Mahalanobis distances, whatever the axes' signs."""
    df, cols = lines(spark, d, "l_quantity", "l_tax"), ["l_quantity", "l_tax"]
    a, b = scaling.whitened(cols, *scaling.pca_whitening(df, cols))
    return df.select(*KEY, r(a * a + b * b, 5).alias("d2"))


@query(f"""WITH c AS (SELECT *, l_quantity - mx AS x, (l_tax - my) * 100 AS y FROM lineitem, (SELECT avg(l_quantity) AS mx, avg(l_tax) AS my FROM lineitem)),
s AS (SELECT count(*) AS n, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy, avg(pow(x * x + y * y, 2)) AS four FROM c),
m AS (SELECT *, (xx + yy) / 2 AS mu, (pow(xx - yy, 2) / 2 + 2 * xy * xy) / 2 AS d2, (four - (xx * xx + yy * yy + 2 * xy * xy)) / n / 2 AS b2 FROM s),
k AS (SELECT *, least(b2, d2) / d2 AS share FROM m),
f AS (SELECT (1 - share) * xx + share * mu AS a, (1 - share) * xy AS b, (1 - share) * yy + share * mu AS e, share FROM k)
SELECT {_K}, round((e * x * x - 2 * b * x * y + a * y * y) / (a * e - b * b), 4) AS d2 FROM c, f""")
def p6_shrunk_whitening(spark, d):
    """Squared lengths of rows whitened by the Ledoit-Wolf covariance."""
    df = lines(spark, d, "l_quantity", "l_tax").withColumn("t", F.col("l_tax") * 100)
    mean, matrix, _ = scaling.shrunk_whitening(df, ["l_quantity", "t"])
    a, b = scaling.whitened(["l_quantity", "t"], mean, matrix)
    return df.select(*KEY, r(a * a + b * b, 4).alias("d2"))


# ------------------------------------------------------------ rules and trees


@query(f"SELECT {_K}, CASE WHEN l_quantity <= 10 THEN 'L' WHEN l_discount <= 0.05 THEN 'RL' ELSE 'RR' END AS leaf FROM lineitem")
def i27_tree_route(spark, d):
    route = trees.bsp_route({"": ("l_quantity", 10.0), "R": ("l_discount", 0.05)})
    return lines(spark, d, "l_quantity", "l_discount").select(*KEY, route.alias("leaf"))


@query(f"SELECT label AS l_returnflag, 'IF ' || string_agg(printf('%s is N(%.2f, %.2f)', feature, mu, sigma), ' AND ' ORDER BY printf('%s is N(%.2f, %.2f)', feature, mu, sigma)) || ' THEN ' || label AS rule FROM ({_FITS}) GROUP BY label")
def b13_rule_text(spark, d):
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    return rules.rule_text(f, "l_returnflag", digits=2)


@query("SELECT 4::BIGINT AS features, 12::BIGINT AS memberships, 81::BIGINT AS grid_rules, count(DISTINCT l_returnflag) AS labels FROM lineitem")
def b13_model_report(spark, d):
    f = fit.normal_fit(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    return rules.model_report(f, "l_returnflag")


@query(f"SELECT feature, label, coalesce(last_value(CASE WHEN near THEN other END IGNORE NULLS) OVER (PARTITION BY feature, label ORDER BY other), label) AS first_match FROM (SELECT a.feature, a.label, b.label AS other, abs(b.mu - a.mu) <= 1e-3 + 1e-2 * abs(a.mu) AND abs(b.sigma - a.sigma) <= 1e-3 + 1e-2 * abs(a.sigma) AS near FROM ({_FITS}) a LEFT JOIN ({_FITS}) b ON a.feature = b.feature AND b.label < a.label) QUALIFY row_number() OVER (PARTITION BY feature, label ORDER BY other DESC NULLS LAST) = 1")
def b3_last_match(spark, d):
    """The last earlier membership of the feature that each is near, before chains are followed."""
    _, m = fitted(spark, d)
    cells, out = m.shapes(), []
    for (f, x), (own, *_) in sorted(cells.items()):
        near = [y for (g, y), (p, *_) in sorted(cells.items()) if g == f and y < x and p.near(own)]
        out.append((f, x, near[-1] if near else x))
    kept, target = rules.dedup_model(cells)
    assert sum(map(len, kept.values())) == sum(k == v for k, v in target.items())
    return spark.createDataFrame(out, "feature string, label string, first_match string")


@query("""WITH RECURSIVE c AS (SELECT l_returnflag AS label, CASE WHEN l_quantity <= 17.5 THEN 1 WHEN l_quantity <= 32.5 THEN 2 ELSE 3 END AS q, CASE WHEN l_discount <= 0.055 THEN 1 ELSE 2 END AS d, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT label, q, d FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS total FROM c) WHERE n >= ceil(total * 0.05)),
e AS (SELECT x.label, x.q AS q1, x.d AS d1, y.q AS q2, y.d AS d2 FROM t x JOIN t y ON x.label = y.label AND abs(x.q - y.q) <= 1 AND abs(x.d - y.d) <= 1),
reach AS (SELECT * FROM e UNION SELECT r.label, r.q1, r.d1, e.q2, e.d2 FROM reach r JOIN e ON e.label = r.label AND e.q1 = r.q2 AND e.d1 = r.d2),
m AS (SELECT label, q1, d1, min(q2 * 100 + d2) AS least FROM reach GROUP BY ALL)
SELECT label, (dense_rank() OVER (PARTITION BY label ORDER BY least) - 1)::INT AS cluster, '(' || q1 || ', ' || d1 || ')' AS term_tuple FROM m""")
def b9_joint_clusters(spark, d):
    terms = {"q": rules.ruspini_terms(F.col("l_quantity"), [10, 25, 40]), "d": rules.ruspini_terms(F.col("l_discount"), [0.01, 0.1])}
    got = rules.joint_clusters(rules.term_tuples(table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount"), "l_returnflag", terms, 0.05), "l_returnflag")
    return spark.createDataFrame([(x, i, str(t)) for x, gs in sorted(got.items()) for i, g in enumerate(gs) for t in g], "label string, cluster int, term_tuple string")


@query()
def h4_differentiation_tree(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    tree = trees.grow(df, FEATURES, "l_returnflag", "differentiation", 1, min_gain=0.0)
    p = trees.predict_proba(tree, trees.leaf_classes(df, tree, "l_returnflag", ["A", "N", "R"]))
    return df.select(*KEY, infer.classify(p, ["A", "N", "R"]).alias("predicted"))


@query()
def h8_tree_experts(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    e = experts.TreeExperts(["l_quantity", "l_discount"], "y", options={"max_depth": 1}).fit(df)
    return df.select(*KEY, r(e.predict(), 3).alias("value"))


@query()
def h9_cascade(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    return df.select(*KEY, experts.Cascade(FEATURES, "l_returnflag", KEY).fit(df).predict().alias("predicted"))


@query("WITH s AS (SELECT event_id, -0.5 * pow((value - m) / s, 2) AS s FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)), o AS (SELECT quantile_cont(s, 0.05) AS o FROM s) SELECT event_id, CASE WHEN s < o THEN -1 ELSE 1 END AS predicted FROM s, o")
def i18_one_class(spark, d):
    ev = table(spark, d, "events", "event_id", "value")
    return ev.select("event_id", experts.OneClass(["value"], contamination=0.05).fit(ev).predict().alias("predicted"))


@query(f"SELECT {_K}, round((CASE WHEN l_quantity > 25 THEN 0.8 ELSE 0.3 END + CASE WHEN l_tax > 0.04 THEN 0.6 ELSE 0.1 END) / 2, 6) AS p FROM lineitem")
def i26_soft_vote(spark, d):
    two = lambda c, a, b: F.array(F.when(c, a).otherwise(b), F.when(c, 1 - a).otherwise(1 - b))
    p = rulebase.soft_vote([two(F.col("l_quantity") > 25, 0.8, 0.3), two(F.col("l_tax") > 0.04, 0.6, 0.1)], 2)
    return lines(spark, d, "l_quantity", "l_tax").select(*KEY, r(F.get(p, F.lit(0))).alias("p"))


@query(f"SELECT feature, round(var_pop(value) * 1e-9, 12) AS floor FROM ({_LONG}) GROUP BY feature")
def f16_variance_floor(spark, d):
    return fit.variance_floor(lines(spark, d, *FEATURES), FEATURES).select("feature", r(F.col("floor"), 12).alias("floor"))


# ------------------------------------------------------------ refinement of estimators


@query()
def t6_refine_regressor(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    reg = tsk.TskRegressor(["l_quantity", "l_discount"], "y", buckets=3).fit(df)
    refine.refine_regressor(df, reg, fold=F.pmod(F.xxhash64(*KEY), F.lit(3)), sweeps=1)
    return df.select(*KEY, r(reg.predict(), 3).alias("value"))


@query()
def t10_refine_partition(spark, d):
    df, model = fitted(spark, d)
    part = rulebase.ruspinize(df, model, "l_returnflag")
    moved, _ = refine.refine_partition(df, part, "l_returnflag", model.labels, sweeps=1)
    return df.select(*KEY, infer.classify(rulebase.partition_probabilities(moved, model.labels), model.labels).alias("predicted"))


def _refined(planes: int):
    def f(spark, d):
        df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
        reg = type2.Type2Regressor(["l_quantity", "l_discount"], "y", KEY, planes=planes, buckets=3).fit(df)
        refine.refine_widths(df, reg, sweeps=1)
        return df.select(*KEY, r(reg.predict_fast(), 3).alias("value"))

    f.__name__ = f"t1{2 if planes else 1}_refine_{'gt2' if planes else 'it2'}"
    query()(f)


for _planes in (0, 2):
    _refined(_planes)


@query()
def t8_population_search(spark, d):
    df, model = fitted(spark, d)
    got, _ = refine.refine_classifier(df, model, "l_returnflag", "multi", population=6, generations=1)
    return df.select(*KEY, infer.classify(infer.firing(got), got.labels).alias("predicted"))
