"""More queries: distances, mixtures, trees, partitions, solves and training steps.

Iterative fits have no SQL; tests hold them against NumPy or known answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hazelogic.functions import membership as mf
from hazelogic.operators import ensemble, fit, infer, interactions, mixtures, refine, rulebase, rules, scaling, solve, trees
from hazelogic.plans.registry import _FIRE, FEATURES, KEY, fitted, lines, query, r
from hazelogic.sources import table

_K = ", ".join(KEY)


def _wasserstein_sql(long: str) -> str:
    """`feature, a, b, d, pooled` from a relation of feature, label and value."""
    return f"""WITH long AS ({long}), labels AS (SELECT DISTINCT label FROM long),
pairs AS (SELECT x.label AS a, y.label AS b FROM labels x JOIN labels y ON x.label < y.label),
n AS (SELECT feature, label, count(*) AS n, var_pop(value) AS v FROM long GROUP BY ALL),
c AS (SELECT p.a, p.b, l.feature, l.value, count(*) FILTER (l.label = p.a) AS u, count(*) FILTER (l.label = p.b) AS w FROM long l JOIN pairs p ON l.label IN (p.a, p.b) GROUP BY ALL),
run AS (SELECT *, sum(u) OVER o AS cu, sum(w) OVER o AS cw, lead(value) OVER o - value AS dx FROM c WINDOW o AS (PARTITION BY a, b, feature ORDER BY value))
SELECT run.feature, run.a, run.b, sum(abs(cu / x.n - cw / y.n) * dx) AS d, any_value(sqrt((x.v + y.v) / 2)) AS pooled FROM run JOIN n x ON x.feature = run.feature AND x.label = run.a JOIN n y ON y.feature = run.feature AND y.label = run.b GROUP BY ALL"""


_LONG4 = "SELECT l_returnflag AS label, unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem"


# ------------------------------------------------------------ feature scoring


@query(f"SELECT feature, a, b, round(d / pooled, 6) AS distance FROM ({_wasserstein_sql(_LONG4)})")
def s3_label_wasserstein(spark, d):
    got = interactions.pair_distances(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag")
    return got.select("feature", "a", "b", r(F.col("wasserstein")).alias("distance"))


@query("""WITH f AS (SELECT l_returnflag AS label, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1),
e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
g AS (SELECT label, k, exp(-0.5 * pow((lo + (hi - lo) * k / 99 - mu) / s, 2)) AS p FROM f, e, range(100) t(k)),
h AS (SELECT label, k, p / sum(p) OVER (PARTITION BY label) AS p FROM g)
SELECT 'l_quantity' AS feature, x.label AS a, y.label AS b, round(1 - sum(sqrt(x.p * y.p)), 6) AS bhattacharyya, round(1 - sum(least(x.p, y.p)), 6) AS overlap
FROM h x JOIN h y ON x.k = y.k AND x.label < y.label GROUP BY x.label, y.label""")
def s3_grid_distances(spark, d):
    got = interactions.pair_distances(lines(spark, d, "l_quantity", "l_returnflag"), ["l_quantity"], "l_returnflag")
    return got.select("feature", "a", "b", r(F.col("bhattacharyya")).alias("bhattacharyya"), r(F.col("overlap")).alias("overlap"))


_LONG6 = "SELECT l_returnflag AS label, unnest(['l_quantity','l_discount','l_tax','l_quantity*l_discount','l_quantity*l_tax','l_discount*l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax, l_quantity * l_discount, l_quantity * l_tax, l_discount * l_tax]) AS value FROM lineitem"


@query(f"""WITH s AS (SELECT feature, sum(d / pooled) AS s FROM ({_wasserstein_sql(_LONG6)}) GROUP BY feature),
l AS (SELECT p.feature, a.feature AS fa, b.feature AS fb, p.s - greatest(a.s, b.s) AS lift FROM s p JOIN s a ON a.feature = split_part(p.feature, '*', 1) JOIN s b ON b.feature = split_part(p.feature, '*', 2) WHERE p.feature LIKE '%*%')
SELECT fa AS feature_a, fb AS feature_b, round(CASE WHEN max(lift) OVER () > 0 THEN lift / max(lift) OVER () ELSE lift END, 5) AS lift FROM l""")
def s7_interaction_lift(spark, d):
    got = interactions.interaction_lift(lines(spark, d, "l_quantity", "l_discount", "l_tax", "l_returnflag"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return got.withColumn("lift", r(F.col("lift"), 5))


_FEATURE_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_LONG10 = f"SELECT l_returnflag AS label, unnest([{', '.join(repr(x) for x in [*FEATURES, *[f'{a}*{b}' for a, b in _FEATURE_PAIRS]])}]) AS feature, unnest([{', '.join([*FEATURES, *[f'{a} * {b}' for a, b in _FEATURE_PAIRS]])}]) AS value FROM lineitem"


@query(f"""WITH s AS (SELECT feature, sum(d / pooled) AS s FROM ({_wasserstein_sql(_LONG10)}) GROUP BY feature),
l AS (SELECT a.feature AS fa, b.feature AS fb, p.s - greatest(a.s, b.s) AS lift FROM s p JOIN s a ON a.feature = split_part(p.feature, '*', 1) JOIN s b ON b.feature = split_part(p.feature, '*', 2) WHERE p.feature LIKE '%*%')
SELECT fa AS feature_a, fb AS feature_b, round(lift / max(lift) OVER (), 5) AS lift FROM l WHERE lift > 0 ORDER BY lift DESC, fa, fb LIMIT 3""")
def s8_top_interactions(spark, d):
    got = interactions.interaction_lift(lines(spark, d, *FEATURES, "l_returnflag"), FEATURES, "l_returnflag", "wasserstein")
    return interactions.top_interactions(got, 3).withColumn("lift", r(F.col("lift"), 5))


@query()
def s10_lasso_interactions(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax")
    df = df.withColumn("y", F.col("l_quantity") * F.col("l_discount") + F.col("l_tax"))
    return interactions.lasso_screen(df, ["l_quantity", "l_discount", "l_tax"], "y")


# ------------------------------------------------------------ mixtures and terms


@query("""WITH l AS (SELECT o_orderstatus AS label, o_totalprice AS v FROM orders), e AS (SELECT label, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
SELECT 'o_totalprice' AS feature, label, least(floor((v - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS n, round(sum(v), 2) AS s FROM l JOIN e USING (label) GROUP BY ALL""")
def f_binned_summary(spark, d):
    got = mixtures.binned(table(spark, d, "orders", "o_totalprice", "o_orderstatus"), ["o_totalprice"], "o_orderstatus", 64)
    return got.select("feature", "label", "bin", "n", r(F.col("s"), 2).alias("s"))


@query()
def f2_f5_mixture_fit(spark, d):
    return mixtures.mixture_fit(table(spark, d, "orders", "o_totalprice", "o_orderstatus"), ["o_totalprice"], "o_orderstatus")


@query()
def f10_f12_trapezoid_em(spark, d):
    return mixtures.shape_fit(table(spark, d, "orders", "o_totalprice", "o_orderstatus"), ["o_totalprice"], "o_orderstatus", 2)


@query()
def f10_f12_triangle_em(spark, d):
    return mixtures.shape_fit(table(spark, d, "orders", "o_totalprice", "o_orderstatus"), ["o_totalprice"], "o_orderstatus", 2, "triangle")


_DIST = "sqrt(pow(x.p_size - y.p_size, 2) + pow(x.p_retailprice / 100 - y.p_retailprice / 100, 2))"


@query(f"""WITH m AS (SELECT x.p_partkey, x.p_brand AS own, y.p_brand AS other, sum({_DIST}) AS s, count(*) AS n FROM part x, part y GROUP BY ALL),
a AS (SELECT p_partkey, CASE WHEN n > 1 THEN s / (n - 1) END AS a FROM m WHERE own = other), b AS (SELECT p_partkey, min(s / n) AS b FROM m WHERE own <> other GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM a JOIN b USING (p_partkey)""")
def f13_silhouette(spark, d):
    df = table(spark, d, "part", "p_size", "p_retailprice", "p_brand").withColumn("price", F.col("p_retailprice") / 100)
    return mixtures.euclidean_silhouette(df, ["p_size", "price"], "p_brand").select(r(F.col("silhouette")).alias("silhouette"))


@query()
def f15_linguistic_terms(spark, d):
    return mixtures.linguistic_terms(table(spark, d, "orders", "o_totalprice"), ["o_totalprice"])


# ------------------------------------------------------------ rules and partitions


@query(f"SELECT {_K}, first(label ORDER BY s DESC, label) AS predicted FROM ({_FIRE}) GROUP BY ALL")
def i4_b4_explicit_rules(spark, d):
    df, model = fitted(spark, d)
    ruleset = rulebase.explicit_rules(model)
    return df.select(*KEY, rulebase.classify_by_rules(rulebase.rule_strengths(ruleset), ruleset).alias("predicted"))


@query("""SELECT 'l_quantity' AS feature, label, term, round(activation, 6) AS activation FROM (SELECT l_returnflag AS label, unnest([0, 1, 2]) AS term,
unnest([avg(CASE WHEN l_quantity <= 10 THEN 1 ELSE greatest(0, (30 - l_quantity) / 20) END), avg(CASE WHEN l_quantity <= 30 THEN greatest(0, (l_quantity - 10) / 20) ELSE greatest(0, (50 - l_quantity) / 20) END), avg(CASE WHEN l_quantity <= 50 THEN greatest(0, (l_quantity - 30) / 20) ELSE 1 END)]) AS activation FROM lineitem GROUP BY 1)""")
def b8_term_activations(spark, d):
    got = rulebase.term_activations(table(spark, d, "lineitem", "l_quantity", "l_returnflag"), "l_returnflag", {"l_quantity": [10.0, 30.0, 50.0]})
    return got.withColumn("activation", r(F.col("activation")))


@query()
def b8_b12_ruspini_classify(spark, d):
    df, model = fitted(spark, d)
    part = rulebase.complete_gaps(rulebase.ruspinize(df, model, "l_returnflag"), {"l_quantity": (1.0, 50.0)})
    p = rulebase.partition_probabilities(part, model.labels)
    return df.select(*KEY, infer.classify(p, model.labels).alias("predicted"))


@query(f"""WITH t AS (SELECT {_K}, CASE WHEN l_quantity <= 10 THEN 1 ELSE greatest(0, (30 - l_quantity) / 20) END AS lo, CASE WHEN l_quantity <= 30 THEN greatest(0, (l_quantity - 10) / 20) ELSE greatest(0, (50 - l_quantity) / 20) END AS mid, CASE WHEN l_quantity <= 50 THEN greatest(0, (l_quantity - 30) / 20) ELSE 1 END AS hi FROM lineitem),
s AS (SELECT *, lo + hi AS a, 1 - (1 - mid) * (1 - hi) AS n FROM t) SELECT {_K}, round(a / (a + n), 6) AS p_a, round(n / (a + n), 6) AS p_n FROM s""")
def i19_ruspini_probabilities(spark, d):
    part = rulebase.Partition({"l_quantity": [10.0, 30.0, 50.0]}, [rulebase.Rule("A", {"l_quantity": [0]}), rulebase.Rule("N", {"l_quantity": [1, 2]}), rulebase.Rule("A", {"l_quantity": [2]})])
    p = rulebase.partition_probabilities(part, ["A", "N"])
    return lines(spark, d, "l_quantity").select(*KEY, r(F.get(p, F.lit(0))).alias("p_a"), r(F.get(p, F.lit(1))).alias("p_n"))


_VOTES = "CASE WHEN l_quantity > 25 THEN 'N' ELSE 'A' END", "CASE WHEN l_discount > 0.05 THEN 'N' ELSE 'R' END", "CASE WHEN l_tax > 0.04 THEN 'A' ELSE 'R' END"


@query(f"""SELECT {_K}, CASE WHEN a >= n AND a >= x THEN 'A' WHEN n >= x THEN 'N' ELSE 'R' END AS vote FROM (SELECT {_K}, {", ".join("+".join(f"({v} = '{c}')::INT" for v in _VOTES) + f" AS {name}" for c, name in (("A", "a"), ("N", "n"), ("R", "x")))} FROM lineitem)""")
def i26_hard_vote(spark, d):
    return lines(spark, d, "l_quantity", "l_discount", "l_tax").select(*KEY, rulebase.hard_vote([F.expr(v) for v in _VOTES], ["A", "N", "R"]).alias("vote"))


@query(f"SELECT {_K}, CASE WHEN b = 'N' AND l_tax > 0.02 AND l_discount < 0.05 THEN 'R' ELSE b END AS label FROM (SELECT *, CASE WHEN l_quantity > 25 THEN CASE WHEN l_tax > 0.05 AND l_discount < 0.08 THEN 'A' ELSE 'N' END ELSE 'A' END AS b FROM lineitem)")
def i25_cascade(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_tax")
    base = F.when(F.col("l_quantity") > 25, "N").otherwise("A")
    return df.select(*KEY, rulebase.cascade(base, [("N", "A", F.col("l_tax"), F.col("l_discount"), 0.08, 0.05), ("N", "R", F.col("l_tax"), F.col("l_discount"), 0.05, 0.02)]).alias("label"))


@query("""WITH s AS (SELECT l_discount AS a, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END) AS g FROM lineitem GROUP BY 1), c AS (SELECT a, sum(g) OVER (ORDER BY a) AS net FROM s),
b AS (SELECT net, a FROM c ORDER BY net DESC, a LIMIT 1) SELECT round(CASE WHEN net > 0 THEN a ELSE 0 END, 6) AS threshold, greatest(net, 0)::BIGINT AS net FROM b""")
def t13_best_threshold(spark, d):
    got = rulebase.best_threshold(table(spark, d, "lineitem", "l_discount", "l_quantity"), F.col("l_discount"), F.when(F.col("l_quantity") > 25, 1).otherwise(-1))
    return got.select(r(F.col("threshold")).alias("threshold"), "net")


# ------------------------------------------------------------ trees and experts


@query("""WITH t AS (SELECT l_returnflag AS c, unnest([10.0, 25.0, 40.0]) AS tau, l_quantity AS q FROM lineitem), k AS (SELECT tau, c, count(*) FILTER (q <= tau) AS l, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT tau, sum(n) AS sn, sum(l) AS sl, sum(n - l) AS sr, 1 - sum(n::DOUBLE * n) / pow(sum(n), 2) AS gn, 1 - sum(l::DOUBLE * l) / pow(sum(l), 2) AS gl, 1 - sum((n - l)::DOUBLE * (n - l)) / pow(sum(n - l), 2) AS gr FROM k GROUP BY 1)
SELECT 'l_quantity' AS feature, tau::DOUBLE AS tau, sn::BIGINT AS n, round(gn - (sl * gl + sr * gr) / sn, 8) AS gain FROM s""")
def h11_gini_gains(spark, d):
    got = trees.gini_gains(table(spark, d, "lineitem", "l_quantity", "l_returnflag"), "l_returnflag", {"l_quantity": [10.0, 25.0, 40.0]})
    return got.select("feature", "tau", "n", r(F.col("gain"), 8).alias("gain"))


@query()
def h11_bsp_tree(spark, d):
    df = table(spark, d, "documents", "doc_id", "text", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    df = df.select("doc_id", "quality", "n_chars", (F.length(F.regexp_replace("text", "[^ ]", "")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("spaces"))
    splits = trees.bsp_grow(df, ["n_chars", "spaces"], "quality", 4, 40)
    return df.groupBy(trees.bsp_route(splits).alias("leaf")).agg(F.count("*").alias("n"), F.avg("quality").alias("share"))


_BANDS = "CASE WHEN l_quantity <= 20 THEN 1 WHEN l_quantity < 29.5 THEN (29.5 - l_quantity) / 9.5 ELSE 0 END AS t0, CASE WHEN l_quantity >= 20 THEN 1 WHEN l_quantity > 5 THEN (l_quantity - 5) / 15 ELSE 0 END AS t1"


@query(f"SELECT {_K}, round((t0 * 10 + t1 * 30) / (t0 + t1), 6) AS value FROM (SELECT *, {_BANDS} FROM lineitem)")
def i21_i22_tree_value(spark, d):
    knots = [1.0, 20.0, 50.0]
    tree = trees.Node(feature="l_quantity", knots=knots, children=[trees.Node((t,), [("l_quantity", knots, t)]) for t in (0, 1)])
    return lines(spark, d, "l_quantity").select(*KEY, r(trees.predict(tree, [10.0, 30.0])).alias("value"))


@query(f"""SELECT {_K}, round(((a * c) * l_discount + (a * e) * 2 + (b * c) * l_tax + (b * e) * 3) / ((a + b) * (c + e)), 6) AS value FROM (SELECT *, exp(-0.5 * pow((l_quantity - 10) / 15, 2)) AS a, exp(-0.5 * pow((l_quantity - 40) / 15, 2)) AS b, exp(-0.5 * pow(l_tax / 0.04, 2)) AS c, exp(-0.5 * pow((l_tax - 0.08) / 0.04, 2)) AS e FROM lineitem)""")
def i23_i24_expert_blend(spark, d):
    gates = [[mf.gaussian(F.col("l_quantity"), 10.0, 15.0), mf.gaussian(F.col("l_quantity"), 40.0, 15.0)], [mf.gaussian(F.col("l_tax"), 0.0, 0.04), mf.gaussian(F.col("l_tax"), 0.08, 0.04)]]
    value = trees.blend(trees.responsibilities(gates), [F.col("l_discount"), F.lit(2.0), F.col("l_tax"), F.lit(3.0)])
    return lines(spark, d, "l_quantity", "l_tax", "l_discount").select(*KEY, r(value).alias("value"))


@query()
def h5_h7_regression_tree(spark, d):
    df = lines(spark, d, *FEATURES)
    tree = trees.prune(trees.grow(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", max_depth=2), 0.01)
    return df.select(*KEY, r(trees.predict(tree, trees.leaf_values(df, tree, "l_extendedprice")), 2).alias("value"))


@query()
def h3_h7_classification_tree(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    tree = trees.grow(df, FEATURES, "l_returnflag", "ambiguity", 2, min_gain=0.0)
    labels = ["A", "N", "R"]
    p = trees.predict_proba(tree, trees.leaf_classes(df, tree, "l_returnflag", labels))
    return df.select(*KEY, infer.classify(p, labels).alias("predicted"))


@query()
def r9_leaf_consequents(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice")
    tree = trees.grow(df, ["l_quantity"], "l_extendedprice", max_depth=1)
    got = trees.leaf_consequents(df, tree, ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(got)], "leaf int, intercept double, l_quantity double, l_discount double")


@query()
def t14_expert_em(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_extendedprice").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    got = refine.em_experts(df, ["l_quantity"], "y", [10.0, 40.0], rounds=5)
    return spark.createDataFrame([(i, float(got["gate_mu"][i]), float(got["share"][i]), float(got["beta"][i][1])) for i in range(2)], "expert int, gate_mu double, share double, slope double")


# ------------------------------------------------------------ solves, preprocessing, training


@query("SELECT l_linenumber AS bucket, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def r2_bucket_corrections(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_linenumber").withColumn("y", F.col("l_extendedprice") / 1000)
    got = solve.bucket_corrections(df, ["l_quantity"], "y", "l_linenumber")
    return spark.createDataFrame([(k, round(float(b[0]), 4), round(float(b[1]), 4)) for k, b in got.items()], "bucket int, intercept double, slope double")


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM part), v AS (SELECT m, unnest(q) AS v FROM q)
SELECT DISTINCT round(v, 4) AS centre FROM v""")
def r4_rbf_centres(spark, d):
    got = solve.rbf_centres(table(spark, d, "part", "p_retailprice"), ["p_retailprice"])
    return spark.createDataFrame(sorted({(round(c[0], 4),) for c in got}), "centre double")


@query()
def r5_choose_by_folds(spark, d):
    df = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    return solve.choose_by_folds(df, ["l_quantity", "l_discount"], "y", (1, 2))


@query()
def i20_r8_anfis(spark, d):
    df = lines(spark, d, "l_quantity", "l_discount", "l_extendedprice").withColumn("y", F.col("l_extendedprice") / 1000)
    net = solve.Anfis(["l_quantity", "l_discount"], "y", epochs=3).fit(df)
    return df.select(*KEY, r(net.predict(), 3).alias("value"))


@query("SELECT i, j, round(v, 8) AS v FROM (" + " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, covar_pop({a}, {b}) AS v FROM lineitem" for i, a in enumerate(("l_quantity", "l_discount", "l_tax")) for j, b in enumerate(("l_quantity", "l_discount", "l_tax"))) + ")")
def p5_covariance(spark, d):
    cov = scaling.covariance(table(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])[1]
    return spark.createDataFrame([(i, j, round(float(v), 8)) for i, row in enumerate(cov) for j, v in enumerate(row)], "i int, j int, v double")


def _moments(cols):
    return [r(f, 5).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("mean", F.abs(F.avg(c))), ("var", F.var_samp(c)))]


@query("""WITH t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
a AS (SELECT user_id, max(value) FILTER (k = 1) AS x, avg(value) FILTER (k <= 3) AS s, avg(value) FILTER (k IN (1, 2)) AS s2 , sum(value) FILTER (k <= 2) AS two, count(*) AS n FROM t GROUP BY 1),
b AS (SELECT *, x + 0.5 * (s - x) AS y FROM a)
SELECT user_id, unnest([0, 1]) AS step, round(unnest([y, y + 0.5 * ((y + two) / (1 + least(n, 2)) - y)]), 6) AS value FROM b""")
def p9_rollout(spark, d):
    got = scaling.rollout(table(spark, d, "events", "user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", lambda x, s, _: 0.5 * (s - x), 2)
    return got.select("user_id", "step", r(F.col("value")).alias("value"))


@query("SELECT l_returnflag AS label, floor(avg(count(*)) OVER ())::BIGINT - count(*) AS n FROM lineitem GROUP BY 1 QUALIFY n > 0")
def p10_oversample(spark, d):
    df, _ = fitted(spark, d)
    made = scaling.oversample(df, "l_returnflag", FEATURES, fit.normal_fit(df, FEATURES, "l_returnflag"))
    return made.groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT {_K}, round(g * (l_quantity - 20) / 100, 8) AS d_mu, round(g * pow(l_quantity - 20, 2) / 1000, 8) AS d_sigma FROM (SELECT *, exp(-0.5 * pow((l_quantity - 20) / 10, 2)) * (1 - exp(-0.5 * pow((l_quantity - 40) / 5, 2))) * exp(-0.5 * pow((l_discount - 0.05) / 0.03, 2)) AS g FROM lineitem)""")
def i28_firing_gradient(spark, d):
    model = infer.Model({("l_quantity", "A"): [(20.0, 10.0), (40.0, 5.0)], ("l_discount", "A"): [(0.05, 0.03)]})
    mu, sigma = refine.firing_gradient(model, "l_quantity", "A")
    return lines(spark, d, "l_quantity", "l_discount").select(*KEY, r(mu, 8).alias("d_mu"), r(sigma, 8).alias("d_sigma"))


@query("""SELECT count(*) AS n, count(*) FILTER (b AND a) AS both_right, count(*) FILTER (b AND NOT a) AS only_before, count(*) FILTER (a AND NOT b) AS only_after
FROM (SELECT l_returnflag = CASE WHEN l_quantity > 25 THEN 'N' ELSE 'A' END AS b, l_returnflag = CASE WHEN l_tax > 0.02 THEN 'N' ELSE 'R' END AS a FROM lineitem)""")
def t5_paired_counts(spark, d):
    df = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_tax").select("l_returnflag", F.when(F.col("l_quantity") > 25, "N").otherwise("A").alias("b"), F.when(F.col("l_tax") > 0.02, "N").otherwise("R").alias("a"))
    return refine.paired_counts(df, "l_returnflag", "b", "a")


@query()
def t1_t3_refine_classifier(spark, d):
    df, model = fitted(spark, d)
    got, _ = refine.refine_classifier(df, model, "l_returnflag", sweeps=1)
    return df.select(*KEY, infer.classify(infer.firing(got), got.labels).alias("predicted"))


# ------------------------------------------------------------ estimators made of others


@query()
def h10_bagging(spark, d):
    df, labels = lines(spark, d, *FEATURES, "l_returnflag"), ["A", "N", "R"]
    models = ensemble.bag(df, FEATURES, "l_returnflag", KEY, members=5, columns=0.75)
    p = ensemble.bag_probabilities(models, labels)
    return df.select(*KEY, *[r(F.get(p, F.lit(i))).alias(f"p_{x.lower()}") for i, x in enumerate(labels)])


@query()
def h15_few_shot(spark, d):
    df = lines(spark, d, *FEATURES, "l_returnflag")
    return df.select(*KEY, r(ensemble.few_shot(df, FEATURES, F.col("l_returnflag") == "R"), 4).alias("score"))


@query()
def h12_multi_output(spark, d):
    df = lines(spark, d, *FEATURES)
    make = lambda t: ensemble.TreeRegressor(["l_quantity", "l_discount"], t, options={"max_depth": 1})
    got = ensemble.MultiOutput(make, ["l_extendedprice", "l_tax"]).fit(df)
    price, tax = got.predict()
    return df.select(*KEY, r(price, 2).alias("price"), r(tax).alias("tax"))
