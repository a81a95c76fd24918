"""Shapes, type-2 models, consequent solves, experts and refinement against NumPy and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazelogic.functions import shapes
from hazelogic.operators import experts, features, fit, infer, mixtures, refine, rulebase, rules, scaling, trees, tsk, type2


def frame(spark, cols, *more):
    names = list(cols)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*cols.values(), strict=True)], names)


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 10, 400), rng.uniform(0, 1, 400)
    return frame(spark, {"id": np.arange(400), "x": x, "z": z, "y": np.sin(x) + 0.3 * z + rng.normal(0, 0.05, 400)})


def test_shapes():
    t, g, s = shapes.trapezoid(1, 2, 4, 7), shapes.gaussian(5, 2), shapes.triangle(-math.inf, 2, 5)
    assert t.widened(0.5).upper.params == (0.5, 2, 4, 8.5) and t.widened(0.95).lower.params == pytest.approx((1.9, 2, 4, 4.3))
    assert g.widened(0.3).upper.params == pytest.approx((5, 2.6)) and g.support() == (-1, 11) and t.support() == (1, 7)
    with pytest.raises(ValueError):
        s.widened(0.1)
    whole = shapes.triangle(0, 2, 6).general(0.5)
    assert whole.alpha_cut(0) == shapes.It2(whole.upper, whole.lower)
    assert whole.alpha_cut(1).upper == whole.alpha_cut(1).lower == whole.principal
    assert shapes.triangle(-9, 2, 6).towards(s, 0.5).params == (-math.inf, 2, 5.5)
    assert g.as_triangle().params == pytest.approx((5 - 2.33293 * 2, 5, 5 + 2.33293 * 2)) and t.as_triangle() == t
    assert s.near(s) and not g.near(t) and shapes.gaussian(1.009, 1).near(shapes.gaussian(1, 1)) and not shapes.gaussian(math.nan, 1).near(shapes.gaussian(math.nan, 1))
    with pytest.raises(ValueError):
        shapes.Shape("gaussian", (1.0,))


def test_order_statistics_and_quantiles(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=500), np.full(300, 0.25), [1e9, -1e9, 1e-300]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    shares = [0, 0.01, 0.25, 0.5, 0.731, 0.99, 1]
    assert fit.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(v, shares)), rel=1e-12)
    assert fit.quantiles(df.limit(0), "v", [0.5]) == []


def test_tsk_solve_is_the_constrained_minimum(spark, line):
    reg = tsk.TskRegressor(["x", "z"], "y", 4, "1st", 1e-3).fit(line)
    rows = line.orderBy("id").select(tsk.design(infer.firing(reg.model), reg.terms()).alias("d"), "y", reg.predict().alias("p")).collect()
    d, y, p = np.array([r.d for r in rows]), np.array([r.y for r in rows]), np.array([r.p for r in rows])
    free = np.ones(d.shape[1])
    free[:: len(reg.terms()) + 1] = 0
    beta = np.linalg.solve(d.T @ d + 1e-3 * np.diag(free), d.T @ y)
    assert np.allclose(p, d @ beta, atol=1e-4) and 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.6
    means, more = tsk.solve(d.T @ d, d.T @ y, 4, 1e-3, {0: -1.0, 3: 1.0})
    assert means[0] == -1.0 and means[3] == 1.0 and more.shape == (4, 2)
    held = np.column_stack([means, more]).ravel()
    for i in range(len(held)):
        if i not in (0, 9):
            for e in (1e-4, -1e-4):
                moved = held.copy()
                moved[i] += e
                cost = lambda b: ((y - d @ b) ** 2).sum() + 1e-3 * (free * b * b).sum()
                assert cost(moved) >= cost(held) - 1e-9
    with pytest.raises(ValueError):
        tsk.gram(line.limit(0), F.array(F.lit(1.0)), F.col("y"))


def test_output_partition(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.1, 0.2, 0.3, 10, 10, 10, 10, 10, 10]], "v double")
    with pytest.warns(UserWarning, match="fewer than"):
        cut, means = features.output_partition(df, "v", 4)
    assert {r.bucket for r in cut.collect()} == {0, 3} and means == pytest.approx([0.15, 0.15 + 9.85 / 3, 0.15 + 2 * 9.85 / 3, 10])
    with pytest.warns(UserWarning):
        _, pinned = features.output_partition(df, "v", 2, "quantile")
    assert pinned == [0.0, 10.0]
    with pytest.raises(ValueError):
        features.output_partition(df, "v", 2, "other")


def test_type2_regressor_contains_narrows_and_covers(spark, line):
    wide = type2.Type2Regressor(["x", "z"], "y", ["id"], width=0.3).fit(line)
    rows = wide.intervals(line).join(line, "id").withColumn("p", wide.base.predict()).collect()
    assert all(r.y_l - 1e-9 <= r.p <= r.y_r + 1e-9 for r in rows)
    none = type2.Type2Regressor(["x", "z"], "y", ["id"], width=0.0).fit(line).intervals(line)
    assert none.agg(F.max(F.col("y_r") - F.col("y_l"))).first()[0] < 1e-6
    planes = type2.Type2Regressor(["x", "z"], "y", ["id"], width=0.3, planes=3).fit(line)
    both = planes.intervals(line).select("id", F.col("y_l").alias("a"), F.col("y_r").alias("b")).join(wide.intervals(line), "id").collect()
    assert all(r.a >= r.y_l - 1e-9 and r.b <= r.y_r + 1e-9 for r in both)  # planes lie inside the footprint
    held = type2.Type2Regressor(["x", "z"], "y", ["id"], width=0.0, calibrate=0.4, alpha=0.1).fit(line)
    seen = held.intervals(line).select("id", "y_l", "y_r").join(line, "id").agg(F.avg(((F.col("y") >= F.col("y_l")) & (F.col("y") <= F.col("y_r"))).cast("double"))).first()[0]
    assert held.margin > 0 and seen > 0.85
    with pytest.raises(ValueError):
        wide.model.plane(0.5)


def test_type2_classifier_of_shapes(spark):
    m = infer.Model({("x", "a"): [shapes.trapezoid(0, 1, 2, 3)], ("x", "b"): [shapes.triangle(2, 4, 6), shapes.gaussian(8, 1)]})
    df = spark.createDataFrame([(v,) for v in (1.5, 2.5, 4.0, 8.0, 20.0)], "x double")
    c = type2.Type2Classifier(["x"], "label", 0.2, planes=2).fit(df, m)
    got = [(r.p, r.q) for r in df.select(c.predict().alias("p"), c.probabilities().alias("q")).collect()]
    assert [p for p, _ in got] == ["a", "a", "b", "b", "a"] and all(sum(q) == pytest.approx(1) for _, q in got)
    assert got[0][1] == pytest.approx([1.0, 0.0], abs=1e-6)


def test_incremental_firing_is_firing():
    rng = np.random.default_rng(3)
    m = infer.Model({(f, x): [(rng.normal(), rng.uniform(0.5, 2)) for _ in range(2)] for f in "fg" for x in "abc"})
    x, v = rng.normal(size=(50, 2)), refine.to_vector(m)
    fire = refine.IncrementalFiring(m)
    for c in [v, *(v + 0.3 * (np.arange(len(v)) == k) for k in range(len(v))), v + rng.normal(0, 0.1, len(v)), v]:
        assert np.allclose(fire(x, c), refine.firing_np(m, x, c), atol=1e-12)


def test_searches_never_end_worse(spark):
    target = np.array([0.3, -0.2, 0.8])
    evaluate = lambda c: ((c - target) ** 2).sum(axis=1)
    start, box = np.zeros(3), np.array([[-1.0, 1.0]] * 3)
    for method in ("ga", "pso", "aco", "multi"):
        v, value = refine.population_search(evaluate, start, box, method, share=2.0, generations=25)
        assert value < 0.2 * evaluate(start[None])[0] and value == pytest.approx(evaluate(v[None])[0])
        assert refine.population_search(evaluate, target, box, method)[1] <= 1e-12
    with pytest.raises(ValueError):
        refine.population_search(evaluate, start, box, "none")


def test_refinement_of_estimators_lessens_error(spark, line):
    mse = lambda c: line.agg(F.avg((c - F.col("y")) ** 2)).first()[0]
    reg = tsk.TskRegressor(["x", "z"], "y", 3, "1st").fit(line)
    before = mse(reg.predict())
    value = refine.refine_regressor(line, reg, sweeps=2)
    assert mse(reg.predict()) < before and value > 0
    for planes in (0, 2):
        est = type2.Type2Regressor(["x", "z"], "y", ["id"], width=0.6, planes=planes, buckets=3).fit(line)
        before = mse(est.predict_fast())
        refine.refine_widths(line, est, sweeps=2)
        assert mse(est.predict_fast()) <= before + 1e-9
        for k, v in est.model.upper.cells.items():
            assert all(u.params[1] >= low.params[1] for u, low in zip(v, est.model.lower.cells[k], strict=True))


def test_refine_partition_keeps_what_the_guard_accepts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 100), rng.normal(4, 1, 100)])
    df = frame(spark, {"x": x, "label": np.array(["a"] * 100 + ["b"] * 100)})
    part = rulebase.Partition({"x": [-3.0, 0.0, 7.0]}, [rulebase.Rule("a", {"x": [0, 1]}), rulebase.Rule("b", {"x": [2]})])
    right = lambda p: df.agg(F.avg((infer.classify(rulebase.partition_probabilities(p, ["a", "b"]), ["a", "b"]) == F.col("label")).cast("double"))).first()[0]
    moved, _ = refine.refine_partition(df, part, "label", ["a", "b"], sweeps=3)
    assert right(moved) >= right(part) and moved.knots["x"] == sorted(moved.knots["x"])


def test_tree_experts_find_pieces(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 10, 500)
    y = np.where(a < 5, 2 * a, -3 * a + 40) + rng.normal(0, 0.1, 500)
    df = frame(spark, {"a": a, "y": y})
    got = experts.TreeExperts(["a"], "y", options={"max_depth": 1, "min_gain": 0.0}).fit(df)
    r2 = lambda c: 1 - df.agg(F.avg((c - F.col("y")) ** 2) / F.var_pop("y")).first()[0]
    slope, mid = np.polyfit(a, y, 1)
    assert r2(got.predict()) > r2(F.col("a") * float(slope) + float(mid)) + 0.1
    few = experts.TreeExperts(["a"], "y", least_rows=10**6).fit(df)
    assert np.isfinite(few.beta).all() and (few.beta[:, 1:] == 0).all()


def test_cascade_never_loses_training_rows(spark):
    rng = np.random.default_rng(7)
    c = np.concatenate([rng.normal([0, 0], 0.6, (80, 2)), rng.normal([3, 3], 0.6, (80, 2)), rng.normal([1.5, 1.5], 0.8, (80, 2))])
    df = frame(spark, {"id": np.arange(240), "f": c[:, 0], "g": c[:, 1], "label": np.repeat(["a", "b", "c"], 80)})
    cas = experts.Cascade(["f", "g"], "label", ["id"]).fit(df)
    right = lambda p: df.agg(F.sum((p == F.col("label")).cast("int"))).first()[0]
    assert right(cas.predict()) >= right(infer.classify(infer.firing(cas.model), cas.model.labels))
    found = cas.confusions(df)
    assert found == sorted(found, key=lambda r: (-r[2], r[0], r[1])) and all(p != t for p, t, _ in found)


def test_one_class_and_classifiers(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, {f"c{i}": np.append(rng.normal(size=300), [6.0] * 20) for i in range(3)} | {"label": np.array(["n"] * 300 + ["o"] * 20)})
    for score in ("surprisal", "complement"):
        one = experts.OneClass(["c0", "c1", "c2"], score).fit(df.where("label = 'n'"))
        assert df.where("label = 'o'").where(one.predict() == 1).count() == 0 and df.where("label = 'n'").where(one.predict() == -1).count() == 0
    cut = experts.OneClass(["c0", "c1", "c2"], trim=1, contamination=0.1).fit(df.where("label = 'n'"))
    assert 25 <= df.where("label = 'n'").where(cut.predict() == -1).count() <= 31
    for options in ({}, {"calibrated": True}, {"refine_with": "coordinate"}):
        c = experts.FuzzyClassifier(["c0", "c1", "c2"], "label", **options).fit(df)
        assert df.where(c.predict() != F.col("label")).count() <= 2


def test_rules_scalers_and_scores(spark):
    near, far = shapes.gaussian(1.0, 1.0), shapes.gaussian(5.0, 1.0)
    kept, target = rules.dedup_model({("f", "a"): [near], ("f", "b"): [shapes.gaussian(1.005, 1.0), far], ("f", "c"): [shapes.gaussian(1.013, 1.0)]})
    assert kept == {("f", "a"): [near], ("f", "b"): [far], ("f", "c"): []}
    assert target["f", "c", 0] == ("f", "a", 0)  # through b's, which is near a's
    tuples = spark.createDataFrame([("x", 1, 1, 9), ("x", 2, 2, 9), ("x", 4, 2, 9), ("y", 1, 3, 9)], "label string, t_q int, t_d int, n long")
    assert rules.joint_clusters(tuples, "label") == {"x": [[(1, 1), (2, 2)], [(4, 2)]], "y": [[(1, 3)]]}
    df = frame(spark, {"c": np.array([2.0, 4.0, 6.0]), "k": np.array([7.0, 7.0, 7.0])})
    s = scaling.fit_min_max(df, ["c", "k"], -1.0, 1.0)
    assert [tuple(r) for r in df.select(s.transform("c"), s.transform("k"), s.inverse(s.transform("c"), "c")).collect()] == [(-1.0, -1.0, 2.0), (0.0, -1.0, 4.0), (1.0, -1.0, 6.0)]
    assert features.log_columns(df, ["c", "k"], ["k", 0]) == ["k", "c"]
    with pytest.raises(ValueError):
        features.log_columns(df, ["c"], ["nope"])
    rng = np.random.default_rng(9)
    p = frame(spark, {"u": rng.normal(size=60), "v": rng.normal(size=60), "g": np.repeat(["a", "b", "c"], 20)})
    x, g = np.array([(r.u, r.v) for r in p.collect()]), np.repeat([0, 1, 2], 20)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    own = [dist[i, g == g[i]].sum() / 19 for i in range(60)]
    other = [min(dist[i, g == k].mean() for k in range(3) if k != g[i]) for i in range(60)]
    want = np.mean([(b - a) / max(a, b) for a, b in zip(own, other, strict=True)])
    assert mixtures.euclidean_silhouette(p, ["u", "v"], "g").first()[0] == pytest.approx(want)


def test_euclidean_silhouette_takes_tables_of_any_size(spark, monkeypatch):
    """60,000 rows of 300 points in one chunk and in several, rows without a coordinate, a cluster of one row."""
    rng = np.random.default_rng(4)
    x, g = np.round(rng.normal(size=(300, 2)), 3), rng.integers(0, 3, 300)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    to = np.stack([dist[:, g == k].sum(axis=1) * 200 for k in range(3)], axis=1)
    size = np.bincount(g) * 200 + [100, 0, 0]
    a = to[np.arange(300), g] / (size[g] - 1)
    b = np.where(np.arange(3) == g[:, None], np.inf, to / size).min(axis=1)
    points = frame(spark, {"u": x[:, 0], "v": x[:, 1], "g": g})
    lacking = spark.range(100).select(F.lit(None).cast("double").alias("u"), F.lit(1.0).alias("v"), F.lit(0).cast("long").alias("g"))
    df = points.crossJoin(spark.range(200)).drop("id").unionByName(lacking)
    want = ((b - a) / np.maximum(a, b)).sum() * 200 / 60_100
    for chunk in (1 << 20, 70):
        monkeypatch.setattr(mixtures, "CHUNK", chunk)
        assert mixtures.euclidean_silhouette(df, ["u", "v"], "g").first()[0] == pytest.approx(want, abs=1e-12)
    two = frame(spark, {"u": np.array([0.0, 1.0, 9.0]), "g": np.array(["a", "a", "b"])})
    assert mixtures.euclidean_silhouette(two, ["u"], "g").first()[0] == pytest.approx((8 / 9 + 7 / 8) / 3)
    assert mixtures.euclidean_silhouette(two.where("g = 'a'"), ["u"], "g").first()[0] is None


def test_differentiation_tree_splits_on_what_tells_classes_apart(spark):
    rng = np.random.default_rng(10)
    df = frame(spark, {"noise": rng.normal(size=300), "tells": np.concatenate([rng.normal(0, 1, 150), rng.normal(4, 1, 150)]), "label": np.repeat(["a", "b"], 150)})
    assert trees.grow(df, ["noise", "tells"], "label", "differentiation", 1).feature == "tells"
    one = np.array([[10.0, 10.0], [0.0, 40.0], [10.0, 170.0]])
    assert trees.separation(one, 0.0, 5.0) > trees.separation(np.array([[10.0, 10.0], [0.0, 1.0], [10.0, 10.1]]), 0.0, 5.0) >= 0
    assert trees.separation(one, 1.0, 1.0) == 0.0


@pytest.mark.parametrize("family", ["min_max", "probability", "luk", "hamacher", "einstein"])
def test_kernel_gives_what_columns_give(spark, family):
    from hazelogic.operators import kernel

    rng = np.random.default_rng(11)
    m = infer.Model({(f"f{i}", x): [(rng.normal(), rng.uniform(0.5, 2)) for _ in range(1 + (i + ord(x)) % 3)] for i in range(4) for x in "abc"})
    df = frame(spark, {"id": np.arange(50)} | {f"f{i}": rng.normal(0, 2, 50) for i in range(4)})
    got = kernel.score(df, m, ["id"], t_norm=family).join(df.select("id", infer.firing(m, family).alias("s"), infer.classify(infer.firing(m, family), m.labels).alias("c")), "id").collect()
    assert all(np.allclose(r.strengths, r.s, atol=1e-12) for r in got)
    label = {r.id: r.label for r in kernel.score(df, m, ["id"], "label", family).collect()}
    assert all(label[r.id] == r.c for r in got if max(r.s) > 0)
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0)], "id long, f0 double, f1 double, f2 double, f3 double")
    assert [r.strengths is None for r in kernel.score(odd, m, ["id"], t_norm=family).orderBy("id").collect()] == [True, False]
    assert kernel.score(odd.limit(0), m, ["id"]).count() == 0
    assert kernel.strengths(df, m, ["id"]).count() == 50


def test_em_experts_with_gates_on_two_features(spark):
    """Four pieces told apart by two features: gates on both find their experts."""
    rng = np.random.default_rng(12)
    a, b = rng.choice([0.0, 10.0], 600) + rng.normal(0, 1, 600), rng.choice([0.0, 10.0], 600) + rng.normal(0, 1, 600)
    y = np.where(a < 5, 1, -1) * a + np.where(b < 5, 2, -2) * b + rng.normal(0, 0.1, 600)
    df = frame(spark, {"a": a, "b": b, "y": y})
    two = refine.em_experts(df, ["a", "b"], "y", [[0, 0], [0, 10], [10, 0], [10, 10]])
    one = refine.em_experts(df, ["a", "b"], "y", [0.0, 3.0, 7.0, 10.0])
    assert two["gate_mu"].shape == (4, 2) and one["gate_mu"].shape == (4,)
    assert np.allclose(np.sort(two["beta"][:, 1:], axis=0), [[-1, -2], [-1, -2], [1, 2], [1, 2]], atol=0.1)
