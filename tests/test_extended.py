"""Known answers of the iterative operators, and NumPy forms of those without SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazelogic.operators import infer, interactions, mixtures, refine, rulebase, scaling, solve, trees


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*cols.values(), strict=True)], names)


def test_two_clusters_are_found(spark, rng):
    x = np.concatenate([rng.normal(0, 0.3, 200), rng.normal(20, 0.3, 200)])
    got = mixtures.mixture_fit(frame(spark, x=x, g=["a"] * 400), ["x"], "g").orderBy("mu").collect()
    assert len(got) == 2 and [round(r.mu) for r in got] == [0, 20]
    assert all(r.weight == pytest.approx(0.5) and 0.25 < r.sigma < 0.35 for r in got)


def test_parts_never_exceed_distinct_values(spark):
    got = mixtures.mixture_fit(frame(spark, x=[1.0] * 20 + [2.0] * 20, g=["a"] * 40), ["x"], "g", 5)
    assert got.count() == 2
    assert mixtures.mixture_fit(frame(spark, x=[3.0, 3.0], g=["a", "a"]), ["x"], "g").first().mu == 3.0


def test_em_shapes_never_lose_likelihood(rng):
    x = np.sort(np.concatenate([rng.uniform(0, 1, 300), rng.uniform(5, 6, 300)]))
    one, two = (mixtures.em_shapes(x, np.ones(600), k)[1] for k in (1, 2))
    assert two > one
    parts, _ = mixtures.em_shapes(x, np.ones(600), 2)
    assert sum(p[4] for p in parts) == pytest.approx(1) and all(p[0] <= p[1] <= p[2] <= p[3] for p in parts)


def test_silhouette_matches_pairs(spark, rng):
    x, g = rng.normal(size=40), [i % 3 for i in range(40)]
    want = []
    for i in range(40):
        d = [np.mean([(x[i] - x[j]) ** 2 for j in range(40) if g[j] == c and j != i]) for c in range(3)]
        a, b = d[g[i]], min(v for c, v in enumerate(d) if c != g[i])
        want.append((b - a) / max(a, b))
    assert mixtures.silhouette(frame(spark, x=x, g=g), ["x"], "g").first()[0] == pytest.approx(np.mean(want))
    assert mixtures.silhouette(frame(spark, x=[1.0], g=[0]), ["x"], "g").first()[0] is None


def test_terms_of_a_constant_are_none(spark):
    assert mixtures.linguistic_terms(frame(spark, x=[2.0] * 9), ["x"]).count() == 0
    assert [r.name for r in mixtures.linguistic_terms(frame(spark, x=[float(i) for i in range(90)]), ["x"]).collect()] == ["Low", "Med", "High"]


def test_tree_follows_a_step(spark, rng):
    a, b = rng.uniform(0, 10, 400), rng.uniform(0, 10, 400)
    df = frame(spark, a=a, b=b, y=np.where(a < 5, 0.0, 10.0))
    tree = trees.grow(df, ["b", "a"], "y", max_depth=1, n_terms=2)
    w, y = trees._soft(a, tree.knots), np.where(a < 5, 0.0, 10.0)
    inside = [np.average((y - np.average(y, weights=t)) ** 2, weights=t) for t in w.T]
    assert tree.feature == "a" and tree.gain == pytest.approx(1 - np.average(inside, weights=w.sum(axis=0)) / y.var())
    values = trees.leaf_values(df, tree, "y")
    got = df.select((trees.predict(tree, values) - F.col("y")).alias("e")).agg(F.avg(F.abs("e"))).first()[0]
    assert got < 0.8 * np.abs(y - y.mean()).mean() and "a (gain" in trees.describe(tree, values)


def test_spark_and_numpy_terms_agree(spark, rng):
    x, knots = rng.uniform(-5, 15, 50), [0.0, 2.0, 7.0, 10.0]
    got = frame(spark, x=x).select(F.array(*trees.soft_terms(F.col("x"), knots))).collect()
    assert np.allclose([r[0] for r in got], trees._soft(x, knots))


def test_class_trees_and_leaf_budget(spark, rng):
    x = rng.uniform(0, 1, 300)
    df = frame(spark, x=x, z=rng.uniform(0, 1, 300), c=["hi" if v > 0.5 else "lo" for v in x])
    for criterion in ("ambiguity", "information"):
        tree = trees.grow(df, ["x", "z"], "c", criterion, 2, 2, max_leaves=3)
        assert tree.feature == "x" and len(tree.leaves()) <= 3
        p = trees.predict_proba(tree, trees.leaf_classes(df, tree, "c", ["hi", "lo"]))
        assert df.where(infer.classify(p, ["hi", "lo"]) == F.col("c")).count() > 270


def test_nonspecificity():
    assert trees.nonspecificity(np.array([4.0, 0.0])) == 0
    assert trees.nonspecificity(np.array([2.0, 2.0])) == pytest.approx(np.log(2))


def test_pruning_collapses_weak_splits(spark, rng):
    df = frame(spark, x=rng.uniform(0, 1, 200), y=rng.normal(size=200))
    tree = trees.grow(df, ["x"], "y", max_depth=1, min_gain=-1.0)
    assert tree.children and not trees.prune(tree, 1.0).children and trees.prune(tree, -1.0).children


def test_bsp_tree_splits_where_classes_part(spark, rng):
    x = rng.uniform(0, 1, 1000)
    df = frame(spark, x=x, c=["a" if v < 0.5 else "b" for v in x])
    splits = trees.bsp_grow(df, ["x"], "c", 2, 50)
    assert splits[""][0] == "x" and abs(splits[""][1] - 0.5) < 0.06


def test_leaf_consequents_recover_a_line(spark, rng):
    a, b = rng.uniform(0, 10, 300), rng.uniform(0, 10, 300)
    df = frame(spark, a=a, b=b, y=2 * a - 3 * b + 1)
    tree = trees.grow(df, ["a"], "y", max_depth=1, min_gain=-1.0)
    assert np.allclose(trees.leaf_consequents(df, tree, ["a", "b"], "y", 1e-9), [[1, 2, -3]] * len(tree.leaves()), atol=1e-3)


def test_partition_helpers():
    assert rulebase.index_runs([5, 1, 2, 2, 7, 6]) == [[1, 2], [5, 6, 7]]
    assert rulebase.merge_close([3.0, 1.0, 1.1], 0.2) == [1.05, 3.0]
    knots = rulebase.landmark_knots([2.0, 5.0], 0.0, 10.0)
    assert knots[1] == 0.0 and knots[-2] == 10.0 and knots[0] < 0 < 10 < knots[-1]
    p = rulebase.complete_gaps(rulebase.Partition({"x": [0.0, 10.0]}, [rulebase.Rule("a", {"x": [0]})]), {"x": (0.0, 10.0)}, 0.5)
    assert p.knots["x"] == [0.0, 5.0, 10.0] and p.ruleset[0].clauses["x"] == [0, 1]
    assert rulebase.from_vector(p, rulebase.to_vector(p)).knots == p.knots
    split = rulebase.split_contiguous(rulebase.Rule("a", {"x": [0, 1, 3], "y": [2]}))
    assert [r.clauses for r in split] == [{"x": [0, 1], "y": [2]}, {"x": [3], "y": [2]}]
    assert len(rulebase.convex_product({"x": [(0, 1), (2, 3)], "y": [(0, 1)]})) == 2


def test_best_threshold_matches_brute_force(spark, rng):
    a, g = rng.uniform(0, 1, 200).round(2), rng.integers(-1, 2, 200)
    got = rulebase.best_threshold(frame(spark, a=a, g=g), F.col("a"), F.col("g")).first()
    assert got.net == max(0, max(int(g[a <= t].sum()) for t in a))
    worse = rulebase.best_threshold(frame(spark, a=[0.5], g=[-1]), F.col("a"), F.col("g")).first()
    assert (worse.threshold, worse.net) == (0.0, 0)


def blobs(spark, rng):
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(3, 1, 80)])
    return frame(spark, x=x, label=["a"] * 80 + ["b"] * 80)


@pytest.mark.parametrize("method", ["coordinate", "ga", "local"])
def test_refinement_lowers_the_loss(spark, rng, method):
    df = blobs(spark, rng)
    model = infer.Model({("x", "a"): [(-2.0, 1.0)], ("x", "b"): [(5.0, 1.0)]})
    options = {"ga": {"generations": 4, "population": 16}, "coordinate": {"sweeps": 2}, "local": {"steps": 2}}[method]
    rows = df.withColumn("__label", (F.col("label") == "b").cast("int"))
    x0, box = refine.to_vector(model), refine.bounds(df, model)
    start = np.clip(x0, box[:, 0], box[:, 1])
    before = refine.mean_loss(rows, ["x"], "__label", refine.cross_entropy(model, x0, box, 0.05), start[None])[0]
    got, after = refine.refine_classifier(df, model, "label", method, **options)
    assert after < before and np.all(refine.to_vector(got) >= box[:, 0]) and np.all(refine.to_vector(got) <= box[:, 1])


def test_other_losses_run(spark, rng):
    df = blobs(spark, rng).withColumn("y", (F.col("label") == "b").cast("double"))
    model = infer.Model({("x", "a"): [(0.0, 1.0)], ("x", "b"): [(3.0, 1.0)]})
    base, w = refine.to_vector(model), np.array([[0.0, 0.0], [0.5, 0.5]])
    for loss in (refine.interval_loss, refine.plane_loss):
        got = refine.mean_loss(df, ["x"], "y", loss(model, np.array([0.0, 1.0]), base), w)
        assert np.all((got > 0) & (got < 0.25))
    knots = refine.knot_loss({"x": [0.0, 3.0]}, [(0, {"x": [0]}), (1, {"x": [1]})], 2)
    near, far = refine.mean_loss(df, ["x"], "y", knots, np.array([[0.0, 3.0], [-9.0, 9.0]]))
    assert near < far


def test_gradient_matches_differences(spark):
    at = lambda mu, s: infer.Model({("x", "a"): [(mu, s), (4.0, 2.0)], ("z", "a"): [(1.0, 1.0)]})
    df, h = frame(spark, x=[0.7], z=[0.4]), 1e-5
    value = lambda mu, s: df.select(F.get(infer.firing(at(mu, s)), F.lit(0))).first()[0]
    got = df.select(*refine.firing_gradient(at(1.0, 1.5), "x", "a")).first()
    assert got[0] == pytest.approx((value(1 + h, 1.5) - value(1 - h, 1.5)) / 2 / h, rel=1e-4)
    assert got[1] == pytest.approx((value(1, 1.5 + h) - value(1, 1.5 - h)) / 2 / h, rel=1e-4)


def test_guards():
    assert refine.mcnemar_p(0, 0) == 1.0 and refine.mcnemar_p(1, 9) == pytest.approx(2 * 11 / 1024)
    assert refine.accept("mcnemar", 100, 1, 9, 1.0, 0.9) and not refine.accept("mcnemar", 100, 4, 6, 1.0, 0.9)
    assert refine.accept("legacy", 10, 1, 1, 1.0, 0.9) and not refine.accept("ce", 10, 0, 5, 1.0, 1.1)
    assert refine.accept("effect-size", 100, 0, 9, 1.0, 1.0) and refine.accept("none", 1, 1, 0, 0, 1)


def test_em_finds_two_experts(spark, rng):
    a = np.concatenate([rng.uniform(0, 4, 200), rng.uniform(6, 10, 200)])
    y = np.where(a < 5, 2 * a, -3 * a + 40) + rng.normal(0, 0.1, 400)
    got = refine.em_experts(frame(spark, a=a, y=y), ["a"], "y", [2.0, 8.0], rounds=20)
    assert np.allclose(got["beta"][:, 1], [2, -3], atol=0.1)


def test_solves_recover_coefficients(spark, rng):
    a, b = rng.uniform(0, 1, 300), rng.uniform(0, 1, 300)
    df = frame(spark, a=a, b=b, y=2 * a + b, k=(a > 0.5).astype(int))
    for beta in solve.bucket_corrections(df, ["a", "b"], "y", "k").values():
        assert np.allclose(beta, [0, 2, 1], atol=1e-6)
    assert solve.choose_by_folds(df, ["a", "b"], "y", (1,), ("raw",), (1e-6,)).first().r2 > 0.999
    got = interactions.lasso_screen(frame(spark, a=a, b=b, c=rng.uniform(0, 1, 300), y=a * b * 5), ["a", "b", "c"], "y").first()
    assert (got.feature_a, got.feature_b) == ("a", "b")


def test_anfis_beats_a_line(spark, rng):
    x = rng.uniform(-3, 3, 300)
    df = frame(spark, x=x, y=np.sin(x))
    net = solve.Anfis(["x"], "y", n_terms=4, epochs=3).fit(df)
    mse = df.select(F.avg(F.pow(net.predict() - F.col("y"), 2))).first()[0]
    assert mse < 0.01 and mse == pytest.approx(net.error / 300, rel=1e-3, abs=1e-6) and len(net.describe_rules()) == 4
    with pytest.raises(ValueError):
        solve.Anfis(["x"] * 9, "y", n_terms=3)


def test_whitening(spark, rng):
    base = rng.normal(size=400)
    x = np.stack([base + 0.1 * rng.normal(size=400), base + 0.1 * rng.normal(size=400)], axis=1)
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    mean, cov, n, _ = scaling.covariance(df, ["a", "b"])
    assert n == 400 and np.allclose(cov, np.cov(x.T, ddof=0)) and np.allclose(mean, x.mean(axis=0))
    got = np.array(df.select(*scaling.whitened(["a", "b"], *scaling.pca_whitening(df, ["a", "b"]))).collect())
    assert np.allclose(np.cov(got.T), np.eye(2), atol=1e-8)
    _, matrix, rate = scaling.shrunk_whitening(df, ["a", "b"])
    assert 0 <= rate < 0.2 and np.allclose(matrix, matrix.T)


def test_rollout_and_oversampling(spark):
    df = frame(spark, g=["a"] * 5, t=list(range(5)), v=[1.0, 2.0, 3.0, 4.0, 5.0])
    got = scaling.rollout(df, "g", ["t"], "v", lambda x, s, m: s - m, 2).orderBy("step").collect()
    assert got[0].value == pytest.approx(5 + 4 - 1.5) and got[1].value == pytest.approx(7.5 + 5.5 - 2.5)
    rows = frame(spark, c=["a"] * 30 + ["b"] * 10, x=[float(i) for i in range(40)])
    fits = frame(spark, feature=["x", "x"], c=["a", "b"], mu=[14.5, 34.5], sigma=[1.0, 0.001])
    made = scaling.oversample(rows, "c", ["x"], fits)
    vals = [r.x for r in made.collect()]
    assert len(vals) == 10 and all(abs(v - 34.5) < 0.01 for v in vals) and sorted(vals) == sorted(r.x for r in made.collect())
