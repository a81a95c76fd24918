"""Bags, few-shot scores and estimators against NumPy and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazelogic.operators import ensemble, infer


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(5)
    y = rng.random(600) < 0.3
    a = rng.normal(np.where(y, 2.0, 0.0), 1.0)
    b = rng.normal(0.0, 3.0, 600) + a
    rows = [(i, float(a[i]), float(b[i]), "p" if y[i] else "n") for i in range(600)]
    return spark.createDataFrame([*rows, (600, None, 1.0, "p"), (601, 1.0, float("nan"), "n"), (602, 1.0, 1.0, None)], "id long, a double, b double, c string")


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = ensemble.poisson_weight(["id"], F.lit(1))
    got = spark.range(40_000).select(w.alias("w")).agg(F.avg("w"), F.var_pop("w"), (F.sum((F.col("w") == 0).cast("int")) / 40_000)).first()
    assert got[0] == pytest.approx(1, abs=0.03) and got[1] == pytest.approx(1, abs=0.05) and got[2] == pytest.approx(np.exp(-1), abs=0.01)


def test_a_bag_fits_its_own_bootstrap(spark, two):
    models = ensemble.bag(two, ["a", "b"], "c", ["id"], members=3, columns=0.5, seed=9)
    again = ensemble.bag(two.repartition(5), ["a", "b"], "c", ["id"], members=3, columns=0.5, seed=9)
    assert len(models) == 3 and all(len(m.features) == 1 and m.labels == ["n", "p"] for m in models)
    for m, o in zip(models, again, strict=True):
        assert {k: pytest.approx(v[0]) for k, v in m.cells.items()} == {k: v[0] for k, v in o.cells.items()}
    rows = two.select("*", ensemble.poisson_weight(["id"], F.lit(9), F.lit(0), F.lit(0)).alias("w")).collect()
    f = models[0].features[0]
    for x in ("n", "p"):
        v, w = np.array([(r[f], r.w) for r in rows if r.c == x and r[f] is not None and r[f] == r[f]]).T
        mean = np.average(v, weights=w)
        assert models[0].cells[f, x][0] == pytest.approx((mean, np.sqrt(np.average((v - mean) ** 2, weights=w))))


def test_bag_votes_and_edges(spark, two):
    p = ensemble.bag_probabilities(ensemble.bag(two, ["a", "b"], "c", ["id"], members=4), ["n", "p"])
    rows = two.where("id < 600").select("c", infer.classify(p, ["n", "p"]).alias("v"), F.aggregate(p, F.lit(0.0), lambda s, x: s + x).alias("s")).collect()
    assert np.mean([r.c == r.v for r in rows]) > 0.75 and all(r.s == pytest.approx(1) for r in rows)
    assert ensemble.bag(two.limit(0), ["a"], "c", ["id"]) == []
    rare = spark.createDataFrame([(0, 1.0, "x"), *[(i, 2.0, "y") for i in range(1, 9)]], "id long, a double, c string")
    drawn = ensemble.bag(rare, ["a"], "c", ["id"], members=20)
    assert sum(m.labels == ["x", "y"] for m in drawn) >= 16  # one draw alone leaves "x" out of 7 in 20


def test_few_shot_is_the_penalised_optimum(spark, two):
    got = two.where("id < 600").select("a", "b", "c", ensemble.few_shot(two, ["a", "b"], F.col("c") == "p", 0.5).alias("s")).collect()
    x, y = np.array([[r.a, r.b] for r in got]), np.array([r.c == "p" for r in got], float)
    d = x - x.mean(axis=0)
    cov = d.T @ d / len(x)
    from hazelogic.operators import scaling

    mean, matrix, _ = scaling.shrunk_whitening(two.where("id < 600"), ["a", "b"])
    assert mean == pytest.approx(x.mean(axis=0)) and cov.shape == matrix.shape
    z = np.column_stack([(x - mean) @ matrix, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        pen = np.array([1.0, 1.0, 0.0])
        w -= np.linalg.solve((z * (0.5 * weight * p * (1 - p))[:, None]).T @ z + np.diag(pen), 0.5 * z.T @ (weight * (p - y)) + pen * w)
    assert [r.s for r in got] == pytest.approx((1 / (1 + np.exp(-z @ w))).tolist(), abs=1e-4)
    with pytest.raises(ValueError):
        ensemble.few_shot(two, ["a"], F.lit(True))


def test_tree_estimators(spark):
    df = spark.createDataFrame([(float(i % 10), 5.0 * (i % 10 >= 5), -1.0 * (i % 10 >= 5), "hi" if i % 10 >= 5 else "lo") for i in range(200)], "x double, y double, z double, c string")
    got = ensemble.MultiOutput(lambda t: ensemble.TreeRegressor(["x"], t, options={"max_depth": 1, "n_terms": 2}), ["y", "z"]).fit(df)
    rows = df.select("x", *got.predict()).collect()
    low, high = [r for r in rows if r.x == 0][0], [r for r in rows if r.x == 9][0]
    assert low.y < 1.5 and high.y > 3.5 and high.z < low.z
    tree = ensemble.TreeClassifier(["x"], "c", options={"max_depth": 1, "n_terms": 2, "min_gain": 0.0}).fit(df)
    assert df.where(tree.predict() == F.col("c")).count() >= 160
