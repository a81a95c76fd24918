"""Laws and hand values of the fuzzy-inference library."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazelogic.functions import membership, norms
from hazelogic.operators import evaluate, features, fit, infer, rules, scaling
from hazelogic.streaming import score_stream


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_folds_agree_with_pairs(spark):
    xs = [0.2, 0.9, 0.55, 0.7]
    for f in norms.FAMILIES:
        lits = [F.lit(x) for x in xs]
        both = one(spark, norms.fold_and(lits, f), reduce(lambda a, b: norms.t_norm(a, b, f), lits), norms.fold_or(lits, f), reduce(lambda a, b: norms.t_conorm(a, b, f), lits))
        assert both[0] == pytest.approx(both[1]) and both[2] == pytest.approx(both[3])
        assert one(spark, norms.t_norm(F.lit(0.0), F.lit(0.0), f), norms.t_conorm(F.lit(1.0), F.lit(1.0), f)) == [0.0, 1.0]


def test_mixed_norms_must_be_asked_for():
    with pytest.raises(ValueError):
        norms.resolve(t_norm="luk", t_conorm="min_max")
    assert norms.resolve(t_norm="luk", t_conorm="min_max", allow_mixed=True) == ("luk", "min_max")


def test_membership_edges(spark):
    inf = float("inf")
    got = one(spark, membership.trapezoid(F.lit(10.0), 10, 10, 20, 20), membership.trapezoid(F.lit(9.99), 10, 10, 20, 20), membership.triangle(F.lit(-50.0), -inf, 0, 1), membership.triangle(F.lit(0.5), 0, 0, 1), membership.gaussian(F.lit(1.0), 1.0, 0.0))
    assert got == [1.0, 0.0, 1.0, 0.5, 1.0]


def test_ruspini_sums_to_one(spark):
    rows = spark.range(-5, 60).select(F.col("id").cast("double").alias("x"))
    total = sum(rules.ruspini_terms(F.col("x"), [0, 10, 35]), F.lit(0.0))
    assert all(abs(r[0] - 1) < 1e-12 for r in rows.select(total).collect())


def test_karnik_mendel_against_a_grid():
    rng = np.random.default_rng(0)
    y, hi = rng.normal(size=(5, 3)), rng.uniform(0.2, 1, (5, 3))
    lo = hi * rng.uniform(0.1, 0.9, (5, 3))
    left, right = infer.karnik_mendel(y, lo, hi)
    for k in range(5):
        grid = [np.dot(w, y[k]) / np.sum(w) for w in np.stack(np.meshgrid(*[(lo[k, i], hi[k, i]) for i in range(3)]), -1).reshape(-1, 3)]
        assert left[k] == pytest.approx(min(grid)) and right[k] == pytest.approx(max(grid))
    assert infer.karnik_mendel(y[:1], lo[:1] * 0, hi[:1] * 0) == (0.0, 0.0)


def test_fit_score_and_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(float(rng.normal(c * 6)), float(rng.normal(c * 3)), "ab"[c]) for c in (0, 1) for _ in range(60)]
    df = spark.createDataFrame([*data, (None, float("nan"), "a")], "x double, y double, label string")
    m = infer.Model.of(fit.normal_fit(df, ["x", "y"], "label"), "label")
    scored = df.dropna().withColumn("s", infer.firing(m)).withColumn("p", infer.classify(F.col("s"), m.labels))
    assert scored.where("p = label").count() >= 115
    with pytest.raises(ValueError):
        infer.firing(m, columns=["x"])
    df.dropna().write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, m).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM scored WHERE label IN ('a', 'b')").first()[0] == 120


def test_scalers_and_buckets_on_constants_and_nulls(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [r.v_scaled for r in scaling.min_max(df, ["v"]).collect()] == [0.0, 0.0, None]
    assert [r.v_z for r in scaling.z_score(df, ["v"]).collect()] == [0.0, 0.0, None]
    rows, edges = features.output_buckets(spark.range(9).select(F.col("id").cast("double").alias("v")), "v", 4)
    assert edges == [0, 2, 4, 6, 8] and [r.bucket for r in rows.orderBy("v").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_ridge_recovers_coefficients(spark):
    df = spark.range(200).select((F.col("id") / 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    beta = evaluate.ridge_solve(df, [F.lit(1.0), F.col("a"), F.col("b")], 3 + 2 * F.col("a") - F.col("b"))
    assert beta == pytest.approx([3, 2, -1], abs=1e-6)


def test_entry_works(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    got = e.entry(spark)
    assert got.count() > 0 and got.columns
