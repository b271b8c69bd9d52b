import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import evaluation, models, selection


def test_exact_quantiles_with_holes_duplicates_and_outliers(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=3000), [1e9, -1e9]])
    b = np.where(rng.uniform(size=3002) < 0.6, 7.0, rng.normal(size=3002))
    rows = [(float(x), float(y), None, float(i) if i % 3 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, none double, holed double").repartition(5)
    holed = [r[3] for r in rows if r[3] is not None]
    for q in (0.5, 0.05, 0.98):
        for accuracy in (20, 10_000):
            got = selection.exact_quantiles(df, ["a", "b", "none", "holed"], q, accuracy)
            assert got["none"] is None
            for name, values in (("a", a), ("b", b), ("holed", holed)):
                assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert selection.exact_quantiles(df, ["x"])["x"] == 2.5


def test_refinement_keeps_the_result(spark, monkeypatch):
    monkeypatch.setattr(selection, "REFINE_ROWS", 5)
    values = np.random.default_rng(2).exponential(size=2000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert selection.exact_quantiles(df, ["x"], 0.5, 50)["x"] == pytest.approx(np.median(values), rel=1e-12)


def test_stratified_split_is_exact_and_reproducible(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    one = selection.stratified_split(df, "id", "y", 0.3, 42)
    counts = {r.y: (r.n, r.t) for r in one.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    for n, t in counts.values():
        assert t == math.ceil(n * 0.3)
    two = selection.stratified_split(df.repartition(7), "id", "y", 0.3, 42)
    other = selection.stratified_split(df, "id", "y", 0.3, 43)
    assert one.exceptAll(two).count() == 0
    assert one.exceptAll(other).count() > 0


def test_group_split_keeps_patients_together(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("patient"))
    sides = selection.group_split(df, "patient").groupBy("patient").agg(F.count_distinct("is_test").alias("s"))
    assert sides.filter("s != 1").count() == 0


def predictions(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_score double, dataset string")


def brute_auc(y, s):
    pos, neg = [v for t, v in zip(y, s) if t], [v for t, v in zip(y, s) if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_report_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.uniform() < 0.4), float(rng.integers(0, 40) / 40), "ab"[i % 3 == 0]) for i in range(400)] + [(1, 0.9, "single")]
    report = {r.dataset: r for r in evaluation.metrics_report(predictions(spark, rows)).collect()}
    assert set(report) == {"overall", "a", "b"}
    for name in report:
        part = [r for r in rows if name in ("overall", r[2])]
        y, s = [r[0] for r in part], [r[1] for r in part]
        assert report[name].auc == pytest.approx(brute_auc(y, s))
        assert report[name].brier_score == pytest.approx(np.mean((np.array(s) - y) ** 2))
        assert report[name].tp == sum(t and v >= 0.5 for t, v in zip(y, s))
        assert report[name].tp + report[name].fn == sum(y)


def test_auc_of_reversed_scores(spark):
    rows = [(i % 2, (i * 37 % 101) / 101, "a") for i in range(200)]
    flipped = [(y, 1 - s, d) for y, s, d in rows]
    a = evaluation.metrics_report(predictions(spark, rows)).first().auc
    b = evaluation.metrics_report(predictions(spark, flipped)).first().auc
    assert a + b == pytest.approx(1.0)


def test_zero_denominators_and_bin_edges(spark):
    rows = [(0, 0.1, "a"), (0, 0.3, "a"), (1, 0.4, "a"), (1, 0.0, "a")]
    r = evaluation.metrics_report(predictions(spark, rows)).filter("dataset = 'a'").first()
    assert (r.sensitivity, r.ppv, r.f1) == (0.0, 0.0, 0.0)
    curve = evaluation.calibration_curve(predictions(spark, rows)).filter("dataset = 'a'")
    # An edge belongs to the lower bin; 0.3 lies below the float edge 3 * 0.1.
    assert sorted((c.bin, c.n) for c in curve.collect()) == [(0, 2), (2, 1), (3, 1)]


def test_threshold_is_inclusive(spark):
    r = evaluation.confusion(predictions(spark, [(1, 0.5, "a"), (0, 0.5, "a")])).filter("dataset = 'a'").first()
    assert (r.tp, r.fp) == (1, 1)


def test_calibration_methods_improve_brier(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.02, 0.98, size=800)
    y = rng.uniform(size=800) < p**3
    df = spark.createDataFrame([(int(t), float(v)) for t, v in zip(y, p)], "y_true int, y_score double")
    for method in ("platt", "isotonic"):
        r = models.calibration_report(df, method).first()
        assert r.brier_score < r.brier_before
    slope, intercept = models.fit_platt(models.calibrated(df, "platt").select("y_true", F.col("calibrated").alias("y_score")))
    assert slope == pytest.approx(1.0, abs=0.02) and intercept == pytest.approx(0.0, abs=0.02)
