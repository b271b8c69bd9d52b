"""Isotonic regression across ranges and Platt's lines against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import calibration, group_fits, models


def max_min(x, y):
    """The isotonic fit at each different score, by its formula."""
    scores = sorted(set(x))
    w = [sum(a == s for a in x) for s in scores]
    t = [sum(b for a, b in zip(x, y) if a == s) for s in scores]
    mean = lambda a, b: sum(t[a: b + 1]) / sum(w[a: b + 1])
    n = len(scores)
    return {s: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i, s in enumerate(scores)}


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "steps", "one"])
def test_isotonic_equals_the_formula(spark, monkeypatch, kind):
    monkeypatch.setattr(calibration, "RANGE", 6)
    rng = np.random.default_rng(2)
    x = np.round(rng.random(150), 2)
    y = {
        "noise": rng.random(150) < x, "falling": rng.random(150) > x, "rising": x > 0.4, "steps": (x * 7).astype(int) % 2, "one": x >= 0,
    }[kind].astype(int)
    rows = [(int(b), float(a)) for a, b in zip(x, y)] + [(None, 0.5), (1, None)]
    got = calibration.isotonic(spark.createDataFrame(rows, "y_true int, y_score double")).collect()
    want = max_min([float(a) for a in x], y.tolist())
    assert len(got) == len(rows)
    for r in got:
        assert (r.calibrated is None) if r.y_score is None else r.calibrated == pytest.approx(want.get(r.y_score), abs=1e-12)


def test_platt_lines_of_many_datasets(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for d in range(12):
        x = np.clip(np.round(rng.random(300), 2), 0.01, 0.99)
        y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + d / 6) * np.log(x / (1 - x)) - 0.3 + d / 9))).astype(int)
        rows += [(int(b), float(a), f"d{d}") for a, b in zip(x, y)]
        z, line = np.stack([np.log(x / (1 - x)), np.ones(300)], axis=1), np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ line))
            line += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (y - p))
        want[f"d{d}"] = line
    rows += [(1, 0.7, "same"), (0, 0.7, "same"), (1, 0.7, "same"), (1, 0.2, "ones"), (1, 0.9, "ones"), (None, 0.1, "d0"), (0, None, "d1")]
    frame = spark.createDataFrame(rows, "y_true int, y_score double, dataset string")
    got = {r.dataset: (r.slope, r.intercept) for r in calibration.platt_lines(frame).collect()}
    for d, line in want.items():
        assert got[d] == pytest.approx(tuple(line), abs=1e-8)
    assert got["same"][1] + got["same"][0] * np.log(0.7 / 0.3) == pytest.approx(np.log(2), abs=1e-9)
    assert all(np.isfinite(got["ones"]))
    one = models.fit_platt(frame.where("dataset = 'd3'"))
    assert one == pytest.approx(tuple(want["d3"]), abs=1e-8)


def test_nothing_to_calibrate(spark):
    empty = spark.createDataFrame([], "y_true int, y_score double, dataset string")
    assert calibration.isotonic(empty).count() == 0 and calibration.platt_lines(empty).count() == 0
    assert calibration.platt_lines(calibration.with_overall(empty)).count() == 0
    assert calibration.with_overall(spark.createDataFrame([(1, 0.5, None)], "y_true int, y_score double, dataset string")).select(F.col("dataset")).collect()[0][0] == "overall"


def test_groups_are_fitted_like_one_by_one(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [1.0, -0.5, 0.0, 2.0] - 0.3))).astype(float)
    w = np.where(y == 1, 1.3, 0.8)
    rows = spark.createDataFrame([(v.tolist(), float(a), float(b)) for v, a, b in zip(x, y, w)], "x array<double>, y double, w double")
    groups = {"one": [3], "some": [0, 2], "all": [0, 1, 2, 3], "none": []}
    got = group_fits.fit_groups(rows.repartition(5), groups, 0.02)
    for g, columns in groups.items():
        own, b = np.concatenate((x[:, columns], np.ones((400, 1))), axis=1), np.zeros(len(columns) + 1)
        ridge = np.append(np.full(len(columns), 0.02), 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-own @ b))
            b += np.linalg.solve(own.T @ (own * (w * p * (1 - p))[:, None]) / w.sum() + np.diag(ridge), own.T @ (w * (y - p)) / w.sum() - ridge * b)
        assert got[g] == pytest.approx(b, abs=1e-9)
        scored = group_fits.score_groups(rows, {g: columns}, got)
        assert scored.count() == 400
        assert sorted(r.y_score for r in scored.collect()) == pytest.approx(sorted((1 / (1 + np.exp(-own @ b))).tolist()), abs=1e-9)
