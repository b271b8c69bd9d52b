"""Boosted trees with missing inputs: sums, splits, accuracy, saving."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from signalframe.operators import boosting

COLUMNS = ["a", "b", "c", "d"]


def table(spark, n=9000, seed=3):
    """The label hangs on a step, a product and on whether an input is missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    lost = rng.random((n, 4)) < [0.3, 0.1, 0.0, 0.05]
    z = 2.0 * (x[:, 1] > 0.3) + 1.5 * x[:, 0] * x[:, 2] + 1.5 * lost[:, 0] - 1.2
    y = rng.random(n) < 1 / (1 + np.exp(-z))
    rows = [(i, *[None if m else float(v) for v, m in zip(r, l)], int(t)) for i, (r, l, t) in enumerate(zip(x, lost, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")


def auc(scored):
    return BinaryClassificationEvaluator(rawPredictionCol="boosting_probability", labelCol="y").evaluate(scored)


def test_not_below_sparks_trees_on_imputed_inputs(spark, tmp_path):
    every = table(spark).repartition(4).cache()
    train, held_out = every.where("id % 3 > 0"), every.where("id % 3 = 0")
    # Spark's loss is of labels -1 and 1 and twice the margin, so that its steps are twice as long
    model = boosting.fit(train.repartition(3), "y", COLUMNS, trees=25, rate=0.4)
    ours = auc(boosting.score(held_out, model, "id", "y"))
    filled = lambda df: VectorAssembler(inputCols=[*COLUMNS, *[f"{c}_lost" for c in COLUMNS]], outputCol="v").transform(
        df.select("y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COLUMNS], *[F.col(c).isNull().cast("double").alias(f"{c}_lost") for c in COLUMNS])
    )
    theirs = GBTClassifier(featuresCol="v", labelCol="y", maxDepth=3, maxIter=25, stepSize=0.2, seed=1).fit(filled(train)).transform(filled(held_out))
    assert ours >= BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="y").evaluate(theirs) - 0.005 and ours > 0.75  # of 3,000 rows
    boosting.save(spark, model, str(tmp_path / "model"))
    again = boosting.score(held_out, boosting.load(spark, str(tmp_path / "model")), "id").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in boosting.score(held_out, model, "id").collect()}
    assert any(t.feature[1] == 0 or 0 in t.feature for t in model.trees)


def test_histogram_equals_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROUND", 2)
    every = table(spark, 300)
    model = boosting.fit(every, "y", COLUMNS, trees=3, depth=2, bins=8, least=5)
    rows = boosting.binned(every.repartition(4), "y", model)
    grown = boosting.Tree([-1, 1, -1, -1] + [-1] * 4, [0, 4, 0, 0] + [0] * 4, [True] * 8, [0.0] * 8)
    got = {(r.node, r.feature, r.bin): (r.n, r.g, r.h) for r in boosting.level_histogram(rows, model, 0, grown, 1).collect()}
    raw = every.select("y", *COLUMNS).toPandas()
    codes = model.codes([raw[c].to_numpy(dtype=float) for c in COLUMNS])
    p = 1 / (1 + np.exp(-model.add(codes, np.full(len(raw), model.prior))))
    want = {}
    for i in range(len(raw)):
        node = 2 if codes[1, i] <= 4 else 3  # a missing value has code 0 and goes left
        for f in range(4):
            n, g, h = want.get((node, f, codes[f, i]), (0, 0.0, 0.0))
            want[node, f, codes[f, i]] = n + 1, g + raw["y"][i] - p[i], h + p[i] * (1 - p[i])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_inputs_without_any_value_and_one_label(spark):
    rows = spark.createDataFrame([(1, None, 0.5), (1, None, None), (None, None, 1.0)], "y int, a double, b double")
    model = boosting.fit(rows, "y", ["a", "b"], trees=2)
    assert all(r.boosting_probability > 0.99 for r in boosting.score(rows, model).collect())
