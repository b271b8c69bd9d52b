"""Trees grown by level jobs are Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from signalframe.operators import level_trees, models
from signalframe.schemas import FEATURES

INPUTS = ["a", "b", "missing", "same"]


def rows(spark, path, n, parts):
    made = spark.range(0, n, 1, parts).selectExpr(
        "id", "(id * 37 % 101) * 1.0D a", "(id * 53 % 997) / 7.0D b", "cast(id % 5 = 0 as double) missing", "0.0D same",
        "cast((id * 37 % 101 > 40 and id * 53 % 997 < 500) or id % 7 = 3 as double) label__",
    )
    VectorAssembler(inputCols=INPUTS, outputCol="tree_vector").transform(made).write.parquet(path)
    return spark.read.parquet(path)


def booster(trees):
    return GBTClassifier(featuresCol="tree_vector", labelCol="label__", maxDepth=3, maxIter=trees, stepSize=0.04, subsamplingRate=0.9, seed=42)


def probabilities(model, ready):
    return np.array([r[0] for r in model.transform(ready).orderBy("id").select(vector_to_array("probability")[1]).collect()])


@pytest.mark.parametrize("n, parts", [(300, 1), (12_000, 3)])
def test_trees_are_those_of_spark(spark, tmp_path, monkeypatch, n, parts):
    monkeypatch.setattr(level_trees, "BLOCK", 1 << 10)  # several blocks in a partition
    ready = rows(spark, str(tmp_path / "rows"), n, parts)
    whole, own = booster(6).fit(ready), level_trees.fit(ready, booster(6))
    assert list(own.treeWeights) == list(whole.treeWeights) and own.getMaxDepth() == 3 and own.numFeatures == len(INPUTS)
    expected = probabilities(whole, ready)
    assert np.abs(probabilities(own, ready) - expected).max() < 1e-12
    own.write().overwrite().save(str(tmp_path / "model"))
    assert np.abs(probabilities(GBTClassificationModel.load(str(tmp_path / "model")), ready) - expected).max() < 1e-12


def test_labels_of_one_class_and_inputs_without_cuts(spark, tmp_path):
    ready = rows(spark, str(tmp_path / "rows"), 200, 2).where("label__ = 1.0")
    one, own = booster(2).fit(ready), level_trees.fit(ready, booster(2))
    assert [t.numNodes for t in own.trees] == [t.numNodes for t in one.trees]
    assert np.abs(probabilities(own, ready) - probabilities(one, ready)).max() < 1e-12


def test_the_training_job_grows_its_trees_so(spark, monkeypatch):
    """Spark's own rounds run two stages a level and take most of their time between them."""
    def waits(self, *_):
        raise AssertionError("400 rounds of Spark's booster")

    monkeypatch.setattr(GBTClassifier, "fit", waits)
    table = spark.range(200).selectExpr("id AS k", *[f"cast((id * {7 + i}) % 23 as double) AS {c}" for i, c in enumerate(FEATURES)], "cast(id % 3 = 0 as int) AS y")
    model, _ = models.fit_models(table, "y", trees=3)
    assert models.score(table, model, "k").filter("boosting_probability between 0 and 1").count() == 200
