"""Training job: a feature table to saved models, with the reload check."""

from __future__ import annotations

from pyspark.sql import SparkSession

from signalframe.operators import models
from signalframe.sources.tables import read_feature_table

TOLERANCE = 1e-12


def run(
    spark: SparkSession, table_path: str, out: str, target: str | None = None, fmt: str = "parquet",
    test_share: float = 0.2, seed: int = 42, trees: int = models.TREES, key: str = "ecg_id",
) -> models.Trained:
    table, label = read_feature_table(spark, table_path, target, fmt)
    trained = models.train(table, key, label, test_share, seed, trees)
    models.save_artifacts(spark, trained, out)
    loaded, _ = models.load_artifacts(spark, out)
    sample = table.orderBy(key).limit(10)
    worst = models.reload_difference(sample, key, trained.model, loaded).first()
    if max(worst["logistic_difference"], worst["boosting_difference"]) > TOLERANCE:
        raise RuntimeError("Reload verification failed.")
    return trained
