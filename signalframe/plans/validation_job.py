"""Validation job: a predictions table to its metrics and calibration points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalframe.operators import evaluation
from signalframe.sources.tables import read_predictions, save_metrics


def run(spark: SparkSession, predictions_path: str, out: str, threshold: float = 0.5) -> tuple[DataFrame, str | None]:
    predictions = read_predictions(spark, predictions_path)
    report = evaluation.metrics_report(predictions, threshold)
    save_metrics(report, f"{out}/metrics")
    save_metrics(evaluation.calibration_curve(predictions), f"{out}/calibration")
    return report, evaluation.patient_warning(predictions)
