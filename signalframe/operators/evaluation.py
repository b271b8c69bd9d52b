"""Evaluation of scores against binary labels, per dataset and overall.

Rows are first reduced to counts per (dataset, score). The counts are dealt out by ranges of dataset and
score, so that a part holds about the same number of scores however they are spread. Ranks come from running
counts inside the parts and the totals of the parts; no group is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalframe.operators.ordered import PART_ROWS, in_parts

OVERALL = "overall"
# The inner edges of ten uniform bins as floating-point multiples of the step.
INNER_EDGES = [i * 0.1 for i in range(1, 10)]


def ratio(top: Column, bottom: Column) -> Column:
    """0 for a zero denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _both_groupings(predictions: DataFrame) -> DataFrame:
    """Each row once for its dataset and once for all."""
    groups = F.array(F.lit(OVERALL)) if "dataset" not in predictions.columns else F.array_compact(
        F.array(F.lit(OVERALL), F.col("dataset"))
    )
    return predictions.select(
        F.explode(groups).alias("dataset"), F.col("y_true").cast("int"), F.col("y_score").cast("double")
    )


def score_cells(predictions: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Positive and negative counts per dataset and distinct score, with the ``part`` of the range they lie in."""
    cells = (
        _both_groupings(predictions)
        .groupBy("dataset", "y_score")
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    )
    return in_parts(cells, "dataset", ["y_score"], part_rows)


def _totals(predictions: DataFrame, threshold: float) -> DataFrame:
    s, pos, neg = F.col("y_score"), F.col("pos"), F.col("neg")
    hit = s >= threshold
    inside = Window.partitionBy("dataset", "part").orderBy("y_score").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    parts = (
        score_cells(predictions)
        .withColumn("u", pos * (earlier + neg / 2))
        .groupBy("dataset", "part")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum("u").alias("u"),
            F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
            F.sum(pos * (s - 1.0) * (s - 1.0) + neg * s * s).alias("squares"),
        )
    )
    before = Window.partitionBy("dataset").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("u", F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0)))
        .groupBy("dataset")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "u", "tp", "fp", "squares")])
    )


def metrics_report(predictions: DataFrame, threshold: float = 0.5, with_accuracy: bool = False) -> DataFrame:
    """One row per dataset with both classes, and one overall row."""
    t = _totals(predictions, threshold).filter(
        (F.col("dataset") == OVERALL) | ((F.col("pos") > 0) & (F.col("neg") > 0))
    )
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    fn, tn, n = pos - tp, neg - fp, pos + neg
    extra = [ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, pos).alias("recall")]
    return t.select(
        "dataset",
        n.alias("n"),
        F.try_divide(F.col("u"), (pos * neg).cast("double")).alias("auc"),
        *(extra if with_accuracy else []),
        ratio(tp, pos).alias("sensitivity"),
        ratio(tn, neg).alias("specificity"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
        F.try_divide(F.col("squares"), n.cast("double")).alias("brier_score"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
    )


def confusion(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit, true = F.col("y_score") >= threshold, F.col("y_true") == 1
    return _both_groupings(predictions).groupBy("dataset").agg(
        F.count_if(~hit & ~true).alias("tn"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(hit & true).alias("tp"),
    )


def calibration_bin(score: Column) -> Column:
    """Number of inner edges strictly below the score."""
    return sum((F.when(score > F.lit(e), 1).otherwise(0) for e in INNER_EDGES[1:]), F.when(score > F.lit(INNER_EDGES[0]), 1).otherwise(0))


def calibration_curve(predictions: DataFrame) -> DataFrame:
    """Mean score and observed rate of the occupied ones of ten uniform bins."""
    return (
        _both_groupings(predictions)
        .groupBy("dataset", calibration_bin(F.col("y_score")).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("y_score").alias("predicted"),
            F.avg(F.col("y_true").cast("double")).alias("observed"),
        )
    )


def dataset_profile(records: DataFrame, label: str = "y_true") -> DataFrame:
    """Total, labelled, positive and negative rows per dataset."""
    return records.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_total_rows"),
        F.count(label).alias("n_labeled"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
    )


def quality_band(sqi: Column) -> Column:
    return F.when(sqi < 50.0, "low").when(sqi <= 70.0, "moderate").otherwise("acceptable")


def failure_by_band(predictions: DataFrame, sqi: str = "sqi", threshold: float = 0.5) -> DataFrame:
    """Metrics per signal-quality band."""
    banded = predictions.withColumn("dataset", quality_band(F.col(sqi)))
    return metrics_report(banded, threshold).filter(F.col("dataset") != OVERALL).withColumnRenamed("dataset", "band")


def patient_warning(predictions: DataFrame) -> str | None:
    if "patient_id" in predictions.columns:
        return None
    return "no patient_id column found; prefer patient-level splits for publication validation"
