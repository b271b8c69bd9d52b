"""Training, scoring, calibration and explanation of the two classifiers, with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalframe.operators import calibration, evaluation, features as feature_ops, level_trees
from signalframe.operators.calibration import logit
from signalframe.operators.group_fits import fit_groups, score_groups
from signalframe.operators.selection import exact_quantiles, stratified_split
from signalframe.schemas import FEATURES, RR_FEATURES
from signalframe.session import materialise

# Training settings and artefact texts.
MAX_ITER = 2000
TREES = 400
DEPTH = 3
LEARNING_RATE = 0.04
ROW_SHARE = 0.9
METADATA_DEFAULTS = {"age": 0.0, "sex": 0.0}
MODEL_TARGET = "current atrial abnormality"
MODEL_WARNING = "not future AF prediction"
MODEL_NAMES = ("PTB-XL Logistic Regression", "PTB-XL Gradient Boosting")
ARTIFACTS_MISSING = "Trained model artifacts are missing; run the training job first."


@dataclass
class Preparation:
    """What is learnt from the training rows before any model: medians, means, deviations."""

    columns: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    def imputed(self, c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(self.medians[c]))

    def scaled(self, c: str) -> Column:
        return (self.imputed(c) - F.lit(self.means[c])) / F.lit(self.deviations[c])

    def statement(self) -> str:
        """The preparation as a SQL stage, so that it is saved with the model."""
        parts = []
        for c in self.columns:
            filled = f"coalesce(`{c}`, {self.medians[c]!r}D)"
            parts.append(f"{filled} AS `{c}__imputed`")
            parts.append(f"(({filled}) - ({self.means[c]!r}D)) / ({self.deviations[c]!r}D) AS `{c}__scaled`")
            parts.append(f"CASE WHEN `{c}` IS NULL THEN 1.0D ELSE 0.0D END AS `{c}__missing`")
        return f"SELECT *, {', '.join(parts)} FROM __THIS__"


def fit_preparation(train: DataFrame, columns: list[str] = FEATURES) -> Preparation:
    """Exact medians, then mean and population deviation of the imputed columns; 0 deviation becomes 1."""
    medians = {c: 0.0 if v is None else float(v) for c, v in exact_quantiles(train, columns, 0.5).items()}
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns}
    row = train.agg(
        *[F.avg(e).alias(f"{c}__m") for c, e in filled.items()],
        *[F.stddev_pop(e).alias(f"{c}__s") for c, e in filled.items()],
    ).first()
    return Preparation(
        columns,
        medians,
        {c: float(row[f"{c}__m"]) for c in columns},
        {c: float(row[f"{c}__s"]) or 1.0 for c in columns},
    )


def balanced_weight(train: DataFrame, label: str) -> tuple[Column, int]:
    """Row weight n / (2 n_class) and n."""
    counts = {int(r[label]): r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * max(1, counts.get(1, 0)))).otherwise(n / (2.0 * max(1, counts.get(0, 0))))
    return weight, n


def _logistic(n: int, features: str = "scaled_vector") -> LogisticRegression:
    return LogisticRegression(
        featuresCol=features, labelCol="label__", weightCol="weight__", maxIter=MAX_ITER, tol=1e-8,
        regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
        probabilityCol="logistic_vector", rawPredictionCol="logistic_raw", predictionCol="logistic_class",
    )


def fit_models(train: DataFrame, label: str, columns: list[str] = FEATURES, trees: int = TREES, seed: int = 42) -> tuple[PipelineModel, Preparation]:
    """Logistic regression on scaled inputs and boosted trees on unscaled ones with missing indicators."""
    preparation = fit_preparation(train, columns)
    weight, n = balanced_weight(train, label)
    prepare = SQLTransformer(statement=preparation.statement())
    scaled = VectorAssembler(inputCols=[f"{c}__scaled" for c in columns], outputCol="scaled_vector")
    plain = VectorAssembler(
        inputCols=[f"{c}__{kind}" for kind in ("imputed", "missing") for c in columns], outputCol="tree_vector"
    )
    ready = plain.transform(scaled.transform(prepare.transform(train))).select(
        F.col(label).cast("double").alias("label__"), weight.alias("weight__"), "scaled_vector", "tree_vector"
    )
    logistic = _logistic(n).fit(ready)
    trees_model = level_trees.fit(ready, GBTClassifier(
        featuresCol="tree_vector", labelCol="label__", maxDepth=DEPTH, maxIter=trees, stepSize=LEARNING_RATE,
        subsamplingRate=ROW_SHARE, seed=seed, predictionCol="boosting_class",
    ))
    return PipelineModel([prepare, scaled, plain, logistic, trees_model]), preparation


def score(df: DataFrame, model: PipelineModel, *keep: str) -> DataFrame:
    """Probabilities of both models; the boosted one decides when it is there."""
    scored = model.transform(df)
    has_trees = "boosting_class" in scored.columns
    logistic = vector_to_array("logistic_vector")[1]
    boosting = vector_to_array("probability")[1] if has_trees else F.lit(None).cast("double")
    return scored.select(
        *(keep or df.columns),
        logistic.alias("logistic_probability"),
        boosting.alias("boosting_probability"),
        F.coalesce(boosting, logistic).alias("main_probability"),
    )


def reported_scores(scored: DataFrame, *keep: str) -> DataFrame:
    """Percentages with one decimal and the name of the deciding model."""
    return scored.select(
        *keep,
        F.bround(F.col("logistic_probability") * 100.0, 1).alias("atrial_remodeling_score_logistic"),
        F.bround(F.col("boosting_probability") * 100.0, 1).alias("atrial_remodeling_score_gradient_boosting"),
        F.bround(F.col("main_probability") * 100.0, 1).alias("main_atrial_remodeling_score"),
        F.when(F.col("boosting_probability").isNull(), MODEL_NAMES[0]).otherwise(MODEL_NAMES[1]).alias("model_used"),
    )


def coefficients(model: PipelineModel) -> list[float]:
    logistic = next(s for s in model.stages if hasattr(s, "coefficients"))
    return [float(v) for v in logistic.coefficients]


def contributions(columns: list[str], weights: list[float]) -> Column:
    """Coefficient times the unscaled input, largest absolute value first."""
    items = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).alias("value"),
            F.when(F.lit(w) * F.col(c) >= 0, "increases").otherwise("decreases").alias("direction"),
            (F.lit(w) * F.col(c)).alias("contribution"),
        )
        for c, w in zip(columns, weights)
    ])
    # Equal sizes keep the column order, so the position is the second key.
    keyed = F.transform(
        items, lambda s, i: F.struct((-F.abs(s["contribution"])).alias("k"), i.alias("i"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def as_predictions(scored: DataFrame, label: str, probability: str, *keep: str) -> DataFrame:
    return scored.select(F.col(label).cast("int").alias("y_true"), F.col(probability).alias("y_score"), *keep)


@dataclass
class Trained:
    model: PipelineModel
    preparation: Preparation
    metrics: DataFrame
    calibration: DataFrame
    metadata: dict = field(default_factory=dict)


def train(
    table: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42, trees: int = TREES,
    dataset: str = "PTB-XL",
) -> Trained:
    """Split, fit, evaluate both models on the held-out rows."""
    rows = table.filter(F.col(label).isNotNull())
    split = materialise(stratified_split(rows.select(key, *FEATURES, label), key, label, test_share, seed))
    model, preparation = fit_models(split.filter(~F.col("is_test")), label, trees=trees, seed=seed)
    held_out = materialise(score(split.filter("is_test"), model, key, label))
    both = {
        "logistic": as_predictions(held_out, label, "logistic_probability"),
        "gradient_boosting": as_predictions(held_out, label, "boosting_probability"),
    }
    metrics = curve = None
    for name, predictions in both.items():
        tagged = predictions.withColumn("dataset", F.lit(name))
        report = evaluation.metrics_report(tagged, with_accuracy=True).filter(F.col("dataset") != evaluation.OVERALL)
        points = evaluation.calibration_curve(tagged).filter(F.col("dataset") != evaluation.OVERALL)
        metrics = report if metrics is None else metrics.unionByName(report)
        curve = points if curve is None else curve.unionByName(points)
    found = {r["dataset"]: r.asDict() for r in metrics.collect()}
    metadata = {
        "dataset": dataset,
        "records_used": split.count(),
        "model_target": MODEL_TARGET,
        "target_column": label,
        "warning": MODEL_WARNING,
        "random_state": seed,
        "test_size": test_share,
        "feature_columns": list(FEATURES),
        "missing_value_strategy": "exact medians of the training rows replace missing inputs",
        "normalization": "logistic regression inputs: less the mean, over the population deviation, of the imputed training rows",
        "gradient_model_type": "GBTClassifier",
        "logistic_auc": found["logistic"]["auc"],
        "gradient_boosting_auc": found["gradient_boosting"]["auc"],
        "logistic_metrics": {k: v for k, v in found["logistic"].items() if k != "dataset"},
        "gradient_boosting_metrics": {k: v for k, v in found["gradient_boosting"].items() if k != "dataset"},
        "calibration": {
            name: [
                {"predicted": r["predicted"], "observed": r["observed"]}
                for r in curve.filter(F.col("dataset") == name).orderBy("bin").collect()
            ]
            for name in both
        },
        "missing_value_defaults": dict(METADATA_DEFAULTS),
        "medians": preparation.medians,
    }
    return Trained(model, preparation, metrics, curve, metadata)


def save_artifacts(spark: SparkSession, trained: Trained, folder: str) -> None:
    """The whole pipeline (preparation, both models) and one metadata line."""
    trained.model.write().overwrite().save(f"{folder}/pipeline")
    line = spark.createDataFrame([(json.dumps(trained.metadata),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_artifacts(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    """Pipeline and metadata; both are required."""
    try:
        model = PipelineModel.load(f"{folder}/pipeline")
        text = spark.read.text(f"{folder}/metadata").first()
    except Exception as cause:
        raise RuntimeError(ARTIFACTS_MISSING) from cause
    if text is None:
        raise RuntimeError(ARTIFACTS_MISSING)
    return model, json.loads(text["value"])


def reload_difference(sample: DataFrame, key: str, before: PipelineModel, after: PipelineModel) -> DataFrame:
    """Largest difference of either probability over the rows, before and after a reload."""
    one = score(sample, before, key).toDF(key, "l1", "b1", "m1")
    two = score(sample, after, key).toDF(key, "l2", "b2", "m2")
    return one.join(two, key).agg(
        F.max(F.abs(F.col("l1") - F.col("l2"))).alias("logistic_difference"),
        F.max(F.abs(F.col("b1") - F.col("b2"))).alias("boosting_difference"),
    )


def smoke_scores(table: DataFrame, model: PipelineModel, key: str, label: str, n: int = 5) -> DataFrame:
    """The first rows by key with both probabilities, the class at 0.5 and the truth."""
    return score(table.orderBy(key).limit(n), model, key, label).select(
        key,
        F.col("boosting_probability").alias("gradient_probability"),
        "logistic_probability",
        (F.col("boosting_probability") >= 0.5).cast("int").alias("predicted_class"),
        F.col(label).cast("int").alias("true_class"),
    )


def serving_defaults(metadata: dict) -> dict[str, float]:
    return feature_ops.serving_defaults(metadata.get("missing_value_defaults"), metadata.get("medians", {}))


# --- calibration -------------------------------------------------------------------------------


def fit_platt(predictions: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the label on the logit of the score, without penalty."""
    line = calibration.platt_lines(predictions.select("y_true", "y_score", F.lit(evaluation.OVERALL).alias("dataset"))).first()
    return float(line["slope"]), float(line["intercept"])


def apply_platt(score_: Column, slope: float, intercept: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * logit(score_) + F.lit(intercept))))


def calibrated(predictions: DataFrame, method: str) -> DataFrame:
    """Add ``calibrated``, fitted on the same rows."""
    if method == "platt":
        return predictions.withColumn("calibrated", apply_platt(F.col("y_score"), *fit_platt(predictions)))
    if method == "isotonic":
        return calibration.isotonic(predictions)
    raise ValueError(f"Unknown calibration method: {method}")


def calibration_report(predictions: DataFrame, method: str) -> DataFrame:
    """Brier score before and after, slope and intercept of the calibrated probability."""
    fitted = calibrated(predictions, method)
    after = fitted.select("y_true", F.col("calibrated").alias("y_score"))
    slope, intercept = fit_platt(after)
    return fitted.agg(
        F.lit(method).alias("method"),
        F.avg(F.pow(F.col("y_score") - F.col("y_true"), 2)).alias("brier_before"),
        F.avg(F.pow(F.col("calibrated") - F.col("y_true"), 2)).alias("brier_score"),
        F.lit(slope).alias("calibration_slope"),
        F.lit(intercept).alias("calibration_intercept"),
    )


def external_validation(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics per dataset with calibration slope and intercept, all lines from one fit."""
    lines = calibration.platt_lines(calibration.with_overall(predictions)).select(
        "dataset", F.col("slope").alias("calibration_slope"), F.col("intercept").alias("calibration_intercept")
    )
    return evaluation.metrics_report(predictions, threshold).join(lines, "dataset")


# --- ablation ----------------------------------------------------------------------------------

# The feature groups of the ablation table, and two more.
_P_WAVE = ["p_duration_ms", "p_amplitude_mv", "p_axis_deg", "pr_interval_ms", "ptfv1_mv_ms"]
_MORPHOLOGY = ["qrs_duration_ms", "qtc_ms"]
ABLATION_GROUPS = {
    "RR only": RR_FEATURES,
    "P-wave only": _P_WAVE,
    "Morphology only": _MORPHOLOGY,
    "RR + P wave": [*RR_FEATURES, *_P_WAVE],
    "RR + P wave + morphology": [*RR_FEATURES, *_P_WAVE, *_MORPHOLOGY],
    "P wave + morphology": [*_P_WAVE, *_MORPHOLOGY],
    "Demographics only": ["age", "sex"],
    "All": [*FEATURES, *RR_FEATURES],
}


def ablation_scores(table: DataFrame, key: str, label: str, groups: dict[str, list[str]] = ABLATION_GROUPS, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``dataset`` (the group), ``y_true``, ``y_score`` of the held-out rows by the logistic model of each group.

    All groups are fitted in the same passes. A table without interval columns has the groups that need none,
    and "All" is what it has.
    """
    columns = [c for c in [*FEATURES, *RR_FEATURES] if c in table.columns]
    rows = table.filter(F.col(label).isNotNull())
    split = materialise(stratified_split(rows.select(key, *columns, label), key, label, test_share, seed))
    fit_rows, held_out = split.filter(~F.col("is_test")), split.filter("is_test")
    preparation = fit_preparation(fit_rows, columns)
    weight, n = balanced_weight(fit_rows, label)

    def ready(df: DataFrame) -> DataFrame:
        return df.select(
            F.array(*[preparation.scaled(c) for c in columns]).alias("x"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w")
        )

    able = {g: [columns.index(c) for c in wanted if c in columns] for g, wanted in groups.items() if g == "All" or set(wanted) <= set(columns)}
    return score_groups(ready(held_out), able, fit_groups(materialise(ready(fit_rows)), able, 1.0 / n))


def ablation(table: DataFrame, key: str, label: str, groups: dict[str, list[str]] = ABLATION_GROUPS, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Held-out metrics of the logistic model on each group of inputs."""
    report = evaluation.metrics_report(materialise(ablation_scores(table, key, label, groups, test_share, seed)))
    return report.filter(F.col("dataset") != evaluation.OVERALL).withColumnRenamed("dataset", "feature_group")
