"""How the given tables serve as inputs of the operators.

The arithmetic texts are valid in Spark and in DuckDB, so that both sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import synthetic
from signalframe.operators import intervals, measurement as M
from signalframe.operators.ordered import Series

MINUTE = 60_000_000.0

# Model inputs over the order key k: every column but two has holes.
FEATURE_SQL = {
    "age": "CASE WHEN k % 11 = 0 THEN NULL ELSE 20.0E0 + k % 70 END",
    "sex": "CASE WHEN k % 13 = 0 THEN NULL ELSE (k % 2) * 1.0E0 END",
    "p_duration_ms": "CASE WHEN k % 7 = 0 THEN NULL ELSE 60.0E0 + (k * 37) % 100 END",
    "p_amplitude_mv": "CASE WHEN k % 17 = 0 THEN NULL ELSE ((k * 53) % 300) / 1000.0E0 END",
    "p_axis_deg": "(k * 29) % 360 - 180.0E0",
    "pr_interval_ms": "CASE WHEN k % 5 = 0 THEN NULL ELSE 100.0E0 + (k * 41) % 160 END",
    "qrs_duration_ms": "60.0E0 + (k * 23) % 100",
    "qtc_ms": "CASE WHEN k % 19 = 0 THEN NULL ELSE 320.0E0 + (k * 31) % 200 END",
    "ptfv1_mv_ms": "CASE WHEN k % 3 = 0 THEN NULL ELSE ((k * 47) % 80) / -1000.0E0 END",
}

# Cuts of the model inputs for the check of a histogram.
CUTS = {
    "age": (35.0, 50.0, 70.0), "sex": (0.0,), "p_duration_ms": (80.0, 110.0, 140.0), "p_amplitude_mv": (0.1, 0.2), "p_axis_deg": (-60.0, 0.0, 90.0),
    "pr_interval_ms": (140.0, 200.0), "qrs_duration_ms": (80.0, 100.0, 120.0), "qtc_ms": (380.0, 430.0, 480.0), "ptfv1_mv_ms": (-0.05, -0.02),
}

# Aggregated measures for the rules, over the order key k, so that every branch is met.
RULE_SQL = {
    "heart_rate": "CASE WHEN k % 29 = 0 THEN NULL ELSE 30.0E0 + (k * 7) % 320 END",
    "cv": "((k * 13) % 300) / 1000.0E0",
    "rmssd": "((k * 17) % 250) * 1.0E0",
    "pnn50": "((k * 19) % 101) * 1.0E0",
    "irregularity": "((k * 23) % 101) + 0.0137E0",
    "p_presence": "CASE WHEN k % 6 = 0 THEN 0.0E0 ELSE ((k * 31) % 101) * 1.0E0 END",
    "pr_consistency": "((k * 37) % 101) * 1.0E0",
    "fib": "((k * 41) % 103) / 100.0E0",
    "sqi": "((k * 43) % 107) * 0.95E0 + 0.0113E0",
    "pr": "CASE WHEN k % 8 = 0 THEN NULL ELSE 100.5E0 + (k * 47) % 160 END",
    "qrs": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN 0.0E0 ELSE 70.0E0 + (k * 53) % 90 END",
    "fridericia": "CASE WHEN k % 9 = 0 THEN NULL ELSE 320.0E0 + (k * 59) % 180 END",
    "rr_mean": "CASE WHEN k % 41 = 0 THEN 0.0E0 ELSE 400.0E0 + (k * 61) % 900 END",
    "model_score": "((k * 67) % 101) * 1.0E0",
    "beats": "(k * 71) % 12",
    "imputed": "(k * 73) % 4",
    "amp_ii": "CASE WHEN k % 43 = 0 THEN NULL ELSE ((k * 79) % 500) / 1000.0E0 END",
    "p_duration": "CASE WHEN k % 47 = 0 THEN NULL ELSE 60.0E0 + (k * 83) % 100 END",
    "ptfv1": "CASE WHEN k % 53 = 0 THEN NULL ELSE ((k * 89) % 90) / -1000.0E0 END",
    "p2_v1": "CASE WHEN k % 59 = 0 THEN NULL ELSE ((k * 97) % 2500) / -1000.0E0 END",
    "p2_v3": "CASE WHEN k % 61 = 0 THEN NULL ELSE ((k * 101) % 2500) / -1000.0E0 END",
    "swing_avl": "CASE WHEN k % 67 = 0 THEN NULL ELSE ((k * 103) % 2000) / 1000.0E0 END",
    "swing_v5": "CASE WHEN k % 3 = 1 THEN NULL ELSE ((k * 107) % 3000) / 1000.0E0 END",
    "swing_v6": "CASE WHEN k % 4 = 1 THEN NULL ELSE ((k * 109) % 3000) / 1000.0E0 END",
    "v1_net": "CASE WHEN k % 71 = 0 THEN NULL ELSE ((k * 113) % 2001 - 1000) / 1000.0E0 END",
    "v6_net": "CASE WHEN k % 73 = 0 THEN NULL ELSE ((k * 127) % 2001 - 1000) / 1000.0E0 END",
    "qt": "CASE WHEN k % 10 = 0 THEN NULL ELSE 300.0E0 + (k * 131) % 200 END",
    "axis_class": "CASE WHEN k % 4 = 0 THEN 'right axis deviation' WHEN k % 4 = 1 THEN 'normal axis' ELSE 'unavailable' END",
    "age": "CASE WHEN k % 7 = 3 THEN NULL ELSE 20.0E0 + (k * 3) % 60 END",
    "sex": "CASE k % 6 WHEN 0 THEN ' Male' WHEN 1 THEN 'female' WHEN 2 THEN 'M' WHEN 3 THEN 'f ' WHEN 4 THEN 'unknown' ELSE NULL END",
}

# Segment level per lead over the order key k, in hundredths of a millivolt; some leads absent.
LEVEL_SQL = {
    lead: f"CASE WHEN k % {skip} = 0 THEN NULL ELSE ((k * {step}) % 61 - 30) / 100.0E0 END"
    for lead, step, skip in [
        ("I", 3, 97), ("II", 7, 89), ("III", 11, 83), ("aVR", 13, 79), ("aVL", 17, 73), ("aVF", 19, 71),
        ("V1", 23, 67), ("V2", 29, 59), ("V3", 31, 53), ("V4", 37, 47), ("V5", 41, 43), ("V6", 43, 37),
    ]
}
CODES_SQL = "concat('{''', event_type, ''': 100.0, ''', CASE event_id % 5 WHEN 0 THEN 'LAE' WHEN 1 THEN 'NORM' WHEN 2 THEN 'AFIB' WHEN 3 THEN 'ABQRS' ELSE 'SR' END, ''': 0.0}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rr_events(spark: SparkSession, sf_dir: str, **options) -> Series:
    """Minutes between the events of a user as the interval series of a record."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("record_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(ts AS timestamp_ntz))").alias("t"), "event_id"
    )
    return intervals.rr_series(events, "record_id", "t", ["t", "event_id"], MINUTE, **options)


def embedding_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as a one-lead signal of two seconds at 32 Hz."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("record_id"),
        F.lit("MLII").alias("lead"),
        F.lit(32.0).alias("fs"),
        F.size("embedding").alias("n"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y_true"))
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("y_score"), F.col("lang").alias("dataset"), "n_chars"
    )
    return labels.join(documents, "doc_id").select(
        "y_true", "y_score", F.col("doc_id").cast("string").alias("patient_id"), "dataset", "n_chars"
    )


def _derived(spark: SparkSession, sf_dir: str, columns: dict[str, str], *keep: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    return orders.selectExpr("k", *keep, *[f"{sql} AS {name}" for name, sql in columns.items()])


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, FEATURE_SQL, "k AS ecg_id", "cast(o_orderstatus = 'F' as int) AS current_atrial_abnormality")


def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs with interval measures, over the order key; one measure has holes."""
    more = {"rr_mean_ms": "CASE WHEN k % 23 = 0 THEN NULL ELSE 500.0E0 + (k * 59) % 700 END", "rr_cv": RULE_SQL["cv"],
            "rmssd_ms": RULE_SQL["rmssd"], "pnn50_percent": RULE_SQL["pnn50"], "sample_entropy": "((k * 61) % 40) / 100.0E0",
            "shannon_entropy": "((k * 67) % 35) / 10.0E0", "turning_point_ratio": "((k * 71) % 101) / 101.0E0"}
    return _derived(spark, sf_dir, FEATURE_SQL | more, "k AS ecg_id", "cast(o_orderstatus = 'F' as int) AS current_atrial_abnormality")


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, RULE_SQL)


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, age, sex, st`` with the levels as a map of lead to value."""
    levels = {f"l_{lead}": sql for lead, sql in LEVEL_SQL.items()}
    rows = _derived(spark, sf_dir, {"age": RULE_SQL["age"], "sex": RULE_SQL["sex"], **levels})
    entries = F.array(*[F.struct(F.lit(l).alias("key"), F.col(f"l_{l}").alias("value")) for l in LEVEL_SQL])
    return rows.select(
        "k", "age", "sex", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("st")
    )


def detected(spark: SparkSession, sf_dir: str, leads: list[str] | None = None) -> DataFrame:
    """Synthetic records with their beats, found in the working lead."""
    return M.detect_beats(synthetic.records(spark, sf_dir))


def delineation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave positions around the true beats of the synthetic records, with holes."""
    truth = synthetic.records(spark, sf_dir).select("record_id", "k", F.posexplode("truth").alias("beat_no", "r"))
    hole = lambda every, e: F.when((F.col("k") + F.col("beat_no")) % every != 0, e)
    return truth.select(
        "record_id",
        "beat_no",
        F.col("r").alias("r_idx"),
        hole(5, F.col("r") - 22).alias("p_on"),
        hole(7, F.col("r") - 9).alias("p_off"),
        hole(6, F.col("r") - 16).alias("p_peak"),
        hole(11, F.col("r") - 5).alias("q_on"),
        hole(8, F.col("r") + 6).alias("s_off"),
        hole(9, F.col("r") + 38).alias("t_off"),
    )
