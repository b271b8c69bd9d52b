"""Table schemas and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Lead order, the order in which a working lead is chosen, upper-case spellings.
STANDARD_LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
WORKING_LEAD_ORDER = ["II", "MLII", "I", "III", "aVF", "aVL", "aVR", "V1"]
LEAD_SPELLING = {name.upper(): name for name in STANDARD_LEADS + ["MLII"]}

# Model input order and the names a label column may have.
FEATURES = [
    "age", "sex", "p_duration_ms", "p_amplitude_mv", "p_axis_deg",
    "pr_interval_ms", "qrs_duration_ms", "qtc_ms", "ptfv1_mv_ms",
]
#: Interval measures that a feature table may hold beside the model inputs.
RR_FEATURES = ["rr_mean_ms", "rr_cv", "rmssd_ms", "pnn50_percent", "sample_entropy", "shannon_entropy", "turning_point_ratio"]
TARGET_NAMES = ["atrial_abnormality", "current_atrial_abnormality", "target", "label", "y"]
REPORTED_FEATURES = ["p_duration_ms", "pr_interval_ms", "qrs_duration_ms", "qtc_ms", "ptfv1_mv_ms"]

# The names under which an extractor may deliver a model input.
FEATURE_ALIASES = {
    "ptfv1_mv_ms": ["ptfv1_mv_ms", "ptfv1", "PTFV1", "ptfv1_ms", "ptfv1_mvms"],
    "pr_interval_ms": ["pr_interval_ms", "pr_mean_ms", "PR", "pr_interval"],
    "p_duration_ms": ["p_duration_ms", "p_wave_duration_ms", "P_duration_ms"],
    "p_amplitude_mv": ["p_amplitude_mv", "p_amp_mv", "P_amplitude_mv"],
    "p_axis_deg": ["p_axis_deg", "p_axis", "P_axis_deg"],
    "qrs_duration_ms": ["qrs_duration_ms", "qrs_ms", "QRS_duration_ms"],
    "qtc_ms": ["qtc_ms", "QTc", "qtc"],
}

# The two label code sets.
MORPHOLOGY_CODES = ["LAO/LAE", "RAO/RAE", "LAE", "RAE", "BAE", "ABQRS", "LAFB"]
RHYTHM_CODES = ["AFIB", "AFLT", "LAO/LAE", "PAC", "RAO/RAE", "SARRH", "SVARR", "SVTAC"]

LEADS_LONG = T.StructType([
    T.StructField("record_id", T.StringType(), False),
    T.StructField("lead", T.StringType(), False),
    T.StructField("fs", T.DoubleType(), False),
    T.StructField("n", T.IntegerType(), False),
    T.StructField("samples", T.ArrayType(T.DoubleType()), False),
])


def records_schema(leads: list[str] = STANDARD_LEADS) -> T.StructType:
    """One row per record; each lead is its own column so that a scan reads only the leads it needs."""
    return T.StructType([
        T.StructField("record_id", T.StringType(), False),
        T.StructField("dataset", T.StringType()),
        T.StructField("fs", T.DoubleType(), False),
        T.StructField("n", T.IntegerType(), False),
        T.StructField("lead_names", T.ArrayType(T.StringType())),
        T.StructField("comments", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("leads", T.StructType([T.StructField(l, T.ArrayType(T.DoubleType())) for l in leads])),
    ])


DELINEATION = T.StructType([
    T.StructField("record_id", T.StringType(), False),
    T.StructField("beat_no", T.IntegerType(), False),
    T.StructField("r_idx", T.IntegerType()),
    T.StructField("p_on", T.IntegerType()),
    T.StructField("p_off", T.IntegerType()),
    T.StructField("p_peak", T.IntegerType()),
    T.StructField("q_on", T.IntegerType()),
    T.StructField("s_off", T.IntegerType()),
    T.StructField("t_off", T.IntegerType()),
])

RECORD_METADATA = T.StructType([
    T.StructField("ecg_id", T.LongType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("sex", T.DoubleType()),
    T.StructField("filename_lr", T.StringType()),
    T.StructField("scp_codes", T.StringType()),
])

FEATURE_TABLE = T.StructType(
    [T.StructField("ecg_id", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField("current_atrial_abnormality", T.IntegerType())]
)

PREDICTIONS = T.StructType([
    T.StructField("y_true", T.IntegerType()),
    T.StructField("y_score", T.DoubleType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
])
