"""Small fixed dimension tables. Their size is set here, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalframe.schemas import MORPHOLOGY_CODES, RHYTHM_CODES

# Dataset key, name, modality, native format, primary task, validation group, notes.
DATASETS = [
    ("ptbxl", "PTB-XL", "12-lead ECG", "WFDB", "morphology and diagnostic labels", "PTB-XL",
     "Primary Version 1 source. Use direct waveform loading for Version 2."),
    ("chapman", "Chapman ECG", "12-lead ECG", "WFDB or CSV depending mirror", "rhythm and diagnostic classes", "Chapman",
     "Useful for AF rhythm detection and domain-shift testing."),
    ("georgia", "Georgia 12-lead", "12-lead ECG", "WFDB", "rhythm and diagnostic classes", "Georgia",
     "Useful for PhysioNet challenge-style multi-label training."),
    ("cpsc2018", "CPSC2018", "12-lead ECG", "MAT/WFDB-convertible", "arrhythmia classification", "CPSC",
     "External validation target for arrhythmia and AF detection."),
    ("ptb_diagnostic", "PTB Diagnostic ECG", "12-lead ECG", "WFDB", "diagnostic ECG classification", "PTB Diagnostic",
     "Useful for diagnostic confounders and ischemia/cardiomyopathy labels."),
    ("mitbih_afdb", "MIT-BIH AFDB", "rhythm ECG", "WFDB", "AF rhythm detection", "MIT-BIH AFDB",
     "Rhythm-focused AF validation dataset."),
    ("mitbih_arrhythmia", "MIT-BIH Arrhythmia Database", "rhythm ECG", "WFDB", "arrhythmia beat/rhythm classification",
     "MIT-BIH Arrhythmia", "Useful for rhythm confounders and beat-level validation."),
]
DATASET_COLUMNS = [
    "dataset_key", "name", "modality", "native_format", "primary_task", "external_validation_group", "notes",
]


def dataset_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, ", ".join(f"{c} string" for c in DATASET_COLUMNS))


def with_dataset_spec(records: DataFrame, key: str = "dataset_key") -> DataFrame:
    """Join the registry; an unknown key is an error when its row is read."""
    spec = dataset_registry(records.sparkSession).withColumnRenamed("dataset_key", key)
    joined = records.join(F.broadcast(spec), key, "left")
    unknown = F.concat(F.lit("unknown dataset key: "), F.coalesce(F.col(key), F.lit("NULL")))
    return joined.withColumn("name", F.when(F.col("name").isNotNull(), F.col("name")).otherwise(F.raise_error(unknown)))


def territories(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """``territory, position, lead``."""
    rows = [(t, i, lead) for t, leads in groups.items() for i, lead in enumerate(leads)]
    return spark.createDataFrame(rows, "territory string, position int, lead string")


def label_codes(spark: SparkSession) -> DataFrame:
    """Both label code sets as rows."""
    rows = [("morphology", c) for c in MORPHOLOGY_CODES] + [("rhythm", c) for c in RHYTHM_CODES]
    return spark.createDataFrame(rows, "label_set string, code string")


def territory_findings(
    lead_findings: DataFrame, groups: dict[str, list[str]], passes: Column, least: int = 2
) -> DataFrame:
    """Territories in which at least ``least`` leads of a record pass, with the leads in order.

    A record has a dozen leads and a handful of territories, so its groups are small by nature.
    """
    dimension = territories(lead_findings.sparkSession, groups)
    # The passing leads travel as bits, so that the aggregate stays a plain hash aggregate.
    found = (
        lead_findings.filter(passes)
        .join(F.broadcast(dimension), "lead")
        .groupBy("record_id", "territory")
        .agg(
            F.count(F.lit(1)).cast("int").alias("lead_count"),
            F.sum(F.pow(F.lit(2.0), F.col("position")).cast("bigint")).alias("bits"),
        )
        .filter(F.col("lead_count") >= least)
    )
    members = F.create_map(*[
        part for t, leads in groups.items() for part in (F.lit(t), F.array(*[F.lit(l) for l in leads]))
    ])
    passed = F.filter(
        F.transform(members[F.col("territory")], lambda l, i: F.when(F.getbit(F.col("bits"), i) == 1, l)),
        lambda l: l.isNotNull(),
    )
    return found.select("record_id", "territory", "lead_count", F.array_join(passed, ", ").alias("leads"))
