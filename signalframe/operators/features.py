"""The feature table: batch morphology from delineated waves, labels, model input."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from signalframe.functions.arrays import cut, let, lets, mean, present
from signalframe.functions.beats import milliseconds
from signalframe.functions.rhythm import add_interval_features, rr_intervals
from signalframe.functions.values import clean, code_map, first_alias, has_code
from signalframe.schemas import FEATURES, MORPHOLOGY_CODES, REPORTED_FEATURES, RR_FEATURES

MIN_BEATS = 3


def interval_means(delineation: DataFrame, intervals: dict[str, tuple[str, str]], fs: float) -> DataFrame:
    """Mean of end less start per record, over the beats that have both; combined before the shuffle."""
    return delineation.groupBy("record_id").agg(*[
        F.avg(milliseconds(F.col(end) - F.col(start), F.lit(fs))).alias(name) for name, (start, end) in intervals.items()
    ])


def delineation_arrays(delineation: DataFrame) -> DataFrame:
    """One row per record with its waves in beat order, to stand beside the record's samples.

    A record that fits a row has fewer beats than samples, so its waves fit too.
    """
    waves = ["beat_no", "r_idx", "p_on", "p_off", "p_peak", "q_on", "s_off", "t_off"]
    return delineation.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct(*waves))).alias("waves"))


def interval_ms(waves: Column, start: str, end: str, fs: Column) -> Column:
    """Mean of end less start over the beats that have both."""
    return lets(
        [waves, fs],
        lambda w, rate: mean(F.transform(w, lambda b: milliseconds(b[end] - b[start], rate))),
    )


def value_at_peaks(samples: Column, waves: Column) -> Column:
    """Mean raw sample at the P peaks."""
    return lets([samples, waves], lambda a, w: mean(F.transform(w, lambda b: F.get(a, b["p_peak"]))))


def terminal_force(v1: Column, waves: Column, fs: Column) -> Column:
    """Mean over beats of abs(lowest) times the time below zero within ``[p_on, p_off)`` of raw V1.

    Positive by definition, unlike the online measure; the two never share a column.
    """

    def run(a: Column, w: Column, rate: Column) -> Column:
        def measure(b: Column) -> Column:
            return let(
                F.filter(cut(a, b["p_on"], b["p_off"]), lambda v: v < 0),
                lambda low: F.when(
                    b["p_on"].isNotNull() & b["p_off"].isNotNull() & (F.size(low) > 0),
                    F.abs(F.array_min(low)) * milliseconds(F.size(low), rate),
                ),
            )

        return mean(F.transform(w, measure))

    return lets([v1, waves, fs], run)


def morphology(records: DataFrame, delineation: DataFrame) -> DataFrame:
    """The seven batch measurements; all NULL below three beats.

    The beats of a record travel to its row, not its samples to the beats: records stored by
    :func:`signalframe.sources.tables.save_by_record` are read in place, and neither they nor any others
    are sorted, as each task holds the few beats of its records in a table.
    """
    joined = records.join(delineation_arrays(delineation).hint("shuffle_hash"), "record_id", "left")
    w, fs = F.col("waves"), F.col("fs")
    beats = F.transform(w, lambda b: b["r_idx"])
    measured = joined.select(
        "record_id",
        (F.coalesce(F.size(present(beats)), F.lit(0)) >= MIN_BEATS).alias("_enough"),
        interval_ms(w, "p_on", "p_off", fs).alias("p_duration_ms"),
        value_at_peaks(F.col("leads")["II"], w).alias("p_amplitude_mv"),
        value_at_peaks(F.col("leads")["I"], w).alias("_p_i"),
        value_at_peaks(F.col("leads")["aVF"], w).alias("_p_avf"),
        interval_ms(w, "p_on", "q_on", fs).alias("pr_interval_ms"),
        interval_ms(w, "q_on", "s_off", fs).alias("qrs_duration_ms"),
        interval_ms(w, "q_on", "t_off", fs).alias("_qt"),
        # The mean interval is the span over the count: the intermediate beats cancel.
        lets(
            [present(beats), fs],
            lambda p, rate: F.when(
                F.size(p) > 1,
                (F.get(p, F.size(p) - 1) - F.get(p, F.lit(0))) / rate / F.nullif(F.size(p) - 1, F.lit(0)),
            ),
        ).alias("_rr_s"),
        terminal_force(F.col("leads")["V1"], w, fs).alias("ptfv1_mv_ms"),
    )
    result = {
        "p_duration_ms": F.col("p_duration_ms"),
        "p_amplitude_mv": F.col("p_amplitude_mv"),
        "p_axis_deg": F.degrees(F.atan2(F.col("_p_avf"), F.col("_p_i"))),
        "pr_interval_ms": F.col("pr_interval_ms"),
        "qrs_duration_ms": F.col("qrs_duration_ms"),
        "qtc_ms": F.when(F.col("_rr_s") > 0, F.col("_qt") / F.sqrt("_rr_s")),
        "ptfv1_mv_ms": F.col("ptfv1_mv_ms"),
    }
    return measured.select("record_id", *[F.when(F.col("_enough"), e).alias(n) for n, e in result.items()])


def labelled(metadata: DataFrame, codes: list[str] = MORPHOLOGY_CODES) -> DataFrame:
    return metadata.withColumn(
        "current_atrial_abnormality", has_code(code_map(F.col("scp_codes")), codes)
    )


def interval_columns(detected: DataFrame) -> DataFrame:
    """``record_id`` and the interval measures of records with their beats; NULL without two intervals."""
    staged = detected.select("record_id", rr_intervals(F.col("peaks"), F.col("fs")).alias("_rr"))
    return add_interval_features(staged, "_rr", "_i").select(
        "record_id", *[F.when(F.col("_i.rr_count") > 1, F.col(f"_i.{c}")).alias(c) for c in RR_FEATURES]
    )


def feature_table(
    metadata: DataFrame, measured: DataFrame, codes: list[str] = MORPHOLOGY_CODES, intervals: DataFrame | None = None
) -> DataFrame:
    """Metadata rows joined with the measurements of their record; unmatched rows are dropped.

    ``intervals`` (:func:`interval_columns`) adds its measures, NULL for a record it does not hold.
    """
    if intervals is not None:
        measured = measured.join(intervals.select("record_id", *RR_FEATURES), "record_id", "left")
    return (
        labelled(metadata, codes)
        .join(measured, metadata["filename_lr"] == measured["record_id"])
        .select("ecg_id", *FEATURES, *(RR_FEATURES if intervals is not None else []), "current_atrial_abnormality")
    )


def unmatched(metadata: DataFrame, records: DataFrame) -> DataFrame:
    """Metadata rows without a record, for the dead-letter table."""
    return metadata.join(records, metadata["filename_lr"] == records["record_id"], "left_anti")


def merge_present(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Columns of ``override`` replace those of ``base`` where they are not NULL."""
    other = override.select(key, *[F.col(c).alias(f"_o_{c}") for c in override.columns if c != key])
    joined = base.join(other, key, "left")
    columns = list(dict.fromkeys([*base.columns, *override.columns]))
    return joined.select(*[
        F.coalesce(*[F.col(c) for c in (f"_o_{name}", name) if c in joined.columns]).alias(name) if name != key else F.col(key)
        for name in columns
    ])


def canonical_features(df: DataFrame, *keep: str) -> DataFrame:
    """The model inputs under their canonical names; NULL where no alias has a value."""
    return df.select(*keep, *[first_alias(df, f).alias(f) for f in FEATURES])


def serving_defaults(metadata: dict[str, float] | None, medians: dict[str, float | None]) -> dict[str, float]:
    """Metadata defaults first, then the medians of training."""
    found = {f: v for f, v in (metadata or {}).items() if f in FEATURES and v is not None}
    for feature, value in medians.items():
        if value is not None:
            found.setdefault(feature, value)
    return found


def imputation_sources(defaults: dict[str, float], value: Callable[[str], Column] = F.col) -> Column:
    """``ARRAY<STRUCT<feature, source>>`` of the inputs that have no value."""
    notes = F.array(*[
        F.when(
            value(f).isNull(),
            F.struct(
                F.lit(f).alias("feature"),
                F.lit("training fallback" if f in defaults else "last-resort zero fallback").alias("source"),
            ),
        )
        for f in FEATURES
    ])
    return F.filter(notes, lambda n: n.isNotNull())


def model_input(df: DataFrame, defaults: dict[str, float], *keep: str) -> DataFrame:
    """Canonical inputs with defaults, then zero; ``imputed`` lists each replaced input and its source."""
    raw = canonical_features(df, *keep)
    return raw.select(
        *keep,
        *[F.coalesce(F.col(f), F.lit(float(defaults.get(f, 0.0)))).alias(f) for f in FEATURES],
        imputation_sources(defaults).alias("imputed"),
    )


def completeness(df: DataFrame) -> Column:
    """Number of missing model inputs of a row."""
    return reduce(lambda a, b: a + b, [F.when(clean(F.col(f)).isNull(), 1).otherwise(0) for f in FEATURES])


def reported_features(value: Callable[[str], Column] = F.col) -> Column:
    """The five reported inputs as (feature, value)."""
    return F.array(*[
        F.struct(F.lit(f).alias("feature"), value(f).alias("value")) for f in FEATURES if f in REPORTED_FEATURES
    ])
