"""Interval variability of series held as rows: one shuffle by series, then partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalframe.functions import rhythm
from signalframe.operators.ordered import PART_ROWS, Series, with_previous


def rr_series(
    events: DataFrame,
    key: str = "record_id",
    time: str = "t",
    order: list[str] | None = None,
    scale: float = 1.0,
    part_rows: int = PART_ROWS,
) -> Series:
    """Intervals, their first and second neighbours' differences and turning points.

    ``time`` is an integer clock (sample index, microseconds); ``scale`` turns a difference of it
    into milliseconds. The first beat of a series has no interval and is dropped.
    """
    base = with_previous(events, key, order or [time], time, 3, part_rows)
    gap = [
        (F.col(time) - F.col("prev_1")) / scale,
        (F.col("prev_1") - F.col("prev_2")) / scale,
        (F.col("prev_2") - F.col("prev_3")) / scale,
    ]
    rows = (
        base.rows.withColumn("rr_ms", gap[0])
        .withColumn("drr_ms", gap[0] - gap[1])
        .withColumn("turn", ((gap[0] - gap[1]) * (gap[1] - gap[2]) < 0).cast("int"))
        .filter(F.col("rr_ms").isNotNull())
        .drop("prev_1", "prev_2", "prev_3")
    )
    return Series(rows, base.keys, base.part_keys)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def variability(series: Series) -> DataFrame:
    """Unrounded mean, deviation, CV, RMSSD, SDNN, pNN50, Poincare and turning-point ratio."""
    moments = series.rows.groupBy(*series.keys).agg(
        F.count("rr_ms").alias("rr_count"),
        F.avg("rr_ms").alias("rr_mean_ms"),
        F.stddev_pop("rr_ms").alias("rr_sd_ms"),
        _zero(F.sqrt(F.avg(F.col("drr_ms") * F.col("drr_ms")))).alias("rmssd_ms"),
        _zero(F.avg((F.abs("drr_ms") > 50.0).cast("double")) * 100.0).alias("pnn50_percent"),
        F.stddev_pop("drr_ms").alias("_sdd"),
        F.sum("turn").alias("_turns"),
    )
    some = F.col("rr_count") >= 2
    sd, sdd = F.col("rr_sd_ms"), F.col("_sdd")
    return moments.select(
        *series.keys,
        "rr_count",
        "rr_mean_ms",
        "rr_sd_ms",
        _zero(F.try_divide(sd, F.col("rr_mean_ms"))).alias("rr_cv"),
        sd.alias("sdnn_ms"),
        "rmssd_ms",
        "pnn50_percent",
        F.when(some, F.sqrt(F.lit(0.5)) * sdd).otherwise(0.0).alias("poincare_sd1_ms"),
        F.when(some, F.sqrt(F.greatest(F.lit(0.0), 2.0 * sd * sd - 0.5 * sdd * sdd))).otherwise(0.0).alias("poincare_sd2_ms"),
        _zero(F.try_divide(F.col("_turns").cast("double"), (F.col("rr_count") - 2).cast("double"))).alias("turning_point_ratio"),
    )


def _histogram(series: Series, value: Column, spec: DataFrame) -> DataFrame:
    """Counts per occupied bin; ``spec`` gives low, high and bins per series.

    The limits travel to the rows along the parts the rows are already partitioned by.
    """
    if series.part_keys != series.keys:
        spec = series.rows.select(*series.part_keys).distinct().join(spec, series.keys)
    same = F.col("low") == F.col("high")
    lower = F.when(same, F.col("low") - 0.5).otherwise(F.col("low"))
    upper = F.when(same, F.col("high") + 0.5).otherwise(F.col("high"))
    slot = F.least(F.floor((F.col("_v") - lower) / (upper - lower) * F.col("bins")), F.col("bins") - 1)
    return (
        series.rows.withColumn("_raw", value)
        .filter(F.col("_raw").isNotNull())
        .join(spec, series.part_keys)
        .withColumn("_v", F.col("_raw") / F.col("spread"))
        .groupBy(*series.keys, "n", "bins", (upper - lower).alias("width"), slot.cast("int").alias("slot"))
        .agg(F.count(F.lit(1)).cast("double").alias("h"))
    )


def entropy_density(series: Series) -> DataFrame:
    """Density entropy of the differences in 8 bins; 0 below 5 intervals or without spread."""
    stats = series.rows.groupBy(*series.keys).agg(
        F.count("rr_ms").alias("rr_count"),
        F.count("drr_ms").alias("n"),
        F.stddev_pop("drr_ms").alias("spread"),
        F.min("drr_ms").alias("_low"),
        F.max("drr_ms").alias("_high"),
    )
    usable = stats.filter((F.col("rr_count") >= 5) & (F.col("spread") > 0)).select(
        *series.keys,
        "n",
        "spread",
        (F.col("_low") / F.col("spread")).alias("low"),
        (F.col("_high") / F.col("spread")).alias("high"),
        F.lit(8).alias("bins"),
    )
    density = F.col("h") / (F.col("n") * F.col("width") / F.col("bins"))
    found = _histogram(series, F.col("drr_ms"), usable).groupBy(*series.keys).agg(
        (-F.sum(density * F.ln(density)) / 10.0).alias("sample_entropy")
    )
    return stats.select(*series.keys, "rr_count").join(found, series.keys, "left").select(
        *series.keys, "rr_count", _zero(F.col("sample_entropy")).alias("sample_entropy")
    )


def entropy_shannon(series: Series) -> DataFrame:
    """Shannon entropy in bits over min(12, max(4, n div 2)) bins; 0 below 5 intervals."""
    stats = series.rows.groupBy(*series.keys).agg(
        F.count("rr_ms").alias("n"), F.min("rr_ms").alias("low"), F.max("rr_ms").alias("high")
    )
    usable = stats.filter(F.col("n") >= 5).select(
        *series.keys,
        "n",
        "low",
        "high",
        F.lit(1.0).alias("spread"),
        F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.col("n") / 2).cast("int"))).alias("bins"),
    )
    p = F.col("h") / F.col("n")
    found = _histogram(series, F.col("rr_ms"), usable).groupBy(*series.keys).agg(
        (-F.sum(p * F.log2(p))).alias("shannon_entropy")
    )
    return stats.select(*series.keys, F.col("n").alias("rr_count")).join(found, series.keys, "left").select(
        *series.keys, "rr_count", _zero(F.col("shannon_entropy")).alias("shannon_entropy")
    )


def rhythm_features(series: Series) -> DataFrame:
    """All interval measures in one row per series, with the irregularity index."""
    whole = (
        variability(series)
        .join(entropy_density(series).drop("rr_count"), series.keys)
        .join(entropy_shannon(series).drop("rr_count"), series.keys)
    )
    return whole.withColumn(
        "rr_irregularity_index",
        rhythm.irregularity(*[
            F.col(c)
            for c in ("rr_cv", "rmssd_ms", "pnn50_percent", "sample_entropy", "shannon_entropy", "turning_point_ratio")
        ]),
    )


def rhythm_report(features: DataFrame, key: str = "record_id") -> DataFrame:
    """The rounded rhythm summary with its class."""
    return features.select(
        key,
        rhythm.rhythm_summary(*[F.col(c) for c in ("rr_count", "rr_mean_ms", "rr_sd_ms", "rr_cv", "rmssd_ms")]).alias("r"),
    ).select(key, "r.*")
