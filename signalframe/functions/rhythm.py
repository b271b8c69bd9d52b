"""Interval variability of one record whose beats are an array in the row.

For series too long for a row, :mod:`signalframe.operators.intervals` computes the same from rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalframe.functions.arrays import absolute, diff, let, lets, mean, std, total


def rr_intervals(peaks: Column, fs: Column) -> Column:
    return let(fs, lambda rate: F.transform(diff(peaks), lambda d: d / rate * 1000.0))


def _histogram_terms(values: Column, bins: Column) -> Column:
    """Counts of the occupied bins; equal widths over [min, max], the last bin closed at both ends."""

    def run(v: Column, count: Column, low: Column, high: Column) -> Column:
        # A constant series gets the range [value - 0.5, value + 0.5].
        lower = F.when(low == high, low - 0.5).otherwise(low)
        upper = F.when(low == high, high + 0.5).otherwise(high)
        return lets(
            [lower, upper - lower],
            lambda start, width: let(
                F.transform(
                    v, lambda x: F.least(F.floor((x - start) / width * count).cast("int"), (count - 1).cast("int"))
                ),
                lambda slots: F.transform(
                    F.array_distinct(slots), lambda s: F.size(F.filter(slots, lambda o: o == s)).cast("double")
                ),
            ),
        )

    return lets([values, bins, F.array_min(values), F.array_max(values)], run)


def entropy_density(rr: Column) -> Column:
    """-sum(h ln h)/10 of the 8-bin density histogram of the scaled differences; 0 below 5 values."""

    def run(r: Column) -> Column:
        return let(
            diff(r),
            lambda d: let(
                std(d),
                lambda spread: F.when((F.size(r) < 5) | (spread == 0), 0.0).otherwise(
                    let(
                        F.transform(d, lambda v: v / spread),
                        lambda s: lets(
                            [_histogram_terms(s, F.lit(8)), (F.array_max(s) - F.array_min(s)) / 8.0],
                            lambda counts, width: -total(
                                F.transform(
                                    counts,
                                    lambda c: c / (F.size(s) * width) * F.ln(c / (F.size(s) * width)),
                                )
                            )
                            / 10.0,
                        ),
                    )
                ),
            ),
        )

    return let(rr, run)


def entropy_shannon(rr: Column) -> Column:
    """-sum(p log2 p) over min(12, max(4, n div 2)) bins; 0 below 5 values."""

    def run(r: Column) -> Column:
        bins = F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.size(r) / 2).cast("int")))
        return F.when(F.size(r) < 5, 0.0).otherwise(
            let(
                _histogram_terms(r, bins),
                lambda counts: -total(F.transform(counts, lambda c: c / F.size(r) * F.log2(c / F.size(r)))),
            )
        )

    return let(rr, run)


def turning_points(rr: Column) -> Column:
    """Strict local extrema over the inner points."""

    def run(r: Column) -> Column:
        return F.when(F.size(r) < 3, 0.0).otherwise(
            let(
                diff(r),
                lambda d: F.size(
                    F.filter(F.transform(d, lambda v, i: F.get(d, i - 1) * v < 0), lambda t: t)
                )
                / (F.size(r) - 2),
            )
        )

    return let(rr, run)


def basic_moments(rr: Column) -> Column:
    """Struct: count, mean, deviation, mean square and deviation of the differences, share above 50 ms."""

    def run(r: Column) -> Column:
        return let(
            diff(r),
            lambda d: F.struct(
                F.size(r).alias("rr_count"),
                F.coalesce(mean(r), F.lit(0.0)).alias("rr_mean_ms"),
                F.coalesce(std(r), F.lit(0.0)).alias("rr_sd_ms"),
                F.coalesce(F.sqrt(mean(F.transform(d, lambda v: v * v))), F.lit(0.0)).alias("rmssd_ms"),
                F.coalesce(std(d), F.lit(0.0)).alias("drr_sd_ms"),
                F.when(
                    F.size(d) > 0,
                    F.size(F.filter(absolute(d), lambda v: v > 50.0)) / F.nullif(F.size(d), F.lit(0)) * 100.0,
                ).otherwise(0.0).alias("pnn50_percent"),
            ),
        )

    return let(rr, run)


def add_interval_features(df: DataFrame, rr: str, alias: str) -> DataFrame:
    """Add a struct of unrounded variability measures; zeros where the service reports zeros."""
    staged = df.withColumns({
        "_m": basic_moments(F.col(rr)),
        "_density": entropy_density(F.col(rr)),
        "_shannon": entropy_shannon(F.col(rr)),
        "_turns": turning_points(F.col(rr)),
    })
    m = F.col("_m")
    sd, sdd = m["rr_sd_ms"], m["drr_sd_ms"]
    few = m["rr_count"] < 2
    cv = F.coalesce(F.try_divide(sd, m["rr_mean_ms"]), F.lit(0.0))
    parts = {
        "rr_count": m["rr_count"],
        "rr_mean_ms": m["rr_mean_ms"],
        "rr_sd_ms": sd,
        "rr_cv": cv,
        "rmssd_ms": m["rmssd_ms"],
        "pnn50_percent": m["pnn50_percent"],
        "sample_entropy": F.col("_density"),
        "shannon_entropy": F.col("_shannon"),
        "poincare_sd1_ms": F.when(few, 0.0).otherwise(F.sqrt(F.lit(0.5)) * sdd),
        "poincare_sd2_ms": F.when(few, 0.0).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), 2.0 * sd * sd - 0.5 * sdd * sdd))
        ),
        "turning_point_ratio": F.col("_turns"),
        "rr_irregularity_index": irregularity(
            cv, m["rmssd_ms"], m["pnn50_percent"], F.col("_density"), F.col("_shannon"), F.col("_turns")
        ),
    }
    return staged.withColumn(alias, F.struct(*[c.alias(n) for n, c in parts.items()])).drop(
        "_m", "_density", "_shannon", "_turns"
    )


def irregularity(cv: Column, rmssd: Column, pnn50: Column, sampen: Column, shannon: Column, tpr: Column) -> Column:
    """The index of the online score, from unrounded inputs."""
    return F.least(
        F.lit(100.0),
        cv * 155.0 + rmssd / 3.2 + pnn50 * 0.55 + sampen * 13.0 + shannon * 5.0 + tpr * 18.0,
    )


def irregularity_basic(cv_rounded: Column, rmssd_rounded: Column, p_presence: Column) -> Column:
    """The index of the measurement bundle, from rounded inputs."""
    return F.least(
        F.lit(100.0),
        F.coalesce(cv_rounded, F.lit(0.0)) * 155.0
        + F.coalesce(rmssd_rounded, F.lit(0.0)) / 3.2
        + (100.0 - p_presence) * 0.2,
    )


def regularity(cv: Column) -> Column:
    return F.when(cv < 0.08, "regular").when(cv < 0.16, "mildly irregular").otherwise("irregular")


def rhythm_summary(count: Column, m: Column, sd: Column, cv: Column, rmssd: Column) -> Column:
    """The reported rhythm struct: rounded, all NULL and 'unavailable' without an interval."""
    some = count > 0
    return F.struct(
        F.when(some, F.bround(m, 1)).alias("mean_rr_ms"),
        F.when(some, F.bround(sd, 1)).alias("rr_sd_ms"),
        F.when(some, F.bround(cv, 3)).alias("rr_cv"),
        F.when(some, F.bround(rmssd, 1)).alias("rmssd_ms"),
        F.when(some, F.bround(F.try_divide(F.lit(60000.0), m), 1)).alias("heart_rate_bpm"),
        F.when(some, regularity(cv)).otherwise("unavailable").alias("regularity"),
    )
