"""Measurements that compare leads: axes, segment levels, voltage criteria, T and Q waves.

All take centred samples unless the name says ``raw``; a missing lead is a NULL array.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalframe.functions.arrays import (
    cut, let, lets, mean, median, offset, quantile_of_sorted, sorted_present, total,
)
from signalframe.functions.beats import after, before, per_beat


def _net_qrs(c: Column, peaks: Column, fs: Column) -> Column:
    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return let(
                cut(a, before(p, rate, 0.04), after(p, F.size(a), rate, 0.06)),
                lambda s: F.array_max(s) + F.array_min(s),
            )

        return F.coalesce(mean(per_beat(beats, 12, measure)), F.lit(0.0))

    return lets([c, peaks, fs], run)


def _axis_band(axis: Column, normal: str, left: str, right: str, extreme: str) -> Column:
    return (
        F.when((axis >= -30.0) & (axis <= 90.0), normal)
        .when((axis >= -90.0) & (axis < -30.0), left)
        .when((axis > 90.0) & (axis <= 180.0), right)
        .otherwise(extreme)
    )


def _axis_struct(horizontal: Column, vertical: Column, known: Column, labels: tuple[str, ...]) -> Column:
    return let(
        F.when(known, F.degrees(F.atan2(vertical, horizontal))),
        lambda axis: F.struct(
            F.bround(axis, 1).alias("axis_deg"),
            F.when(axis.isNull(), "unavailable").otherwise(_axis_band(axis, *labels)).alias("classification"),
        ),
    )


def qrs_axis(lead_i: Column, lead_avf: Column, peaks: Column, fs: Column) -> Column:
    """Frontal axis from the net deflection in I and aVF, first 12 beats."""
    known = lead_i.isNotNull() & lead_avf.isNotNull() & (F.size(peaks) > 0)
    return _axis_struct(
        _net_qrs(lead_i, peaks, fs),
        _net_qrs(lead_avf, peaks, fs),
        known,
        ("normal axis", "left axis deviation", "right axis deviation", "extreme axis"),
    )


def _area(c: Column, peaks: Column, fs: Column, left: float, right: float) -> Column:
    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [F.greatest(F.lit(0), p + offset(rate, left)), F.least(F.size(a), p + offset(rate, right))],
                lambda start, end: F.when(end > start, total(cut(a, start, end))),
            )

        return F.coalesce(mean(per_beat(beats, 12, measure)), F.lit(0.0))

    return lets([c, peaks, fs], run)


def wave_axis(a: Column, b: Column, peaks: Column, fs: Column, left: float, right: float) -> Column:
    """Axis of the summed area of a wave in two leads, first 12 beats."""
    known = a.isNotNull() & b.isNotNull() & (F.size(peaks) > 0)
    return _axis_struct(
        _area(a, peaks, fs, left, right),
        _area(b, peaks, fs, left, right),
        known,
        ("normal", "left axis deviation", "right axis deviation", "extreme axis deviation"),
    )


def p_axis(lead_i: Column, lead_avf: Column, peaks: Column, fs: Column) -> Column:
    return wave_axis(lead_i, lead_avf, peaks, fs, -0.25, -0.12)


def t_axis(lead_i: Column, lead_avf: Column, peaks: Column, fs: Column) -> Column:
    return wave_axis(lead_i, lead_avf, peaks, fs, 0.14, 0.42)


def st_level(c: Column, peaks: Column, fs: Column) -> Column:
    """Level 80 ms after the beat less the median 200 to 80 ms before it, first 12 beats, 3 decimals."""

    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [before(p, rate, 0.20), before(p, rate, 0.08), F.least(F.size(a) - 1, p + offset(rate, 0.08))],
                lambda start, end, at: F.when(
                    (end > start) & (at > 0), F.get(a, at) - median(cut(a, start, end))
                ),
            )

        return F.bround(mean(per_beat(beats, 12, measure)), 3)

    return lets([c, peaks, fs], run)


def swing(c: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Distance between two percentiles, NULL for a missing lead."""
    return F.when(
        c.isNotNull(),
        let(sorted_present(c), lambda s: quantile_of_sorted(s, high) - quantile_of_sorted(s, low)),
    )


def low_percentile(c: Column, q: float = 0.02) -> Column:
    return F.when(c.isNotNull(), let(sorted_present(c), lambda s: quantile_of_sorted(s, q)))


def percentile_sum_raw(x: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.when(
        x.isNotNull(),
        let(sorted_present(x), lambda s: quantile_of_sorted(s, high) + quantile_of_sorted(s, low)),
    )


def atrial_amplitude(c: Column) -> Column:
    """92nd percentile less the median."""
    return F.when(
        c.isNotNull(),
        let(sorted_present(c), lambda s: quantile_of_sorted(s, 0.92) - quantile_of_sorted(s, 0.5)),
    )


def qrs_polarity(c: Column, peaks: Column, fs: Column) -> Column:
    """Mean height, mean depth and net deflection of the first 12 beats, 3 decimals."""

    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return let(
                cut(a, before(p, rate, 0.05), after(p, F.size(a), rate, 0.07)),
                lambda s: F.when(
                    F.array_max(s).isNotNull(),
                    F.struct(F.array_max(s).alias("r"), F.abs(F.array_min(s)).alias("s")),
                ),
            )

        return let(
            per_beat(beats, 12, measure),
            lambda found: lets(
                [mean(F.transform(found, lambda f: f["r"])), mean(F.transform(found, lambda f: f["s"]))],
                lambda r, s: F.struct(
                    F.bround(r, 3).alias("r_mv"), F.bround(s, 3).alias("s_mv"), F.bround(r - s, 3).alias("net_mv")
                ),
            ),
        )

    return lets([c, peaks, fs], run)


def t_wave(c: Column, peaks: Column, fs: Column, lead: Column) -> Column:
    """Amplitude and status of the T wave of one lead, first 10 beats; NULL when none is measured."""

    def run(a: Column, beats: Column, rate: Column, name: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [after(p, F.size(a), rate, 0.14), after(p, F.size(a), rate, 0.42)],
                lambda start, end: F.when(
                    end > start + 5,
                    let(
                        cut(a, start, end),
                        lambda s: F.struct(F.array_max(s).alias("high"), F.array_min(s).alias("low")),
                    ),
                ),
            )

        def judge(found: Column) -> Column:
            tops = F.transform(
                found, lambda f: F.when(F.abs(f["high"]) >= F.abs(f["low"]), f["high"]).otherwise(f["low"])
            )
            inverted = F.size(F.filter(tops, lambda t: t < 0)) / F.size(found) > 0.6
            both = F.size(F.filter(found, lambda f: (f["high"] > 0.12) & (f["low"] < -0.12)))
            return let(
                mean(tops),
                lambda m: F.struct(
                    F.bround(m, 3).alias("t_amplitude_mv"),
                    F.when(inverted, "T-wave inversion")
                    .when(F.abs(m) >= F.when(name.startswith("V"), 1.0).otherwise(0.5), "tall T waves")
                    .when(
                        both >= F.greatest(F.lit(2), F.floor(F.size(found) / 2).cast("int")), "biphasic T waves"
                    )
                    .otherwise("normal/undetermined")
                    .alias("status"),
                ),
            )

        return let(per_beat(beats, 10, measure), lambda found: F.when(F.size(found) > 0, judge(found)))

    return lets([c, peaks, fs, lead], run)


def deep_q(c: Column, peaks: Column, fs: Column) -> Column:
    """Mean depth 50 to 10 ms before the beat and mean height of the 40 ms after it, first 10 beats.

    ``pathologic`` holds when the depth reaches the larger of 0.10 mV and a quarter of the height.
    """

    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [before(p, rate, 0.05), before(p, rate, 0.01), after(p, F.size(a), rate, 0.04)],
                lambda start, end, stop: F.when(
                    (end > start) & (stop > p),
                    F.struct(
                        F.abs(F.array_min(cut(a, start, end))).alias("depth"),
                        F.abs(F.array_max(cut(a, p, stop))).alias("height"),
                    ),
                ),
            )

        return let(
            per_beat(beats, 10, measure),
            lambda found: lets(
                [mean(F.transform(found, lambda f: f["depth"])), mean(F.transform(found, lambda f: f["height"]))],
                lambda depth, height: F.struct(
                    depth.alias("q_depth_mv"),
                    height.alias("r_height_mv"),
                    F.coalesce(depth >= F.greatest(F.lit(0.10), height * 0.25), F.lit(False)).alias("pathologic"),
                ),
            ),
        )

    return lets([c, peaks, fs], run)
