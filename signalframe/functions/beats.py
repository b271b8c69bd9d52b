"""Beat detection and beat-window measurements on one lead, in the row that holds its samples.

``x`` is the raw lead, ``c`` the centred one (:func:`signalframe.functions.arrays.centre`),
``peaks`` an ascending ``ARRAY<INT>`` of beat positions and ``fs`` the sampling rate in Hz.
A window around a beat is a slice of the row, never a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from signalframe.functions.arrays import (
    absolute, argmax_first, clamp, cut, dense_std, diff, indices, let, lets, mean, mean_of_dense, median,
    moving_average, offset, present, std,
)

MIN_WINDOW = 3  # samples; a shorter window is not measured


def milliseconds(samples: Column, fs: Column) -> Column:
    return samples / fs * 1000.0


def qrs_energy(c: Column, fs: Column) -> Column:
    """Squared slope, averaged over 120 ms; the slope of the first sample is 0."""
    slope = let(c, lambda a: F.concat(F.array(F.get(a, F.lit(0)) * 0.0), diff(a)))
    return moving_average(F.transform(slope, lambda v: v * v), offset(fs, 0.12))


def refractory_walk(c: Column, candidates: Column, fs: Column) -> Column:
    """Accept candidates in order, each one moved to the largest deflection within 80 ms.

    A candidate closer than 250 ms to the last accepted *moved* position is skipped.
    """

    def run(a: Column, found: Column, rate: Column) -> Column:
        reach = offset(rate, 0.08)
        wait = F.greatest(F.lit(1), offset(rate, 0.25))

        def step(acc: Column, at: Column) -> Column:
            start = F.greatest(F.lit(0), at - reach)
            end = F.least(F.size(a), at + reach)
            moved = let(
                start + argmax_first(absolute(cut(a, start, end))),
                lambda m: F.struct(m.alias("last"), F.concat(acc["peaks"], F.array(m)).alias("peaks")),
            )
            return F.when((at - acc["last"] < wait) | (end <= start), acc).otherwise(moved)

        empty = F.struct((-wait).alias("last"), F.expr("cast(array() as array<int>)").alias("peaks"))
        return F.aggregate(found, empty, step, lambda acc: F.sort_array(F.array_distinct(acc["peaks"])))

    return lets([c, candidates, fs], run)


def detect_peaks(c: Column, fs: Column) -> Column:
    """Beat positions of a centred lead: ascending, distinct, empty when there are none."""

    def run(a: Column, rate: Column) -> Column:
        energy = qrs_energy(a, rate)
        candidates = let(
            energy,
            lambda e: let(
                let(present(e), lambda p: mean_of_dense(p) + 1.6 * dense_std(p)),
                lambda limit: indices(e, lambda v: v > limit),
            ),
        )
        return F.coalesce(refractory_walk(a, candidates, rate), F.expr("cast(array() as array<int>)"))

    return lets([c, fs], run)


def first_beats(peaks: Column, count: int | None) -> Column:
    return peaks if count is None else F.slice(peaks, 1, count)


def per_beat(peaks: Column, count: int | None, measure: Callable[[Column], Column]) -> Column:
    """``measure`` for each of the first ``count`` beats, beats without a result dropped."""
    return present(F.transform(first_beats(peaks, count), measure))


def before(p: Column, fs: Column, seconds: float) -> Column:
    """Index ``seconds`` before a beat, not below 0."""
    return F.greatest(F.lit(0), p - offset(fs, seconds))


def after(p: Column, n: Column, fs: Column, seconds: float) -> Column:
    """Index ``seconds`` after a beat, not above ``n``."""
    return F.least(n, p + offset(fs, seconds))


def beat_windows(n: Column, peaks: Column, fs: Column, left: float, right: float, count: int | None = None) -> Column:
    """Non-empty ``[start, end)`` ranges around the beats, clipped to the record."""
    return F.filter(
        F.transform(
            first_beats(peaks, count),
            lambda p, i: F.struct(
                i.alias("beat_no"),
                p.alias("r_idx"),
                F.greatest(F.lit(0), p + offset(fs, left)).alias("start_idx"),
                F.least(n, p + offset(fs, right)).alias("end_idx"),
            ),
        ),
        lambda w: w["end_idx"] > w["start_idx"],
    )


def p_wave(c: Column, peaks: Column, fs: Column) -> Column:
    """Deflection 250 to 120 ms before each beat: presence, PR, duration, amplitude.

    Values are rounded as reported; later rules read the rounded ones.
    """

    def run(a: Column, beats: Column, rate: Column, threshold: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [before(p, rate, 0.25), before(p, rate, 0.12)],
                lambda start, end: let(
                    absolute(cut(a, start, end)),
                    lambda s: let(
                        argmax_first(s),
                        lambda at: let(
                            F.get(s, at),
                            lambda top: F.when(
                                (end - start >= MIN_WINDOW) & (top >= threshold),
                                let(
                                    indices(s, lambda v: v < top * 0.5),
                                    lambda low: F.struct(
                                        milliseconds(p - (start + at), rate).alias("pr"),
                                        top.alias("amplitude"),
                                        clamp(
                                            milliseconds(
                                                F.coalesce(F.array_min(F.filter(low, lambda i: i > at)), F.size(s) - 1)
                                                - F.coalesce(F.array_max(F.filter(low, lambda i: i < at)), F.lit(0)),
                                                rate,
                                            ),
                                            40.0,
                                            180.0,
                                        ).alias("duration"),
                                    ),
                                ),
                            ),
                        ),
                    ),
                ),
            )

        return let(per_beat(beats, None, measure), lambda found: summary(found, F.size(beats)))

    def summary(found: Column, beats: Column) -> Column:
        presence = F.when(beats > 0, F.size(found) / F.nullif(beats, F.lit(0)) * 100.0).otherwise(0.0)
        pr = F.transform(found, lambda f: f["pr"])
        spread = F.when(F.size(found) > 1, std(pr))
        return lets(
            [presence, spread],
            lambda share, sd: F.struct(
                F.bround(share, 1).alias("p_wave_presence_ratio"),
                F.bround(mean(pr), 1).alias("pr_mean_ms"),
                F.bround(sd, 1).alias("pr_sd_ms"),
                # A spread of exactly 0 counts as unknown, like a missing one.
                F.when(
                    beats > 0,
                    F.bround(F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(45.0)) * 2.2), 1),
                ).otherwise(0.0).alias("pr_consistency"),
                F.bround(mean(F.transform(found, lambda f: f["duration"])), 1).alias("p_duration_ms"),
                F.bround(mean(F.transform(found, lambda f: f["amplitude"])), 4).alias("p_amplitude_mv"),
                F.bround(100.0 - share, 1).alias("missing_p_wave_percent"),
            ),
        )

    return lets(
        [c, peaks, fs],
        lambda a, beats, rate: let(
            F.greatest(std(a) * 0.08, F.lit(1e-6)), lambda threshold: run(a, beats, rate, threshold)
        ),
    )


def _active_span(s: Column, share: float) -> Column:
    """First and last index where the absolute window reaches a share of its maximum."""
    return let(
        F.greatest(F.array_max(s) * share, F.lit(1e-9)),
        lambda limit: let(
            indices(s, lambda v: v >= limit),
            lambda on: F.when(
                F.size(on) > 0, F.struct(F.array_min(on).alias("first"), F.array_max(on).alias("last"))
            ),
        ),
    )


def qrs_spans(c: Column, peaks: Column, fs: Column, left: float, right: float, share: float, count: int) -> Column:
    """``ARRAY<STRUCT<q_on, r_idx, s_off>>`` per beat with a window of at least 3 samples."""

    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return lets(
                [before(p, rate, left), after(p, F.size(a), rate, right)],
                lambda start, end: F.when(
                    end - start >= MIN_WINDOW,
                    let(
                        _active_span(absolute(cut(a, start, end)), share),
                        lambda span: F.when(
                            span.isNotNull(),
                            F.struct(
                                (start + span["first"]).alias("q_on"),
                                p.alias("r_idx"),
                                (start + span["last"]).alias("s_off"),
                            ),
                        ),
                    ),
                ),
            )

        return per_beat(beats, count, measure)

    return lets([c, peaks, fs], run)


def qrs_bounds(c: Column, peaks: Column, fs: Column) -> Column:
    """Onset and offset of the first 30 beats."""
    return qrs_spans(c, peaks, fs, 0.09, 0.11, 0.16, 30)


def qrs_duration(c: Column, peaks: Column, fs: Column) -> Column:
    """Mean width in ms over the first 20 beats, rounded to 1 decimal."""
    return lets(
        [qrs_spans(c, peaks, fs, 0.08, 0.08, 0.18, 20), fs],
        lambda spans, rate: F.bround(
            mean(F.transform(spans, lambda b: milliseconds(b["s_off"] - b["q_on"] + 1, rate))), 1
        ),
    )


def qt_interval(c: Column, bounds: Column, fs: Column) -> Column:
    """Mean onset-to-T-end in ms over the first 12 bounds, unrounded; NULL when no T end is found."""

    def run(a: Column, spans: Column, rate: Column) -> Column:
        def measure(b: Column) -> Column:
            return lets(
                [after(b["r_idx"], F.size(a), rate, 0.12), after(b["r_idx"], F.size(a), rate, 0.52)],
                lambda start, end: F.when(
                    end > start + 5,
                    lets(
                        [
                            start + argmax_first(absolute(cut(a, start, end))),
                            F.when(b["q_on"] > 0, median(cut(a, before(b["q_on"], rate, 0.08), b["q_on"]))).otherwise(0.0),
                        ],
                        lambda top, level: let(
                            F.greatest(F.abs(F.get(a, top) - level) * 0.15, F.lit(1e-6)),
                            lambda limit: milliseconds(
                                top
                                + F.array_min(indices(cut(a, top, end), lambda v: F.abs(v - level) <= limit))
                                - b["q_on"],
                                rate,
                            ),
                        ),
                    ),
                ),
            )

        return mean(per_beat(spans, 12, measure))

    return lets([c, bounds, fs], run)


def ptfv1(c: Column, peaks: Column, fs: Column) -> Column:
    """Terminal force in V1 over the P window, first 20 beats: negative mV times ms, 3 decimals."""

    def run(a: Column, beats: Column, rate: Column) -> Column:
        def measure(p: Column) -> Column:
            return let(
                F.filter(cut(a, before(p, rate, 0.25), before(p, rate, 0.12)), lambda v: v < 0),
                lambda low: F.when(F.size(low) > 0, F.array_min(low) * milliseconds(F.size(low), rate)),
            )

        return F.bround(mean(per_beat(beats, 20, measure)), 3)

    return lets([c, peaks, fs], run)


def beat_similarity(c: Column, peaks: Column, fs: Column, left: float = 0.2, right: float = 0.4) -> Column:
    """Mean correlation of each whole beat window with the record's mean window."""

    def run(a: Column, beats: Column, rate: Column) -> Column:
        width = offset(rate, left) + offset(rate, right)
        windows = per_beat(
            beats,
            None,
            lambda p: F.when(
                (p >= offset(rate, left)) & (p + offset(rate, right) <= F.size(a)),
                cut(a, p - offset(rate, left), p + offset(rate, right)),
            ),
        )
        return lets(
            [windows, width],
            lambda all_, w: let(
                F.transform(F.sequence(F.lit(0), w - 1), lambda i: mean(F.transform(all_, lambda s: F.get(s, i)))),
                lambda centre_: F.when(
                    F.size(all_) > 0, mean(present(F.transform(all_, lambda s: correlation(s, centre_))))
                ),
            ),
        )

    return F.when(F.size(peaks) > 0, lets([c, peaks, fs], run))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two equally long arrays; NULL when one of them is constant."""
    return lets(
        [x, y],
        lambda a, b: lets(
            [mean(a), mean(b)],
            lambda ma, mb: lets(
                [
                    F.aggregate(F.zip_with(a, b, lambda p, q: (p - ma) * (q - mb)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))),
                    F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce((v - ma) * (v - ma), F.lit(0.0))),
                    F.aggregate(b, F.lit(0.0), lambda s, v: s + F.coalesce((v - mb) * (v - mb), F.lit(0.0))),
                ],
                lambda xy, xx, yy: F.when((xx > 0) & (yy > 0), xy / F.nullif(F.sqrt(xx * yy), F.lit(0.0))),
            ),
        ),
    )
