"""Signal quality of a lead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from signalframe.functions.arrays import clamp, diff, fill, let, lets, present, quantile_of_sorted, sorted_present

USABLE = 35.0  # a lead of at least this quality counts as usable


def finite_ratio(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.size(present(x)) / F.nullif(F.size(x), F.lit(0))).otherwise(0.0)


def _noise(x: Column) -> Column:
    """Deviation of the slope of a lead without missing samples; the mean slope is end less start."""

    def spread(a: Column, count: Column) -> Column:
        return let(
            (F.get(a, count) - F.get(a, F.lit(0))) / count,
            lambda m: F.sqrt(F.aggregate(diff(a), F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / count),
        )

    return F.when(F.size(x) > 2, let(x, lambda a: let(F.size(a) - 1, lambda count: spread(a, count)))).otherwise(0.0)


def _amplitude(s: Column) -> Column:
    """95th less 5th percentile of ascending samples."""
    return quantile_of_sorted(s, 0.95) - quantile_of_sorted(s, 0.05)


def _or_one(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(1.0))


def lead_quality(x: Column) -> Column:
    """0 to 100: finite share, less noise, less 60 for a flat line; 0 when nothing is finite."""

    def run(raw: Column, s: Column) -> Column:
        share = F.size(s) / F.nullif(F.size(raw), F.lit(0))
        whole = F.size(s) == F.size(raw)
        return let(
            F.when(whole, raw).otherwise(fill(raw, quantile_of_sorted(s, 0.5))),
            lambda a: lets(
                [let(F.when(whole, s).otherwise(F.sort_array(a)), _amplitude), _noise(a)],
                lambda amp, noise: F.when(F.size(s) == 0, 0.0).otherwise(
                    clamp(
                        share * 100.0
                        - F.least(F.lit(100.0), noise / _or_one(amp) * 100.0) * 1.4
                        - F.when(amp < 1e-6, 60.0).otherwise(0.0),
                        0.0,
                        100.0,
                    )
                ),
            ),
        )

    return F.when(F.size(x) > 0, let(x, lambda raw: let(sorted_present(raw), lambda s: run(raw, s)))).otherwise(0.0)


def _quality(x: np.ndarray) -> float:
    """:func:`lead_quality` of one lead, missing samples as NaN."""
    ascending = np.sort(x)  # NaN last
    s = ascending[: len(x) - int(np.isnan(ascending).sum())]
    if not len(s):
        return 0.0

    def quantile(values: np.ndarray, q: float) -> float:
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    share = len(s) / len(x)
    if len(s) < len(x):
        x = np.where(np.isnan(x), quantile(s, 0.5), x)
        ascending = np.sort(x)
    amplitude = quantile(ascending, 0.95) - quantile(ascending, 0.05)
    noise = float(np.diff(x).std()) if len(x) > 2 else 0.0
    found = share * 100.0 - min(100.0, noise / (amplitude or 1.0) * 100.0) * 1.4 - (60.0 if amplitude < 1e-6 else 0.0)
    return min(100.0, max(0.0, found))


def _qualities(leads):
    out = []
    for record in leads:
        qualities = []
        for lead in record.values:
            lead = lead.values
            qualities.append(None if lead is None else _quality(lead.to_numpy(zero_copy_only=False)))
        out.append(qualities)
    return pa.array(out, type=pa.list_(pa.float64()))


# Spark reads these to tell the kind of function; text annotations would not do.
_qualities.__annotations__ = {"leads": pa.Array, "return": pa.Array}
_qualities_udf = F.arrow_udf(_qualities, T.ArrayType(T.DoubleType()))


def lead_qualities(leads: Column) -> Column:
    """:func:`lead_quality` of every lead of an array of leads, NULL for a missing lead; one Arrow pass over them."""
    return _qualities_udf(leads)


def _wave(x: np.ndarray, width: int) -> dict:
    """What the index reads from the samples of a lead, missing ones as NaN and filled with the median."""
    lost = np.isnan(x)
    n, there = len(x), len(x) - int(lost.sum())
    a = np.where(lost, np.median(x[~lost]) if there else 0.0, x)
    a = a - np.median(a) if n else a
    ascending, drift = np.sort(a), None
    if n >= width:
        ahead = (width - 1) // 2
        drift = float((np.convolve(a, np.ones(width))[ahead: ahead + n] / width).std())
    amplitude = None
    if n:
        at = np.array([0.95, 0.05]) * (n - 1)
        low = at.astype(int)
        high = np.minimum(low + 1, n - 1)
        upper, lower = ascending[low] + (ascending[high] - ascending[low]) * (at - low)
        amplitude = float(upper - lower)
    return {
        "share": there / n if n else 0.0, "amplitude": amplitude, "noise": float(np.diff(a).std()) if n > 2 else 0.0, "drift": drift, "n": n or None,
    }


_WAVE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("share", "amplitude", "noise", "drift")] + [T.StructField("n", T.IntegerType())])


def _waves(x, width):
    out = []
    for samples, w in zip(x, width):
        values = samples.values
        out.append(_wave(np.empty(0) if values is None else values.to_numpy(zero_copy_only=False).astype(float), w.as_py()))
    kinds = [(f.name, pa.int32() if f.name == "n" else pa.float64()) for f in _WAVE]
    return pa.StructArray.from_arrays([pa.array([r[c] for r in out], t) for c, t in kinds], names=[c for c, _ in kinds])


_waves.__annotations__ = {"x": pa.Array, "width": pa.Array, "return": pa.Array}
_waves_udf = F.arrow_udf(_waves, _WAVE)


def signal_quality(x: Column, fs: Column, beats: Column, usable: Column, leads: Column) -> Column:
    """The quality index of the working lead and its parts, rounded as reported; the samples take one Arrow pass.

    An amplitude of 0 is replaced by 1 before the flat-line test, so an exactly flat lead is not
    penalised here; :func:`lead_quality` does penalise it.
    """
    width = F.coalesce(F.greatest(fs, F.lit(1.0)).cast("int"), F.lit(1))

    def run(w: Column, rate: Column) -> Column:
        amp = _or_one(w["amplitude"])
        bpm = F.coalesce(F.try_divide(beats.cast("double"), F.try_divide(w["n"], rate)) * 60.0, F.lit(0.0))
        return lets(
            [
                F.when(amp < 1e-6, 100.0).otherwise(0.0),
                F.least(F.lit(100.0), w["noise"] / amp * 100.0),
                F.least(F.lit(100.0), w["drift"] / amp * 100.0),
                F.when((bpm >= 35.0) & (bpm <= 220.0), 100.0).otherwise(clamp(bpm / 35.0 * 100.0, 0.0, 100.0)),
            ],
            lambda flat, noise_ratio, wander, success: F.struct(
                F.bround(
                    clamp(
                        95.0
                        - (1.0 - w["share"]) * 80.0
                        - noise_ratio * 1.45
                        - wander * 1.05
                        - flat
                        + usable / F.greatest(F.lit(1), leads) * 8.0
                        + success * 0.08,
                        0.0,
                        100.0,
                    ),
                    1,
                ).alias("signal_quality_index"),
                F.bround((1.0 - w["share"]) * 100.0, 1).alias("missing_data_percent"),
                F.bround(flat, 1).alias("flatline_score"),
                F.bround(noise_ratio, 1).alias("noise_score"),
                F.bround(wander, 1).alias("baseline_wander_score"),
                F.bround(success, 1).alias("qrs_detection_success"),
                usable.cast("int").alias("usable_leads"),
            ),
        )

    return lets([_waves_udf(x, width), fs], run)
