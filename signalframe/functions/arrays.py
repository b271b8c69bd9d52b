"""Column functions over a sample array kept in one row.

Inputs are ``ARRAY<DOUBLE>`` where NULL marks a missing sample. Every function binds its array
arguments with :func:`let`, so an argument is evaluated once per row however often it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body``: computed once, usable many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lets(values: list[Column], body: Callable[..., Column]) -> Column:
    """:func:`let` for several values."""
    if not values:
        return body()
    return let(values[0], lambda v: lets(values[1:], lambda *rest: body(v, *rest)))


def offset(fs: Column, seconds: float) -> Column:
    """Seconds as a number of samples, truncated toward zero."""
    return (F.lit(float(seconds)) * fs).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def present(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def total(x: Column) -> Column:
    """Sum of the non-missing values, 0 for none."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def mean(x: Column) -> Column:
    """Mean of the non-missing values, NULL for none."""
    return let(present(x), lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)))


def mean_of_dense(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(p), F.lit(0))


def dense_std(p: Column) -> Column:
    """Population standard deviation of an array without missing values, NULL for none."""
    return let(
        p,
        lambda a: let(
            mean_of_dense(a),
            lambda m: F.sqrt(
                F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / F.nullif(F.size(a), F.lit(0))
            ),
        ),
    )


def std(x: Column) -> Column:
    """Population standard deviation of the non-missing values, NULL for none."""
    return dense_std(present(x))


def sorted_present(x: Column) -> Column:
    """The non-missing values ascending. Missing ones sort first, so one look tells if there are any."""
    return let(
        F.sort_array(x),
        lambda s: F.when(F.get(s, F.lit(0)).isNull(), present(s)).otherwise(s),
    )


def quantile_of_sorted(s: Column, q: float) -> Column:
    """Linear interpolation at position (n-1)q of an ascending array without NULLs."""
    return lets(
        [(F.size(s) - 1) * F.lit(float(q))],
        lambda h: lets(
            [F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))],
            lambda a, b: a + (b - a) * (h - F.floor(h)),
        ),
    )


def quantile(x: Column, q: float) -> Column:
    return let(sorted_present(x), lambda s: quantile_of_sorted(s, q))


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def centre(x: Column) -> Column:
    return let(x, lambda a: let(median(a), lambda m: F.transform(a, lambda v: v - m)))


def fill(x: Column, value: Column) -> Column:
    return F.transform(x, lambda v: F.coalesce(v, value))


def diff(x: Column) -> Column:
    """First differences, one shorter than the input."""
    return let(
        x,
        lambda a: F.transform(
            F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
            lambda v, i: v - F.get(a, i),
        ),
    )


def moving_sum(x: Column, window: Column) -> Column:
    """Zero-padded sum over ``[i - w//2, i + (w-1)//2]``; NULL where the frame holds a missing sample.

    Built from sums over 1, 2, 4, ... samples and the binary digits of the width, so the work is
    n log w instead of n w, without the cancellation of differences of running sums.
    """

    def run(a: Column, w: Column) -> Column:
        padded = F.concat(
            F.array_repeat(F.lit(0.0), F.floor(w / 2).cast("int")),
            F.transform(a, lambda v: F.coalesce(v, F.lit(float("nan")))),
            F.array_repeat(F.lit(0.0), w),
        )
        levels = F.length(F.bin(w.cast("bigint"))) - 1
        start = F.struct(
            padded.alias("block"),
            F.expr("cast(null as array<double>)").alias("out"),
            F.lit(0).alias("off"),
            F.lit(1).alias("step"),
        )

        def widen(acc: Column, bit: Column) -> Column:
            block, out, off, step = acc["block"], acc["out"], acc["off"], acc["step"]
            taken = F.getbit(w, bit) == 1
            added = F.when(out.isNull(), F.slice(block, off + 1, F.size(a))).otherwise(
                F.transform(out, lambda v, i: v + F.get(block, i + off))
            )
            wider = F.zip_with(
                F.slice(block, F.lit(1), F.size(block) - step),
                F.slice(block, step + 1, F.size(block) - step),
                lambda v, u: v + u,
            )
            return F.struct(
                F.when(bit < levels, wider).otherwise(block).alias("block"),
                F.when(taken, added).otherwise(out).alias("out"),
                F.when(taken, off + step).otherwise(off).alias("off"),
                (step * 2).alias("step"),
            )

        summed = F.aggregate(F.sequence(F.lit(0), levels), start, widen, lambda acc: acc["out"])
        return F.when(F.exists(a, lambda v: v.isNull()), F.transform(summed, lambda v: F.when(~F.isnan(v), v))).otherwise(summed)

    return lets([x, F.greatest(window, F.lit(1))], run)


def moving_average(x: Column, window: Column) -> Column:
    """Moving sum over the width (not over the count); NULL when the array is shorter than the width."""
    return lets(
        [x, F.greatest(window, F.lit(1))],
        lambda a, w: F.when(F.size(a) >= w, F.transform(moving_sum(a, w), lambda v: v / w)),
    )


def argmax_first(a: Column) -> Column:
    """0-based index of the largest value, the first on ties; NULL when there is none."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def absolute(x: Column) -> Column:
    return F.transform(x, lambda v: F.abs(v))


def cut(x: Column, start: Column, end: Column) -> Column:
    """Samples ``[start, end)``; an empty array when the range is empty."""
    return F.when(end > start, F.slice(x, start + 1, end - start)).otherwise(F.slice(x, F.lit(1), F.lit(0)))


def indices(a: Column, test: Callable[[Column], Column]) -> Column:
    """0-based indices whose value passes ``test``."""
    return let(
        a,
        lambda v: F.when(
            F.size(v) > 0, F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: test(F.get(v, i)))
        ).otherwise(F.expr("cast(array() as array<int>)")),
    )
