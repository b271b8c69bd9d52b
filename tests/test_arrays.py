import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import arrays as A
from signalframe.operators.measurement import preview_values
from signalframe.operators.preprocessing import resample


def one(spark, values, *columns):
    df = spark.createDataFrame([(values,)], "x array<double>")
    return df.select(*columns).first()


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 12, 30])
def test_moving_average_is_same_convolution(spark, width):
    x = np.random.default_rng(width).normal(size=30)
    got = one(spark, x.tolist(), A.moving_average(F.col("x"), F.lit(width)))[0]
    assert np.allclose(got, np.convolve(x, np.ones(width) / width, "same"), atol=1e-12)


def test_moving_average_wider_than_signal_is_null(spark):
    assert one(spark, [1.0, 2.0], A.moving_average(F.col("x"), F.lit(3)))[0] is None


def test_missing_sample_spoils_its_frames_only(spark):
    got = one(spark, [1.0, None, 3.0, 4.0, 5.0], A.moving_average(F.col("x"), F.lit(3)))[0]
    assert got[:3] == [None, None, None]
    assert got[3] == pytest.approx(4.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_quantiles_interpolate_like_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    qs = [0.02, 0.05, 0.5, 0.92, 0.95, 0.98]
    got = one(spark, x.tolist(), *[A.quantile(F.col("x"), q).alias(str(q)) for q in qs])
    assert np.allclose(list(got), np.percentile(x, [q * 100 for q in qs]), atol=1e-12)


def test_statistics_skip_missing_and_are_null_on_empty(spark):
    got = one(spark, [1.0, None, 4.0], A.mean(F.col("x")), A.std(F.col("x")), A.median(F.col("x")))
    assert list(got) == [2.5, 1.5, 2.5]
    assert list(one(spark, [], A.mean(F.col("x")), A.std(F.col("x")), A.median(F.col("x")))) == [None, None, None]


def test_argmax_takes_the_first_of_ties(spark):
    assert one(spark, [1.0, 3.0, 3.0], A.argmax_first(F.col("x")))[0] == 1
    assert one(spark, [], A.argmax_first(F.col("x")))[0] is None


def test_diff_and_offset(spark):
    got = one(spark, [1.0, 4.0, 2.0], A.diff(F.col("x")), A.offset(F.lit(100.0), -0.257), A.offset(F.lit(100.0), 0.257))
    assert list(got) == [[3.0, -2.0], -25, 25]
    assert one(spark, [1.0], A.diff(F.col("x")))[0] == []


def test_preview_picks_evenly_and_scales(spark):
    x = np.sin(np.arange(1000) / 7.0)
    got = one(spark, x.tolist(), preview_values(F.col("x")))[0]
    picked = x[np.linspace(0, 999, 600).astype(int)]
    want = (picked - np.median(picked)) / np.abs(picked - np.median(picked)).max()
    assert np.allclose(got, want, atol=6e-5)
    assert one(spark, [2.0, 2.0, 2.0], preview_values(F.col("x")))[0] == [0.0, 0.0, 0.0]
    assert one(spark, [], preview_values(F.col("x")))[0] == []


def test_resample_interpolates_linearly(spark):
    got = one(spark, [0.0, 1.0, 3.0], resample(F.col("x"), F.lit(100.0), 200.0))[0]
    assert got == [0.0, 0.5, 1.0, 2.0, 3.0]


def test_normalise_equals_convolution(spark):
    from signalframe.operators.preprocessing import normalise

    rng = np.random.default_rng(3)
    x, broken = rng.normal(size=300), rng.normal(size=300)
    rows = [("a", 250.0, 300, ["ii", "V2"], {"ii": x.tolist(), "V2": None}), ("b", 250.0, 300, ["ii"], {"ii": [None if i == 150 else float(v) for i, v in enumerate(broken)], "V2": []})]
    records = spark.createDataFrame(rows, "record_id string, fs double, n int, lead_names array<string>, leads struct<ii: array<double>, V2: array<double>>")
    got = {r.record_id: r for r in normalise(records).collect()}
    y = np.interp(np.arange(599) / 2, np.arange(300), x)
    same = lambda v, w: np.convolve(np.concatenate((np.zeros(w // 2), v, np.zeros((w - 1) // 2))), np.ones(w) / w, "valid")
    y = same(y, 10)
    assert got["a"].fs == 500.0 and got["a"].n == 599 and got["a"].lead_names[0] == "II"
    assert np.allclose(got["a"].leads.II, same(y, 6) - same(y, 599)) and got["a"].leads.V2 is None
    assert got["b"].leads.V2 == [] and got["b"].leads.II[300] is None
