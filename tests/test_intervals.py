import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import rhythm as R
from signalframe.operators import intervals

KEYS = ["rr_mean_ms", "rr_sd_ms", "rr_cv", "rmssd_ms", "pnn50_percent", "poincare_sd1_ms", "poincare_sd2_ms",
        "turning_point_ratio", "sample_entropy", "shannon_entropy", "rr_irregularity_index"]


@pytest.fixture(scope="module")
def beats(spark):
    rng = np.random.default_rng(5)
    rows = []
    for record, count in (("long", 600), ("a", 40), ("b", 7), ("c", 3), ("d", 2), ("e", 1)):
        at = 0
        for _ in range(count):
            rows.append((record, int(at)))
            at += rng.integers(300, 1400)
    rows += [("even", i * 800) for i in range(9)]
    return spark.createDataFrame(rows, "record_id string, t int").repartition(4).cache()


def by_record(df):
    return {r.record_id: r.asDict() for r in df.collect()}


def test_split_series_equal_whole_series(beats):
    whole = intervals.rr_series(beats)
    split = intervals.rr_series(beats, part_rows=30)
    assert split.part_keys == ["record_id", "part"]
    parts = split.rows.groupBy("part").count()
    assert parts.count() > 10 and parts.agg({"count": "max"}).first()[0] <= 90
    one = whole.rows.select("record_id", "t", "rr_ms", "drr_ms", "turn")
    two = split.rows.select("record_id", "t", "rr_ms", "drr_ms", "turn")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    a, b = by_record(intervals.rhythm_features(whole)), by_record(intervals.rhythm_features(split))
    assert a.keys() == b.keys()
    for record in a:
        for key in KEYS:
            assert a[record][key] == pytest.approx(b[record][key], rel=1e-9, abs=1e-9)


def test_rows_equal_arrays(beats):
    rows = by_record(intervals.rhythm_features(intervals.rr_series(beats)))
    arrays = beats.groupBy("record_id").agg(F.sort_array(F.collect_list("t")).alias("peaks"))
    arrays = arrays.select("record_id", R.rr_intervals(F.col("peaks"), F.lit(1000.0)).alias("rr"))
    found = by_record(R.add_interval_features(arrays, "rr", "f").select("record_id", "f.*"))
    for record in rows:
        for key in KEYS:
            assert rows[record][key] == pytest.approx(found[record][key], rel=1e-9, abs=1e-9), (record, key)
    assert found["e"]["rr_count"] == 0 and found["e"]["rr_mean_ms"] == 0.0


def test_against_numpy(beats):
    rows = by_record(intervals.rhythm_features(intervals.rr_series(beats)))
    t = np.sort([r.t for r in beats.filter("record_id = 'a'").collect()])
    rr, d = np.diff(t).astype(float), np.diff(np.diff(t)).astype(float)
    h, _ = np.histogram(d / d.std(), bins=8, density=True)
    h = h[h > 0]
    p, _ = np.histogram(rr, bins=12)
    p = p[p > 0] / p.sum()
    got = rows["a"]
    assert got["sample_entropy"] == pytest.approx(-(h * np.log(h)).sum() / 10)
    assert got["shannon_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert got["poincare_sd1_ms"] ** 2 == pytest.approx(0.5 * d.var())
    assert got["pnn50_percent"] == pytest.approx((np.abs(d) > 50).mean() * 100)


def test_even_series_is_regular(beats):
    rows = by_record(intervals.rhythm_features(intervals.rr_series(beats)))
    assert (rows["even"]["rr_cv"], rows["even"]["sample_entropy"], rows["even"]["shannon_entropy"]) == (0.0, 0.0, 0.0)
    report = by_record(intervals.rhythm_report(intervals.variability(intervals.rr_series(beats))))
    assert report["even"]["regularity"] == "regular" and report["even"]["heart_rate_bpm"] == 75.0
