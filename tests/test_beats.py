import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import beats as B, leads as L, quality as Q
from signalframe.functions.arrays import centre
from signalframe.operators import long_records, measurement as M
from checks import synthetic

SCHEMA = "record_id string, fs double, x array<double>"


def brute_force_peaks(x, fs):
    """Straight loop over the definition, on one record."""
    c = x - np.median(x)
    width = max(1, int(0.12 * fs))
    slope = np.concatenate([[0.0], np.diff(c)])
    energy = np.convolve(slope**2, np.ones(width) / width, "same")
    limit = energy.mean() + 1.6 * energy.std()
    reach, wait = int(0.08 * fs), max(1, int(0.25 * fs))
    found, last = [], -wait
    for at in range(len(c)):
        if energy[at] <= limit or at - last < wait:
            continue
        lo, hi = max(0, at - reach), min(len(c), at + reach)
        if hi > lo:
            last = lo + int(np.argmax(np.abs(c[lo:hi])))
            found.append(last)
    return sorted(set(found))


def signal(seed, fs, seconds=6):
    rng = np.random.default_rng(seed)
    n = int(fs * seconds)
    x = rng.normal(scale=0.02, size=n)
    at = 0.4 * fs
    while at < n - 0.3 * fs:
        for off, sigma, amp in ((-0.16, 0.02, 0.15), (0.0, 0.012, 1.0), (0.28, 0.04, 0.3)):
            x += amp * np.exp(-((np.arange(n) - at - off * fs) ** 2) / (2 * (sigma * fs) ** 2))
        at += fs * rng.uniform(0.5, 1.1)
    return np.round(x * 1024) / 1024


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"{fs}-{seed}", float(fs), signal(seed, fs).tolist()) for fs in (100, 250) for seed in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", centre(F.col("x")))
    return df.withColumn("peaks", B.detect_peaks(F.col("c"), F.col("fs"))).collect()


def test_detection_follows_the_definition(records):
    for r in records:
        assert r.peaks == brute_force_peaks(np.array(r.x), r.fs), r.record_id
        assert len(r.peaks) >= 5


def test_detection_on_degenerate_records(spark):
    rows = [("flat", 100.0, [1.0] * 300), ("short", 100.0, [0.0, 1.0]), ("empty", 100.0, []), ("one", 100.0, [0.0] * 100 + [5.0] + [0.0] * 100)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", centre(F.col("x")))
    got = {r.record_id: r.peaks for r in df.select("record_id", B.detect_peaks(F.col("c"), F.col("fs")).alias("peaks")).collect()}
    assert got["flat"] == [] and got["short"] == [] and got["empty"] == []
    assert got["one"] == [100]


def test_detection_does_not_depend_on_scale(spark, records):
    rows = [(r.record_id, r.fs, [v * 4 for v in r.x]) for r in records]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", centre(F.col("x")))
    got = {r.record_id: r.peaks for r in df.select("record_id", B.detect_peaks(F.col("c"), F.col("fs")).alias("peaks")).collect()}
    assert got == {r.record_id: r.peaks for r in records}


def test_p_wave_without_beats(spark):
    df = spark.createDataFrame([([0.0] * 50,)], "c array<double>")
    got = df.select(B.p_wave(F.col("c"), F.expr("cast(array() as array<int>)"), F.lit(100.0)).alias("p")).first().p
    assert (got.p_wave_presence_ratio, got.pr_consistency, got.missing_p_wave_percent) == (0.0, 0.0, 100.0)
    assert got.pr_mean_ms is None and got.p_duration_ms is None


def test_p_wave_known_position_and_zero_spread_counts_as_unknown(spark):
    c = np.zeros(300)
    for peak in (100, 200):
        c[peak] = 1.0
        c[peak - 16] = 0.2
    df = spark.createDataFrame([(c.tolist(),)], "c array<double>")
    got = df.select(B.p_wave(F.col("c"), F.array(F.lit(100), F.lit(200)), F.lit(100.0)).alias("p")).first().p
    assert (got.pr_mean_ms, got.pr_sd_ms, got.p_amplitude_mv) == (160.0, 0.0, 0.2)
    assert got.pr_consistency == 1.0  # 100 - 45 * 2.2, not 100
    assert got.p_duration_ms == 40.0  # clamped from below


def test_qrs_span_and_axis(spark):
    c = np.zeros(200)
    c[95:106] = [0.1, 0.2, 0.5, 0.8, 0.9, 1.0, 0.9, 0.8, 0.5, 0.17, 0.1]
    half = (0.5 * c).tolist()
    df = spark.createDataFrame([(c.tolist(), half)], "a array<double>, b array<double>")
    peaks, fs = F.array(F.lit(100)), F.lit(100.0)
    got = df.select(
        B.qrs_duration(F.col("a"), peaks, fs).alias("width"),
        L.qrs_axis(F.col("a"), F.col("a"), peaks, fs).alias("same"),
        L.qrs_axis(F.col("a"), F.lit(None).cast("array<double>"), peaks, fs).alias("none"),
        L.qrs_axis(F.col("b"), F.col("a"), peaks, fs).alias("steep"),
    ).first()
    assert got.width == 80.0
    assert (got.same.axis_deg, got.same.classification) == (45.0, "normal axis")
    assert (got.none.axis_deg, got.none.classification) == (None, "unavailable")
    assert got.steep.axis_deg == 63.4


def test_flat_line_is_punished_by_one_quality_only(spark):
    df = spark.createDataFrame([([1.0] * 200,)], "x array<double>")
    got = df.select(
        Q.lead_quality(F.col("x")).alias("lead"),
        Q.signal_quality(F.col("x"), F.lit(100.0), F.lit(2), F.lit(1), F.lit(1)).alias("whole"),
        Q.lead_quality(F.expr("cast(array(null, null) as array<double>)")).alias("nothing"),
    ).first()
    assert got.lead == 40.0 and got.nothing == 0.0
    assert got.whole.flatline_score == 0.0


def test_working_lead_falls_back_to_quality(spark):
    rows = [
        ("a", 100.0, 4, ["V3", "V2"], ([0.0, 1.0, 0.0, 1.0], [0.0, 1.0, 0.0, 1.0], None)),
        ("b", 100.0, 4, ["II"], (None, None, [1.0, 2.0, 1.0, 2.0])),
    ]
    schema = "record_id string, fs double, n int, lead_names array<string>, leads struct<V2: array<double>, V3: array<double>, II: array<double>>"
    got = {r.record_id: r.selected_lead for r in M.select_lead(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "V3", "b": "II"}  # equal quality: the record's own order decides


def test_long_record_detection_equals_in_row_detection(spark):
    rows = [(f"r{seed}", 100.0, signal(seed, 100, 20).tolist()) for seed in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = df.withColumn("c", centre(F.col("x"))).select("record_id", B.detect_peaks(F.col("c"), F.col("fs")).alias("p"))
    want = {r.record_id: r.p for r in whole.collect()}
    chunks = df.select(
        "record_id",
        "fs",
        F.size("x").alias("n"),
        F.explode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(300))).alias("start"),
        "x",
    ).select("record_id", "fs", "n", "start", F.slice("x", F.col("start") + 1, F.lit(300)).alias("samples"))
    got: dict = {}
    for r in long_records.detect_peaks(chunks).orderBy("record_id", "r_idx").collect():
        got.setdefault(r.record_id, []).append(r.r_idx)
    assert got == want


def fast_signal(seed, fs, seconds, rate):
    """A noisy record with beats so close that every candidate lies within the refractory time of another."""
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=0.15, size=seconds * fs)
    for at in np.arange(fs // 3, len(x) - fs // 3, 60 * fs / rate) + rng.integers(-fs // 30, fs // 30 + 1):
        x[int(at) - 2: int(at) + 3] += [0.3, 0.8, 1.5, 0.7, 0.2]
    return np.round(x, 3)


@pytest.mark.parametrize("fs, rate, size", [(100, 160, 61), (100, 220, 250), (250, 200, 130), (64, 300, 40), (500, 180, 1700)])
def test_long_records_with_close_beats_and_gaps(spark, monkeypatch, fs, rate, size):
    monkeypatch.setattr(long_records, "POINTS", 4)
    monkeypatch.setattr(long_records, "INSIDE", 20)
    rows = []
    for seed in range(5):
        x = fast_signal(seed, fs, 12, rate).tolist()
        if seed == 1:
            x[3 * fs: 3 * fs + fs // 2] = [None] * (fs // 2)
        if seed == 2:
            x = [0.5] * len(x)
        if seed == 3:
            x = x[: size * 3 + 1]  # the last chunk holds one sample
        rows.append((f"r{seed}", float(fs), x))
    df = spark.createDataFrame([*rows, ("none", float(fs), [None] * 900)], SCHEMA)
    whole = df.withColumn("c", centre(F.col("x"))).select("record_id", B.detect_peaks(F.col("c"), F.col("fs")).alias("p"))
    want = {r.record_id: r.p for r in whole.collect()}
    got: dict = {k: [] for k in want}
    for r in long_records.detect_peaks(long_records.cut(df, "x", size)).orderBy("record_id", "r_idx").collect():
        got[r.record_id].append(r.r_idx)
    assert got == want and sum(map(len, want.values())) > 30


def test_median_of_long_records(spark, monkeypatch):
    monkeypatch.setattr(long_records, "POINTS", 3)
    monkeypatch.setattr(long_records, "INSIDE", 5)
    rng = np.random.default_rng(4)
    rows = [(f"m{i}", 100.0, v) for i, v in enumerate([
        rng.normal(size=500).tolist(), rng.integers(0, 4, 301).astype(float).tolist(), [2.0] * 77, [1.0, 3.0], [None, 5.0, None],
        np.repeat([1.0, 2.0], 60).tolist(), (rng.normal(size=200) * 1e-200).tolist(),
    ])]
    got = {r.record_id: r.median for r in long_records.record_median(long_records.cut(spark.createDataFrame(rows, SCHEMA), "x", 20)).collect()}
    for name, _, x in rows:
        v = sorted(y for y in x if y is not None)
        low, high = v[(len(v) - 1) // 2], v[len(v) // 2]
        assert got[name] == low + (high - low) * 0.5, name


def test_states_compose_to_the_plain_walk():
    rng = np.random.default_rng(6)
    for _ in range(200):
        fs = float(rng.choice([30, 100, 250]))
        _, reach, wait, _ = long_records._sizes(fs)
        n = int(rng.integers(50, 400))
        at = np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.4, 0.9]))
        peak = np.maximum(0, at + rng.integers(-reach, reach, len(at))) if len(at) else at
        edges = [0, *sorted(rng.choice(np.arange(1, n), 6, replace=False).tolist()), n]
        state, got = -wait, []
        for a, b in zip(edges, edges[1:]):
            own = (at >= a) & (at < b)
            got += long_records.walk(at[own], peak[own], a + state, fs)
            state = int(long_records.transitions(at[own], peak[own], (a, b), fs)[state + wait])
        assert got == long_records.walk(at, peak, -wait, fs)


def test_synthetic_peaks_are_found(spark):
    customers = spark.range(40).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    found = M.detect_beats(synthetic.waveforms(customers, ["II"]), "II").filter("k % 23 NOT IN (7, 8) AND k % 11 != 4")
    for r in found.select("k", "peaks", "truth").collect():
        assert r.peaks == r.truth, r.k
