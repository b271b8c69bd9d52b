"""The record file source, records stored by key, and the all-or-nothing save."""

import os

import pytest
from pyspark.sql import functions as F

from checks import encode, synthetic
from signalframe.operators import features, measurement as M
from signalframe.schemas import DELINEATION, STANDARD_LEADS
from signalframe.sources import record_source, tables, wfdb
from signalframe.streaming import arrivals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def records(spark):
    customers = spark.range(1, 25).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    return synthetic.waveforms(customers, STANDARD_LEADS)


def test_pairing_by_name():
    found = record_source.pair([
        ("d/a.dat", 5, 30), ("d/a.hea", 1, 40), ("e/a.HEA", 2, 0), ("d/b.hea", 1, 0), ("d/c.dat", 9, 0), ("d/readme.txt", 3, 0),
        ("d/a.HEA", 7, 20), ("noext", 1, 0),
    ])
    assert [(s.stem, s.header, s.signal) for s in found] == [
        ("d/a", "d/a.hea", "d/a.dat"), ("d/b", "d/b.hea", None), ("d/c", None, "d/c.dat"), ("e/a", "e/a.HEA", None),
    ]
    assert (found[0].signal_bytes, found[0].arrived) == (5, 40)


def test_tasks_are_planned_by_bytes():
    stems = record_source.pair([(f"r{i:03}.{x}", 10 if x == "hea" else 100 + (900 if i == 7 else 0), 0) for i in range(20) for x in ("hea", "dat")])
    dealt = record_source.shares(stems, 350, 0, True)
    assert [s.stem for share in dealt for s in share.stems] == [s.stem for s in stems]
    assert max(len(share.stems) for share in dealt) == 3
    assert [share.stems for share in dealt if stems[7] in share.stems] == [[stems[7]]]
    assert len(record_source.shares(stems, 350, 0, False)) == 1  # headers alone are little


def test_records_from_files(spark, records, tmp_path):
    encode.write_files(encode.encode_records(records, "set/", synthetic.STEPS), str(tmp_path))
    os.remove(tmp_path / "set" / "3.dat")
    os.remove(tmp_path / "set" / "5.hea")
    stems = record_source.read_records(spark, str(tmp_path), partition_bytes=100_000)
    readable, errors = wfdb.split_readable(record_source.complete(stems))
    made = wfdb.to_records(readable, STANDARD_LEADS)
    assert "Exchange" not in plan(made) and made.rdd.getNumPartitions() > 3
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    sums = lambda df: {(r.record_id, r.lead): round(r.t, 6) for r in M.leads_long(df).select("record_id", "lead", total.alias("t")).collect()}
    assert sums(made) == {k: v for k, v in sums(records).items() if k[0] not in ("3", "5")}
    assert errors.count() == 0
    lost = {(r.path.rsplit("/", 1)[1], r.error) for r in record_source.unpaired(stems).collect()}
    assert lost == {("3.hea", "signal file missing"), ("5.dat", "header file missing")}


def test_headers_are_read_without_signals(spark, records, tmp_path):
    encode.write_files(encode.encode_records(records, "", synthetic.STEPS), str(tmp_path))
    (tmp_path / "2.dat").write_bytes(b"x" * 1001)
    stems = record_source.read_records(spark, "file:" + str(tmp_path), signals=False)
    assert stems.filter("signal is not null").count() == 0
    readable, errors = wfdb.split_readable(record_source.complete(stems))
    assert [r.stem.rsplit("/", 1)[1] for r in errors.collect()] == ["2"]
    meta = wfdb.record_metadata(readable)
    assert "Exchange" not in plan(meta)
    assert {r.duration_seconds for r in meta.collect()} == {10.0} and meta.count() == 23


def test_an_empty_folder_has_no_records(spark, tmp_path):
    assert record_source.read_records(spark, str(tmp_path)).count() == 0


def test_joins_leave_stored_samples_in_place(spark, records, tmp_path):
    stored_at = str(tmp_path / "by key")
    tables.save_by_record(records.select("record_id", "fs", "n", "leads"), stored_at, buckets=4)
    stored = tables.read_by_record(spark, stored_at)
    beats = M.beats(M.detect_beats(records, "II")).selectExpr(
        "record_id", "beat_no", "r_idx", "r_idx - 20 AS p_on", "r_idx - 12 AS p_off", "r_idx - 16 AS p_peak", "r_idx - 4 AS q_on", "r_idx + 4 AS s_off", "r_idx + 35 AS t_off"
    )
    assert beats.columns == DELINEATION.names
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        measured = features.morphology(stored, beats)
        want = sorted(map(str, features.morphology(records, beats).collect()))
        assert sorted(map(str, measured.collect())) == want
        text = plan(measured)
        join = text[text.index("ShuffledHashJoin"):]
        side = join[: join.index("HashAggregate")]  # above the beats' aggregation
        assert "Bucketed: true" in text and side.count("Exchange") == 0 and "Sort " not in side.split("FileScan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_failed_save_leaves_the_old_table(spark, tmp_path, fmt):
    path = str(tmp_path / "table")
    rows = spark.range(5).withColumn("x", F.col("id") * 2)
    read = lambda: spark.read.option("header", True).format(fmt).load(path).count()
    assert tables.save_checked(rows, path, fmt) == 5
    with pytest.raises(RuntimeError):
        tables.save_checked(rows.filter("id < 0"), path, fmt)
    with pytest.raises(Exception):
        tables.save_checked(rows.withColumn("y", F.raise_error(F.lit("no"))), path, fmt)
    with pytest.raises(FileExistsError):
        tables.save_checked(rows, path, fmt, overwrite=False)
    assert read() == 5
    assert tables.save_checked(rows.filter("id > 2"), path, fmt) == 2 and read() == 2
    assert os.listdir(tmp_path) == ["table"]


def test_arriving_files_are_scored_once(spark, records, tmp_path):
    out, dead, checkpoint, folder = (str(tmp_path / n) for n in ("out", "dead", "checkpoint", "in"))
    files = encode.encode_records(records.where("k <= 12"), "", synthetic.STEPS)
    work = lambda r: M.detect_beats(r).select("record_id", "selected_lead", "peaks")
    late = F.col("path").startswith("7.") | F.col("path").endswith("9.hea")
    encode.write_files(files.where(~late), folder)
    (tmp_path / "in" / "3.dat").write_bytes(b"x" * 1001)

    def run():
        stems = record_source.arriving_records(spark, folder, settle=0)
        arrivals.score_arrivals(stems, work, out, dead, checkpoint).awaitTermination()
        found = spark.read.parquet(out).collect()
        return sorted(r.record_id for r in found), [r.stem.rsplit("/", 1)[1] for r in spark.read.parquet(dead).collect()]

    whole = {str(i) for i in range(1, 13)}
    assert run() == (sorted(whole - {"3", "7", "9"}), ["3"])
    assert run() == (sorted(whole - {"3", "7", "9"}), ["3"])  # nothing new
    encode.write_files(files.where(late), folder)
    assert run() == (sorted(whole - {"3"}), ["3"])
    again = record_source.complete(record_source.read_records(spark, folder)).where("record_id in ('7', '9')")
    number = max(r.batch_id for r in spark.read.parquet(out).collect())
    arrivals.write_batch(again, number, work, out, dead)  # a batch that runs twice
    found = {r.record_id: (r.selected_lead, r.peaks) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 11
    assert found == {r.record_id: (r.selected_lead, r.peaks) for r in work(records.where("k <= 12 and k <> 3")).collect()}


def test_pairing_sends_no_signals_to_the_driver(spark):
    """The planner knows the length of no file, so that a small estimate may stand for any amount of bytes."""
    files = spark.createDataFrame([(f"d/{i}.{x}", bytearray(b"1")) for i in range(3) for x in ("hea", "dat")], "path string, content binary")
    pairs = wfdb.find_pairs(files)
    assert "SortMergeJoin" in plan(pairs) and "BroadcastExchange" not in plan(pairs)
    assert pairs.count() == 3


def test_lengths_stand_for_signals_that_stay(spark):
    """Dead letters and metadata are the same without the signals, and the join moves lengths only."""
    rows = []
    for i, length in enumerate((8, 7, 12)):
        rows.append((f"d/{i}.hea", bytearray(f"{i} 2 100 2\n{i}.dat 16 200 16 0 0 0 0 I\n{i}.dat 16 200 16 0 0 0 0 II\n".encode())))
        rows.append((f"d/{i}.dat", bytearray(length)))
    files = spark.createDataFrame(rows, "path string, content binary")
    found = []
    for signals in (True, False):
        readable, errors = wfdb.split_readable(wfdb.find_pairs(files, signals=signals))
        found.append((sorted(map(tuple, errors.collect())), sorted(map(str, wfdb.record_metadata(readable).collect()))))
    assert found[0] == found[1]
    assert [e for _, e in found[1][0]] == ["signal file has a partial frame", "length differs from header"]
    bodies = plan(wfdb.find_pairs(files, signals=False).select("signal_bytes", "stem"))
    assert "signal_bytes" in bodies and "content#" not in "".join(l for l in bodies.splitlines() if "Sort [" in l or "SortMergeJoin" in l)


def test_registered_dead_letters_and_metadata_move_no_signals(spark, tmp_path):
    customers = spark.range(1, 12).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    from checks.queries import QUERIES

    for name in ("P9_dead_letters", "S3_record_metadata"):
        found = QUERIES[name](spark, str(tmp_path))
        joins = [l for l in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in l]
        assert len(joins) == 1 and "BroadcastExchange" not in plan(found)
        assert "signal_bytes" in found._jdf.queryExecution().optimizedPlan().toString()
    assert QUERIES["P9_dead_letters"](spark, str(tmp_path)).count() == 1  # record 11, whose signals are cut short


def test_arriving_rows_of_one_file_are_spread_over_tasks(spark, tmp_path):
    customers = spark.range(1, 41).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    from checks.queries import QUERIES

    found = QUERIES["T1_arrivals"](spark, str(tmp_path))
    assert found.count() == 40 and len(found.inputFiles()) > 1
