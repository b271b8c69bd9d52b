import os

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import TABLES, normal
from checks.oracle import ORACLE
from checks.queries import QUERIES
from signalframe.operators import measurement as M
from signalframe.plans import analyse
from checks import synthetic
from signalframe.streaming.arrivals import append_results, arriving

SF = "/root/testdata/sf0.001"
QUICK = [
    "A3_rr_summary", "C3_rhythm_features", "A32_report_by_dataset", "A31_calibration_curve", "A1_lead_quality", "W3_moving_average",
    "W4_qrs_peaks", "R1_rhythm_class", "R2_stemi", "R3_ischemia_and_infarction", "R7_af_score", "R10_reasons", "A35_hf_points",
    "J6_territory_join", "M1_stratified_split", "M2_median_impute", "M8_model_input", "P11_code_label", "S13_adapted_labels",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(str(tuple(normal(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    ours = sorted(str(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    assert ours == theirs


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    customers = spark.range(30).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    path = str(tmp_path_factory.mktemp("records") / "records")
    synthetic.waveforms(customers).drop("k", "age", "sex", "truth").write.parquet(path)
    return path


def test_stored_scan_reads_only_the_working_lead(spark, stored):
    plan = M.qrs_duration(M.detect_beats(spark.read.parquet(stored), "II"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "leads:struct<II:array<double>>" in text and "Exchange" not in text


def test_stream_equals_batch(spark, stored, tmp_path):
    records = spark.read.parquet(stored)
    work = lambda df: M.qrs_duration(M.detect_beats(df))
    stream = arriving(spark, stored, records.schema, files_per_batch=2)
    append_results(stream, work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    a, b = work(records), spark.read.parquet(str(tmp_path / "out"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and b.count() == 30


def test_measurement_bundle(spark, stored):
    found = analyse.interpret(analyse.measure(spark.read.parquet(stored)))
    bundle = found.select("record_id", analyse.basic_measurements().alias("b"), "rhythm_class", "stemi", "peaks").cache()
    rows = {r.record_id: r for r in bundle.collect()}
    assert len(rows) == 30 and rows["1"].b.selected_lead == "II" and rows["7"].b.selected_lead == "I"
    assert rows["1"].b.heart_rate.mean_rr_ms == 670.0 and rows["1"].b.p_wave_pr.pr_interval_ms == 160.0
    single = M.p_wave(M.detect_beats(spark.read.parquet(stored))).collect()
    for r in single:
        assert rows[r.record_id].b.p_wave_pr.pr_interval_ms == r.pr_mean_ms
    levels = {(r.record_id, r.lead): r.st_level_mv for r in M.st_levels(M.detect_beats(spark.read.parquet(stored))).collect()}
    for record, r in rows.items():
        assert r.b.st_segment.lead_measurements == {l: v for (i, l), v in levels.items() if i == record}


def python_inputs(df):
    """The columns that wait in the JVM while Python has their rows, for each pass through Python."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("ArrowEvalPython"):
            out = below[0].output()
            found.append({out.apply(i).name(): out.apply(i).dataType().simpleString() for i in range(out.size())})
        todo += below
    return found


def test_all_leads_do_not_wait_for_python(spark, tmp_path):
    """Rows wait by thousands: with all leads in them they went to disk, 4 GB at a time."""
    customers = spark.range(1, 4).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    from checks.queries import QUERIES

    for name in ("R11_bundle_columns", "R11_measurement_bundle", "C12_feature_bundle"):
        passes = [p for p in python_inputs(QUERIES[name](spark, str(tmp_path))) if "x" in p]
        after = [p for p in passes if "leads" not in p]  # the one pass over all leads counts the usable ones
        assert after and len(passes) == len(after) + 1, name
        assert not any({"centred", "c"} & set(p) for p in after), name
    assert QUERIES["R11_bundle_columns"](spark, str(tmp_path)).count() == 3
