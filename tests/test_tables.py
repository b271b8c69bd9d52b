import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import rules
from signalframe.functions.values import clean, code_map, comment_age, comment_sex, has_code, sex_code
from signalframe.operators import dimensions, features, models
from signalframe.plans import feature_job, training_job, validation_job
from signalframe.schemas import DELINEATION, FEATURES, MORPHOLOGY_CODES
from checks import encode, synthetic
from signalframe.sources import tables, wfdb


def column(spark, values, kind, build):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_missing_values_and_sex(spark):
    assert column(spark, ["1.5", "NaN", "inf", "x", None], "string", clean) == [1.5, None, None, None, None]
    assert column(spark, [" Male", "m", "1", "F", "0", "x", None], "string", sex_code) == [1.0, 1.0, 1.0, 0.0, 0.0, None, None]


def test_codes(spark):
    texts = ["{'NORM': 100.0, 'LAE': 0.0}", "{}", "bad", "[1]", None, "{'NORM': 1.0}"]
    assert column(spark, texts, "string", lambda c: F.size(code_map(c))) == [2, 0, 0, 0, 0, 1]
    assert column(spark, texts, "string", lambda c: has_code(code_map(c), MORPHOLOGY_CODES)) == [1, 0, 0, 0, 0, 0]


def test_demographics_last_parsable_wins(spark):
    lists = [["age: 54", "Sex: Male", "AGE: x"], ["age 54", "sex"], None, ["Age: 1", "age: 2", "sex: f", "SEX: M: x"]]
    assert column(spark, lists, "array<string>", comment_age) == [54.0, None, None, 2.0]
    assert column(spark, lists, "array<string>", comment_sex) == ["male", None, None, "m: x"]


def test_record_files_round_trip(spark, tmp_path):
    customers = spark.range(12).selectExpr("id AS c_custkey", "'X' AS c_mktsegment", "0 AS c_nationkey")
    records = synthetic.waveforms(customers)
    files = encode.encode_records(records, "", synthetic.STEPS).collect()
    for f in files:
        if f.path not in ("3.dat", "5.hea"):
            (tmp_path / f.path.replace(".dat", ".DAT") if f.path == "2.dat" else tmp_path / f.path).write_bytes(bytes(f.content))
    (tmp_path / "bad.hea").write_text("bad 1 100 4\nbad.dat 16 200 16 0 0 0 0 II\n")
    (tmp_path / "bad.dat").write_bytes(b"\x01\x00\x02")
    (tmp_path / "other.hea").write_text("other 1 100 2\nother.dat 212 200 16 0 0 0 0 II\n")
    (tmp_path / "other.dat").write_bytes(b"\x01\x00\x02")
    found = wfdb.read_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.error for r in wfdb.unpaired(found).collect()} == {
        "3.hea": "signal file missing", "5.dat": "header file missing"
    }
    readable, errors = wfdb.split_readable(wfdb.find_pairs(found))
    assert {r.stem.rsplit("/", 1)[1]: r.error for r in errors.collect()} == {
        "bad": "signal file has a partial frame", "other": "format is not 16"
    }
    names = records.schema["leads"].dataType.names
    back = {r.record_id: r for r in wfdb.to_records(readable, names).collect()}
    for r in records.filter("k NOT IN (3, 5)").collect():
        assert back[r.record_id].lead_names == r.lead_names and back[r.record_id].comments == r.comments
        for lead in names:
            assert back[r.record_id].leads[lead] == r.leads[lead], (r.record_id, lead)


def test_header_gain_baseline_and_missing_marker(spark):
    header = "r 2 250/250 3\nr.dat 16 100(10)/mV 16 0 0 0 0 ii\nr.dat 16 0 16 5 0 0 0 V1 x\n#age: 7\n"
    signal = np.array([[110, 205], [-32768, 5], [10, 5]], dtype="<i2").tobytes()
    files = spark.createDataFrame([("d/r.hea", header.encode()), ("d/r.dat", signal)], "path string, content binary")
    readable, _ = wfdb.split_readable(wfdb.find_pairs(files))
    leads = {r.lead: r.samples for r in wfdb.decode_leads(readable).collect()}
    assert leads == {"II": [1.0, None, 0.0], "V1 x": [1.0, 0.0, 0.0]}
    meta = wfdb.record_metadata(readable).first()
    assert (meta.sampling_frequency, meta.duration_seconds, meta.age) == (250.0, 0.012, 7.0)


def test_metadata_csv(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("ecg_id,x,age,sex,filename_lr,scp_codes\n2,9,50,1,r2,\"{'LAE': 0.0}\"\n1,9,nan,0,r1,{}\n3,9,60,1,,{}\n")
    rows = tables.read_record_metadata(spark, str(path), limit=2).orderBy("ecg_id").collect()
    assert [(r.ecg_id, r.age, r.filename_lr) for r in rows] == [(1, None, "r1"), (2, 50.0, "r2")]


def test_feature_table_job(spark, tmp_path):
    leads = {l: [0.0] * 400 for l in ("I", "II", "aVF", "V1")}
    leads["II"] = [0.25] * 400
    leads["I"] = [0.1] * 400
    leads["aVF"] = [0.1] * 400
    leads["V1"] = [-0.05] * 400
    records = spark.createDataFrame([("r1", 100.0, 400, tuple(leads.values())), ("r2", 100.0, 400, tuple(leads.values()))],
                                    "record_id string, fs double, n int, leads struct<I:array<double>,II:array<double>,aVF:array<double>,V1:array<double>>")
    beats = [("r1", i, 100 * i + 50, 100 * i + 30, 100 * i + 40, 100 * i + 35, 100 * i + 46, 100 * i + 54, 100 * i + 86) for i in range(4)]
    beats[1] = ("r1", 1, 150, None, 140, None, 146, 154, 186)
    beats += [("r2", 0, 50, 30, 40, 35, 46, 54, 86)]
    delineation = spark.createDataFrame(beats, DELINEATION)
    metadata = spark.createDataFrame([(1, 50.0, 1.0, "r1", "{'LAE': 0.0}"), (2, 40.0, 0.0, "r2", "{}"), (3, 1.0, 0.0, "gone", "{}"), (4, 1.0, 0.0, "", "{}")],
                                     "ecg_id long, age double, sex double, filename_lr string, scp_codes string")
    assert feature_job.run(metadata, records, delineation, str(tmp_path / "out"), "csv") == 2
    table, target = tables.read_feature_table(spark, str(tmp_path / "out"), fmt="csv")
    one, two = table.orderBy("ecg_id").collect()
    assert target == "current_atrial_abnormality" and (one[target], two[target]) == (1, 0)
    assert (one.p_duration_ms, one.pr_interval_ms, one.qrs_duration_ms, one.p_amplitude_mv) == (100.0, 160.0, 80.0, 0.25)
    assert one.p_axis_deg == pytest.approx(45.0) and one.qtc_ms == pytest.approx(400.0)
    assert one.ptfv1_mv_ms == pytest.approx(0.05 * 100.0)
    assert all(two[f] is None for f in FEATURES if f not in ("age", "sex"))
    assert [r.ecg_id for r in features.unmatched(tables.usable_metadata(metadata), records).collect()] == [3]
    with pytest.raises(RuntimeError, match="empty"):
        tables.save_checked(table.limit(0), str(tmp_path / "none"))


def test_equal_names_in_two_folders_stay_two_records(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.hEa").write_text("r 2 100 3\nr.dat 16 1(0)/mV 16 0 0 0 0 i\nr.dat 16 1(0)/mV 16 0 0 0 0 V1\n# age: 5")
        np.full((3, 2), value, dtype="<i2").tofile(tmp_path / folder / "r.DAT")
    pairs = wfdb.find_pairs(wfdb.read_files(spark, str(tmp_path)))
    readable, _ = wfdb.split_readable(pairs)
    got = wfdb.to_records(readable, ["I", "V1", "V6"]).collect()
    assert sorted((r.metadata["stem"][-3:], r.leads.I[0], r.lead_names[0], r.leads.V6) for r in got) == [("a/r", 1.0, "I", None), ("b/r", 2.0, "I", None)]
    assert wfdb.decode_leads(readable).select("stem", "lead").distinct().count() == 4


def test_code_map_reads_python_literals(spark):
    from signalframe.functions.values import code_map

    texts = ["{'NORM': None}", "{'A': True, 5: 1.0}", "{\"a: None, b\": 2}", "{}", "bad", "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.m for r in df.select(code_map(F.col("t")).alias("m")).collect()] == [
        {"NORM": None}, {"A": "true", "5": "1.0"}, {"a: None, b": "2"}, {}, {}, {}, {}
    ]


def test_table_checks(spark):
    df = spark.createDataFrame([(1.0,) * 9 + (2,)], ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    assert tables.resolve_target(df) == "label"
    with pytest.raises(ValueError):
        tables.check_feature_table(df, "label")
    with pytest.raises(ValueError):
        tables.resolve_target(df, "absent")
    with pytest.raises(ValueError):
        tables.check_feature_table(df.drop("age"), "label")


def test_registry(spark):
    df = spark.createDataFrame([("ptbxl",)], "dataset_key string")
    assert dimensions.with_dataset_spec(df).first()["name"] == "PTB-XL"
    with pytest.raises(Exception, match="unknown dataset key"):
        dimensions.with_dataset_spec(spark.createDataFrame([("zzz",)], "dataset_key string")).collect()


def af(spark, **values):
    base = dict(cv=0.05, irregularity=10.0, rmssd=10.0, pnn50=0.0, p_presence=100.0, p_missing=0.0, pr_consistency=50.0, fib=0.1, sqi=90.0)
    base.update(values)
    df = spark.createDataFrame([tuple(float(v) for v in base.values())], ", ".join(f"{k} double" for k in base))
    return df.select(rules.af_score(*[F.col(k) for k in base]).alias("a")).first().a


def test_af_gate_opens_only_with_all_conditions(spark):
    strong = dict(cv=0.3, irregularity=90.0, rmssd=200.0, pnn50=80.0, p_presence=10.0, p_missing=90.0, pr_consistency=0.0, fib=0.8)
    assert af(spark, **strong).af_gate_passed and af(spark, **strong).af_score == 100.0
    closed = af(spark, **{**strong, "fib": 0.5})
    assert not closed.af_gate_passed and closed.af_score == 69.0
    assert af(spark, **{**strong, "sqi": 49.9}).af_score == 50.0
    assert af(spark, cv=0.11, irregularity=100.0, rmssd=500.0, pnn50=100.0, p_presence=71.0, fib=1.0).af_score <= 39.0


def test_stemi_thresholds_depend_on_sex_and_age(spark):
    rows = [(30.0, "male"), (50.0, "male"), (50.0, "female"), (None, None)]
    df = spark.createDataFrame(rows, "age double, sex string").withColumn(
        "st", F.create_map(F.lit("V2"), F.lit(0.21), F.lit("V1"), F.lit(0.12), F.lit("V3"), F.lit(0.0), F.lit("V4"), F.lit(0.0))
    )
    got = [r.s for r in df.select(rules.stemi(F.col("st"), F.col("age"), F.col("sex")).alias("s")).collect()]
    assert [g.territories for g in got] == [[], *[["septal", "posterior"]] * 3]
    assert got[1].culprit_vessel == "LAD" and got[0].culprit_vessel == "none suggested"


def test_training_job_and_validation_job(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        y = int(rng.uniform() < 0.4)
        row = [float(rng.normal(loc=y * (f == "p_duration_ms"))) if rng.uniform() > 0.1 else None for f in FEATURES]
        rows.append((i, *row, y))
    table = spark.createDataFrame(rows, "ecg_id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", current_atrial_abnormality int")
    tables.save_checked(table, str(tmp_path / "features"))
    trained = training_job.run(spark, str(tmp_path / "features"), str(tmp_path / "models"), test_share=0.3, trees=3)
    model, metadata = models.load_artifacts(spark, str(tmp_path / "models"))
    assert metadata["records_used"] == 240 and metadata["logistic_auc"] > 0.6
    scored = models.score(table, model, "ecg_id", "current_atrial_abnormality")
    assert scored.filter("main_probability between 0 and 1").count() == 240
    with pytest.raises(RuntimeError):
        models.load_artifacts(spark, str(tmp_path / "nothing"))
    filled = np.array([[v if v is not None else np.nan for v in r[1:10]] for r in rows])
    train = trained.preparation
    assert set(train.medians) == set(FEATURES) and np.isfinite(list(train.means.values())).all() and filled.shape == (240, 9)
    path = str(tmp_path / "predictions")
    scored.select(
        F.col("current_atrial_abnormality").alias("y_true"), F.col("logistic_probability").alias("y_score"),
        F.when(F.col("ecg_id") % 2 == 0, "a").otherwise("b").alias("dataset"),
    ).write.option("header", True).csv(path)
    report, warning = validation_job.run(spark, path, str(tmp_path / "report"))
    assert {r.dataset for r in report.collect()} == {"overall", "a", "b"} and warning is not None


def test_contributions_are_sorted_and_signed(spark):
    df = spark.createDataFrame([(2.0, 3.0, 0.0)], "a double, b double, c double")
    got = df.select(models.contributions(["a", "b", "c"], [1.0, -1.0, 5.0]).alias("x")).first().x
    assert [(g.feature, g.direction, g.contribution) for g in got] == [("b", "decreases", -3.0), ("a", "increases", 2.0), ("c", "increases", 0.0)]
