"""One registered query per operator; the key starts with the operator's id."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import bridges
from checks.bridges import table
from signalframe.functions import beats as B, leads as L, quality as Q, rhythm as R, rules, spectrum as S
from signalframe.functions.arrays import centre, let, median, moving_average, quantile_of_sorted, present
from signalframe.functions.values import code_map, comment_age, comment_sex, has_code, sex_code
from signalframe.operators import (
    boosting, calibration as fits, dimensions, evaluation, features, intervals, long_records, measurement as M, models, preprocessing, selection,
)
from signalframe.operators.group_fits import fit_groups
from signalframe.plans import analyse, feature_job
from signalframe.schemas import FEATURES, MORPHOLOGY_CODES, RHYTHM_CODES, RR_FEATURES, STANDARD_LEADS
from signalframe.session import materialise, settle, shared_dir
from checks import encode, synthetic
from signalframe.sources import record_source, tables, wfdb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at fixed digits, without a negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# --- interval series on events -----------------------------------------------------------------


@query("A3_rr_summary")
def rr_summary(spark, sf):
    return rounded(intervals.rhythm_report(intervals.variability(bridges.rr_events(spark, sf))))


@query("A4_rr_variability")
def rr_variability(spark, sf):
    return rounded(
        intervals.variability(bridges.rr_events(spark, sf)).select(
            "record_id", "rr_count", "rr_mean_ms", "rr_cv", "sdnn_ms", "rmssd_ms", "pnn50_percent"
        )
    )


@query("A5_rr_entropy_density")
def rr_entropy_density(spark, sf):
    return rounded(intervals.entropy_density(bridges.rr_events(spark, sf)))


@query("A6_rr_entropy_shannon")
def rr_entropy_shannon(spark, sf):
    return rounded(intervals.entropy_shannon(bridges.rr_events(spark, sf)))


@query("A7_rr_histogram")
def rr_histogram(spark, sf):
    series = bridges.rr_events(spark, sf)
    spec = series.rows.groupBy("record_id").agg(
        F.count("rr_ms").alias("n"), F.min("rr_ms").alias("low"), F.max("rr_ms").alias("high")
    ).withColumns({"bins": F.lit(10), "spread": F.lit(1.0)})
    counts = intervals._histogram(series, F.col("rr_ms"), spec)
    return rounded(counts.select("record_id", "slot", F.col("h").cast("long").alias("n"), "width"), 8)


@query("A8_rr_poincare")
def rr_poincare(spark, sf):
    return rounded(
        intervals.variability(bridges.rr_events(spark, sf)).select("record_id", "poincare_sd1_ms", "poincare_sd2_ms")
    )


@query("W1_rr_differences")
def rr_differences(spark, sf):
    return rounded(bridges.rr_events(spark, sf).rows.select("record_id", "event_id", "rr_ms", "drr_ms"), 8)


@query("W2_rr_turning_points")
def rr_turning_points(spark, sf):
    return rounded(intervals.variability(bridges.rr_events(spark, sf)).select("record_id", "turning_point_ratio"))


@query("W6_rr_irregularity_index")
def rr_irregularity(spark, sf):
    return rounded(
        intervals.rhythm_features(bridges.rr_events(spark, sf)).select("record_id", "rr_irregularity_index"), 5
    )


@query("C3_rhythm_features")
def rhythm_feature_struct(spark, sf):
    return rounded(intervals.rhythm_features(bridges.rr_events(spark, sf)).drop("rr_irregularity_index"), 5)


# --- predictions on labels and documents -------------------------------------------------------


@query("A27_confusion_counts")
def confusion_counts(spark, sf):
    return evaluation.confusion(bridges.predictions(spark, sf))


@query("A28_rates")
def rates(spark, sf):
    report = evaluation.metrics_report(bridges.predictions(spark, sf), with_accuracy=True)
    return rounded(report.select("dataset", "accuracy", "precision", "recall", "sensitivity", "specificity", "f1", "ppv", "npv"))


@query("A29_auc")
def auc(spark, sf):
    return rounded(evaluation.metrics_report(bridges.predictions(spark, sf)).select("dataset", "auc"))


@query("A30_brier")
def brier(spark, sf):
    return rounded(evaluation.metrics_report(bridges.predictions(spark, sf)).select("dataset", "brier_score"))


@query("A31_calibration_curve")
def calibration_curve(spark, sf):
    return rounded(evaluation.calibration_curve(bridges.predictions(spark, sf)))


@query("A32_report_by_dataset")
def report_by_dataset(spark, sf):
    return rounded(evaluation.metrics_report(bridges.predictions(spark, sf)))


@query("A34_dataset_profile")
def dataset_profile(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return evaluation.dataset_profile(documents.join(labels, "doc_id", "left"))


@query("C8_dataset_characteristics")
def dataset_characteristics(spark, sf):
    records = synthetic.records(spark, sf, [])
    return rounded(
        records.groupBy("dataset").agg(
            F.count(F.lit(1)).alias("records"),
            F.avg("age").alias("mean_age"),
            F.count_if(sex_code(F.col("sex")) == 1.0).alias("male"),
            F.count_if(sex_code(F.col("sex")) == 0.0).alias("female"),
            F.avg(F.size("lead_names").cast("double")).alias("mean_leads"),
            F.sum(F.col("n") / F.col("fs")).alias("seconds"),
        )
    )


@query("C10_failure_by_band")
def failure_by_band(spark, sf):
    scored = bridges.predictions(spark, sf).withColumn("sqi", (F.col("n_chars") % 97).cast("double"))
    return rounded(evaluation.failure_by_band(scored))


# --- one-lead signals on embeddings ------------------------------------------------------------


@query("A1_lead_quality")
def embedding_quality(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    return rounded(leads.select("record_id", Q.lead_quality(F.col("samples")).alias("quality")))


@query("P4_centred_samples")
def centred_samples(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    return rounded(leads.select("record_id", F.posexplode(centre(F.col("samples"))).alias("idx", "mv")))


@query("P5_finite_ratio")
def finite_ratio(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    holed = F.transform("samples", lambda v, i: F.when(v > -0.1, v))
    return rounded(leads.select("record_id", Q.finite_ratio(holed).alias("finite_ratio")))


@query("P12_mean_of_present")
def mean_of_present(spark, sf):
    from signalframe.functions.arrays import mean

    leads = bridges.embedding_leads(spark, sf)
    holed = F.transform("samples", lambda v: F.when(v > 0.1, v))
    return rounded(leads.select("record_id", mean(holed).alias("mean_mv")))


@query("P13_percentiles")
def percentiles(spark, sf):
    leads = bridges.embedding_leads(spark, sf).select("record_id", F.sort_array(present(F.col("samples"))).alias("s"))
    names = {"p02": 0.02, "p05": 0.05, "p50": 0.5, "p92": 0.92, "p95": 0.95, "p98": 0.98}
    return rounded(leads.select("record_id", *[quantile_of_sorted(F.col("s"), q).alias(n) for n, q in names.items()]))


@query("P15_preview")
def preview(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    values = M.preview_values(F.col("samples"), 40)
    return rounded(leads.select("record_id", F.posexplode(values).alias("idx", "value")))


@query("P16_clamped")
def clamped(spark, sf):
    from signalframe.functions.arrays import clamp

    orders = table(spark, sf, "orders")
    return rounded(orders.select("o_orderkey", clamp(F.col("o_totalprice") / 1000.0 - 100.0, 0.0, 100.0).alias("value")))


@query("W3_moving_average")
def moving_averages(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    even = moving_average(F.col("samples"), F.lit(6))
    odd = moving_average(F.col("samples"), F.lit(19))
    return rounded(
        leads.select("record_id", F.posexplode(F.arrays_zip(even.alias("even"), odd.alias("odd"))).alias("idx", "a"))
        .select("record_id", "idx", "a.even", "a.odd")
    )


@query("A24_band_power")
def band_power(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    raw = leads.select("record_id", S.band_power(F.col("samples"), F.col("fs")).alias("b"))
    return rounded(raw.select("record_id", "b.f_power", "b.total_power", "b.dominant_hz"))


@query("D1_samples_and_back")
def samples_and_back(spark, sf):
    leads = bridges.embedding_leads(spark, sf)
    back = M.samples_to_leads(M.samples_long(leads), 32.0)
    return rounded(
        back.select("record_id", "lead", "n", F.get("samples", F.lit(0)).alias("first_mv"), F.get("samples", F.col("n") - 1).alias("last_mv"))
    )


# --- synthetic records: leads, beats, windows --------------------------------------------------


@query("P1_working_lead")
def working_lead(spark, sf):
    return M.select_lead(synthetic.records(spark, sf)).select("record_id", "selected_lead")


@query("P2_usable_leads")
def usable_leads(spark, sf):
    return M.usable_leads(synthetic.records(spark, sf))


@query("P3_lead_by_name")
def lead_by_name(spark, sf):
    records = synthetic.records(spark, sf, ["aVF"])
    total = F.aggregate("leads.aVF", F.lit(0.0), lambda a, v: a + v)
    return rounded(records.select("record_id", F.size("leads.aVF").alias("n"), total.alias("total_mv")), 3)


@query("W4_qrs_peaks")
def qrs_peaks(spark, sf):
    return M.beats(bridges.detected(spark, sf)).select("record_id", "r_idx")


@query("W4_long_records")
def long_record_peaks(spark, sf):
    chunks = long_records.cut(M.select_lead(synthetic.records(spark, sf)).select("record_id", "fs", "x"), "x", 250)
    return long_records.detect_peaks(materialise(chunks))


@query("W5_first_beats")
def first_beats(spark, sf):
    return M.beats(bridges.detected(spark, sf)).filter(F.col("beat_no") < 12)


@query("O2_distinct_sorted_peaks")
def distinct_sorted(spark, sf):
    detected = bridges.detected(spark, sf)
    return detected.select("record_id", F.array_join("peaks", ",").alias("peaks"))


@query("O5_strongest_beat")
def strongest_beat(spark, sf):
    from signalframe.functions.arrays import absolute, argmax_first

    return bridges.detected(spark, sf).select("record_id", argmax_first(absolute(F.col("c"))).alias("idx"))


@query("D8_rr_of_records")
def rr_of_records(spark, sf):
    return rounded(M.rr(bridges.detected(spark, sf)))


@query("C4_beat_windows")
def beat_windows(spark, sf):
    return M.beat_windows(bridges.detected(spark, sf), -0.25, 0.40)


@query("J4_window_samples")
def window_samples(spark, sf):
    from signalframe.functions.arrays import cut, offset

    detected = bridges.detected(spark, sf)
    sums = F.transform(
        F.slice("peaks", 1, 20),
        lambda p: F.aggregate(
            cut(F.col("c"), F.greatest(F.lit(0), p + offset(F.col("fs"), -0.08)), F.least(F.col("n"), p + offset(F.col("fs"), 0.08))),
            F.lit(0.0),
            lambda a, v: a + F.coalesce(v, F.lit(0.0)),
        ),
    )
    return rounded(
        detected.select("record_id", F.posexplode_outer(sums).alias("beat_no", "total_mv")).filter("beat_no is not null")
    )


@query("A9_p_wave")
def p_wave(spark, sf):
    return M.p_wave(bridges.detected(spark, sf))


@query("A10_qrs_duration")
def qrs_duration(spark, sf):
    return M.qrs_duration(bridges.detected(spark, sf))


@query("A11_qrs_bounds")
def qrs_bounds(spark, sf):
    return M.qrs_bounds(bridges.detected(spark, sf))


@query("A12_qt_qtc")
def qt_qtc(spark, sf):
    measured = M.detect_beats(synthetic.records(spark, sf)).select(
        "record_id", "sex", R.rr_intervals(F.col("peaks"), F.col("fs")).alias("rr"),
        B.qt_interval(F.col("c"), B.qrs_bounds(F.col("c"), F.col("peaks"), F.col("fs")), F.col("fs")).alias("qt"),
    )
    from signalframe.functions.arrays import mean

    timed = measured.withColumn("rr_mean", F.bround(mean(F.col("rr")), 1))
    return timed.select("record_id", rules.qt_report(F.col("qt"), F.col("rr_mean"), F.col("sex")).alias("q")).select("record_id", "q.*")


@query("A14_qrs_axis")
def qrs_axis(spark, sf):
    return M.axes(bridges.detected(spark, sf)).select("record_id", "qrs_axis.*")


@query("A15_p_and_t_axis")
def wave_axes(spark, sf):
    return M.axes(bridges.detected(spark, sf)).select(
        "record_id",
        F.col("p_axis.axis_deg").alias("p_axis_deg"), F.col("p_axis.classification").alias("p_class"),
        F.col("t_axis.axis_deg").alias("t_axis_deg"), F.col("t_axis.classification").alias("t_class"),
    )


@query("A16_st_levels")
def st_levels(spark, sf):
    return M.st_levels(bridges.detected(spark, sf))


@query("J5_beats_by_lead")
def beats_by_lead(spark, sf):
    found = M.leads_long(bridges.detected(spark, sf), None, "peaks")
    return found.groupBy("lead").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("peaks")).alias("beats"))


@query("J8_sample_at_index")
def sample_at_index(spark, sf):
    detected = bridges.detected(spark, sf)
    value = F.transform("peaks", lambda p: F.get("x", p))
    return rounded(
        detected.select("record_id", F.posexplode_outer(value).alias("beat_no", "mv")).filter("beat_no is not null")
    )


@query("A17_lvh")
def lvh(spark, sf):
    records = synthetic.records(spark, sf, ["aVL", "V1", "V3", "V5", "V6"])
    staged = records.select(
        "record_id", "sex",
        L.low_percentile(centre(F.col("leads.V1"))).alias("v1"), L.low_percentile(centre(F.col("leads.V3"))).alias("v3"),
        L.swing(centre(F.col("leads.aVL"))).alias("avl"), L.swing(centre(F.col("leads.V5"))).alias("v5"),
        L.swing(centre(F.col("leads.V6"))).alias("v6"),
    )
    found = rules.lvh(*[F.col(c) for c in ("v1", "v3", "avl", "v5", "v6", "sex")])
    return staged.select("record_id", found.alias("l")).select("record_id", "l.*")


@query("A18_bundle_branch")
def bundle_branch(spark, sf):
    staged = bridges.detected(spark, sf).select(
        "record_id",
        B.qrs_duration(F.col("c"), F.col("peaks"), F.col("fs")).alias("qrs"),
        L.percentile_sum_raw(F.col("leads.V1")).alias("v1"),
        L.percentile_sum_raw(F.col("leads.V6")).alias("v6"),
    )
    return staged.select("record_id", rules.bundle_branch(F.col("qrs"), F.col("v1"), F.col("v6")).alias("status"))


@query("A19_qrs_polarity")
def qrs_polarity(spark, sf):
    return M.polarity(bridges.detected(spark, sf)).filter(F.col("r_mv").isNotNull())


@query("A20_t_findings")
def t_findings(spark, sf):
    return M.t_waves(bridges.detected(spark, sf))


@query("A21_ptfv1")
def ptfv1(spark, sf):
    return M.ptfv1(bridges.detected(spark, sf))


@query("A26_pathologic_q")
def pathologic_q(spark, sf):
    return rounded(M.q_waves(bridges.detected(spark, sf)), 12)


@query("A2_signal_quality")
def signal_quality(spark, sf):
    return M.signal_quality(bridges.detected(spark, sf))


@query("A24_fibrillatory_power")
def fibrillatory_power(spark, sf):
    return M.fibrillatory_power(bridges.detected(spark, sf))


@query("C1_normalised_leads")
def normalised_leads(spark, sf):
    normal = preprocessing.normalise(synthetic.records(spark, sf))
    return rounded(
        M.leads_long(normal).select(
            "record_id", "lead", "fs", "n", F.size("samples").alias("samples"),
            F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.coalesce(v * v, F.lit(0.0))).alias("energy"),
        )
    )


@query("C2_missing_leads")
def missing_leads(spark, sf):
    return M.missing_leads(synthetic.records(spark, sf, [])).select(
        "record_id", F.array_join("missing_leads", ",").alias("missing_leads")
    )


@query("C5_beat_similarity")
def beat_similarity(spark, sf):
    return rounded(M.beat_similarity(bridges.detected(spark, sf)).select("record_id", "beat_morphology_similarity"))


@query("C12_feature_bundle")
def feature_bundle(spark, sf):
    detected = bridges.detected(spark, sf)
    counted = settle(detected.select("record_id", "peaks", "fs", "c", "x", "lead_names", M._usable_count(detected).alias("usable")))
    measured = settle(counted.select(
        "record_id", "peaks", "usable", "fs", "x", "lead_names",
        R.rr_intervals(F.col("peaks"), F.col("fs")).alias("rr"),
        B.p_wave(F.col("c"), F.col("peaks"), F.col("fs")).alias("p"),
    ))
    staged = measured.select(
        "record_id", "peaks", "usable", "rr", "p",
        Q.signal_quality(F.col("x"), F.col("fs"), F.size("peaks"), F.col("usable"), F.size("lead_names")).alias("quality"),
        S.band_power(F.col("x"), F.col("fs")).alias("power"),
    )
    return rounded(
        R.add_interval_features(staged, "rr", "r").select(
            "record_id", F.size("peaks").alias("qrs_count"), "r.rr_cv", "r.rmssd_ms", "r.turning_point_ratio",
            "r.sample_entropy", "r.shannon_entropy", "p.p_wave_presence_ratio", "p.pr_mean_ms",
            "quality.noise_score", "quality.baseline_wander_score", "quality.signal_quality_index", "usable",
            S.fibrillatory(F.col("power")).alias("fibrillatory"),
        ).select("*", "fibrillatory.*").drop("fibrillatory")
    )


@query("A25_territories")
def territories(spark, sf):
    levels = M.st_levels(bridges.detected(spark, sf))
    found = dimensions.territory_findings(levels, rules.ISCHEMIA_TERRITORIES, F.col("st_level_mv") <= -0.10)
    return found


@query("J6_territory_join")
def territory_join(spark, sf):
    levels = bridges.level_rows(spark, sf).select(
        F.col("k").cast("string").alias("record_id"), "age", "sex", F.explode_outer("st").alias("lead", "st_level_mv")
    )
    high = F.col("st_level_mv") >= rules.st_threshold(F.col("lead"), F.col("age"), F.col("sex"))
    return dimensions.territory_findings(levels, rules.STEMI_TERRITORIES, high)


@query("J7_thresholds")
def thresholds(spark, sf):
    rows = bridges.rule_rows(spark, sf)
    limit = lambda lead: rules.st_threshold(F.lit(lead), F.col("age"), F.col("sex"))
    return rows.select("k", limit("V2").alias("v2_mv"), limit("V3").alias("v3_mv"), limit("I").alias("i_mv"))


# --- rules on rows derived from orders ---------------------------------------------------------


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query("R1_rhythm_class")
def rhythm_class(spark, sf):
    found = rules.rhythm_class(*_c("heart_rate", "cv", "p_presence", "pr", "fib", "qrs"))
    rows = bridges.rule_rows(spark, sf).select("k", found.alias("r"))
    return rounded(
        rows.select(
            "k", "r.primary", "r.confidence", F.size("r.candidates").alias("candidates"),
            F.get("r.reasons", F.lit(0)).alias("reason"), F.get(F.get("r.candidates", F.lit(1))["reasons"], F.lit(0)).alias("second_reason"),
        )
    )


@query("R2_stemi")
def stemi(spark, sf):
    rows = bridges.level_rows(spark, sf).select("k", rules.stemi(F.col("st"), F.col("age"), F.col("sex")).alias("s"))
    return rows.select(
        "k", "s.status", "s.confidence", "s.culprit_vessel", joined(F.col("s.territories")).alias("territories"),
        joined(F.col("s.reasons")).alias("reasons"),
    )


@query("R3_ischemia_and_infarction")
def ischemia_and_infarction(spark, sf):
    deep = F.map_keys(F.map_filter("st", lambda l, v: v <= -0.2))
    rows = bridges.level_rows(spark, sf).select(
        "k", rules.ischemia(F.col("st")).alias("i"), rules.infarction(deep).alias("m")
    )
    text = lambda c: joined(F.transform(c, lambda g: F.concat(g["territory"], F.lit(": "), F.array_join(g["leads"], ","))))
    return rows.select("k", text("i").alias("ischemia"), text("m").alias("infarction"))


@query("R4_chambers")
def chambers(spark, sf):
    rows = bridges.rule_rows(spark, sf).withColumn(
        "lvh_status", F.when(F.col("k") % 5 == 0, "LVH criteria met").otherwise("LVH criteria not met")
    )
    found = rules.chambers(*_c("amp_ii", "p_duration", "ptfv1", "lvh_status", "axis_class"))
    return rows.select("k", found.alias("c")).select(
        "k", "c.right_atrial_enlargement", "c.left_atrial_enlargement", "c.biatrial_enlargement", "c.rvh",
        joined(F.col("c.summary")).alias("summary"),
    )


@query("R5_interval_flags")
def interval_flags(spark, sf):
    prolonged = F.when(F.col("fridericia") >= 450.0, "flagged").otherwise("not flagged")
    return bridges.rule_rows(spark, sf).select(
        "k", joined(rules.interval_flags(prolonged, *_c("fridericia", "pr", "qrs"))).alias("flags")
    )


AF_INPUT = ("cv", "irregularity", "rmssd", "pnn50", "p_presence", "p_missing", "pr_consistency", "fib", "sqi")


def _af_rows(spark, sf) -> DataFrame:
    rows = bridges.rule_rows(spark, sf).withColumn("p_missing", 100.0 - F.col("p_presence"))
    return rows.withColumn("af", rules.af_score(*_c(*AF_INPUT)))


@query("R6_af_gate")
def af_gate(spark, sf):
    gate = rules.af_gate(*_c("cv", "irregularity", "p_presence", "fib", "sqi"))
    return bridges.rule_rows(spark, sf).select("k", gate.alias("af_gate_passed"))


@query("R7_af_score")
def af_score(spark, sf):
    return rounded(_af_rows(spark, sf).select("k", "af.af_score", F.size("af.cap_reasons").alias("caps")))


@query("R8_af_text")
def af_text(spark, sf):
    return _af_rows(spark, sf).select("k", rules.af_text(F.col("af.af_score"), F.col("af.af_gate_passed")).alias("rhythm"))


@query("R9_confidence")
def confidence(spark, sf):
    unreliable = rules.p_unreliable(F.col("p_presence"), F.col("beats"))
    value = rules.confidence(F.col("sqi"), F.lit(9), F.col("imputed"), F.col("af.af_score"), F.col("model_score"), unreliable)
    return rounded(_af_rows(spark, sf).select("k", value.alias("confidence_score")))


@query("R10_reasons")
def reasons(spark, sf):
    unreliable = rules.p_unreliable(F.col("p_presence"), F.col("beats"))
    found = rules.af_reasons(
        F.col("af.af_gate_passed"), F.col("af.cap_reasons"), F.col("p_presence"), F.col("cv"), F.col("sqi"), unreliable, F.col("imputed")
    )
    none = F.expr("cast(array() as array<string>)")
    return _af_rows(spark, sf).select(
        "k", joined(found).alias("reasons"), joined(rules.warnings_list(F.col("sqi"), none)).alias("warnings"),
        F.size(rules.limitations_list(none)).alias("limitations"),
    )


@query("C11_af_decision")
def af_decision(spark, sf):
    rows = _af_rows(spark, sf)
    return rounded(
        rows.select(
            "k", F.col("af.af_score").alias("af_probability"), "af.af_gate_passed",
            rules.af_text(F.col("af.af_score"), F.col("af.af_gate_passed")).alias("rhythm_label"),
            (F.col("sqi") < 50.0).alias("repeat_recommended"),
        )
    )


@query("A13_qtc_approximate")
def qtc_approximate(spark, sf):
    return bridges.rule_rows(spark, sf).select("k", rules.qtc_approximate(*_c("rr_mean", "qrs", "pr")).alias("qtc_ms"))


@query("A12_qt_rules")
def qt_rules(spark, sf):
    rows = bridges.rule_rows(spark, sf).select("k", rules.qt_report(*_c("qt", "rr_mean", "sex")).alias("q"))
    return rows.select("k", "q.*")


@query("A17_lvh_rules")
def lvh_rules(spark, sf):
    found = rules.lvh(*_c("p2_v1", "p2_v3", "swing_avl", "swing_v5", "swing_v6", "sex"))
    return bridges.rule_rows(spark, sf).select("k", found.alias("l")).select("k", "l.*")


@query("A18_bundle_rules")
def bundle_rules(spark, sf):
    return bridges.rule_rows(spark, sf).select("k", rules.bundle_branch(*_c("qrs", "v1_net", "v6_net")).alias("status"))


@query("A35_hf_points")
def hf_points(spark, sf):
    rows = bridges.rule_rows(spark, sf).withColumn(
        "lvh_status", F.when(F.col("k") % 5 == 0, "LVH criteria met").otherwise("unavailable")
    )
    found = rules.hf_points(*_c("qrs", "fridericia", "heart_rate", "lvh_status", "model_score"))
    return rows.select("k", found.alias("h")).select("k", "h.category", "h.score_points", joined(F.col("h.reasons")).alias("reasons"))


@query("W6_irregularity_basic")
def irregularity_basic(spark, sf):
    value = R.irregularity_basic(*_c("cv", "rmssd", "p_presence"))
    return rounded(bridges.rule_rows(spark, sf).select("k", value.alias("rr_irregularity_index")))


@query("P17_rounding")
def rounding(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", F.bround(F.col("o_totalprice") * 0.1234567, 1).alias("one"), F.bround(F.col("o_totalprice") * 0.1234567, 3).alias("three"))


# --- labels, features, model data --------------------------------------------------------------


def _coded(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", f"{bridges.CODES_SQL} AS scp_codes")


@query("P10_code_map")
def code_maps(spark, sf):
    odd = F.when(F.col("event_id") % 17 == 0, "bad").when(F.col("event_id") % 13 == 1, "{'NORM': None, \"a: None, b\": 1.0, 5: True}")
    codes = _coded(spark, sf).withColumn("scp_codes", odd.otherwise(F.col("scp_codes")))
    return codes.select("event_id", F.size(code_map(F.col("scp_codes"))).alias("codes"))


@query("P11_code_label")
def code_label(spark, sf):
    codes = code_map(F.col("scp_codes"))
    return _coded(spark, sf).select(
        "event_id", has_code(codes, MORPHOLOGY_CODES).alias("morphology_label"), has_code(codes, RHYTHM_CODES).alias("rhythm_label")
    )


@query("U3_code_overlap")
def code_overlap(spark, sf):
    codes = F.map_keys(code_map(F.col("scp_codes")))
    both = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in RHYTHM_CODES]))
    return _coded(spark, sf).groupBy(both.alias("overlaps")).agg(F.count(F.lit(1)).alias("n"))


@query("P6_sex_code")
def sex_codes(spark, sf):
    return bridges.rule_rows(spark, sf).select("k", sex_code(F.col("sex")).alias("sex_code"))


@query("P7_feature_alias")
def feature_alias(spark, sf):
    rows = bridges.feature_rows(spark, sf).select(
        "k", F.col("pr_interval_ms").alias("pr_mean_ms"), (F.col("qtc_ms") + 1.0).alias("QTc"), F.col("qtc_ms").alias("qtc_ms"),
        F.col("ptfv1_mv_ms").cast("string").alias("PTFV1"), "age", "sex",
    )
    return rounded(features.canonical_features(rows, "k"))


@query("P8_clean_values")
def clean_values(spark, sf):
    from signalframe.functions.values import clean

    text = F.when(F.col("k") % 4 == 0, "NaN").when(F.col("k") % 4 == 1, "none").when(F.col("k") % 4 == 2, "-Infinity").otherwise(
        F.col("k").cast("string")
    )
    return bridges.rule_rows(spark, sf).select("k", clean(text).alias("value"))


@query("A33_completeness")
def completeness(spark, sf):
    return bridges.feature_rows(spark, sf).select("k", features.completeness(bridges.feature_rows(spark, sf)).alias("missing"))


@query("M1_stratified_split")
def stratified_split(spark, sf):
    split = selection.stratified_split(bridges.feature_rows(spark, sf), "ecg_id", "current_atrial_abnormality", 0.3, 42)
    return split.select("ecg_id", "current_atrial_abnormality", "is_test")


@query("C13_group_split")
def group_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    split = selection.group_split(orders, "o_custkey")
    return split.select("o_orderkey", "o_custkey", "is_test")


@query("M2_median_impute")
def median_impute(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    medians = selection.exact_quantiles(rows, FEATURES)
    return rounded(rows.select("k", *[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in FEATURES]))


@query("M3_standardise")
def standardise(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    preparation = models.fit_preparation(rows)
    return rounded(rows.select("k", *[preparation.scaled(c).alias(c) for c in FEATURES]))


@query("M7_contributions")
def contributions(spark, sf):
    weights = [0.5, -1.25, 0.01, 2.0, -0.003, 0.02, 0.015, -0.004, -30.0]
    filled = features.model_input(bridges.feature_rows(spark, sf), {"age": 50.0, "pr_interval_ms": 160.0}, "k")
    found = filled.select("k", F.posexplode(models.contributions(FEATURES, weights)).alias("rank", "c"))
    return rounded(found.select("k", "rank", "c.feature", "c.direction", "c.contribution"))


@query("C14_attributions")
def attributions(spark, sf):
    """One row per record and input: name, value, contribution, direction."""
    weights = [0.5, -1.25, 0.01, 2.0, -0.003, 0.02, 0.015, -0.004, -30.0]
    filled = features.model_input(bridges.feature_rows(spark, sf), {"age": 50.0, "pr_interval_ms": 160.0}, "k")
    found = filled.select("k", F.explode(models.contributions(FEATURES, weights)).alias("c"))
    return rounded(found.select("k", F.col("c.feature").alias("name"), "c.value", "c.contribution", "c.direction"))


@query("O4_top_contribution")
def top_contribution(spark, sf):
    return contributions(spark, sf).filter("rank = 0").drop("rank")


@query("J9_weighted_sum")
def weighted_sum(spark, sf):
    weights = F.array(*[F.lit(float(i + 1)) for i in range(len(FEATURES))])
    zipped = F.zip_with(F.array(*FEATURES), weights, lambda v, w: F.coalesce(v, F.lit(0.0)) * w)
    return rounded(bridges.feature_rows(spark, sf).select("k", F.aggregate(zipped, F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("M8_model_input")
def model_input(spark, sf):
    defaults = {"age": 0.0, "sex": 0.0, "p_duration_ms": 110.0, "qtc_ms": 410.0}
    found = features.model_input(bridges.feature_rows(spark, sf), defaults, "k")
    sources = joined(F.transform("imputed", lambda i: F.concat(i["feature"], F.lit("="), i["source"])))
    return rounded(found.select("k", *FEATURES, sources.alias("imputed")))


@query("M12_reported_features")
def reported_features(spark, sf):
    found = bridges.feature_rows(spark, sf).select("k", F.explode(features.reported_features()).alias("f"))
    return rounded(found.select("k", "f.feature", "f.value"))


@query("U5_merge_present")
def merge_present(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    base = rows.select("k", "age", "qtc_ms", "pr_interval_ms")
    override = rows.select("k", (F.col("pr_interval_ms") + 5.0).alias("pr_interval_ms"), F.col("p_duration_ms"))
    override = override.withColumn("pr_interval_ms", F.when(F.col("k") % 2 == 0, F.col("pr_interval_ms")))
    return rounded(features.merge_present(base, override, "k"))


@query("O1_first_records")
def first_records(spark, sf):
    return bridges.feature_rows(spark, sf).orderBy("ecg_id").limit(25).select("ecg_id", "qrs_duration_ms")


@query("O3_missing_columns")
def missing_columns(spark, sf):
    rows = bridges.feature_rows(spark, sf).drop("qtc_ms", "age")
    missing = tables.missing_columns(rows, FEATURES)
    return rows.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(",".join(missing)).alias("missing"))


@query("U4_subset_test")
def subset_test(spark, sf):
    records = synthetic.records(spark, sf, [])
    holds = F.size(F.array_except(F.array(F.lit("V1"), F.lit("V6")), F.col("lead_names"))) == 0
    return records.select("record_id", holds.alias("holds"))


@query("P14_target_and_order")
def target_and_order(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    target = tables.resolve_target(rows)
    tables.check_feature_table(rows, target)
    return rounded(rows.select("ecg_id", *FEATURES, F.col(target).alias("target")))


@query("A22_ptfv1_batch")
def ptfv1_batch(spark, sf):
    records = synthetic.records(spark, sf, ["I", "II", "aVF", "V1"])
    measured = features.morphology(records, bridges.delineation(spark, sf))
    return rounded(measured.select("record_id", "ptfv1_mv_ms"))


@query("A23_batch_morphology")
def batch_morphology(spark, sf):
    records = synthetic.records(spark, sf, ["I", "II", "aVF", "V1"])
    return rounded(features.morphology(records, bridges.delineation(spark, sf)).drop("ptfv1_mv_ms"))


@query("J3_positional_intervals")
def positional_intervals(spark, sf):
    wanted = {"pr_ms": ("p_on", "q_on"), "qt_ms": ("q_on", "t_off")}
    return rounded(features.interval_means(bridges.delineation(spark, sf), wanted, 100.0))


def _metadata(spark, sf) -> DataFrame:
    """Record metadata from orders: several rows per record, some without a file or without a record."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ecg_id"),
        (F.col("o_orderkey") % 70 + 20).cast("double").alias("age"),
        (F.col("o_orderkey") % 2).cast("double").alias("sex"),
        F.when(F.col("o_orderkey") % 9 == 0, "")
        .when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string")).alias("filename_lr"),
        F.concat(F.lit("{'"), F.when(F.col("o_orderstatus") == "F", "LAO/LAE").otherwise("NORM"), F.lit("': 0.0}")).alias("scp_codes"),
    )


@query("J2_feature_table")
def feature_table(spark, sf):
    records = synthetic.records(spark, sf, ["I", "II", "aVF", "V1"])
    return rounded(feature_job.build(_metadata(spark, sf), records, bridges.delineation(spark, sf)))


# The same from records stored by key: their samples stay where they lie.


def _stored_by_record(spark, sf) -> DataFrame:
    path = _fresh(spark, "by-record")
    tables.save_by_record(synthetic.records(spark, sf, ["I", "II", "aVF", "V1"]), path, buckets=16)
    return tables.read_by_record(spark, path)


@query("A22_ptfv1_stored")
def ptfv1_stored(spark, sf):
    measured = features.morphology(_stored_by_record(spark, sf), bridges.delineation(spark, sf))
    return rounded(measured.select("record_id", "ptfv1_mv_ms"))


@query("A23_morphology_stored")
def morphology_stored(spark, sf):
    return rounded(features.morphology(_stored_by_record(spark, sf), bridges.delineation(spark, sf)).drop("ptfv1_mv_ms"))


@query("J2_feature_table_stored")
def feature_table_stored(spark, sf):
    return rounded(feature_job.build(_metadata(spark, sf), _stored_by_record(spark, sf), bridges.delineation(spark, sf)))


@query("J2_unmatched")
def unmatched(spark, sf):
    usable = tables.usable_metadata(_metadata(spark, sf))
    records = synthetic.records(spark, sf, []).select("record_id")
    return features.unmatched(usable, records).select("ecg_id", "filename_lr")


@query("S4_usable_metadata")
def usable_metadata(spark, sf):
    return tables.usable_metadata(_metadata(spark, sf)).select("ecg_id", "filename_lr", "scp_codes")


@query("S7_feature_table_checked")
def feature_table_checked(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    tables.check_feature_table(rows, tables.resolve_target(rows))
    return rows.groupBy("current_atrial_abnormality").agg(F.count(F.lit(1)).alias("n"))


def _fresh(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S6_feature_table_saved")
def feature_table_saved(spark, sf):
    path = _fresh(spark, "features")
    tables.save_checked(bridges.feature_rows(spark, sf).drop("k"), path)
    saved, _ = tables.read_feature_table(spark, path)
    return rounded(saved)


@query("S8_predictions_read")
def predictions_read(spark, sf):
    path = _fresh(spark, "predictions")
    bridges.predictions(spark, sf).drop("n_chars").write.option("header", True).csv(path)
    return rounded(tables.read_predictions(spark, path))


@query("S9_report_saved")
def report_saved(spark, sf):
    path = _fresh(spark, "report")
    tables.save_metrics(evaluation.metrics_report(bridges.predictions(spark, sf)), path)
    back = spark.read.option("header", True).csv(path)
    return rounded(back.select("dataset", F.col("n").cast("long"), F.col("auc").cast("double"), F.col("tp").cast("long")))


@query("U1_overall_and_parts")
def overall_and_parts(spark, sf):
    report = evaluation.confusion(bridges.predictions(spark, sf))
    return report.groupBy((F.col("dataset") == evaluation.OVERALL).alias("is_overall")).agg(
        F.sum("tn").alias("tn"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tp").alias("tp")
    )


@query("U2_union_of_datasets")
def union_of_datasets(spark, sf):
    adapters = {
        "ptbxl": lambda s, p: synthetic.records(s, p, ["II"]).select("record_id", "fs", "n", "lead_names"),
        "mitbih_afdb": lambda s, p: bridges.embedding_leads(s, p).select("record_id", "fs", "n"),
    }
    whole = tables.union_datasets(spark, adapters, {"ptbxl": sf, "mitbih_afdb": sf})
    return whole.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("samples"), F.count("lead_names").alias("with_names")
    )


@query("S12_dataset_registry")
def dataset_registry(spark, sf):
    keys = [d[0] for d in dimensions.DATASETS]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("c_custkey") % len(keys) + 1).cast("int"))
    records = table(spark, sf, "customer").select("c_custkey", key.alias("dataset_key"))
    return dimensions.with_dataset_spec(records).select("c_custkey", "dataset_key", "name", "modality", "external_validation_group")


@query("S13_adapted_labels")
def adapted_labels(spark, sf):
    coded = _coded(spark, sf).select("event_id", F.explode(F.map_keys(code_map(F.col("scp_codes")))).alias("code"))
    wanted = dimensions.label_codes(spark)
    return (
        coded.join(F.broadcast(wanted), "code")
        .groupBy("event_id", "label_set")
        .agg(F.count(F.lit(1)).alias("codes"))
    )


# --- binary records ----------------------------------------------------------------------------


def _files(spark, sf) -> DataFrame:
    """Header and signal files of the synthetic records; some lack their partner."""
    files = encode.encode_records(synthetic.records(spark, sf), "records/", synthetic.STEPS)
    key = F.regexp_extract("path", r"(\d+)\.", 1).cast("long")
    lost = (F.col("path").endswith(".dat") & (key % 14 == 3)) | (F.col("path").endswith(".hea") & (key % 14 == 5))
    return files.filter(~lost)


def _with_broken(files: DataFrame) -> DataFrame:
    """Some signal files are cut short."""
    key = F.regexp_extract("path", r"(\d+)\.", 1).cast("long")
    cut = F.col("path").endswith(".dat") & (key % 11 == 0)
    return files.withColumn("content", F.when(cut, F.substring(F.col("content"), 1, 1001)).otherwise(F.col("content")))


@query("S1_record_pairs")
def record_pairs(spark, sf):
    return wfdb.find_pairs(_files(spark, sf)).select("record_id", "header_path", "signal_path")


@query("J1_unpaired_files")
def unpaired_files(spark, sf):
    return wfdb.unpaired(_files(spark, sf)).select("path", "error")


@query("S2_decoded_leads")
def decoded_leads(spark, sf):
    readable, _ = wfdb.split_readable(wfdb.find_pairs(_files(spark, sf)))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rounded(
        wfdb.decode_leads(readable).select(
            "record_id", "lead", "fs", "n", total.alias("total_mv"), F.size(present(F.col("samples"))).alias("present")
        ), 3
    )


@query("S3_record_metadata")
def record_metadata(spark, sf):
    readable, _ = wfdb.split_readable(wfdb.find_pairs(_files(spark, sf), signals=False))
    meta = wfdb.record_metadata(readable)
    return rounded(meta.select("record_id", "sampling_frequency", "number_of_leads", F.array_join("lead_names", ",").alias("lead_names"), "duration_seconds"))


@query("S5_demographics")
def demographics(spark, sf):
    records = synthetic.records(spark, sf, [])
    return records.select("record_id", comment_age(F.col("comments")).alias("age"), comment_sex(F.col("comments")).alias("sex"))


@query("P9_dead_letters")
def dead_letters(spark, sf):
    _, errors = wfdb.split_readable(wfdb.find_pairs(_with_broken(_files(spark, sf)), signals=False))
    return errors


@query("O6_first_pair")
def first_pair(spark, sf):
    return wfdb.find_pairs(_files(spark, sf)).select("stem").orderBy("stem").limit(1)


# The same from files in a folder, through the data source.


def _written(spark, sf, files: DataFrame | None = None) -> str:
    folder = _fresh(spark, "record-files")
    encode.write_files(_files(spark, sf) if files is None else files, folder)
    return folder


def _below(path: Column) -> Column:
    """A path without the folder."""
    return F.regexp_extract(path, r"(records/[^/]*)$", 1)


@query("S1_pairs_of_files")
def pairs_of_files(spark, sf):
    folder = _written(spark, sf)
    pairs = record_source.complete(record_source.read_records(spark, folder, signals=False))
    return pairs.select("record_id", *[_below(F.col(c)).alias(c) for c in ("header_path", "signal_path")])


@query("J1_unpaired_of_files")
def unpaired_of_files(spark, sf):
    folder = _written(spark, sf)
    return record_source.unpaired(record_source.read_records(spark, folder, signals=False)).select(
        _below(F.col("path")).alias("path"), "error"
    )


@query("S2_records_of_files")
def records_of_files(spark, sf):
    stems = record_source.complete(record_source.read_records(spark, _written(spark, sf), partition_bytes=4 << 20))
    readable, _ = wfdb.split_readable(stems)
    leads = M.leads_long(wfdb.to_records(readable, STANDARD_LEADS, "ptbxl"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rounded(
        leads.select("record_id", "lead", "fs", "n", total.alias("total_mv"), F.size(present(F.col("samples"))).alias("present")), 3
    )


@query("S3_metadata_of_files")
def metadata_of_files(spark, sf):
    stems = record_source.complete(record_source.read_records(spark, _written(spark, sf), signals=False))
    readable, _ = wfdb.split_readable(stems)
    return rounded(wfdb.record_metadata(readable).select(
        "record_id", "sampling_frequency", "number_of_leads", F.array_join("lead_names", ",").alias("lead_names"), "duration_seconds"
    ))


@query("P9_dead_letters_of_files")
def dead_letters_of_files(spark, sf):
    folder = _written(spark, sf, _with_broken(_files(spark, sf)))
    _, errors = wfdb.split_readable(record_source.complete(record_source.read_records(spark, folder, signals=False)))
    return errors.select(_below(F.col("stem")).alias("stem"), "error")


# --- models (no SQL counterpart) ---------------------------------------------------------------


def _trained(spark, sf) -> models.Trained:
    """The training job with its own settings."""
    return models.train(bridges.feature_rows(spark, sf).drop("k"), "ecg_id", "current_atrial_abnormality")


@functools.cache
def _saved(application: str, sf: str) -> str:
    """Where the artefacts lie that the queries of a session load which use a model but do not train one."""
    spark = SparkSession.getActiveSession()
    folder = _fresh(spark, "models")
    models.save_artifacts(spark, _trained(spark, sf), folder)
    return folder


def _loaded(spark, sf):
    return models.load_artifacts(spark, _saved(spark.sparkContext.applicationId, sf))


@query("M4_logistic_coefficients")
def logistic_coefficients(spark, sf):
    rows = bridges.feature_rows(spark, sf)
    preparation = models.fit_preparation(rows)
    weight, n = models.balanced_weight(rows, "current_atrial_abnormality")
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=FEATURES, outputCol="scaled_vector").transform(
        rows.select(
            F.col("current_atrial_abnormality").cast("double").alias("label__"), weight.alias("weight__"),
            *[preparation.scaled(c).alias(c) for c in FEATURES],
        )
    )
    fitted = models._logistic(n).fit(ready)
    return spark.createDataFrame(
        [(c, float(w)) for c, w in zip(FEATURES, fitted.coefficients)] + [("intercept", float(fitted.intercept))],
        "term string, weight double",
    )


@query("M4_gradient_at_fit")
def gradient_at_fit(spark, sf):
    """Whether the slope of the penalised loss vanishes at the fitted weights, term by term."""
    rows = bridges.feature_rows(spark, sf)
    preparation = models.fit_preparation(rows)
    fitted = {r["term"]: r["weight"] for r in logistic_coefficients(spark, sf).collect()}
    weight, n = models.balanced_weight(rows, "current_atrial_abnormality")
    z = sum((F.lit(fitted[c]) * preparation.scaled(c) for c in FEATURES), F.lit(fitted["intercept"]))
    miss = weight * (1.0 / (1.0 + F.exp(-z)) - F.col("current_atrial_abnormality"))
    slopes = rows.agg(*[(F.avg(miss * preparation.scaled(c)) + fitted[c] / n).alias(c) for c in FEATURES], F.avg(miss).alias("intercept"))
    flat = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), (F.abs(c) < 1e-5).alias("settled")) for c in slopes.columns]))
    return slopes.select(flat.alias("s")).select("s.*")


@query("M5_boosted_scores")
def boosted_scores(spark, sf):
    rows = bridges.feature_rows(spark, sf).drop("k")
    return models.score(rows, _trained(spark, sf).model, "ecg_id").select("ecg_id", "boosting_probability")


@query("M5_missing_scores")
def missing_scores(spark, sf):
    """Trees that take missing inputs as they are; fewer than the training job's, to keep the check short."""
    rows = bridges.feature_rows(spark, sf)
    model = boosting.fit(rows, "current_atrial_abnormality", FEATURES, trees=10)
    return boosting.score(rows, model, "ecg_id")


@query("M5_level_histogram")
def level_histogram(spark, sf):
    """The sums of the second level of a tree whose first split is given, with given cuts."""
    model = boosting.Boosted(FEATURES, [list(c) for c in bridges.CUTS.values()], -0.5, 0.1)
    rows = boosting.binned(bridges.feature_rows(spark, sf), "current_atrial_abnormality", model)
    grown = boosting.Tree([-1, FEATURES.index("qtc_ms"), -1, -1], [0, 2, 0, 0], [True, False, True, True], [0.0] * 4)
    found = boosting.level_histogram(rows, model, 0, grown, 1)
    named = F.get(F.array(*map(F.lit, FEATURES)), F.col("feature").cast("int"))
    return rounded(found.withColumn("feature", named))


@query("M6_scores")
def scores(spark, sf):
    rows = bridges.feature_rows(spark, sf).drop("k")
    return models.reported_scores(models.score(rows, _loaded(spark, sf)[0], "ecg_id"), "ecg_id")


@query("M9_reload_identity")
def reload_identity(spark, sf):
    """The model as trained beside the model as saved and loaded."""
    trained, folder = _trained(spark, sf), _fresh(spark, "models")
    models.save_artifacts(spark, trained, folder)
    loaded, _ = models.load_artifacts(spark, folder)
    difference = models.reload_difference(bridges.feature_rows(spark, sf).drop("k"), "ecg_id", trained.model, loaded)
    return difference.select(*[(F.col(c) <= 1e-12).alias(c) for c in difference.columns])


@query("M10_model_metrics")
def model_metrics(spark, sf):
    return _trained(spark, sf).metrics


@query("M11_smoke_scores")
def smoke_scores(spark, sf):
    return models.smoke_scores(bridges.feature_rows(spark, sf).drop("k"), _loaded(spark, sf)[0], "ecg_id", "current_atrial_abnormality")


@query("S10_saved_metadata")
def saved_metadata(spark, sf):
    folder = _fresh(spark, "models")
    models.save_artifacts(spark, _trained(spark, sf), folder)
    return spark.read.json(f"{folder}/metadata").select("records_used", "target_column", "logistic_auc", "gradient_boosting_auc")


@query("S11_loaded_scores")
def loaded_scores(spark, sf):
    model, _ = _loaded(spark, sf)
    return models.score(bridges.feature_rows(spark, sf).drop("k"), model, "ecg_id")


@query("C6_calibration")
def calibration(spark, sf):
    predictions = bridges.predictions(spark, sf).select("y_true", "y_score")
    return models.calibration_report(predictions, "platt").unionByName(models.calibration_report(predictions, "isotonic"))


@query("C7_external_validation")
def external_validation(spark, sf):
    return rounded(models.external_validation(bridges.predictions(spark, sf)))


@query("C6_isotonic")
def isotonic_scores(spark, sf):
    fitted = fits.isotonic(bridges.predictions(spark, sf))
    return rounded(fitted.select(F.col("patient_id").cast("string").alias("patient_id"), "y_true", "y_score", "calibrated"))


@query("C6_platt")
def platt_scores(spark, sf):
    predictions = bridges.predictions(spark, sf)
    fitted = models.calibrated(predictions, "platt")
    return rounded(fitted.select(F.col("patient_id").cast("string").alias("patient_id"), "y_true", "y_score", "calibrated"))


@query("C9_ablation")
def ablation(spark, sf):
    return models.ablation(bridges.interval_rows(spark, sf), "ecg_id", "current_atrial_abnormality")


@query("C9_ablation_settled")
def ablation_settled(spark, sf):
    """Whether the slope of the penalised loss vanishes at the weights of each group, whatever its inputs."""
    rows = bridges.interval_rows(spark, sf)
    groups = {g: c for g, c in models.ABLATION_GROUPS.items() if set(c) <= set(rows.columns)}
    columns = [c for c in [*FEATURES, *RR_FEATURES] if c in rows.columns]
    preparation = models.fit_preparation(rows, columns)
    weight, n = models.balanced_weight(rows, "current_atrial_abnormality")
    ready = materialise(rows.select(
        F.array(*[preparation.scaled(c) for c in columns]).alias("x"), F.col("current_atrial_abnormality").cast("double").alias("y"), weight.alias("w")
    ))
    fitted = fit_groups(ready, {g: [columns.index(c) for c in wanted] for g, wanted in groups.items()}, 1.0 / n)
    slopes = []
    for g, wanted in groups.items():
        at = {columns.index(c): float(b) for c, b in zip(wanted, fitted[g])}
        z = sum((F.get("x", F.lit(i)) * b for i, b in at.items()), F.lit(float(fitted[g][-1])))
        miss = F.col("w") * (1.0 / (1.0 + F.exp(-z)) - F.col("y"))
        worst = F.greatest(F.abs(F.avg(miss)), *[F.abs(F.avg(miss * F.get("x", F.lit(i))) + b / n) for i, b in at.items()])
        slopes.append(F.struct(F.lit(g).alias("feature_group"), F.lit(len(wanted)).alias("inputs"), (worst < 1e-9).alias("settled")))
    return ready.agg(F.array(*slopes).alias("s")).select(F.explode("s").alias("s")).select("s.*")


@query("C9_feature_table_with_intervals")
def feature_table_with_intervals(spark, sf):
    records = synthetic.records(spark, sf, ["I", "II", "aVF", "V1"])
    table_ = feature_job.build(_metadata(spark, sf), records, bridges.delineation(spark, sf), with_intervals=True)
    return rounded(table_.select("ecg_id", "qrs_duration_ms", *RR_FEATURES))


# --- whole records -----------------------------------------------------------------------------


@query("R11_measurement_bundle")
def measurement_bundle(spark, sf):
    found = analyse.interpret(analyse.measure(synthetic.records(spark, sf)))
    return found.select("record_id", analyse.basic_measurements().alias("basic_ecg_measurements"))


@query("R11_bundle_columns")
def bundle_columns(spark, sf):
    """The measurement bundle, flat."""
    found = analyse.interpret(analyse.measure(synthetic.records(spark, sf)))
    b = found.select("record_id", "qrs_count", analyse.basic_measurements().alias("b"))
    regular = ("mean_rr_ms", "rr_sd_ms", "rr_cv", "rmssd_ms", "heart_rate_bpm", "regularity")
    return rounded(b.select(
        "record_id", "qrs_count", "b.selected_lead", *[F.col(f"b.rhythm_regularity.{c}").alias(c) for c in regular],
        "b.p_wave_pr.pr_interval_ms", "b.p_wave_pr.pr_sd_ms", "b.p_wave_pr.p_wave_presence_ratio", "b.p_wave_pr.missing_p_wave_percent",
        F.col("b.p_wave_pr.status").alias("p_status"), "b.qrs.qrs_duration_ms", "b.qrs.wide_qrs", F.col("b.qrs.status").alias("qrs_status"),
        "b.qt_qtc.qt_ms", "b.qt_qtc.qtc_bazett_ms", "b.qt_qtc.qtc_fridericia_ms", "b.qt_qtc.prolonged_qtc", "b.axis.axis_deg",
        F.col("b.axis.classification").alias("axis_class"), "b.st_segment.max_elevation_mv", "b.st_segment.max_depression_mv",
        F.size("b.st_segment.lead_measurements").alias("st_leads"), F.col("b.lvh.status").alias("lvh_status"), F.col("b.bbb.status").alias("bbb_status"),
        "b.af_rhythm_markers.rr_irregularity_index", "b.af_rhythm_markers.p_wave_absence_percent",
        "b.af_rhythm_markers.fibrillatory_baseline_power", "b.af_rhythm_markers.dominant_f_wave_hz",
    ))


def _report_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        "record_id", "selected_lead", "qrs_count", "af_detection_score", "main_atrial_remodeling_score", "confidence_score",
        "rhythm", F.col("advanced_ecg_interpretation.physician_report").alias("physician_report"),
    )


@query("R12_report")
def report(spark, sf):
    return _report_columns(analyse.analyse(synthetic.records(spark, sf), *_loaded(spark, sf)))


@query("S14_documents")
def documents(spark, sf):
    path = _fresh(spark, "documents")
    tables.save_documents(analyse.analyse(synthetic.records(spark, sf), *_loaded(spark, sf)), path)
    text = spark.read.text(path)
    return text.select(
        F.get_json_object("value", "$.record_id").alias("record_id"),
        F.get_json_object("value", "$.basic_ecg_measurements.axis.classification").alias("axis"),
        F.get_json_object("value", "$.waveform_preview.lead").alias("lead"),
    )


@query("T1_arrivals")
def arrivals(spark, sf):
    from signalframe.streaming.arrivals import append_results, arriving

    customers = spark.read.parquet(f"{sf}/customer.parquet").schema
    out, checkpoint = _fresh(spark, "arrivals"), _fresh(spark, "arrivals-checkpoint")

    spread = 3 * spark.sparkContext.defaultParallelism  # a stream tells no partitions of its own

    def score_batch(stream: DataFrame) -> DataFrame:
        return M.qrs_duration(M.detect_beats(synthetic.waveforms(stream, spread=spread)))

    stream = arriving(spark, f"{sf}/customer.parquet*", customers)
    append_results(stream, score_batch, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def _arrived(spark, sf, transform) -> tuple[DataFrame, DataFrame]:
    """Documents and dead letters of a stream over record files, some of them broken."""
    from signalframe.streaming.arrivals import score_arrivals

    stems = record_source.arriving_records(spark, _written(spark, sf, _with_broken(_files(spark, sf))), settle=0)
    out, dead, checkpoint = _fresh(spark, "documents"), _fresh(spark, "dead-letters"), _fresh(spark, "arrivals-checkpoint")
    score_arrivals(stems, transform, out, dead, checkpoint).awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(dead)


@query("T1_scored_arrivals")
def scored_arrivals(spark, sf):
    from signalframe.streaming.arrivals import report_of

    return _report_columns(_arrived(spark, sf, report_of(*_loaded(spark, sf)))[0])


@query("T1_arrival_findings")
def arrival_findings(spark, sf):
    found, dead = _arrived(spark, sf, lambda r: M.detect_beats(r).select("record_id", "selected_lead", F.size("peaks").alias("qrs_count")))
    lost = dead.select(
        F.regexp_extract("stem", "([^/]*)$", 1).alias("record_id"), F.lit(None).cast("string").alias("selected_lead"),
        F.lit(None).cast("int").alias("qrs_count"), "error",
    )
    return found.select("record_id", "selected_lead", "qrs_count", F.lit(None).cast("string").alias("error")).unionByName(lost)
