"""Rule-based findings: row-wise expressions over aggregated columns.

Thresholds, labels and sentences are fixed values of the rule set. Arguments named ``*_rounded``
take the reported (rounded) measure, the others the unrounded one; the two differ at thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalframe.functions.arrays import clamp, let, lets
from signalframe.functions.values import sex_code

# Lead groups.
STEMI_TERRITORIES = {
    "septal": ["V1", "V2"],
    "anterior": ["V3", "V4"],
    "lateral": ["I", "aVL", "V5", "V6"],
    "inferior": ["II", "III", "aVF"],
    "posterior": ["V1", "V2", "V3"],
}
ISCHEMIA_TERRITORIES = {
    "anterior ischemia": ["V2", "V3", "V4"],
    "inferior ischemia": ["II", "III", "aVF"],
    "lateral ischemia": ["I", "aVL", "V5", "V6"],
    "posterior ischemia": ["V1", "V2", "V3"],
}
INFARCT_TERRITORIES = {
    "septal MI pattern": ["V1", "V2"],
    "anterior MI pattern": ["V3", "V4"],
    "inferior MI pattern": ["II", "III", "aVF"],
    "lateral MI pattern": ["I", "aVL", "V5", "V6"],
}
INFERIOR = ["II", "III", "aVF"]
LATERAL = ["I", "aVL", "V5", "V6"]
ISCHEMIA_BASIS = "ST depression >=0.1 mV in contiguous leads"
INFARCT_BASIS = "pathologic Q-wave morphology flag - research"
DISCLAIMER = "This is a research prototype and does not diagnose AF. Physician confirmation is required."


def present_only(*values: Column) -> Column:
    """The values that are not NULL, in order."""
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_male(sex: Column) -> Column:
    return F.coalesce(sex_code(sex) == 1.0, F.lit(False))


def is_female(sex: Column) -> Column:
    return F.coalesce(sex_code(sex) == 0.0, F.lit(False))


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# --- intervals ---------------------------------------------------------------------------------


def qtc_approximate(rr_mean: Column, qrs_ms: Column, pr_ms: Column) -> Column:
    """QTc from QRS and PR alone, for the model input; 0 counts as unknown."""
    qrs = F.coalesce(F.nullif(qrs_ms, F.lit(0.0)), F.lit(90.0))
    pr = F.coalesce(F.nullif(pr_ms, F.lit(0.0)), F.lit(160.0))
    qt = 360.0 + F.greatest(F.lit(0.0), qrs - 90.0) * 0.45 + F.greatest(F.lit(0.0), pr - 160.0) * 0.15
    return F.when(rr_mean > 0, F.bround(qt / F.sqrt(rr_mean / 1000.0), 1))


def qt_report(qt: Column, rr_mean_rounded: Column, sex: Column) -> Column:
    """QT, both corrections, the threshold by sex and the flag (Fridericia at or above it)."""
    known = _holds(qt.isNotNull() & (rr_mean_rounded != 0.0))
    limit = F.when(is_female(sex), 470.0).when(is_male(sex), 450.0).otherwise(460.0)
    return lets(
        [F.when(known, qt), F.when(known, rr_mean_rounded / 1000.0), limit],
        lambda q, rr, lim: lets(
            [q / F.sqrt(rr), q / F.pow(rr, F.lit(1.0 / 3.0))],
            lambda bazett, fridericia: F.struct(
                F.bround(q, 1).alias("qt_ms"),
                F.bround(bazett, 1).alias("qtc_bazett_ms"),
                F.bround(fridericia, 1).alias("qtc_fridericia_ms"),
                F.when(q.isNull(), "unavailable")
                .when(fridericia >= lim, "flagged")
                .otherwise("not flagged")
                .alias("prolonged_qtc"),
                F.when(q.isNotNull(), lim).alias("sex_specific_threshold_ms"),
            ),
        ),
    )


def interval_flags(prolonged: Column, fridericia_rounded: Column, pr_rounded: Column, qrs_rounded: Column) -> Column:
    return present_only(
        F.when(prolonged == "flagged", "prolonged QTc"),
        F.when(fridericia_rounded < 340.0, "short QT"),
        F.when(pr_rounded > 200.0, "first-degree AV block"),
        F.when(qrs_rounded >= 120.0, "wide QRS"),
    )


# --- voltage, bundle, chambers -----------------------------------------------------------------


def lvh(p2_v1: Column, p2_v3: Column, swing_avl: Column, swing_v5: Column, swing_v6: Column, sex: Column) -> Column:
    """Voltage criteria from percentiles of the centred leads; NULL inputs are missing leads."""
    sokolow = F.when(
        p2_v1.isNotNull() & (swing_v5.isNotNull() | swing_v6.isNotNull()),
        F.abs(p2_v1) + F.greatest(F.coalesce(swing_v5, F.lit(0.0)), F.coalesce(swing_v6, F.lit(0.0))),
    )
    cornell = F.when(swing_avl.isNotNull() & p2_v3.isNotNull(), swing_avl + F.abs(p2_v3))
    limit = F.when(is_female(sex), 2.0).otherwise(2.8)
    return lets(
        [sokolow, cornell, limit],
        lambda s, c, lim: F.struct(
            F.when(_holds(s >= 3.5) | _holds(c >= lim), "LVH criteria met")
            .when(s.isNotNull() | c.isNotNull(), "LVH criteria not met")
            .otherwise("unavailable")
            .alias("status"),
            F.bround(s, 2).alias("sokolow_lyon_mv"),
            F.bround(c, 2).alias("cornell_mv"),
            lim.alias("cornell_threshold_mv"),
        ),
    )


def bundle_branch(qrs_rounded: Column, v1_net: Column, v6_net: Column) -> Column:
    """Status from the width and the sign of p95 + p5 of the raw V1 and V6."""
    return (
        F.when(qrs_rounded.isNull(), "unavailable")
        .when(qrs_rounded < 120.0, "No wide QRS flag")
        .when(v1_net.isNull() | v6_net.isNull(), "Wide QRS flag; BBB morphology unavailable")
        .when((v1_net > 0) & (v6_net < 0), "RBBB-like morphology flag - research")
        .when((v1_net < 0) & (v6_net > 0), "LBBB-like morphology flag - research")
        .otherwise("Wide QRS flag; nonspecific morphology")
    )


def chambers(amp_ii: Column, p_duration_rounded: Column, ptfv1: Column, lvh_status: Column, axis_class: Column) -> Column:
    rae = _holds(amp_ii >= 0.25)
    lae = _holds(p_duration_rounded >= 120.0) | _holds(ptfv1 <= -0.04)
    rvh = _holds(axis_class == "right axis deviation")
    return lets(
        [rae, lae, rvh, _holds(lvh_status == "LVH criteria met")],
        lambda r, l, v, h: let(
            present_only(
                F.when(r, "right atrial enlargement criteria"),
                F.when(l, "left atrial enlargement criteria"),
                F.when(r & l, "biatrial enlargement criteria"),
                F.when(h, "LVH criteria"),
                F.when(v, "RVH screening flag"),
            ),
            lambda found: F.struct(
                F.when(r, "criteria met").otherwise("not met/unavailable").alias("right_atrial_enlargement"),
                F.when(l, "criteria met").otherwise("not met/unavailable").alias("left_atrial_enlargement"),
                F.when(r & l, "criteria met").otherwise("not met").alias("biatrial_enlargement"),
                lvh_status.alias("lvh"),
                F.when(v, "screening flag").otherwise("not met/unavailable").alias("rvh"),
                F.when(F.size(found) > 0, found)
                .otherwise(texts("No chamber enlargement criteria met by available rules."))
                .alias("summary"),
            ),
        ),
    )


# --- segment levels by territory ---------------------------------------------------------------


def st_threshold(lead: Column, age: Column, sex: Column) -> Column:
    """Elevation threshold in mV by lead, sex and age."""
    return F.when(
        lead.isin("V2", "V3"),
        F.when(is_female(sex), 0.15)
        .when(is_male(sex) & _holds(age < 40), 0.25)
        .when(is_male(sex), 0.20)
        .otherwise(0.10),
    ).otherwise(0.10)


def st_status(highest: Column, lowest: Column) -> Column:
    return (
        F.when(highest.isNull(), "unavailable")
        .when(highest >= 0.1, "possible ST elevation - research/experimental")
        .when(lowest <= -0.1, "possible ST depression - research/experimental")
        .otherwise("no major ST deviation flag - research/experimental")
    )


def _level(levels: Column, lead: Column) -> Column:
    return F.coalesce(F.try_element_at(levels, lead), F.lit(0.0))


def stemi(levels: Column, age: Column, sex: Column) -> Column:
    """Territories with at least two leads at or above their threshold, and what follows from them.

    ``levels`` maps a lead to its reported segment level.
    """

    def run(st: Column, years: Column, gender: Column) -> Column:
        def elevated(leads: list[str]) -> Column:
            return F.filter(texts(*leads), lambda l: _level(st, l) >= st_threshold(l, years, gender))

        groups = F.filter(
            F.array(*[
                F.struct(F.lit(name).alias("territory"), elevated(leads).alias("leads"))
                for name, leads in STEMI_TERRITORIES.items()
            ]),
            lambda g: F.size(g["leads"]) >= 2,
        )
        low_inferior = F.exists(texts(*INFERIOR), lambda l: _level(st, l) <= -0.10)
        low_lateral = F.exists(texts(*LATERAL), lambda l: _level(st, l) <= -0.10)
        return lets([groups, low_inferior, low_lateral], lambda g, i, l: outcome(st, g, i, l))

    def outcome(st: Column, groups: Column, inferior: Column, lateral: Column) -> Column:
        names = F.transform(groups, lambda g: g["territory"])
        known, any_group = F.size(st) > 0, F.size(groups) > 0
        return F.struct(
            F.when(~known, "unavailable")
            .when(any_group, "possible STEMI pattern - research criteria")
            .otherwise("No STEMI criteria met by research rules")
            .alias("status"),
            F.when(~known, 0.0)
            .when(
                any_group,
                F.least(F.lit(96.0), 72.0 + F.size(groups) * 8.0 + F.when(inferior | lateral, 8.0).otherwise(0.0)),
            )
            .otherwise(35.0)
            .alias("confidence"),
            F.when(~known, "unavailable")
            .when(~any_group, "none suggested")
            .when(F.array_contains(names, "anterior") | F.array_contains(names, "septal"), "LAD")
            .when(F.array_contains(names, "inferior") & lateral, "RCA")
            .when(F.array_contains(names, "lateral"), "LCX")
            .otherwise("uncertain")
            .alias("culprit_vessel"),
            names.alias("territories"),
            F.when(~known, texts("ST measurements unavailable."))
            .when(~any_group, texts("No contiguous lead group meets ST-elevation thresholds."))
            .otherwise(
                F.concat(
                    F.transform(
                        groups,
                        lambda g: F.concat(
                            F.lit("ST elevation meets threshold in contiguous "),
                            g["territory"],
                            F.lit(" leads: "),
                            F.array_join(g["leads"], ", "),
                            F.lit("."),
                        ),
                    ),
                    present_only(
                        F.when(inferior, "Reciprocal inferior ST depression flag present."),
                        F.when(lateral, "Reciprocal lateral ST depression flag present."),
                    ),
                )
            )
            .alias("reasons"),
        )

    return lets([F.coalesce(levels, F.create_map().cast("map<string,double>")), age, sex], run)


def _territories(groups: dict[str, list[str]], test, basis: str) -> Column:
    found = F.array(*[
        F.struct(
            F.lit(name).alias("territory"),
            F.filter(texts(*leads), test).alias("leads"),
            F.lit(basis).alias("basis"),
        )
        for name, leads in groups.items()
    ])
    return F.filter(found, lambda g: F.size(g["leads"]) >= 2)


def ischemia(levels: Column) -> Column:
    """Territories with at least two leads depressed by 0.10 mV or more."""
    return let(levels, lambda st: _territories(ISCHEMIA_TERRITORIES, lambda l: _level(st, l) <= -0.10, ISCHEMIA_BASIS))


def infarction(q_leads: Column) -> Column:
    """Territories with at least two leads that show a pathologic Q wave."""
    return let(
        q_leads, lambda q: _territories(INFARCT_TERRITORIES, lambda l: F.array_contains(q, l), INFARCT_BASIS)
    )


# --- rhythm ------------------------------------------------------------------------------------


def rhythm_class(
    heart_rate: Column, cv_rounded: Column, p_presence: Column, pr_rounded: Column, fib_power: Column, qrs_rounded: Column
) -> Column:
    """First matching rhythm rule, plus the additional candidates."""

    def run(rate: Column, cv: Column, p: Column, pr: Column, fib: Column, wide: Column) -> Column:
        def rule(label: str, confidence: Column | float, reason: str) -> Column:
            value = F.lit(confidence) if isinstance(confidence, float) else confidence
            return F.struct(F.lit(label).alias("rhythm"), F.bround(value, 1).alias("confidence"), texts(reason).alias("reasons"))

        chosen = (
            F.when(
                (p >= 70.0) & (cv < 0.08) & rate.between(50, 100),
                rule("sinus rhythm", 88.0, "P waves are present before most QRS complexes with regular RR intervals and rate 50-100 bpm."),
            )
            .when(
                (p >= 70.0) & (cv >= 0.08),
                rule("sinus arrhythmia", 74.0, "P waves are present but RR variability is increased."),
            )
            .when(
                (cv >= 0.16) & (p < 55.0) & (fib >= 0.45),
                rule(
                    "atrial fibrillation pattern",
                    F.least(F.lit(95.0), 72.0 + cv * 60.0 + fib * 10.0),
                    "Irregular RR intervals, low P-wave presence, and fibrillatory baseline power support AF pattern.",
                ),
            )
            .when(
                (p < 55.0) & rate.between(240, 340),
                rule("atrial flutter pattern", 58.0, "Very rapid atrial-rate surrogate pattern; flutter-wave confirmation requires better atrial delineation."),
            )
            .when((rate > 150) & (cv < 0.10) & ~wide, rule("SVT pattern", 66.0, "Regular narrow-complex tachycardia pattern."))
            .when(
                (p < 45.0) & rate.between(40, 100) & ~wide,
                rule("junctional rhythm pattern", 52.0, "P waves are often absent with a narrow QRS and non-tachycardic rate."),
            )
            .when(
                wide & (rate >= 100),
                rule("ventricular rhythm pattern", 55.0, "Wide-complex rhythm pattern; ventricular rhythm requires expert confirmation."),
            )
            .otherwise(rule("undetermined rhythm", 35.0, "Available features do not meet a specific rhythm rule with high confidence."))
        )
        block = F.when(
            pr > 200.0,
            F.struct(
                F.lit("first-degree AV block pattern").alias("rhythm"),
                F.lit(70.0).alias("confidence"),
                F.array(F.concat(F.lit("PR interval is prolonged at "), pr.cast("string"), F.lit(" ms."))).alias("reasons"),
            ),
        )
        pacemaker = rule("pacemaker rhythm", 0.0, "Pacemaker spike detection is not yet validated in this prototype.")
        return let(
            chosen,
            lambda c: F.struct(
                c["rhythm"].alias("primary"),
                c["confidence"].alias("confidence"),
                c["reasons"].alias("reasons"),
                present_only(c, block, pacemaker).alias("candidates"),
            ),
        )

    return lets(
        [heart_rate, F.coalesce(cv_rounded, F.lit(0.0)), p_presence, pr_rounded, fib_power, _holds(qrs_rounded >= 120.0)], run
    )


def af_gate(cv: Column, irregularity: Column, p_presence: Column, fib_power: Column, sqi: Column) -> Column:
    high = (cv >= 0.18) | (irregularity >= 62.0)
    return high & (p_presence < 55.0) & (fib_power >= 0.55) & (sqi >= 50.0)


def af_score(
    cv: Column, irregularity: Column, rmssd: Column, pnn50: Column, p_presence: Column, p_missing: Column,
    pr_consistency: Column, fib_power: Column, sqi: Column,
) -> Column:
    """Struct: score after its caps, the gate, and the sentences of the caps that applied."""
    zero = F.lit(0.0)
    high = (cv >= 0.18) | (irregularity >= 62.0)
    gate = af_gate(cv, irregularity, p_presence, fib_power, sqi)
    raw = (
        irregularity * 0.28
        + F.least(F.lit(30.0), cv * 110.0)
        + F.least(F.lit(18.0), rmssd / 5.0)
        + F.least(F.lit(14.0), pnn50 * 0.35)
        + F.greatest(zero, 70.0 - p_presence) * 0.28
        + p_missing * 0.18
        + fib_power * 22.0
        - F.greatest(zero, p_presence - 70.0) * 0.45
        - F.greatest(zero, pr_consistency - 70.0) * 0.18
        - F.when(cv < 0.12, 14.0).otherwise(0.0)
        - F.when(sqi < 50.0, 10.0).otherwise(0.0)
        + F.when((p_presence < 40.0) & high, 14.0).otherwise(0.0)
        + F.when(gate, 10.0).otherwise(0.0)
    )

    def caps(start: Column, passed: Column) -> Column:
        sinus = (p_presence > 70.0) & (cv < 0.12)
        low = sqi < 50.0
        moderate = (sqi >= 50.0) & (sqi <= 70.0) & ~passed
        capped = F.least(
            start,
            F.when(sinus, 39.0).otherwise(100.0),
            F.when(low, 50.0).when(moderate, 69.0).otherwise(100.0),
        )
        return let(
            capped,
            lambda s: F.struct(
                F.when((s >= 70.0) & ~passed, 69.0).otherwise(s).alias("af_score"),
                passed.alias("af_gate_passed"),
                present_only(
                    F.when(sinus, "Sinus rhythm pattern likely: P-wave presence is >70% and RR coefficient of variation is <0.12."),
                    F.when(low, "Low confidence due to signal quality: signal quality index is <50."),
                    F.when(moderate, "Moderate signal quality and incomplete AF gate limit high-confidence rhythm labeling."),
                    F.when(
                        (s >= 70.0) & ~passed,
                        "High AF likelihood requires RR irregularity, P-wave absence, fibrillatory activity, and acceptable signal quality.",
                    ),
                ).alias("cap_reasons"),
            ),
        )

    return lets([F.bround(clamp(raw, 0.0, 100.0), 1), gate], caps)


def af_text(score: Column, gate: Column) -> Column:
    return (
        F.when((score >= 70.0) & gate, "Pattern compatible with AF or irregular atrial rhythm")
        .when(score >= 40.0, "Indeterminate atrial rhythm")
        .otherwise("AF unlikely / sinus rhythm pattern likely")
    )


def p_unreliable(p_presence: Column, beats: Column) -> Column:
    return (p_presence == 0.0) & (beats < 5)


def confidence(sqi: Column, features: Column, imputed: Column, af: Column, model: Column, unreliable: Column) -> Column:
    """5 to 96, from quality, completeness, agreement with the model and distance from the cut-offs."""
    complete = (features - imputed) / F.greatest(F.lit(1), features) * 100.0
    away = F.least(F.abs(af - 40.0), F.abs(af - 70.0))
    return F.bround(
        clamp(
            sqi * 0.36
            + complete * 0.22
            + (100.0 - F.abs(af - model)) * 0.16
            + F.least(away, F.lit(30.0)) * 0.42
            - imputed * 6.0
            - F.when(unreliable, 15.0).otherwise(0.0),
            5.0,
            96.0,
        ),
        1,
    )


def af_reasons(
    gate: Column, cap_reasons: Column, p_presence: Column, cv: Column, sqi: Column, unreliable: Column, imputed: Column
) -> Column:
    found = F.concat(
        present_only(F.when(gate, "AF gate passed: RR irregularity, P-wave absence, fibrillatory activity, and acceptable SQI are present.")),
        cap_reasons,
        present_only(
            F.when(p_presence > 70.0, "Visible P waves before most QRS complexes reduce AF probability."),
            F.when((cv < 0.12) & (p_presence > 70.0), "Regular RR intervals with visible P waves are more compatible with sinus rhythm."),
            F.when(sqi <= 70.0, "Signal quality limits confidence; high-confidence AF labeling is blocked."),
            F.when(unreliable, "P-wave detection is unreliable; confidence was lowered instead of forcing AF."),
            F.when(imputed > 0, "One or more PTB-XL model inputs were unavailable and imputed; model confidence was lowered."),
        ),
    )
    return let(
        found,
        lambda f: F.concat(
            F.when(F.size(f) > 0, f).otherwise(
                texts("Digital WFDB waveform was parsed and analyzed with conservative AF gating.")
            ),
            texts(DISCLAIMER),
        ),
    )


def imputation_notes(imputed: Column) -> Column:
    """A sentence per imputed input; ``imputed`` is ``ARRAY<STRUCT<feature, source>>``."""
    return F.transform(
        imputed,
        lambda i: F.concat(
            F.when(i["feature"] == "ptfv1_mv_ms", "PTFV1").otherwise(i["feature"]),
            F.lit(" unavailable — imputed using "),
            i["source"],
            F.lit("; confidence reduced."),
        ),
    )


def warnings_list(sqi: Column, notes: Column) -> Column:
    return F.concat(
        present_only(F.when(sqi < 50.0, "Signal quality index is <50; analysis is limited and repeat ECG is recommended.")),
        notes,
    )


def limitations_list(notes: Column) -> Column:
    return F.concat(
        texts(
            "This model detects current atrial abnormality/remodeling.",
            "It does not predict future AF without longitudinal follow-up data.",
            DISCLAIMER,
        ),
        notes,
    )


def hf_points(
    qrs_rounded: Column, fridericia_rounded: Column, heart_rate: Column, lvh_status: Column, model_score: Column
) -> Column:
    """Struct: points, category and the reasons in order."""
    parts = [
        (_holds(qrs_rounded >= 120.0), 2, "QRS duration is prolonged."),
        (_holds(fridericia_rounded >= 460.0), 1, "QTc is prolonged."),
        (_holds(heart_rate > 100.0), 1, "Heart rate is elevated."),
        (_holds(lvh_status == "LVH criteria met"), 2, "LVH criteria are met."),
        (_holds(model_score >= 70.0), 1, "PTB-XL atrial remodeling probability is high."),
    ]
    points = sum((F.when(c, p).otherwise(0) for c, p, _ in parts[1:]), F.when(parts[0][0], parts[0][1]).otherwise(0))
    reasons = present_only(*[F.when(c, text) for c, _, text in parts])
    return lets(
        [points, reasons],
        lambda n, r: F.struct(
            F.when(n <= 1, "low").when(n <= 3, "intermediate").otherwise("high").alias("category"),
            n.alias("score_points"),
            F.when(F.size(r) > 0, r).otherwise(texts("No major ECG HF-risk flags in available features.")).alias("reasons"),
        ),
    )


def _number(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit(0.0)).cast("string"), F.lit("unavailable"))


def text_report(
    primary: Column, heart_rate: Column, axis_class: Column, stemi_status: Column, af: Column, hf_category: Column,
    flags: Column, chamber_summary: Column,
) -> Column:
    sentence = F.concat(F.upper(F.substring(primary, 1, 1)), F.lower(F.substr(primary, F.lit(2))), F.lit("."))
    return F.concat_ws(
        "\n",
        F.lit("FINAL ECG INTERPRETATION"),
        sentence,
        F.concat(F.lit("Heart rate "), _number(heart_rate), F.lit(" bpm.")),
        F.concat(F.lit("QRS axis: "), axis_class, F.lit(".")),
        F.when(stemi_status.startswith("No STEMI"), F.lit("No STEMI criteria met by research rules.")).otherwise(stemi_status),
        F.concat(F.lit("AF probability: "), af.cast("string"), F.lit("%.")),
        F.concat(F.lit("Heart failure probability: "), hf_category, F.lit(".")),
        F.when(F.size(flags) > 0, F.concat(F.lit("Interval flags: "), F.array_join(flags, ", "), F.lit("."))),
        F.when(
            F.size(chamber_summary) > 0,
            F.concat(F.lit("Chamber findings: "), F.array_join(chamber_summary, "; "), F.lit(".")),
        ),
        F.lit("Research interpretation only. Requires physician confirmation."),
    )
