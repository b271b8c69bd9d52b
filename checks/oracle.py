"""The same results in plain SQL for DuckDB, written from joins, windows and CASE.

Record samples are rows here, not arrays, and a beat window is a range join, so that the two sides
share the input arithmetic but not the way the result is reached.
"""

from __future__ import annotations

from checks.bridges import CUTS, FEATURE_SQL, LEVEL_SQL, RULE_SQL
from signalframe.functions.rules import INFARCT_TERRITORIES, ISCHEMIA_TERRITORIES, STEMI_TERRITORIES
from signalframe.operators.dimensions import DATASETS
from signalframe.operators.evaluation import INNER_EDGES
from signalframe.schemas import FEATURES, MORPHOLOGY_CODES, RHYTHM_CODES, STANDARD_LEADS, WORKING_LEAD_ORDER
from checks.synthetic import ABSENT, GAIN, GAP, PARAMETERS, ROUNDING, SHIFT, STEPS

ORACLE: dict[str, str] = {}


def r6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {digits}) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


def columns(table: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in table.items())


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- interval series ---------------------------------------------------------------------------

RR = """
WITH t AS (
  SELECT CAST(user_id AS VARCHAR) AS record_id, event_id,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0 AS rr_ms
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (
  SELECT e.record_id, e.event_id, t.rr_ms,
         t.rr_ms - lag(t.rr_ms) OVER w AS drr_ms, lag(t.rr_ms) OVER w - lag(t.rr_ms, 2) OVER w AS before
  FROM t JOIN (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id, ts FROM events) e USING (record_id, event_id)
  WINDOW w AS (PARTITION BY e.record_id ORDER BY e.ts, e.event_id)
), r AS (SELECT * FROM s WHERE rr_ms IS NOT NULL),
m AS (
  SELECT record_id, count(*) AS n, avg(rr_ms) AS mean_rr, stddev_pop(rr_ms) AS sd, coalesce(sqrt(avg(drr_ms * drr_ms)), 0) AS rmssd,
         coalesce(avg(CASE WHEN abs(drr_ms) > 50 THEN 100.0 WHEN drr_ms IS NOT NULL THEN 0.0 END), 0) AS pnn50,
         stddev_pop(drr_ms) AS sdd, count(drr_ms) AS nd, min(rr_ms) AS lo, max(rr_ms) AS hi, min(drr_ms) AS dlo, max(drr_ms) AS dhi,
         sum(CASE WHEN drr_ms * before < 0 THEN 1 ELSE 0 END) AS turns
  FROM r GROUP BY record_id
), v AS (
  SELECT *, sd / mean_rr AS cv, CASE WHEN n > 2 THEN turns / (n - 2) ELSE 0 END AS tpr,
         CASE WHEN n >= 2 THEN sqrt(0.5) * sdd ELSE 0 END AS sd1,
         CASE WHEN n >= 2 THEN sqrt(greatest(0, 2 * sd * sd - 0.5 * sdd * sdd)) ELSE 0 END AS sd2
  FROM m
), dh AS (
  SELECT r.record_id, least(floor((drr_ms / sdd - dlo / sdd) / (dhi / sdd - dlo / sdd) * 8), 7) AS slot,
         any_value(dhi / sdd - dlo / sdd) / 8 AS width, any_value(nd) AS nd, count(*) AS h
  FROM r JOIN m USING (record_id) WHERE n >= 5 AND sdd > 0 AND drr_ms IS NOT NULL GROUP BY 1, 2
), de AS (
  SELECT record_id, -sum(h / (nd * width) * ln(h / (nd * width))) / 10 AS e FROM dh GROUP BY 1
), sh AS (
  SELECT r.record_id, least(floor((rr_ms - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)
           / CASE WHEN lo = hi THEN 1 ELSE hi - lo END * least(12, greatest(4, n // 2))), least(12, greatest(4, n // 2)) - 1) AS slot,
         any_value(n) AS n, count(*) AS h
  FROM r JOIN m USING (record_id) WHERE n >= 5 GROUP BY 1, 2
), se AS (SELECT record_id, -sum(h / n * log2(h / n)) AS e FROM sh GROUP BY 1),
f AS (
  SELECT v.*, coalesce(de.e, 0) AS sampen, coalesce(se.e, 0) AS shannon
  FROM v LEFT JOIN de USING (record_id) LEFT JOIN se USING (record_id)
)
"""
ORACLE["A3_rr_summary"] = RR + """
SELECT record_id, round_even(mean_rr, 1) AS mean_rr_ms, round_even(sd, 1) AS rr_sd_ms, round_even(cv, 3) AS rr_cv,
       round_even(rmssd, 1) AS rmssd_ms, round_even(60000.0 / mean_rr, 1) AS heart_rate_bpm,
       CASE WHEN cv < 0.08 THEN 'regular' WHEN cv < 0.16 THEN 'mildly irregular' ELSE 'irregular' END AS regularity FROM v"""
ORACLE["A4_rr_variability"] = RR + f"""
SELECT record_id, n AS rr_count, {r6('mean_rr AS rr_mean_ms', 'cv AS rr_cv', 'sd AS sdnn_ms', 'rmssd AS rmssd_ms', 'pnn50 AS pnn50_percent')} FROM v"""
ORACLE["A5_rr_entropy_density"] = RR + f"SELECT record_id, n AS rr_count, {r6('sampen AS sample_entropy')} FROM f"
ORACLE["A6_rr_entropy_shannon"] = RR + f"SELECT record_id, n AS rr_count, {r6('shannon AS shannon_entropy')} FROM f"
ORACLE["A7_rr_histogram"] = RR + f"""
SELECT record_id, CAST(least(floor((rr_ms - lo) / (hi - lo) * 10), 9) AS INT) AS slot, count(*) AS n, {r6('any_value(hi - lo) AS width', digits=8)}
FROM r JOIN m USING (record_id) GROUP BY 1, 2"""
ORACLE["A8_rr_poincare"] = RR + f"SELECT record_id, {r6('sd1 AS poincare_sd1_ms', 'sd2 AS poincare_sd2_ms')} FROM v"
ORACLE["W1_rr_differences"] = RR + f"SELECT record_id, event_id, {r6('rr_ms', 'drr_ms', digits=8)} FROM r"
ORACLE["W2_rr_turning_points"] = RR + f"SELECT record_id, {r6('tpr AS turning_point_ratio')} FROM v"
ORACLE["W6_rr_irregularity_index"] = RR + f"""
SELECT record_id, {r6('least(100, cv*155 + rmssd/3.2 + pnn50*0.55 + sampen*13 + shannon*5 + tpr*18) AS rr_irregularity_index', digits=5)} FROM f"""
ORACLE["C3_rhythm_features"] = RR + f"""
SELECT record_id, n AS rr_count, {r6('mean_rr AS rr_mean_ms', 'sd AS rr_sd_ms', 'cv AS rr_cv', 'sd AS sdnn_ms', 'rmssd AS rmssd_ms',
 'pnn50 AS pnn50_percent', 'sd1 AS poincare_sd1_ms', 'sd2 AS poincare_sd2_ms', 'tpr AS turning_point_ratio', 'sampen AS sample_entropy',
 'shannon AS shannon_entropy', digits=5)} FROM f"""

# --- evaluation --------------------------------------------------------------------------------

PRED = """
WITH p AS (
  SELECT CAST(quality AS INT) AS y, (n_chars % 1000) / 1000.0 AS s, lang AS dataset, n_chars, doc_id
  FROM labels JOIN documents USING (doc_id)
), g AS (SELECT y, s, dataset FROM p UNION ALL SELECT y, s, 'overall' FROM p),
"""
METRICS = """
c AS (
  SELECT dataset, count(*) AS n, sum(y) AS pos, count(*) - sum(y) AS neg,
         count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s >= 0.5 AND y = 0) AS fp,
         count(*) FILTER (s < 0.5 AND y = 1) AS fn, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, avg((s - y) * (s - y)) AS brier
  FROM g GROUP BY dataset
), k AS (
  SELECT dataset, y, rank() OVER (PARTITION BY dataset ORDER BY s) + (count(*) OVER (PARTITION BY dataset, s) - 1) / 2.0 AS rk FROM g
), u AS (SELECT dataset, sum(rk) AS ranks FROM k WHERE y = 1 GROUP BY dataset),
m AS (
  SELECT c.*, (ranks - pos * (pos + 1) / 2.0) / (pos * neg) AS auc, tp / pos AS sens, tn / neg AS spec,
         CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS ppv, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS npv,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, (tp + tn) / n AS acc
  FROM c JOIN u USING (dataset) WHERE (pos > 0 AND neg > 0)
)
"""
ORACLE["A27_confusion_counts"] = PRED + METRICS + "SELECT dataset, tn, fp, fn, tp FROM c"
ORACLE["A28_rates"] = PRED + METRICS + f"""
SELECT dataset, {r6('acc AS accuracy', 'ppv AS precision', 'sens AS recall', 'sens AS sensitivity', 'spec AS specificity', 'f1', 'ppv', 'npv')} FROM m"""
ORACLE["A29_auc"] = PRED + METRICS + f"SELECT dataset, {r6('auc')} FROM m"
ORACLE["A30_brier"] = PRED + METRICS + f"SELECT dataset, {r6('brier AS brier_score')} FROM m"
BIN = " + ".join(f"CASE WHEN s > CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in INNER_EDGES)
ORACLE["A31_calibration_curve"] = PRED + f"""
x AS (SELECT dataset, {BIN} AS bin, s, y FROM g)
SELECT dataset, bin, count(*) AS n, {r6('avg(s) AS predicted', 'avg(y) AS observed')} FROM x GROUP BY 1, 2"""
ORACLE["A32_report_by_dataset"] = PRED + METRICS + f"""
SELECT dataset, n, {r6('auc', 'sens AS sensitivity', 'spec AS specificity', 'f1', 'ppv', 'npv', 'brier AS brier_score')}, tn, fp, fn, tp FROM m"""
ORACLE["S9_report_saved"] = PRED + METRICS + f"SELECT dataset, n, {r6('auc')}, tp FROM m"
ORACLE["U1_overall_and_parts"] = PRED + METRICS + """
SELECT dataset = 'overall' AS is_overall, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
       CAST(sum(tp) AS BIGINT) AS tp FROM c GROUP BY 1"""
ORACLE["C10_failure_by_band"] = PRED.replace("SELECT y, s, 'overall' FROM p", "SELECT y, s, 'overall' FROM p WHERE false").replace(
    "SELECT y, s, dataset FROM p", "SELECT y, s, CASE WHEN n_chars % 97 < 50 THEN 'low' WHEN n_chars % 97 <= 70 THEN 'moderate' ELSE 'acceptable' END AS dataset FROM p"
) + METRICS + f"""
SELECT dataset AS band, n, {r6('auc', 'sens AS sensitivity', 'spec AS specificity', 'f1', 'ppv', 'npv', 'brier AS brier_score')}, tn, fp, fn, tp FROM m"""
ORACLE["A34_dataset_profile"] = """
SELECT lang AS dataset, count(*) AS n_total_rows, count(quality) AS n_labeled, count(*) FILTER (quality = 1) AS n_positive,
       count(*) FILTER (quality = 0) AS n_negative FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
ORACLE["S8_predictions_read"] = f"""
SELECT CAST(quality AS INT) AS y_true, {r6('(n_chars % 1000) / 1000.0 AS y_score')}, CAST(doc_id AS VARCHAR) AS patient_id, lang AS dataset
FROM labels JOIN documents USING (doc_id)"""

# --- one-lead signals --------------------------------------------------------------------------

EMB = """
WITH x AS (
  SELECT CAST(vec_id AS VARCHAR) AS record_id, CAST(i AS INT) AS idx, CAST(embedding[i + 1] AS DOUBLE) AS mv, len(embedding) AS n
  FROM embeddings, range(64) t(i) WHERE i < len(embedding)
)
"""
ORACLE["A1_lead_quality"] = EMB + f""", d AS (
  SELECT record_id, mv, mv - lag(mv) OVER (PARTITION BY record_id ORDER BY idx) AS dx FROM x
), s AS (
  SELECT record_id, quantile_cont(mv, 0.95) - quantile_cont(mv, 0.05) AS amp, stddev_pop(dx) AS noise FROM d GROUP BY 1
) SELECT record_id, {r6('greatest(0, least(100, 100 - 1.4 * least(100, noise / CASE WHEN amp = 0 THEN 1 ELSE amp END * 100) - CASE WHEN amp < 1e-6 THEN 60 ELSE 0 END)) AS quality')} FROM s"""
ORACLE["P4_centred_samples"] = EMB + f"SELECT record_id, idx, {r6('mv - median(mv) OVER (PARTITION BY record_id) AS mv')} FROM x"
ORACLE["P5_finite_ratio"] = EMB + f"SELECT record_id, {r6('count(*) FILTER (mv > -0.1) / count(*) AS finite_ratio')} FROM x GROUP BY 1"
ORACLE["P12_mean_of_present"] = EMB + f"SELECT record_id, {r6('avg(CASE WHEN mv > 0.1 THEN mv END) AS mean_mv')} FROM x GROUP BY 1"
ORACLE["P13_percentiles"] = EMB + "SELECT record_id, " + r6(
    *[f"quantile_cont(mv, {q}) AS {n}" for n, q in [("p02", 0.02), ("p05", 0.05), ("p50", 0.5), ("p92", 0.92), ("p95", 0.95), ("p98", 0.98)]]
) + " FROM x GROUP BY 1"
ORACLE["P15_preview"] = EMB + """, k AS (
  SELECT record_id, CAST(j AS INT) AS idx, mv FROM x JOIN range(40) t(j) ON x.idx = CAST(trunc(j * (n - 1) / 39.0) AS INT)
), m AS (SELECT record_id, median(mv) AS med FROM k GROUP BY 1),
s AS (SELECT record_id, max(abs(mv - med)) AS top FROM k JOIN m USING (record_id) GROUP BY 1)
SELECT record_id, idx, round_even((mv - med) / CASE WHEN top = 0 THEN 1 ELSE top END, 4) + 0.0 AS value FROM k JOIN m USING (record_id) JOIN s USING (record_id)"""
ORACLE["P16_clamped"] = f"SELECT o_orderkey, {r6('greatest(0, least(100, o_totalprice / 1000.0 - 100.0)) AS value')} FROM orders"
ORACLE["W3_moving_average"] = EMB + f"""
SELECT record_id, idx, {r6('sum(mv) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS even', 'sum(mv) OVER (w ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) / 19 AS odd')}
FROM x WINDOW w AS (PARTITION BY record_id ORDER BY idx)"""


def dft(samples: str, n: int, fs: float, reported: str) -> str:
    """Power of each bin of 1 to 20 Hz by explicit sums over the detrended samples ``(record_id, idx, v)``."""
    return f"""{samples}, w AS MATERIALIZED (
  SELECT j, cos(2 * pi() * j / {n}) AS c, sin(2 * pi() * j / {n}) AS s FROM range({n}) t(j)
), b AS (SELECT k FROM range({n // 2 + 1}) t(k) WHERE k * {fs} / {n} BETWEEN 1 AND 20),
pw AS (
  SELECT record_id, k, sum(v * w.c) * sum(v * w.c) + sum(v * w.s) * sum(v * w.s) AS power
  FROM dt, b JOIN w ON w.j = (b.k * dt.idx) % {n} GROUP BY 1, 2
), sm AS (
  SELECT record_id, sum(power) AS total_power, sum(power) FILTER (k * {fs} / {n} BETWEEN 4 AND 9) AS f_power FROM pw GROUP BY 1
), dm AS (
  SELECT record_id, k * {fs} / {n} AS dominant_hz FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY power DESC, k) AS rn FROM pw WHERE k * {fs} / {n} BETWEEN 4 AND 9) WHERE rn = 1
) {reported}"""


ORACLE["A24_band_power"] = dft(
    EMB + """, dt AS (
  SELECT record_id, idx, mv - sum(mv) OVER (PARTITION BY record_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) / 19 AS v FROM x
)""", 64, 32.0, f"SELECT record_id, {r6('f_power', 'total_power', 'dominant_hz')} FROM sm JOIN dm USING (record_id)")
ORACLE["D1_samples_and_back"] = EMB + f"""
SELECT record_id, 'MLII' AS lead, count(*) AS n, {r6('arg_min(mv, idx) AS first_mv', 'arg_max(mv, idx) AS last_mv')} FROM x GROUP BY 1"""

# --- synthetic records -------------------------------------------------------------------------

BEAT = (
    "p_amp * exp(-((j + 16.0) * (j + 16.0)) / 8.0) + q_amp * exp(-((j + 3.0) * (j + 3.0)) / 2.0)"
    " + exp(-(j * j * 1.0) / (2.0 * r_sigma * r_sigma)) - 0.2 * exp(-((j - 3.0) * (j - 3.0)) / 2.0)"
    " + t_amp * exp(-((j - 28.0) * (j - 28.0)) / 32.0)"
)
BASE = f"""
WITH RECURSIVE par AS MATERIALIZED (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS record_id, c_mktsegment AS dataset, * EXCLUDE (c_custkey, c_mktsegment)
  FROM (SELECT c_custkey, c_mktsegment, {columns(PARAMETERS)} FROM (SELECT *, c_custkey AS k FROM customer))
), truth AS MATERIALIZED (
  SELECT k, b AS beat_no, 50 + b * period + CASE WHEN af THEN (b * b * 17 + k * 11) % 35 - 17 ELSE 0 END AS r
  FROM par, range(16) t(b) WHERE 50 + b * period + CASE WHEN af THEN (b * b * 17 + k * 11) % 35 - 17 ELSE 0 END < 960
), shape AS (
  SELECT k, j, {BEAT} AS beat, exp(-((j - 10.0) * (j - 10.0)) / 18.0) AS seg FROM par, range(-40, 71) t(j)
), waves AS (
  SELECT k, r + j AS i, sum(beat) AS beat, sum(seg) AS seg FROM truth JOIN shape USING (k) GROUP BY 1, 2
), base AS MATERIALIZED (
  SELECT par.k, CAST(i AS INT) AS idx, coalesce(beat, 0.0) AS beat, coalesce(seg, 0.0) AS seg,
         fwave * sin(0.12 * pi() * i) + drift * sin(0.006 * pi() * i) + noise * (((i * 7919 + k * 104729) % 1000) / 1000.0 - 0.5) AS bg
  FROM par CROSS JOIN range(1000) t(i) LEFT JOIN waves USING (k, i)
)
"""


def lead(name: str, where: str = "true") -> str:
    """Rows ``k, lead, idx, mv`` of one lead of the records that hold it."""
    value = f"floor(({GAIN[name]}) * (beat + bg) * {STEPS} + ({SHIFT[name]}) * seg * {STEPS} + {ROUNDING}) / {STEPS}"
    if name == "V5":
        value = f"CASE WHEN {GAP} THEN NULL ELSE {value} END"
    return f"SELECT k, '{name}' AS lead, idx, {value} AS mv FROM base WHERE NOT ({ABSENT.get(name, 'false')}) AND ({where})"


def leads(*names: str) -> str:
    return " UNION ALL ".join(lead(n) for n in names)


def absent_all(names: list[str]) -> str:
    return " AND ".join(f"({ABSENT.get(n, 'false')})" for n in names) or "true"


QUALITY = """
{p}med AS (SELECT k, lead, median(mv) AS m, count(mv) / count(*) AS share FROM {src} GROUP BY 1, 2),
{p}fil AS (
  SELECT k, lead, share, coalesce(mv, m) AS v, coalesce(mv, m) - lag(coalesce(mv, m)) OVER (PARTITION BY k, lead ORDER BY idx) AS dx
  FROM {src} JOIN {p}med USING (k, lead)
), {p}amp AS (
  SELECT k, lead, any_value(share) AS share, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS amp, stddev_pop(dx) AS noise FROM {p}fil GROUP BY 1, 2
), {p}qual AS MATERIALIZED (
  SELECT k, lead, greatest(0, least(100, share * 100 - least(100, noise / CASE WHEN amp = 0 THEN 1 ELSE amp END * 100) * 1.4
         - CASE WHEN amp < 1e-6 THEN 60 ELSE 0 END)) AS quality FROM {p}amp
)
"""
# The working lead: by preference, else by quality.
PREFERRED = [l for l in WORKING_LEAD_ORDER if l in STANDARD_LEADS]
OTHERS = [l for l in STANDARD_LEADS if l not in PREFERRED]
CANDIDATES = " UNION ALL ".join(
    lead(name, absent_all(PREFERRED[:at])) for at, name in enumerate(PREFERRED)
    if not any(n not in ABSENT for n in PREFERRED[:at])
)
RESERVE = " UNION ALL ".join(lead(n, absent_all(PREFERRED)) for n in OTHERS)
WORK = BASE + f""", reserve AS MATERIALIZED ({RESERVE}), {QUALITY.format(p='r_', src='reserve')},
best AS (
  SELECT k, lead FROM (SELECT k, lead, row_number() OVER (PARTITION BY k ORDER BY quality DESC, lead) AS rn FROM r_qual) WHERE rn = 1
), work AS MATERIALIZED (
  {CANDIDATES} UNION ALL SELECT reserve.* FROM reserve JOIN best USING (k, lead)
)
"""
PEAKS = WORK + """, wmed AS (SELECT k, median(mv) AS m FROM work GROUP BY 1),
cen AS MATERIALIZED (SELECT k, idx, mv - m AS c, mv FROM work JOIN wmed USING (k)),
slope AS (SELECT k, idx, CASE WHEN idx = 0 THEN c * 0 ELSE c - lag(c) OVER (PARTITION BY k ORDER BY idx) END AS d FROM cen),
energy AS MATERIALIZED (
  SELECT k, idx, CASE WHEN count(d) OVER w = count(*) OVER w THEN sum(d * d) OVER w / 12 END AS e
  FROM slope WINDOW w AS (PARTITION BY k ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
), lim AS (SELECT k, avg(e) + 1.6 * stddev_pop(e) AS lim FROM energy GROUP BY 1),
cand AS (SELECT k, idx FROM energy JOIN lim USING (k) WHERE e > lim),
near AS (
  SELECT cand.k, cand.idx, cen.idx AS pos, row_number() OVER (PARTITION BY cand.k, cand.idx ORDER BY abs(c) DESC NULLS LAST, cen.idx) AS rn
  FROM cand JOIN cen ON cen.k = cand.k AND cen.idx >= cand.idx - 8 AND cen.idx < cand.idx + 8
), local AS MATERIALIZED (SELECT k, idx, pos FROM near WHERE rn = 1),
walk AS (
  SELECT k, -25 AS last FROM par
  UNION ALL
  SELECT walk.k, arg_min(local.pos, local.idx) FROM walk JOIN local ON local.k = walk.k AND local.idx - walk.last >= 25 GROUP BY walk.k
), picked AS MATERIALIZED (SELECT k, last AS r FROM walk WHERE last >= 0 GROUP BY 1, 2),
peaks AS MATERIALIZED (SELECT a.k, a.r, count(b.r) AS beat_no FROM picked a LEFT JOIN picked b ON b.k = a.k AND b.r < a.r GROUP BY 1, 2)
"""
ID = "CAST(k AS VARCHAR) AS record_id"
ORACLE["P1_working_lead"] = WORK + f"SELECT {ID}, any_value(lead) AS selected_lead FROM work GROUP BY k"
ORACLE["P2_usable_leads"] = BASE + f", al AS MATERIALIZED ({leads(*STANDARD_LEADS)}), {QUALITY.format(p='a_', src='al')} SELECT {ID}, CAST(count(*) FILTER (quality >= 35) AS INT) AS usable_leads FROM a_qual GROUP BY k"
ORACLE["P3_lead_by_name"] = BASE + f", a AS ({lead('aVF')}) SELECT {ID}, CASE WHEN count(idx) > 0 THEN CAST(count(idx) AS INT) END AS n, {r6('sum(mv) AS total_mv', digits=3)} FROM par LEFT JOIN a USING (k) GROUP BY k"
ORACLE["W4_qrs_peaks"] = PEAKS + f"SELECT {ID}, r AS r_idx FROM peaks"
ORACLE["W5_first_beats"] = PEAKS + f"SELECT {ID}, beat_no, r AS r_idx FROM peaks WHERE beat_no < 12"
ORACLE["O2_distinct_sorted_peaks"] = PEAKS + f"SELECT {ID}, coalesce(string_agg(r, ',' ORDER BY r), '') AS peaks FROM par LEFT JOIN peaks USING (k) GROUP BY k"
ORACLE["O5_strongest_beat"] = PEAKS + f"SELECT {ID}, idx FROM (SELECT k, idx, row_number() OVER (PARTITION BY k ORDER BY abs(c) DESC NULLS LAST, idx) AS rn FROM cen) WHERE rn = 1"
ORACLE["D8_rr_of_records"] = PEAKS + f"SELECT * FROM (SELECT {ID}, beat_no, round((r - lag(r) OVER (PARTITION BY k ORDER BY r)) / 100.0 * 1000.0, 6) AS rr_ms FROM peaks) WHERE rr_ms IS NOT NULL"
ORACLE["C4_beat_windows"] = PEAKS + f"SELECT {ID}, beat_no, r AS r_idx, greatest(0, r - 25) AS start_idx, least(1000, r + 40) AS end_idx FROM peaks"
ORACLE["J4_window_samples"] = PEAKS + f"""
SELECT {ID}, beat_no, {r6('coalesce(sum(c), 0) AS total_mv')} FROM (SELECT cen.k, beat_no, c FROM peaks JOIN cen ON cen.k = peaks.k AND idx >= r - 8 AND idx < r + 8 WHERE beat_no < 20) GROUP BY k, beat_no"""
PWAVE = PEAKS + """, wsd AS (SELECT k, greatest(stddev_pop(c) * 0.08, 1e-6) AS lim FROM cen GROUP BY 1),
seg AS (
  SELECT p.k, beat_no, r, idx, abs(c) AS a, greatest(0, r - 25) AS lo, greatest(0, r - 12) AS hi
  FROM peaks p JOIN cen ON cen.k = p.k AND idx >= greatest(0, r - 25) AND idx < greatest(0, r - 12) WHERE greatest(0, r - 12) - greatest(0, r - 25) >= 3
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, beat_no ORDER BY a DESC NULLS LAST, idx) AS rn FROM seg) WHERE rn = 1
), got AS (
  SELECT t.k, t.beat_no, any_value(t.r - t.idx) / 100.0 * 1000.0 AS pr, any_value(t.a) AS amp,
         greatest(40, least(180, (coalesce(min(s.idx) FILTER (s.idx > t.idx AND s.a < t.a * 0.5), any_value(t.hi) - 1)
           - coalesce(max(s.idx) FILTER (s.idx < t.idx AND s.a < t.a * 0.5), any_value(t.lo))) / 100.0 * 1000.0)) AS dur
  FROM top t JOIN wsd USING (k) JOIN seg s ON s.k = t.k AND s.beat_no = t.beat_no WHERE t.a >= lim GROUP BY 1, 2
), nb AS (SELECT k, count(r) AS beats FROM par LEFT JOIN peaks USING (k) GROUP BY k),
pw AS (
  SELECT k, any_value(beats) AS beats, CASE WHEN any_value(beats) > 0 THEN count(pr) / any_value(beats) * 100.0 ELSE 0.0 END AS share,
         avg(pr) AS pr, CASE WHEN count(pr) > 1 THEN stddev_pop(pr) END AS sd, avg(dur) AS dur, avg(amp) AS amp
  FROM nb LEFT JOIN got USING (k) GROUP BY k
), pf AS (
  SELECT k, round_even(share, 1) AS p_wave_presence_ratio, round_even(pr, 1) AS pr_mean_ms, round_even(sd, 1) AS pr_sd_ms,
       CASE WHEN beats > 0 THEN round_even(greatest(0, 100 - coalesce(nullif(sd, 0), 45) * 2.2), 1) ELSE 0 END AS pr_consistency,
       round_even(dur, 1) AS p_duration_ms, round_even(amp, 4) AS p_amplitude_mv, round_even(100 - share, 1) AS missing_p_wave_percent FROM pw
)
"""
ORACLE["A9_p_wave"] = PWAVE + f"SELECT {ID}, * EXCLUDE (k) FROM pf"


def spans(name: str, left: int, right: int, share: float, count: int) -> str:
    return f""", {name}_seg AS (
  SELECT p.k, beat_no, r, idx, abs(c) AS a, max(abs(c)) OVER (PARTITION BY p.k, beat_no) AS top
  FROM peaks p JOIN cen ON cen.k = p.k AND idx >= r - {left} AND idx < r + {right}
  WHERE beat_no < {count} AND least(1000, r + {right}) - greatest(0, r - {left}) >= 3
), {name} AS (
  SELECT k, beat_no, any_value(r) AS r, min(idx) AS q_on, max(idx) AS s_off FROM {name}_seg WHERE a >= greatest(top * {share}, 1e-9) GROUP BY 1, 2
)"""


DURATION = PEAKS + spans("w", 8, 8, 0.18, 20) + ", qd AS (SELECT k, round_even(avg((s_off - q_on + 1) / 100.0 * 1000.0), 1) AS qrs_duration_ms FROM par LEFT JOIN w USING (k) GROUP BY k)"
ORACLE["A10_qrs_duration"] = DURATION + f"SELECT {ID}, qrs_duration_ms FROM qd"
BOUNDS = PEAKS + spans("bnd", 9, 11, 0.16, 30)
ORACLE["A11_qrs_bounds"] = BOUNDS + f"SELECT {ID}, q_on, r AS r_idx, s_off FROM bnd"
QT = BOUNDS + """, num AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY beat_no) AS bn FROM bnd),
tw AS (
  SELECT n.k, beat_no, r, q_on, idx, c, row_number() OVER (PARTITION BY n.k, beat_no ORDER BY abs(c) DESC NULLS LAST, idx) AS rn
  FROM num n JOIN cen ON cen.k = n.k AND idx >= r + 12 AND idx < r + 52 WHERE bn <= 12 AND least(1000, r + 52) > least(1000, r + 12) + 5
), tp AS (SELECT k, beat_no, r, q_on, idx AS tpk, c AS tc FROM tw WHERE rn = 1),
lv AS (
  SELECT tp.k, tp.beat_no, any_value(tp.r) AS r, any_value(q_on) AS q_on, any_value(tpk) AS tpk, any_value(tc) AS tc,
         CASE WHEN any_value(q_on) > 0 THEN median(cen.c) ELSE 0 END AS lvl
  FROM tp LEFT JOIN cen ON cen.k = tp.k AND cen.idx >= greatest(0, tp.q_on - 8) AND cen.idx < tp.q_on GROUP BY 1, 2
), te AS (
  SELECT lv.k, lv.beat_no, min(cen.idx - lv.q_on) / 100.0 * 1000.0 AS qt
  FROM lv JOIN cen ON cen.k = lv.k AND cen.idx >= tpk AND cen.idx < lv.r + 52 WHERE abs(cen.c - lvl) <= greatest(abs(tc - lvl) * 0.15, 1e-6) GROUP BY 1, 2
), qtm AS (SELECT k, avg(qt) AS qt FROM te GROUP BY 1),
rrm AS (
  SELECT k, round_even(avg(d), 1) AS rr FROM (SELECT k, (r - lag(r) OVER (PARTITION BY k ORDER BY r)) / 100.0 * 1000.0 AS d FROM peaks) GROUP BY 1
)
"""


def is_sex(kind: str) -> str:
    words = {"male": "'male', 'm', '1'", "female": "'female', 'f', '0'"}[kind]
    return f"coalesce(lower(trim(sex)) IN ({words}), false)"


QT_REPORT = f"""
SELECT {{key}}, round_even(qt, 1) AS qt_ms, round_even(qt / sqrt(rr / 1000), 1) AS qtc_bazett_ms,
       round_even(qt / pow(rr / 1000, 1.0 / 3.0), 1) AS qtc_fridericia_ms,
       CASE WHEN qt IS NULL THEN 'unavailable' WHEN qt / pow(rr / 1000, 1.0 / 3.0) >= lim THEN 'flagged' ELSE 'not flagged' END AS prolonged_qtc,
       CASE WHEN qt IS NOT NULL THEN lim END AS sex_specific_threshold_ms
FROM (SELECT {{keycol}}, CASE WHEN qt IS NOT NULL AND rr IS NOT NULL AND rr <> 0 THEN qt END AS qt, nullif(rr, 0) AS rr,
             CASE WHEN {is_sex('female')} THEN 470.0::DOUBLE WHEN {is_sex('male')} THEN 450.0 ELSE 460.0 END AS lim FROM {{src}})"""
ORACLE["A12_qt_qtc"] = QT + QT_REPORT.format(key=ID, keycol="k", src="par LEFT JOIN qtm USING (k) LEFT JOIN rrm USING (k)")


def centred(name: str, *names: str) -> str:
    return f", {name}_l AS MATERIALIZED ({leads(*names)}), {name}_m AS (SELECT k, lead, median(mv) AS m FROM {name}_l GROUP BY 1, 2), {name} AS MATERIALIZED (SELECT k, lead, idx, mv, mv - m AS c FROM {name}_l JOIN {name}_m USING (k, lead))"


def band(axis: str, normal: str, left: str, right: str, extreme: str) -> str:
    return f"CASE WHEN {axis} IS NULL THEN 'unavailable' WHEN {axis} BETWEEN -30 AND 90 THEN '{normal}' WHEN {axis} >= -90 AND {axis} < -30 THEN '{left}' WHEN {axis} > 90 AND {axis} <= 180 THEN '{right}' ELSE '{extreme}' END"


HAVE = "SELECT p.k FROM par p WHERE EXISTS (SELECT 1 FROM ax a WHERE a.k = p.k AND lead = 'I') AND EXISTS (SELECT 1 FROM ax a WHERE a.k = p.k AND lead = 'aVF') AND EXISTS (SELECT 1 FROM peaks q WHERE q.k = p.k)"
AXES = PEAKS + centred("ax", "I", "aVF") + f""", have AS ({HAVE}),
win AS (SELECT k, lead, beat_no, max(c) + min(c) AS net FROM (
  SELECT ax.k, lead, beat_no, c FROM peaks JOIN ax ON ax.k = peaks.k AND idx >= r - 4 AND idx < r + 6 WHERE beat_no < 12) GROUP BY 1, 2, 3),
pwin AS (SELECT k, lead, beat_no, sum(c) AS area FROM (
  SELECT ax.k, lead, beat_no, c FROM peaks JOIN ax ON ax.k = peaks.k AND idx >= greatest(0, r - 25) AND idx < r - 12 WHERE beat_no < 12) GROUP BY 1, 2, 3),
twin AS (SELECT k, lead, beat_no, sum(c) AS area FROM (
  SELECT ax.k, lead, beat_no, c FROM peaks JOIN ax ON ax.k = peaks.k AND idx >= r + 14 AND idx < r + 42 WHERE beat_no < 12) GROUP BY 1, 2, 3),
qa AS (SELECT have.k, coalesce(avg(net) FILTER (lead = 'I'), 0) AS i, coalesce(avg(net) FILTER (lead = 'aVF'), 0) AS f FROM have LEFT JOIN win USING (k) GROUP BY 1),
pa AS (SELECT have.k, coalesce(avg(area) FILTER (lead = 'I'), 0) AS i, coalesce(avg(area) FILTER (lead = 'aVF'), 0) AS f FROM have LEFT JOIN pwin USING (k) GROUP BY 1),
ta AS (SELECT have.k, coalesce(avg(area) FILTER (lead = 'I'), 0) AS i, coalesce(avg(area) FILTER (lead = 'aVF'), 0) AS f FROM have LEFT JOIN twin USING (k) GROUP BY 1),
axs AS (SELECT par.k, degrees(atan2(qa.f, qa.i)) AS q, degrees(atan2(pa.f, pa.i)) AS p, degrees(atan2(ta.f, ta.i)) AS t
  FROM par LEFT JOIN qa USING (k) LEFT JOIN pa USING (k) LEFT JOIN ta USING (k))
"""
ORACLE["A14_qrs_axis"] = AXES + f"SELECT {ID}, round_even(q, 1) AS axis_deg, {band('q', 'normal axis', 'left axis deviation', 'right axis deviation', 'extreme axis')} AS classification FROM axs"
WAVE_LABELS = ("normal", "left axis deviation", "right axis deviation", "extreme axis deviation")
ORACLE["A15_p_and_t_axis"] = AXES + f"SELECT {ID}, round_even(p, 1) AS p_axis_deg, {band('p', *WAVE_LABELS)} AS p_class, round_even(t, 1) AS t_axis_deg, {band('t', *WAVE_LABELS)} AS t_class FROM axs"
ALL12 = PEAKS + centred("al", *STANDARD_LEADS)
ST = ALL12 + """, bl AS (
  SELECT al.k, lead, beat_no, median(c) AS lvl FROM peaks JOIN al ON al.k = peaks.k AND idx >= greatest(0, r - 20) AND idx < greatest(0, r - 8) WHERE beat_no < 12 GROUP BY 1, 2, 3
), st AS (
  SELECT k, lead, round_even(avg(c - lvl), 3) AS st_level_mv FROM (
    SELECT bl.k, bl.lead, al.c, lvl FROM bl JOIN peaks USING (k, beat_no) JOIN al ON al.k = bl.k AND al.lead = bl.lead AND al.idx = least(999, r + 8))
  GROUP BY 1, 2 HAVING avg(c - lvl) IS NOT NULL
)
"""
ORACLE["A16_st_levels"] = ST + f"SELECT {ID}, lead, st_level_mv FROM st"


def territory_rows(groups: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{t}', {i}, '{l}')" for t, ls in groups.items() for i, l in enumerate(ls))
    return f"(VALUES {rows}) AS terr(territory, position, lead)"


ORACLE["A25_territories"] = ST + f"""
SELECT {ID}, territory, CAST(count(*) AS INT) AS lead_count, string_agg(lead, ', ' ORDER BY position) AS leads
FROM st JOIN {territory_rows(ISCHEMIA_TERRITORIES)} USING (lead) WHERE st_level_mv <= -0.10 GROUP BY k, territory HAVING count(*) >= 2"""
ORACLE["J5_beats_by_lead"] = PEAKS + f"""
, held AS ({' UNION ALL '.join(f"SELECT k, '{l}' AS lead FROM par WHERE NOT ({ABSENT.get(l, 'false')})" for l in STANDARD_LEADS)}),
nb AS (SELECT k, count(r) AS beats FROM par LEFT JOIN peaks USING (k) GROUP BY k)
SELECT lead, count(*) AS records, CAST(sum(beats) AS BIGINT) AS beats FROM held JOIN nb USING (k) GROUP BY 1"""
ORACLE["J8_sample_at_index"] = PEAKS + f"SELECT {ID.replace('k AS', 'peaks.k AS')}, beat_no, {r6('mv')} FROM peaks JOIN cen ON cen.k = peaks.k AND cen.idx = r"


def lvh_sql(key: str, src: str) -> str:
    return f"""
SELECT {key}, CASE WHEN coalesce(sok >= 3.5, false) OR coalesce(cor >= lim, false) THEN 'LVH criteria met'
            WHEN sok IS NOT NULL OR cor IS NOT NULL THEN 'LVH criteria not met' ELSE 'unavailable' END AS status,
       round_even(sok, 2) AS sokolow_lyon_mv, round_even(cor, 2) AS cornell_mv, lim AS cornell_threshold_mv
FROM (SELECT *, CASE WHEN p2_v1 IS NOT NULL AND (swing_v5 IS NOT NULL OR swing_v6 IS NOT NULL) THEN abs(p2_v1) + greatest(coalesce(swing_v5, 0), coalesce(swing_v6, 0)) END AS sok,
             CASE WHEN swing_avl IS NOT NULL AND p2_v3 IS NOT NULL THEN swing_avl + abs(p2_v3) END AS cor,
             CASE WHEN {is_sex('female')} THEN 2.0::DOUBLE ELSE 2.8 END AS lim FROM {src})"""


ORACLE["A17_lvh"] = BASE + centred("vl", "aVL", "V1", "V3", "V5", "V6") + """, pc AS (
  SELECT k, lead, quantile_cont(c, 0.02) AS lo, quantile_cont(c, 0.98) AS hi FROM vl GROUP BY 1, 2
), pv AS (
  SELECT par.k, any_value(sex) AS sex, max(lo) FILTER (lead = 'V1') AS p2_v1, max(lo) FILTER (lead = 'V3') AS p2_v3,
         max(hi - lo) FILTER (lead = 'aVL') AS swing_avl, max(hi - lo) FILTER (lead = 'V5') AS swing_v5, max(hi - lo) FILTER (lead = 'V6') AS swing_v6
  FROM par LEFT JOIN pc USING (k) GROUP BY 1
)""" + lvh_sql(ID, "pv")


def bundle_sql(key: str, src: str) -> str:
    return f"""
SELECT {key}, CASE WHEN qrs IS NULL THEN 'unavailable' WHEN qrs < 120 THEN 'No wide QRS flag'
  WHEN v1_net IS NULL OR v6_net IS NULL THEN 'Wide QRS flag; BBB morphology unavailable'
  WHEN v1_net > 0 AND v6_net < 0 THEN 'RBBB-like morphology flag - research' WHEN v1_net < 0 AND v6_net > 0 THEN 'LBBB-like morphology flag - research'
  ELSE 'Wide QRS flag; nonspecific morphology' END AS status FROM {src}"""


ORACLE["A18_bundle_branch"] = DURATION + f""", b6 AS ({leads('V1', 'V6')}),
nt AS (SELECT k, lead, quantile_cont(mv, 0.95) + quantile_cont(mv, 0.05) AS net FROM b6 GROUP BY 1, 2),
pv AS (SELECT qd.k, any_value(qrs_duration_ms) AS qrs, max(net) FILTER (lead = 'V1') AS v1_net, max(net) FILTER (lead = 'V6') AS v6_net FROM qd LEFT JOIN nt USING (k) GROUP BY 1)
""" + bundle_sql(ID, "pv")
ORACLE["A19_qrs_polarity"] = ALL12 + f""", pol AS (
  SELECT al.k, lead, beat_no, max(c) AS hi, abs(min(c)) AS lo FROM peaks JOIN al ON al.k = peaks.k AND idx >= r - 5 AND idx < r + 7 WHERE beat_no < 12 GROUP BY 1, 2, 3 HAVING max(c) IS NOT NULL)
SELECT {ID}, lead, round_even(avg(hi), 3) AS r_mv, round_even(avg(lo), 3) AS s_mv, round_even(avg(hi) - avg(lo), 3) AS net_mv FROM pol GROUP BY k, lead"""
ORACLE["A20_t_findings"] = ALL12 + f""", tb AS (
  SELECT al.k, lead, beat_no, max(c) AS hi, min(c) AS lo FROM peaks JOIN al ON al.k = peaks.k AND idx >= r + 14 AND idx < r + 42
  WHERE beat_no < 10 AND least(1000, r + 42) > least(1000, r + 14) + 5 GROUP BY 1, 2, 3
), ta AS (SELECT *, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS amp FROM tb),
tg AS (SELECT k, lead, avg(amp) AS m, count(*) FILTER (amp < 0) / count(*) AS neg, count(*) FILTER (hi > 0.12 AND lo < -0.12) AS two, count(*) AS n FROM ta GROUP BY 1, 2)
SELECT {ID}, lead, round_even(m, 3) AS t_amplitude_mv, CASE WHEN neg > 0.6 THEN 'T-wave inversion'
  WHEN abs(m) >= CASE WHEN lead LIKE 'V%' THEN 1.0 ELSE 0.5 END THEN 'tall T waves' WHEN two >= greatest(2, n // 2) THEN 'biphasic T waves'
  ELSE 'normal/undetermined' END AS status FROM tg"""
ORACLE["A21_ptfv1"] = PEAKS + centred("v1", "V1") + f""", fb AS (
  SELECT v1.k, beat_no, min(c) * count(*) / 100.0 * 1000.0 AS f FROM peaks JOIN v1 ON v1.k = peaks.k AND idx >= greatest(0, r - 25) AND idx < greatest(0, r - 12)
  WHERE beat_no < 20 AND c < 0 GROUP BY 1, 2)
SELECT {ID}, round_even(avg(f), 3) AS ptfv1_mv_ms FROM par LEFT JOIN fb USING (k) GROUP BY k"""
ORACLE["A26_pathologic_q"] = ALL12 + f""", qb AS (
  SELECT al.k, lead, beat_no, abs(min(c) FILTER (idx >= r - 5 AND idx < r - 1)) AS depth, abs(max(c) FILTER (idx >= r AND idx < r + 4)) AS height
  FROM peaks JOIN al ON al.k = peaks.k AND idx >= r - 5 AND idx < r + 4 WHERE beat_no < 10 AND greatest(0, r - 1) > greatest(0, r - 5) GROUP BY 1, 2, 3
), qg AS (SELECT k, lead, avg(depth) AS d, avg(height) AS h FROM qb GROUP BY 1, 2)
SELECT {ID}, lead, {r6('d AS q_depth_mv', 'h AS r_height_mv', digits=12)}, coalesce(d >= greatest(0.10, h * 0.25), false) AS pathologic FROM qg WHERE d IS NOT NULL"""
SQI = PEAKS + f""", al AS MATERIALIZED ({leads(*STANDARD_LEADS)}), {QUALITY.format(p='a_', src='al')},
us AS (SELECT k, count(*) FILTER (quality >= 35) AS usable, count(*) AS held FROM a_qual GROUP BY 1),
fl AS (SELECT k, idx, mv, coalesce(mv, m) AS v FROM work JOIN wmed USING (k)),
fm AS (SELECT k, median(v) AS m2, count(mv) / count(*) AS share, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS amp0 FROM fl GROUP BY 1),
sl AS (
  SELECT k, idx, v - lag(v) OVER w AS d, sum(v - m2) OVER (w ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING) / 100 AS ma FROM fl JOIN fm USING (k) WINDOW w AS (PARTITION BY k ORDER BY idx)
), sg AS (SELECT k, stddev_pop(d) AS noise, stddev_pop(ma) AS drift FROM sl GROUP BY 1),
nb AS (SELECT k, count(r) / 10.0 * 60 AS bpm FROM par LEFT JOIN peaks USING (k) GROUP BY k),
qq AS (
  SELECT k, share, usable, held, CASE WHEN amp0 = 0 THEN 1 ELSE amp0 END AS amp, least(100, noise / CASE WHEN amp0 = 0 THEN 1 ELSE amp0 END * 100) AS nr,
         least(100, drift / CASE WHEN amp0 = 0 THEN 1 ELSE amp0 END * 100) AS bw, CASE WHEN bpm BETWEEN 35 AND 220 THEN 100 ELSE greatest(0, least(100, bpm / 35 * 100)) END AS ok
  FROM fm JOIN sg USING (k) JOIN nb USING (k) JOIN us USING (k)
), sq AS (
  SELECT k, round_even(greatest(0, least(100, 95 - (1 - share) * 80 - nr * 1.45 - bw * 1.05 - CASE WHEN amp < 1e-6 THEN 100 ELSE 0 END + usable / held * 8 + ok * 0.08)), 1) AS signal_quality_index,
       round_even((1 - share) * 100, 1) AS missing_data_percent, CASE WHEN amp < 1e-6 THEN 100.0 ELSE 0.0 END::DOUBLE AS flatline_score, round_even(nr, 1) AS noise_score,
       round_even(bw, 1) AS baseline_wander_score, round_even(ok, 1)::DOUBLE AS qrs_detection_success, CAST(usable AS INT) AS usable_leads FROM qq
)
"""
ORACLE["A2_signal_quality"] = SQI + f"SELECT {ID}, * EXCLUDE (k) FROM sq"
ORACLE["A24_fibrillatory_power"] = dft(
    WORK + """, ma AS (
  SELECT k AS record_id, idx, mv, CASE WHEN count(mv) OVER w = count(*) OVER w THEN sum(mv) OVER w / 60 END AS m
  FROM work WINDOW w AS (PARTITION BY k ORDER BY idx ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING)
), dt AS MATERIALIZED (SELECT record_id, idx, coalesce(mv - m, 0) AS v FROM ma)""", 1000, 100.0,
    "SELECT CAST(record_id AS VARCHAR) AS record_id, round_even(least(1, f_power / total_power), 3) AS fibrillatory_power, round_even(dominant_hz, 2) AS dominant_f_wave_hz FROM sm JOIN dm USING (record_id)")
ORACLE["C2_missing_leads"] = f"""{BASE}
SELECT {ID}, concat_ws(',', {', '.join(f"CASE WHEN {ABSENT[l]} THEN '{l}' END" for l in STANDARD_LEADS if l in ABSENT)}) AS missing_leads FROM par"""
ORACLE["U4_subset_test"] = f"{BASE} SELECT {ID}, NOT ({ABSENT['V1']}) AS holds FROM par"
ORACLE["S5_demographics"] = f"{BASE} SELECT {ID}, age, lower(sex) AS sex FROM par"
HELD = " + ".join(f"CASE WHEN {ABSENT.get(l, 'false')} THEN 0 ELSE 1 END" for l in STANDARD_LEADS)
ORACLE["C8_dataset_characteristics"] = f"""{BASE}
SELECT dataset, count(*) AS records, {r6('avg(age) AS mean_age')}, count(*) FILTER (lower(sex) = 'male') AS male, count(*) FILTER (lower(sex) = 'female') AS female,
       {r6(f'avg({HELD}) AS mean_leads')}, CAST(count(*) * 10.0 AS DOUBLE) AS seconds FROM par GROUP BY 1"""
SIM = PEAKS + f""", wn AS (
  SELECT cen.k, beat_no, idx - r AS o, c FROM peaks JOIN cen ON cen.k = peaks.k AND idx >= r - 20 AND idx < r + 40 WHERE r >= 20 AND r + 40 <= 1000
), mw AS (SELECT k, o, avg(c) AS a FROM wn GROUP BY 1, 2),
co AS (SELECT wn.k, beat_no, corr(c, a) AS cc FROM wn JOIN mw USING (k, o) GROUP BY 1, 2)
"""
ORACLE["C5_beat_similarity"] = SIM + f"SELECT {ID}, {r6('avg(cc) AS beat_morphology_similarity')} FROM par LEFT JOIN co USING (k) GROUP BY k"

# --- rules -------------------------------------------------------------------------------------

RULES = f"WITH q AS (SELECT o_orderkey AS k, {columns(RULE_SQL)} FROM (SELECT *, o_orderkey AS k FROM orders)), "
RULES = RULES.replace("o_orderkey AS k, ", "k, ", 1)
LIM = f"""CASE WHEN {{lead}} IN ('V2', 'V3') THEN CASE WHEN {is_sex('female')} THEN 0.15 WHEN {is_sex('male')} AND coalesce(age < 40, false) THEN 0.25 WHEN {is_sex('male')} THEN 0.20 ELSE 0.10 END ELSE 0.10 END::DOUBLE"""
ORACLE["J7_thresholds"] = RULES + f"z AS (SELECT 1) SELECT k, {LIM.format(lead=chr(39) + 'V2' + chr(39))} AS v2_mv, {LIM.format(lead=chr(39) + 'V3' + chr(39))} AS v3_mv, 0.10::DOUBLE AS i_mv FROM q"
RC = """
a AS (SELECT *, coalesce(qrs >= 120, false) AS wide FROM q),
b AS (SELECT *, CASE
  WHEN p_presence >= 70 AND cv < 0.08 AND heart_rate BETWEEN 50 AND 100 THEN 1 WHEN p_presence >= 70 AND cv >= 0.08 THEN 2
  WHEN cv >= 0.16 AND p_presence < 55 AND fib >= 0.45 THEN 3 WHEN p_presence < 55 AND heart_rate BETWEEN 240 AND 340 THEN 4
  WHEN heart_rate > 150 AND cv < 0.10 AND NOT wide THEN 5 WHEN p_presence < 45 AND heart_rate BETWEEN 40 AND 100 AND NOT wide THEN 6
  WHEN wide AND heart_rate >= 100 THEN 7 ELSE 8 END AS rule FROM a)
"""
ORACLE["R1_rhythm_class"] = RULES + RC + """
SELECT k, ['sinus rhythm', 'sinus arrhythmia', 'atrial fibrillation pattern', 'atrial flutter pattern', 'SVT pattern', 'junctional rhythm pattern', 'ventricular rhythm pattern', 'undetermined rhythm'][rule] AS "primary",
  CASE rule WHEN 1 THEN 88 WHEN 2 THEN 74 WHEN 3 THEN round_even(least(95, 72 + cv * 60 + fib * 10), 1) WHEN 4 THEN 58 WHEN 5 THEN 66 WHEN 6 THEN 52 WHEN 7 THEN 55 ELSE 35 END::DOUBLE AS confidence,
  CASE WHEN pr > 200 THEN 3 ELSE 2 END AS candidates,
  ['P waves are present before most QRS complexes with regular RR intervals and rate 50-100 bpm.', 'P waves are present but RR variability is increased.',
   'Irregular RR intervals, low P-wave presence, and fibrillatory baseline power support AF pattern.', 'Very rapid atrial-rate surrogate pattern; flutter-wave confirmation requires better atrial delineation.',
   'Regular narrow-complex tachycardia pattern.', 'P waves are often absent with a narrow QRS and non-tachycardic rate.',
   'Wide-complex rhythm pattern; ventricular rhythm requires expert confirmation.', 'Available features do not meet a specific rhythm rule with high confidence.'][rule] AS reason,
  CASE WHEN pr > 200 THEN 'PR interval is prolonged at ' || CAST(pr AS DOUBLE) || ' ms.' ELSE 'Pacemaker spike detection is not yet validated in this prototype.' END AS second_reason FROM b"""
LEVELS = f"WITH q AS (SELECT k, {RULE_SQL['age']} AS age, {RULE_SQL['sex']} AS sex, {', '.join(f'{sql} AS {chr(34)}l_{l}{chr(34)}' for l, sql in LEVEL_SQL.items())} FROM (SELECT *, o_orderkey AS k FROM orders)), "
LONG = "lv AS (" + " UNION ALL ".join(f"SELECT k, age, sex, '{l}' AS lead, \"l_{l}\" AS v FROM q WHERE \"l_{l}\" IS NOT NULL" for l in LEVEL_SQL) + ")"
STEMI_HITS = f"""{LEVELS}{LONG}, hit AS (
  SELECT k, territory, count(*) AS n, string_agg(lead, ', ' ORDER BY position) AS leads FROM lv JOIN {territory_rows(STEMI_TERRITORIES)} USING (lead)
  WHERE v >= {LIM.format(lead='lead')} GROUP BY 1, 2 HAVING count(*) >= 2)
"""
ORACLE["J6_territory_join"] = STEMI_HITS + "SELECT CAST(k AS VARCHAR) AS record_id, territory, CAST(n AS INT) AS lead_count, leads FROM hit"
ORDER = "CASE territory " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(STEMI_TERRITORIES)) + " END"
ORACLE["R2_stemi"] = STEMI_HITS + f""", low AS (
  SELECT k, count(*) AS held, coalesce(bool_or(v <= -0.1 AND lead IN ('II', 'III', 'aVF')), false) AS inf, coalesce(bool_or(v <= -0.1 AND lead IN ('I', 'aVL', 'V5', 'V6')), false) AS lat FROM lv GROUP BY 1
), g AS (
  SELECT k, count(*) AS n, string_agg(territory, '|' ORDER BY {ORDER}) AS territories,
         string_agg('ST elevation meets threshold in contiguous ' || territory || ' leads: ' || leads || '.', '|' ORDER BY {ORDER}) AS reasons,
         bool_or(territory IN ('anterior', 'septal')) AS ant, bool_or(territory = 'inferior') AS infe, bool_or(territory = 'lateral') AS late FROM hit GROUP BY 1
)
SELECT k, CASE WHEN coalesce(held, 0) = 0 THEN 'unavailable' WHEN n > 0 THEN 'possible STEMI pattern - research criteria' ELSE 'No STEMI criteria met by research rules' END AS status,
  CASE WHEN coalesce(held, 0) = 0 THEN 0 WHEN n > 0 THEN least(96, 72 + n * 8 + CASE WHEN inf OR lat THEN 8 ELSE 0 END) ELSE 35 END::DOUBLE AS confidence,
  CASE WHEN coalesce(held, 0) = 0 THEN 'unavailable' WHEN n IS NULL THEN 'none suggested' WHEN ant THEN 'LAD' WHEN infe AND lat THEN 'RCA' WHEN late THEN 'LCX' ELSE 'uncertain' END AS culprit_vessel,
  coalesce(territories, '') AS territories,
  CASE WHEN coalesce(held, 0) = 0 THEN 'ST measurements unavailable.' WHEN n IS NULL THEN 'No contiguous lead group meets ST-elevation thresholds.'
       ELSE concat_ws('|', reasons, CASE WHEN inf THEN 'Reciprocal inferior ST depression flag present.' END, CASE WHEN lat THEN 'Reciprocal lateral ST depression flag present.' END) END AS reasons
FROM q LEFT JOIN low USING (k) LEFT JOIN g USING (k)"""


def found_sql(name: str, groups: dict[str, list[str]], passes: str) -> str:
    order = "CASE territory " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(groups)) + " END"
    return f"""{name}_h AS (SELECT k, territory, string_agg(lead, ',' ORDER BY position) AS leads FROM lv JOIN {territory_rows(groups)} USING (lead) WHERE {passes} GROUP BY 1, 2 HAVING count(*) >= 2),
{name} AS (SELECT k, string_agg(territory || ': ' || leads, '|' ORDER BY {order}) AS {name} FROM {name}_h GROUP BY 1)"""


ORACLE["R3_ischemia_and_infarction"] = f"""{LEVELS}{LONG}, {found_sql('ischemia', ISCHEMIA_TERRITORIES, 'v <= -0.1')}, {found_sql('infarction', INFARCT_TERRITORIES, 'v <= -0.2')}
SELECT k, coalesce(ischemia, '') AS ischemia, coalesce(infarction, '') AS infarction FROM q LEFT JOIN ischemia USING (k) LEFT JOIN infarction USING (k)"""
ORACLE["R4_chambers"] = RULES + """
z AS (SELECT k, coalesce(amp_ii >= 0.25, false) AS r, coalesce(p_duration >= 120, false) OR coalesce(ptfv1 <= -0.04, false) AS l, k % 5 = 0 AS h, axis_class = 'right axis deviation' AS v FROM q)
SELECT k, CASE WHEN r THEN 'criteria met' ELSE 'not met/unavailable' END AS right_atrial_enlargement, CASE WHEN l THEN 'criteria met' ELSE 'not met/unavailable' END AS left_atrial_enlargement,
  CASE WHEN r AND l THEN 'criteria met' ELSE 'not met' END AS biatrial_enlargement, CASE WHEN v THEN 'screening flag' ELSE 'not met/unavailable' END AS rvh,
  coalesce(nullif(concat_ws('|', CASE WHEN r THEN 'right atrial enlargement criteria' END, CASE WHEN l THEN 'left atrial enlargement criteria' END, CASE WHEN r AND l THEN 'biatrial enlargement criteria' END,
    CASE WHEN h THEN 'LVH criteria' END, CASE WHEN v THEN 'RVH screening flag' END), ''), 'No chamber enlargement criteria met by available rules.') AS summary FROM z"""
ORACLE["R5_interval_flags"] = RULES + """z AS (SELECT 1)
SELECT k, concat_ws('|', CASE WHEN fridericia >= 450 THEN 'prolonged QTc' END, CASE WHEN fridericia < 340 THEN 'short QT' END, CASE WHEN pr > 200 THEN 'first-degree AV block' END, CASE WHEN qrs >= 120 THEN 'wide QRS' END) AS flags FROM q"""
AF = RULES + """
a AS (SELECT *, 100 - p_presence AS p_missing, cv >= 0.18 OR irregularity >= 62 AS high FROM q),
b AS (SELECT *, high AND p_presence < 55 AND fib >= 0.55 AND sqi >= 50 AS gate FROM a),
c AS (SELECT *, round_even(greatest(0, least(100, irregularity * 0.28 + least(30, cv * 110) + least(18, rmssd / 5) + least(14, pnn50 * 0.35) + greatest(0, 70 - p_presence) * 0.28
  + p_missing * 0.18 + fib * 22 - greatest(0, p_presence - 70) * 0.45 - greatest(0, pr_consistency - 70) * 0.18 - CASE WHEN cv < 0.12 THEN 14 ELSE 0 END - CASE WHEN sqi < 50 THEN 10 ELSE 0 END
  + CASE WHEN p_presence < 40 AND high THEN 14 ELSE 0 END + CASE WHEN gate THEN 10 ELSE 0 END)), 1) AS s0,
  p_presence > 70 AND cv < 0.12 AS sinus, sqi < 50 AS low, sqi >= 50 AND sqi <= 70 AND NOT gate AS moderate FROM b),
d AS (SELECT *, least(s0, CASE WHEN sinus THEN 39 ELSE 100 END, CASE WHEN low THEN 50 WHEN moderate THEN 69 ELSE 100 END) AS s1 FROM c),
af AS (SELECT *, CASE WHEN s1 >= 70 AND NOT gate THEN 69 ELSE s1 END::DOUBLE AS score, s1 >= 70 AND NOT gate AS last_cap, p_presence = 0 AND beats < 5 AS unrel FROM d)
"""
TEXT = "CASE WHEN score >= 70 AND gate THEN 'Pattern compatible with AF or irregular atrial rhythm' WHEN score >= 40 THEN 'Indeterminate atrial rhythm' ELSE 'AF unlikely / sinus rhythm pattern likely' END"
ORACLE["R6_af_gate"] = AF + "SELECT k, gate AS af_gate_passed FROM af"
ORACLE["R7_af_score"] = AF + f"SELECT k, {r6('score AS af_score')}, sinus::INT + low::INT + moderate::INT + last_cap::INT AS caps FROM af"
ORACLE["R8_af_text"] = AF + f"SELECT k, {TEXT} AS rhythm FROM af"
ORACLE["C11_af_decision"] = AF + f"SELECT k, {r6('score AS af_probability')}, gate AS af_gate_passed, {TEXT} AS rhythm_label, low AS repeat_recommended FROM af"
ORACLE["R9_confidence"] = AF + """SELECT k, round(round_even(greatest(5, least(96, sqi * 0.36 + (9 - imputed) / 9 * 100 * 0.22 + (100 - abs(score - model_score)) * 0.16
  + least(least(abs(score - 40), abs(score - 70)), 30) * 0.42 - imputed * 6 - CASE WHEN unrel THEN 15 ELSE 0 END)), 1), 6) + 0.0 AS confidence_score FROM af"""
LAST = "This is a research prototype and does not diagnose AF. Physician confirmation is required."
ORACLE["R10_reasons"] = AF + f"""SELECT k, concat_ws('|', coalesce(nullif(concat_ws('|',
  CASE WHEN gate THEN 'AF gate passed: RR irregularity, P-wave absence, fibrillatory activity, and acceptable SQI are present.' END,
  CASE WHEN sinus THEN 'Sinus rhythm pattern likely: P-wave presence is >70% and RR coefficient of variation is <0.12.' END,
  CASE WHEN low THEN 'Low confidence due to signal quality: signal quality index is <50.' END,
  CASE WHEN moderate THEN 'Moderate signal quality and incomplete AF gate limit high-confidence rhythm labeling.' END,
  CASE WHEN last_cap THEN 'High AF likelihood requires RR irregularity, P-wave absence, fibrillatory activity, and acceptable signal quality.' END,
  CASE WHEN p_presence > 70 THEN 'Visible P waves before most QRS complexes reduce AF probability.' END,
  CASE WHEN cv < 0.12 AND p_presence > 70 THEN 'Regular RR intervals with visible P waves are more compatible with sinus rhythm.' END,
  CASE WHEN sqi <= 70 THEN 'Signal quality limits confidence; high-confidence AF labeling is blocked.' END,
  CASE WHEN unrel THEN 'P-wave detection is unreliable; confidence was lowered instead of forcing AF.' END,
  CASE WHEN imputed > 0 THEN 'One or more PTB-XL model inputs were unavailable and imputed; model confidence was lowered.' END), ''),
  'Digital WFDB waveform was parsed and analyzed with conservative AF gating.'), '{LAST}') AS reasons,
  CASE WHEN low THEN 'Signal quality index is <50; analysis is limited and repeat ECG is recommended.' ELSE '' END AS warnings, 3 AS limitations FROM af"""
ORACLE["A13_qtc_approximate"] = RULES + """z AS (SELECT 1) SELECT k, CASE WHEN rr_mean > 0 THEN round_even((360 + greatest(0, coalesce(nullif(qrs, 0), 90) - 90) * 0.45
  + greatest(0, coalesce(nullif(pr, 0), 160) - 160) * 0.15) / sqrt(rr_mean / 1000), 1) END AS qtc_ms FROM q"""
ORACLE["A12_qt_rules"] = RULES + "z AS (SELECT *, rr_mean AS rr FROM q)" + QT_REPORT.format(key="k", keycol="k", src="z")
ORACLE["A17_lvh_rules"] = RULES + "z AS (SELECT 1)" + lvh_sql("k", "q")
ORACLE["A18_bundle_rules"] = RULES + "z AS (SELECT 1)" + bundle_sql("k", "q")
ORACLE["A35_hf_points"] = RULES + """
h AS (SELECT k, coalesce(qrs >= 120, false) AS a, coalesce(fridericia >= 460, false) AS b, coalesce(heart_rate > 100, false) AS c, k % 5 = 0 AS d, model_score >= 70 AS e FROM q),
s AS (SELECT *, 2 * a::INT + b::INT + c::INT + 2 * d::INT + e::INT AS n FROM h)
SELECT k, CASE WHEN n <= 1 THEN 'low' WHEN n <= 3 THEN 'intermediate' ELSE 'high' END AS category, n AS score_points,
  coalesce(nullif(concat_ws('|', CASE WHEN a THEN 'QRS duration is prolonged.' END, CASE WHEN b THEN 'QTc is prolonged.' END, CASE WHEN c THEN 'Heart rate is elevated.' END,
   CASE WHEN d THEN 'LVH criteria are met.' END, CASE WHEN e THEN 'PTB-XL atrial remodeling probability is high.' END), ''), 'No major ECG HF-risk flags in available features.') AS reasons FROM s"""
ORACLE["W6_irregularity_basic"] = RULES + f"z AS (SELECT 1) SELECT k, {r6('least(100, cv * 155 + rmssd / 3.2 + (100 - p_presence) * 0.2) AS rr_irregularity_index')} FROM q"
ORACLE["P17_rounding"] = "SELECT o_orderkey, round_even(o_totalprice * 0.1234567, 1) AS one, round_even(o_totalprice * 0.1234567, 3) AS three FROM orders"
ORACLE["P6_sex_code"] = RULES + f"z AS (SELECT 1) SELECT k, CASE WHEN {is_sex('male')} THEN 1.0 WHEN {is_sex('female')} THEN 0.0 END::DOUBLE AS sex_code FROM q"
ORACLE["P8_clean_values"] = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_orderkey AS DOUBLE) END AS value FROM orders"

# --- codes, features, model data ---------------------------------------------------------------

CODED = f"WITH c AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'LAE' WHEN 1 THEN 'NORM' WHEN 2 THEN 'AFIB' WHEN 3 THEN 'ABQRS' ELSE 'SR' END AS second FROM events) "
ORACLE["P10_code_map"] = "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 13 = 1 THEN 3 ELSE 2 END AS codes FROM events"
ORACLE["P11_code_label"] = CODED + f"""SELECT event_id, (event_type IN ({listed(MORPHOLOGY_CODES)}) OR second IN ({listed(MORPHOLOGY_CODES)}))::INT AS morphology_label,
  (event_type IN ({listed(RHYTHM_CODES)}) OR second IN ({listed(RHYTHM_CODES)}))::INT AS rhythm_label FROM c"""
ORACLE["U3_code_overlap"] = CODED + f"SELECT event_type IN ({listed(RHYTHM_CODES)}) OR second IN ({listed(RHYTHM_CODES)}) AS overlaps, count(*) AS n FROM c GROUP BY 1"
ORACLE["S13_adapted_labels"] = CODED + f""", l AS (SELECT event_id, event_type AS code FROM c UNION ALL SELECT event_id, second FROM c),
w AS (SELECT * FROM (VALUES {', '.join([f"('morphology', '{c}')" for c in MORPHOLOGY_CODES] + [f"('rhythm', '{c}')" for c in RHYTHM_CODES])}) AS t(label_set, code))
SELECT event_id, label_set, count(*) AS codes FROM l JOIN w USING (code) GROUP BY 1, 2"""
FEAT = f"WITH q AS (SELECT k, k AS ecg_id, (o_orderstatus = 'F')::INT AS current_atrial_abnormality, {columns(FEATURE_SQL)} FROM (SELECT *, o_orderkey AS k FROM orders)) "
ORACLE["P7_feature_alias"] = FEAT + f"SELECT k, {r6('age', 'sex', 'CAST(NULL AS DOUBLE) AS p_duration_ms', 'CAST(NULL AS DOUBLE) AS p_amplitude_mv', 'CAST(NULL AS DOUBLE) AS p_axis_deg', 'pr_interval_ms', 'CAST(NULL AS DOUBLE) AS qrs_duration_ms', 'qtc_ms', 'ptfv1_mv_ms').replace('round(CAST(NULL, 6)', 'CAST(NULL')} FROM q"
ORACLE["P7_feature_alias"] = FEAT + "SELECT k, age, sex, NULL::DOUBLE AS p_duration_ms, NULL::DOUBLE AS p_amplitude_mv, NULL::DOUBLE AS p_axis_deg, pr_interval_ms, NULL::DOUBLE AS qrs_duration_ms, qtc_ms, " + r6("ptfv1_mv_ms") + " FROM q"
ORACLE["A33_completeness"] = FEAT + "SELECT k, " + " + ".join(f"({f} IS NULL)::INT" for f in FEATURES) + " AS missing FROM q"
ORACLE["M1_stratified_split"] = FEAT + """, o AS (SELECT *, row_number() OVER (PARTITION BY current_atrial_abnormality ORDER BY md5(k || ':42')) AS pos, ceil(count(*) OVER (PARTITION BY current_atrial_abnormality) * 0.3) AS quota FROM q)
SELECT ecg_id, current_atrial_abnormality, pos <= quota AS is_test FROM o"""
# a fifth of the 32-bit numbers lies below 33333333 in hexadecimal
ORACLE["C13_group_split"] = "SELECT o_orderkey, o_custkey, substr(md5(o_custkey || ':42'), 1, 8) < '33333333' AS is_test FROM orders"
MED = FEAT + ", md AS (SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in FEATURES) + " FROM q), im AS (SELECT k, " + ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATURES) + " FROM q, md) "
ORACLE["M2_median_impute"] = MED + f"SELECT k, {r6(*FEATURES)} FROM im"
ORACLE["M3_standardise"] = MED + ", ms AS (SELECT " + ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + f" FROM im) SELECT k, {r6(*[f'({f} - a_{f}) / s_{f} AS {f}' for f in FEATURES])} FROM im, ms"
WEIGHTS = [0.5, -1.25, 0.01, 2.0, -0.003, 0.02, 0.015, -0.004, -30.0]
CONTRIB = FEAT + ", fl AS (SELECT k, " + ", ".join(f"coalesce({f}, {dict(age=50.0, pr_interval_ms=160.0).get(f, 0.0)}) AS {f}" for f in FEATURES) + " FROM q), lo AS (" + " UNION ALL ".join(
    f"SELECT k, {i} AS i, '{f}' AS feature, CAST({w} AS DOUBLE) * {f} AS c, {f} AS v FROM fl" for i, (f, w) in enumerate(zip(FEATURES, WEIGHTS))
) + "), rk AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY abs(c) DESC, i) - 1 AS INT) AS rank, feature, CASE WHEN c >= 0 THEN 'increases' ELSE 'decreases' END AS direction, c, v FROM lo) "
ORACLE["M7_contributions"] = CONTRIB + f"SELECT k, rank, feature, direction, {r6('c AS contribution')} FROM rk"
ORACLE["C14_attributions"] = CONTRIB + f"SELECT k, feature AS name, direction, {r6('v AS value', 'c AS contribution')} FROM rk"
ORACLE["O4_top_contribution"] = CONTRIB + f"SELECT k, feature, direction, {r6('c AS contribution')} FROM rk WHERE rank = 0"
ORACLE["J9_weighted_sum"] = FEAT + f"SELECT k, {r6(' + '.join(f'coalesce({f}, 0) * {i + 1}' for i, f in enumerate(FEATURES)) + ' AS total').replace('coalesce(age', 'coalesce(age')} FROM q"
DEFAULTS = {"age": 0.0, "sex": 0.0, "p_duration_ms": 110.0, "qtc_ms": 410.0}
ORACLE["M8_model_input"] = FEAT + "SELECT k, " + ", ".join(f"round(coalesce({f}, {DEFAULTS.get(f, 0.0)}), 6) + 0.0 AS {f}" for f in FEATURES) + ", concat_ws('|', " + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}={'training fallback' if f in DEFAULTS else 'last-resort zero fallback'}' END" for f in FEATURES
) + ") AS imputed FROM q"
ORACLE["M12_reported_features"] = FEAT + " UNION ALL ".join(f"SELECT k, '{f}' AS feature, round({f}, 6) + 0.0 AS value FROM q" for f in ["p_duration_ms", "pr_interval_ms", "qrs_duration_ms", "qtc_ms", "ptfv1_mv_ms"])
ORACLE["U5_merge_present"] = FEAT + "SELECT k, age, qtc_ms, coalesce(CASE WHEN k % 2 = 0 THEN pr_interval_ms + 5 END, pr_interval_ms) AS pr_interval_ms, p_duration_ms FROM q"
ORACLE["O1_first_records"] = FEAT + "SELECT ecg_id, qrs_duration_ms FROM q ORDER BY ecg_id LIMIT 25"
ORACLE["O3_missing_columns"] = "SELECT count(*) AS rows, 'age,qtc_ms' AS missing FROM orders"
ORACLE["P14_target_and_order"] = FEAT + f"SELECT ecg_id, {r6(*FEATURES)}, current_atrial_abnormality AS target FROM q"
ORACLE["S6_feature_table_saved"] = FEAT + f"SELECT ecg_id, {r6(*FEATURES)}, current_atrial_abnormality FROM q"
ORACLE["S7_feature_table_checked"] = FEAT + "SELECT current_atrial_abnormality, count(*) AS n FROM q GROUP BY 1"


def hole(every: int, e: str) -> str:
    return f"CASE WHEN (k + beat_no) % {every} <> 0 THEN {e} END"


MORPH = BASE + f""", dl AS (
  SELECT k, beat_no, r, {hole(5, 'r - 22')} AS p_on, {hole(7, 'r - 9')} AS p_off, {hole(6, 'r - 16')} AS p_peak, {hole(11, 'r - 5')} AS q_on, {hole(8, 'r + 6')} AS s_off, {hole(9, 'r + 38')} AS t_off FROM truth
), iv AS (
  SELECT k, count(*) AS n, avg((p_off - p_on) / 100.0 * 1000.0) AS pd, avg((q_on - p_on) / 100.0 * 1000.0) AS pr, avg((s_off - q_on) / 100.0 * 1000.0) AS qd,
         avg((t_off - q_on) / 100.0 * 1000.0) AS qt, (max(r) - min(r)) / 100.0 / (count(*) - 1) AS rr FROM dl GROUP BY 1
), sl AS MATERIALIZED ({leads('I', 'II', 'aVF', 'V1')}),
pk AS (SELECT dl.k, avg(mv) FILTER (lead = 'II') AS ii, avg(mv) FILTER (lead = 'I') AS i, avg(mv) FILTER (lead = 'aVF') AS f FROM dl JOIN sl ON sl.k = dl.k AND sl.idx = dl.p_peak GROUP BY 1),
tf AS (SELECT k, avg(f) AS ptf FROM (SELECT dl.k, beat_no, abs(min(mv)) * (count(*) / 100.0 * 1000.0) AS f FROM dl JOIN sl ON sl.k = dl.k AND sl.lead = 'V1' AND idx >= p_on AND idx < p_off WHERE mv < 0 GROUP BY 1, 2) GROUP BY 1),
mo AS (
  SELECT par.k, CASE WHEN n >= 3 THEN pd END AS p_duration_ms, CASE WHEN n >= 3 THEN ii END AS p_amplitude_mv, CASE WHEN n >= 3 THEN degrees(atan2(f, i)) END AS p_axis_deg,
         CASE WHEN n >= 3 THEN pr END AS pr_interval_ms, CASE WHEN n >= 3 THEN qd END AS qrs_duration_ms, CASE WHEN n >= 3 AND rr > 0 THEN qt / sqrt(rr) END AS qtc_ms, CASE WHEN n >= 3 THEN ptf END AS ptfv1_mv_ms
  FROM par LEFT JOIN iv USING (k) LEFT JOIN pk USING (k) LEFT JOIN tf USING (k)
) """
MORPH_COLUMNS = ["p_duration_ms", "p_amplitude_mv", "p_axis_deg", "pr_interval_ms", "qrs_duration_ms", "qtc_ms"]
ORACLE["A22_ptfv1_batch"] = MORPH + f"SELECT {ID}, {r6('ptfv1_mv_ms')} FROM mo"
ORACLE["A23_batch_morphology"] = MORPH + f"SELECT {ID}, {r6(*MORPH_COLUMNS)} FROM mo"
ORACLE["J3_positional_intervals"] = MORPH + f"SELECT {ID}, {r6('pr AS pr_ms', 'qt AS qt_ms')} FROM iv"
META = """md AS (
  SELECT o_orderkey AS ecg_id, CAST(o_orderkey % 70 + 20 AS DOUBLE) AS age, CAST(o_orderkey % 2 AS DOUBLE) AS sex, o_orderstatus,
         CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 10 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS filename_lr FROM orders)
"""
ORACLE["J2_feature_table"] = MORPH + "," + META + f"""SELECT ecg_id, age, sex, {r6(*MORPH_COLUMNS, 'ptfv1_mv_ms')}, (o_orderstatus = 'F')::INT AS current_atrial_abnormality
FROM md JOIN mo ON md.filename_lr = CAST(mo.k AS VARCHAR)"""
ORACLE["J2_unmatched"] = "WITH " + META + "SELECT ecg_id, filename_lr FROM md WHERE filename_lr <> '' AND filename_lr NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)"
ORACLE["S4_usable_metadata"] = "WITH " + META + "SELECT ecg_id, filename_lr, '{''' || CASE WHEN o_orderstatus = 'F' THEN 'LAO/LAE' ELSE 'NORM' END || ''': 0.0}' AS scp_codes FROM md WHERE filename_lr <> ''"
ORACLE["U2_union_of_datasets"] = """
SELECT 'ptbxl' AS dataset, count(*) AS records, count(*) * 1000 AS samples, count(*) AS with_names FROM customer
UNION ALL SELECT 'mitbih_afdb', count(*), CAST(sum(len(embedding)) AS BIGINT), 0 FROM embeddings"""
ORACLE["S12_dataset_registry"] = f"""
SELECT c_custkey, dataset_key, name, modality, external_validation_group FROM (SELECT c_custkey, [{listed([d[0] for d in DATASETS])}][c_custkey % {len(DATASETS)} + 1] AS dataset_key FROM customer)
JOIN (VALUES {', '.join(str(d[:3] + (d[5],)) for d in DATASETS)}) AS t(dataset_key, name, modality, external_validation_group) USING (dataset_key)"""

# --- binary records ----------------------------------------------------------------------------

ORACLE["S1_record_pairs"] = "SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'records/' || c_custkey || '.hea' AS header_path, 'records/' || c_custkey || '.dat' AS signal_path FROM customer WHERE c_custkey % 14 NOT IN (3, 5)"
ORACLE["J1_unpaired_files"] = "SELECT 'records/' || c_custkey || CASE WHEN c_custkey % 14 = 3 THEN '.hea' ELSE '.dat' END AS path, CASE WHEN c_custkey % 14 = 3 THEN 'signal file missing' ELSE 'header file missing' END AS error FROM customer WHERE c_custkey % 14 IN (3, 5)"
ORACLE["S2_decoded_leads"] = BASE + f", al AS ({leads(*STANDARD_LEADS)}) SELECT {ID}, lead, 100.0::DOUBLE AS fs, CAST(count(*) AS INT) AS n, {r6('sum(mv) AS total_mv', digits=3)}, CAST(count(mv) AS INT) AS present FROM al WHERE k % 14 NOT IN (3, 5) GROUP BY k, lead"
ORACLE["S3_record_metadata"] = f"""{BASE}
SELECT {ID}, 100.0::DOUBLE AS sampling_frequency, {HELD} AS number_of_leads, concat_ws(',', {', '.join(f"CASE WHEN NOT ({ABSENT.get(l, 'false')}) THEN '{l}' END" for l in STANDARD_LEADS)}) AS lead_names, 10.0::DOUBLE AS duration_seconds FROM par WHERE k % 14 NOT IN (3, 5)"""
ORACLE["P9_dead_letters"] = f"""{BASE} SELECT 'records/' || k AS stem, CASE WHEN 1001 % (2 * ({HELD})) <> 0 THEN 'signal file has a partial frame' ELSE 'length differs from header' END AS error
FROM par WHERE k % 14 NOT IN (3, 5) AND k % 11 = 0"""
ORACLE["O6_first_pair"] = "SELECT min('records/' || c_custkey) AS stem FROM customer WHERE c_custkey % 14 NOT IN (3, 5)"
ORACLE["T1_arrivals"] = ORACLE["A10_qrs_duration"]

# --- the same results by another way of the data -----------------------------------------------

for ours, sql in {
    "S1_pairs_of_files": "S1_record_pairs", "J1_unpaired_of_files": "J1_unpaired_files", "S2_records_of_files": "S2_decoded_leads",
    "S3_metadata_of_files": "S3_record_metadata", "P9_dead_letters_of_files": "P9_dead_letters", "A22_ptfv1_stored": "A22_ptfv1_batch",
    "A23_morphology_stored": "A23_batch_morphology", "J2_feature_table_stored": "J2_feature_table", "W4_long_records": "W4_qrs_peaks",
}.items():
    ORACLE[ours] = ORACLE[sql]

# --- calibration -------------------------------------------------------------------------------

# Newton's steps for the lines of all datasets; the logit is kept off 0 and 1.
LINES = """cells AS MATERIALIZED (
  SELECT dataset, ln(greatest(1e-12, least(1 - 1e-12, s)) / (1 - greatest(1e-12, least(1 - 1e-12, s)))) AS x, count(*) AS n, sum(y) AS hits
  FROM g GROUP BY 1, 2
), lines AS (
  SELECT DISTINCT dataset, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS step FROM g
  UNION ALL
  SELECT dataset, a + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), b + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), step + 1 FROM (
    SELECT dataset, any_value(a) AS a, any_value(b) AS b, any_value(step) AS step, sum(hits - n * p) AS g0, sum((hits - n * p) * x) AS g1,
           sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM cells JOIN lines USING (dataset)) WHERE step < 20 GROUP BY dataset)
), line AS (SELECT dataset, a, b FROM lines WHERE step = 20)
"""
RECURSIVE = PRED.replace("WITH p AS", "WITH RECURSIVE p AS")
ORACLE["C7_external_validation"] = RECURSIVE + METRICS + ", " + LINES + f"""
SELECT dataset, n, {r6('auc', 'sens AS sensitivity', 'spec AS specificity', 'f1', 'ppv', 'npv', 'brier AS brier_score', 'a AS calibration_slope', 'b AS calibration_intercept')}, tn, fp, fn, tp
FROM m JOIN line USING (dataset)"""
ORACLE["C6_platt"] = RECURSIVE + LINES + f"""
SELECT CAST(doc_id AS VARCHAR) AS patient_id, y AS y_true, {r6('s AS y_score', '1 / (1 + exp(-(a * ln(greatest(1e-12, least(1 - 1e-12, s)) / (1 - greatest(1e-12, least(1 - 1e-12, s)))) + b))) AS calibrated')}
FROM p, line WHERE line.dataset = 'overall'"""
# The step at a score: the largest over beginnings up to it of the smallest over ends from it of the mean between.
ORACLE["C6_isotonic"] = PRED + f"""
q AS (SELECT s, count(*) AS w, sum(y) AS t, row_number() OVER (ORDER BY s) AS i FROM p GROUP BY s),
u AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(t) OVER (ORDER BY i) AS ct FROM q),
ab AS (SELECT a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS mean FROM u a JOIN u b ON a.i <= b.i),
lo AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM ab),
v AS (SELECT i, max(least) AS value FROM lo GROUP BY i)
SELECT CAST(doc_id AS VARCHAR) AS patient_id, y AS y_true, {r6('p.s AS y_score', 'value AS calibrated')} FROM p JOIN q USING (s) JOIN v USING (i)"""

# What must hold whatever was trained.
ORACLE["M9_reload_identity"] = "SELECT true AS logistic_difference, true AS boosting_difference"
ORACLE["T1_arrival_findings"] = PEAKS + f""", one AS (SELECT k, any_value(lead) AS selected_lead FROM work GROUP BY k)
SELECT {ID}, selected_lead, CAST(count(r) AS INT) AS qrs_count, NULL AS error FROM one LEFT JOIN peaks USING (k)
WHERE k % 14 NOT IN (3, 5) AND k % 11 <> 0 GROUP BY k, selected_lead
UNION ALL SELECT replace(stem, 'records/', ''), NULL, NULL, error FROM ({ORACLE['P9_dead_letters']})"""
ORACLE["M4_gradient_at_fit"] = f"SELECT unnest([{listed([*FEATURES, 'intercept'])}]) AS term, true AS settled"

# --- whole records, from the SQL of their parts ------------------------------------------------

BUNDLE_RR = f"""(
  SELECT record_id, count(*) AS n, avg(rr_ms) AS m, stddev_pop(rr_ms) AS sd, coalesce(sqrt(avg(d * d)), 0) AS rmssd
  FROM (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY record_id ORDER BY beat_no) AS d FROM ({ORACLE['D8_rr_of_records']})) GROUP BY 1
)"""
ORACLE["R11_bundle_columns"] = f"""
WITH rr AS {BUNDLE_RR},
rs AS (SELECT record_id, round_even(m, 1) AS mean_rr_ms, round_even(sd, 1) AS rr_sd_ms, round_even(sd / m, 3) AS rr_cv, round_even(rmssd, 1) AS rmssd_ms,
  round_even(60000.0 / m, 1) AS heart_rate_bpm, CASE WHEN sd / m < 0.08 THEN 'regular' WHEN sd / m < 0.16 THEN 'mildly irregular' ELSE 'irregular' END AS regularity FROM rr),
ct AS (SELECT record_id, count(*) AS n FROM ({ORACLE['W4_qrs_peaks']}) GROUP BY 1),
st AS (SELECT record_id, max(st_level_mv) AS hi, min(st_level_mv) AS lo, count(*) AS n FROM ({ORACLE['A16_st_levels']}) GROUP BY 1)
SELECT record_id, CAST(coalesce(ct.n, 0) AS INT) AS qrs_count, l.selected_lead, mean_rr_ms, rr_sd_ms, rr_cv, rmssd_ms, heart_rate_bpm,
  coalesce(regularity, 'unavailable') AS regularity, p.pr_mean_ms AS pr_interval_ms, p.pr_sd_ms, p.p_wave_presence_ratio, p.missing_p_wave_percent,
  CASE WHEN p.missing_p_wave_percent > 50 THEN 'missing P waves flagged' ELSE 'P waves usually detected' END AS p_status,
  d.qrs_duration_ms, coalesce(d.qrs_duration_ms >= 120, false) AS wide_qrs,
  CASE WHEN d.qrs_duration_ms IS NULL THEN 'unavailable' WHEN d.qrs_duration_ms >= 120 THEN 'wide QRS flag' ELSE 'No wide QRS flag' END AS qrs_status,
  q.qt_ms, q.qtc_bazett_ms, q.qtc_fridericia_ms, q.prolonged_qtc, x.axis_deg, x.classification AS axis_class, st.hi AS max_elevation_mv, st.lo AS max_depression_mv,
  CAST(coalesce(st.n, 0) AS INT) AS st_leads, v.status AS lvh_status, b.status AS bbb_status,
  round_even(least(100, coalesce(rr_cv, 0) * 155 + coalesce(rmssd_ms, 0) / 3.2 + (100 - p.p_wave_presence_ratio) * 0.2), 1) AS rr_irregularity_index,
  round_even(100 - p.p_wave_presence_ratio, 1) AS p_wave_absence_percent, f.fibrillatory_power AS fibrillatory_baseline_power, f.dominant_f_wave_hz
FROM ({ORACLE['P1_working_lead']}) l JOIN ({ORACLE['A9_p_wave']}) p USING (record_id) JOIN ({ORACLE['A10_qrs_duration']}) d USING (record_id)
JOIN ({ORACLE['A12_qt_qtc']}) q USING (record_id) JOIN ({ORACLE['A14_qrs_axis']}) x USING (record_id) JOIN ({ORACLE['A17_lvh']}) v USING (record_id)
JOIN ({ORACLE['A18_bundle_branch']}) b USING (record_id) LEFT JOIN ({ORACLE['A24_fibrillatory_power']}) f USING (record_id)
LEFT JOIN rs USING (record_id) LEFT JOIN ct USING (record_id) LEFT JOIN st USING (record_id)"""
ORACLE["S14_documents"] = f"SELECT record_id, classification AS axis, selected_lead AS lead FROM ({ORACLE['A14_qrs_axis']}) JOIN ({ORACLE['P1_working_lead']}) USING (record_id)"
BEAT_RR = PEAKS + """, t AS (SELECT k, r, (r - lag(r) OVER (PARTITION BY k ORDER BY r)) / 100.0 * 1000.0 AS rr_ms FROM peaks),
s AS (
  SELECT CAST(k AS VARCHAR) AS record_id, r AS event_id, rr_ms, rr_ms - lag(rr_ms) OVER w AS drr_ms, lag(rr_ms) OVER w - lag(rr_ms, 2) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY k ORDER BY r)
), r AS (SELECT * FROM s WHERE rr_ms IS NOT NULL),""" + RR.split("r AS (SELECT * FROM s WHERE rr_ms IS NOT NULL),")[1]
ORACLE["C12_feature_bundle"] = f"""
WITH rf AS ({BEAT_RR} SELECT record_id, cv, rmssd, tpr, sampen, shannon FROM f),
ct AS (SELECT record_id, count(*) AS n FROM ({ORACLE['W4_qrs_peaks']}) GROUP BY 1)
SELECT record_id, CAST(coalesce(ct.n, 0) AS INT) AS qrs_count,
  {r6('coalesce(cv, 0) AS rr_cv', 'coalesce(rmssd, 0) AS rmssd_ms', 'coalesce(tpr, 0) AS turning_point_ratio', 'coalesce(sampen, 0) AS sample_entropy', 'coalesce(shannon, 0) AS shannon_entropy')},
  p_wave_presence_ratio, pr_mean_ms, noise_score, baseline_wander_score, signal_quality_index, usable_leads AS usable, fibrillatory_power, dominant_f_wave_hz
FROM ({ORACLE['A9_p_wave']}) JOIN ({ORACLE['A2_signal_quality']}) USING (record_id) LEFT JOIN ({ORACLE['A24_fibrillatory_power']}) USING (record_id)
LEFT JOIN rf USING (record_id) LEFT JOIN ct USING (record_id)"""
ORACLE["C9_ablation_settled"] = "SELECT * FROM (VALUES ('RR only', 7), ('P-wave only', 5), ('Morphology only', 2), ('RR + P wave', 12), ('RR + P wave + morphology', 14), ('P wave + morphology', 7), ('Demographics only', 2), ('All', 16)) t(feature_group, inputs), (SELECT true AS settled)"
ORACLE["C9_feature_table_with_intervals"] = f"""
WITH {META}, rf AS ({BEAT_RR} SELECT * FROM f WHERE n > 1 AND CAST(record_id AS BIGINT) % 23 <> 8)
SELECT ecg_id, qrs_duration_ms, {r6('mean_rr AS rr_mean_ms', 'cv AS rr_cv', 'rmssd AS rmssd_ms', 'pnn50 AS pnn50_percent', 'sampen AS sample_entropy', 'shannon AS shannon_entropy', 'tpr AS turning_point_ratio')}
FROM ({ORACLE['J2_feature_table']}) JOIN (SELECT ecg_id, filename_lr FROM md) USING (ecg_id) LEFT JOIN rf ON rf.record_id = filename_lr"""
CODED = ", ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 + {' + '.join(f'({f} > {c})::INT' for c in cuts)} END AS {f}" for f, cuts in CUTS.items())
ORACLE["M5_level_histogram"] = FEAT + f""", c AS (SELECT current_atrial_abnormality AS y, {CODED} FROM q),
n AS (SELECT *, CASE WHEN qtc_ms BETWEEN 1 AND 2 THEN 2 ELSE 3 END AS node, 1 / (1 + exp(0.5)) AS p FROM c),
u AS ({' UNION ALL '.join(f"SELECT node, '{f}' AS feature, {f} AS bin, y, p FROM n" for f in FEATURES)})
SELECT CAST(node AS BIGINT) AS node, feature, CAST(bin AS BIGINT) AS bin, count(*) AS n, {r6('sum(y - p) AS g', 'sum(p * (1 - p)) AS h')} FROM u GROUP BY 1, 2, 3"""
