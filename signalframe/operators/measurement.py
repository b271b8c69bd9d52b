"""Record-level measurements. A record is one row, so none of these moves samples between tasks.

Input is a ``records`` frame (:func:`signalframe.schemas.records_schema`). A scan of stored records
reads only the leads that the chosen measurement names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalframe.functions import beats as B, leads as L, quality as Q, rhythm as R, spectrum as S
from signalframe.functions.arrays import centre, lets, median
from signalframe.schemas import STANDARD_LEADS, WORKING_LEAD_ORDER
from signalframe.session import settle

BASE = ["record_id", "fs", "n"]


def lead_columns(records: DataFrame) -> list[str]:
    return records.schema["leads"].dataType.names


def lead_or_null(records: DataFrame, name: str) -> Column:
    """The samples of a lead; a typed NULL when the frame does not hold it."""
    if name in lead_columns(records):
        return F.col("leads")[name]
    return F.lit(None).cast("array<double>")


def leads_long(records: DataFrame, leads: list[str] | None = None, *carry: str) -> DataFrame:
    """One row per record and present lead: ``record_id, lead, fs, n, samples`` and the carried columns."""
    names = [l for l in lead_columns(records) if leads is None or l in leads]
    return (
        records.select(
            *BASE,
            *carry,
            F.explode(
                F.array(*[F.struct(F.lit(l).alias("lead"), F.col("leads")[l].alias("samples")) for l in names])
            ).alias("s"),
        )
        .select(*BASE, *carry, "s.lead", "s.samples")
        .filter(F.col("samples").isNotNull())
    )


def samples_long(leads: DataFrame) -> DataFrame:
    """``record_id, lead, idx, mv`` from long leads."""
    return leads.select("record_id", "lead", F.posexplode("samples").alias("idx", "mv"))


def samples_to_leads(samples: DataFrame, fs: float) -> DataFrame:
    """Back from samples to one array per record and lead, in index order."""
    return (
        samples.groupBy("record_id", "lead")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "mv"))).alias("s"))
        .select(
            "record_id",
            "lead",
            F.lit(fs).alias("fs"),
            F.size("s").alias("n"),
            F.transform("s", lambda p: p["mv"]).alias("samples"),
        )
    )


def lead_quality(records: DataFrame) -> DataFrame:
    """Quality of every present lead."""
    return leads_long(records).select("record_id", "lead", Q.lead_quality(F.col("samples")).alias("quality"))


def usable_leads(records: DataFrame) -> DataFrame:
    """Number of leads of at least the usable quality, per record."""
    return records.select("record_id", _usable_count(records).alias("usable_leads"))


def _usable_count(records: DataFrame) -> Column:
    qualities = Q.lead_qualities(F.array(*[F.col("leads")[l] for l in lead_columns(records)]))
    return F.size(F.filter(qualities, lambda q: q >= Q.USABLE))


def _by_quality(records: DataFrame, leads: list[str]) -> Column:
    """Present lead of highest quality, the earliest in the record's own order on ties."""
    order = F.col("lead_names") if "lead_names" in records.columns else F.array(*[F.lit(l) for l in leads])
    present = F.filter(
        F.array(*[F.struct(F.lit(l).alias("lead"), F.col("leads")[l].alias("samples")) for l in leads]),
        lambda s: s["samples"].isNotNull(),
    )
    ranked = F.transform(
        present,
        lambda s: F.struct(
            Q.lead_quality(s["samples"]).alias("quality"),
            (-F.array_position(order, s["lead"])).alias("rank"),
            s.alias("s"),
        ),
    )
    return F.array_max(ranked)["s"]


def select_lead(records: DataFrame, only: str | None = None) -> DataFrame:
    """Add ``selected_lead`` and its samples ``x``.

    ``only`` names a lead every record is known to hold, so that no other lead is read.
    """
    if only is not None:
        return records.withColumns({"selected_lead": F.lit(only), "x": F.col("leads")[only]})
    names = lead_columns(records)
    preferred = [l for l in WORKING_LEAD_ORDER if l in names]
    rest = [l for l in names if l not in preferred]
    choice = [
        F.when(F.col("leads")[l].isNotNull(), F.struct(F.lit(l).alias("lead"), F.col("leads")[l].alias("samples")))
        for l in preferred
    ]
    if rest:
        choice.append(_by_quality(records, rest))
    chosen = records.withColumn("_s", F.coalesce(*choice))
    return chosen.withColumns({"selected_lead": F.col("_s")["lead"], "x": F.col("_s")["samples"]}).drop("_s")


def detect_beats(records: DataFrame, only: str | None = None) -> DataFrame:
    """Add the working lead, its centred samples ``c`` and the beat positions ``peaks``."""
    chosen = select_lead(records, only)
    return chosen.withColumn("c", centre(F.col("x"))).withColumn("peaks", B.detect_peaks(F.col("c"), F.col("fs")))


def beats(detected: DataFrame) -> DataFrame:
    """``record_id, beat_no, r_idx``."""
    return detected.select("record_id", F.posexplode_outer("peaks").alias("beat_no", "r_idx")).filter("r_idx is not null")


def beat_windows(detected: DataFrame, left: float, right: float, count: int | None = None) -> DataFrame:
    return detected.select(
        "record_id",
        F.explode_outer(B.beat_windows(F.col("n"), F.col("peaks"), F.col("fs"), left, right, count)).alias("w"),
    ).filter("w is not null").select("record_id", "w.*")


def rr(detected: DataFrame) -> DataFrame:
    """``record_id, beat_no, rr_ms``: the interval that ends at a beat."""
    return detected.select(
        "record_id", F.posexplode_outer(R.rr_intervals(F.col("peaks"), F.col("fs"))).alias("_at", "rr_ms")
    ).filter("rr_ms is not null").select("record_id", (F.col("_at") + 1).alias("beat_no"), "rr_ms")


def rhythm_features(detected: DataFrame) -> DataFrame:
    """Unrounded interval measures per record."""
    series = detected.select("record_id", "peaks", R.rr_intervals(F.col("peaks"), F.col("fs")).alias("_rr"))
    return R.add_interval_features(series, "_rr", "r").select("record_id", F.size("peaks").alias("qrs_count"), "r.*")


def p_wave(detected: DataFrame) -> DataFrame:
    return detected.select("record_id", B.p_wave(F.col("c"), F.col("peaks"), F.col("fs")).alias("p")).select(
        "record_id", "p.*"
    )


def qrs_duration(detected: DataFrame) -> DataFrame:
    return detected.select(
        "record_id", B.qrs_duration(F.col("c"), F.col("peaks"), F.col("fs")).alias("qrs_duration_ms")
    )


def qrs_bounds(detected: DataFrame) -> DataFrame:
    """``record_id, q_on, r_idx, s_off`` of the first 30 beats."""
    return detected.select(
        "record_id", F.explode_outer(B.qrs_bounds(F.col("c"), F.col("peaks"), F.col("fs"))).alias("b")
    ).filter("b is not null").select("record_id", "b.*")


def qt_interval(detected: DataFrame) -> DataFrame:
    c, peaks, fs = F.col("c"), F.col("peaks"), F.col("fs")
    return detected.select("record_id", B.qt_interval(c, B.qrs_bounds(c, peaks, fs), fs).alias("qt_ms"))


def lead_measure(detected: DataFrame, measure, alias: str, leads: list[str] | None = None, centred: bool = True) -> DataFrame:
    """``measure(samples, peaks, fs, lead)`` for every present lead of every record; less their median if ``centred``."""
    samples = centre(F.col("samples")) if centred else F.col("samples")
    return settle(
        leads_long(detected, leads, "peaks").select(
            "record_id",
            "lead",
            measure(samples, F.col("peaks"), F.col("fs"), F.col("lead")).alias(alias),
        )
    )


def st_levels(detected: DataFrame) -> DataFrame:
    """Reported segment level per record and lead: a difference, so the lead need not be centred."""
    found = lead_measure(detected, lambda x, p, fs, lead: L.st_level(x, p, fs), "st_level_mv", centred=False)
    return found.filter(F.col("st_level_mv").isNotNull())


def t_waves(detected: DataFrame) -> DataFrame:
    found = lead_measure(detected, L.t_wave, "t")
    return found.filter(F.col("t").isNotNull()).select("record_id", "lead", "t.*")


def q_waves(detected: DataFrame) -> DataFrame:
    found = lead_measure(detected, lambda c, p, fs, lead: L.deep_q(c, p, fs), "q")
    return found.select("record_id", "lead", "q.*").filter(F.col("q_depth_mv").isNotNull())


def polarity(detected: DataFrame) -> DataFrame:
    found = lead_measure(detected, lambda c, p, fs, lead: L.qrs_polarity(c, p, fs), "p")
    return found.select("record_id", "lead", "p.*")


def axes(detected: DataFrame) -> DataFrame:
    """QRS, P and T axes from leads I and aVF."""
    pair = detected.select(
        "record_id",
        "fs",
        "peaks",
        centre(lead_or_null(detected, "I")).alias("_i"),
        centre(lead_or_null(detected, "aVF")).alias("_f"),
    )
    args = (F.col("_i"), F.col("_f"), F.col("peaks"), F.col("fs"))
    return pair.select(
        "record_id", L.qrs_axis(*args).alias("qrs_axis"), L.p_axis(*args).alias("p_axis"), L.t_axis(*args).alias("t_axis")
    )


def ptfv1(detected: DataFrame) -> DataFrame:
    return detected.select(
        "record_id",
        B.ptfv1(centre(lead_or_null(detected, "V1")), F.col("peaks"), F.col("fs")).alias("ptfv1_mv_ms"),
    )


def signal_quality(detected: DataFrame) -> DataFrame:
    """The quality index of the working lead, with the usable share of all leads."""
    counted = settle(detected.select(
        "record_id", "x", "fs", F.size("peaks").alias("_beats"), _usable_count(detected).alias("_usable"), F.size("lead_names").alias("_leads")
    ))
    found = Q.signal_quality(F.col("x"), F.col("fs"), F.col("_beats"), F.col("_usable"), F.col("_leads"))
    return counted.select("record_id", found.alias("q")).select("record_id", "q.*")


def fibrillatory_power(detected: DataFrame) -> DataFrame:
    lead = settle(detected.select("record_id", "fs", "x"))
    raw = lead.select("record_id", S.band_power(F.col("x"), F.col("fs")).alias("raw"))
    return raw.select("record_id", S.fibrillatory(F.col("raw")).alias("f")).select("record_id", "f.*")


def preview(records: DataFrame, samples: str = "x", points: int = 600) -> DataFrame:
    """At most ``points`` evenly spaced samples less their median, over the largest absolute one."""
    return records.select("record_id", preview_values(F.col(samples), points).alias("values"))


def preview_values(x: Column, points: int = 600) -> Column:
    def run(a: Column) -> Column:
        count = F.least(F.lit(points), F.size(a))
        picked = F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda i: F.get(
                a,
                F.when(count > 1, (i * (F.size(a) - 1).cast("double") / F.nullif(count - 1, F.lit(0))).cast("int")).otherwise(0),
            ),
        )
        return F.when(F.size(a) > 0, lets([picked], scale)).otherwise(F.expr("cast(array() as array<double>)"))

    def scale(v: Column) -> Column:
        return lets(
            [median(v)],
            lambda m: lets(
                [F.array_max(F.transform(v, lambda s: F.abs(s - m)))],
                lambda top: F.transform(
                    v, lambda s: F.bround((s - m) / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)), 4)
                ),
            ),
        )

    return lets([x], run)


def missing_leads(records: DataFrame, required: list[str] = STANDARD_LEADS) -> DataFrame:
    return records.select(
        "record_id",
        F.array_except(F.array(*[F.lit(l) for l in required]), F.col("lead_names")).alias("missing_leads"),
    )


def beat_similarity(detected: DataFrame) -> DataFrame:
    """Mean correlation of the beats with the record's mean beat. A cluster count is not defined: NULL."""
    return detected.select(
        "record_id",
        B.beat_similarity(F.col("c"), F.col("peaks"), F.col("fs")).alias("beat_morphology_similarity"),
        F.lit(None).cast("int").alias("beat_cluster_count"),
    )
