"""Waveform records derived from the rows of the ``customer`` table.

One 10 s, 12-lead record per customer at 100 Hz, by plain arithmetic on the key, so that any SQL
engine can derive the same rows. The parameters vary by key: regular and irregular rhythm, wide
complexes, deep first deflections, segment shifts by territory, axis, noise, drift, flat leads,
missing samples and missing leads all occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from signalframe.schemas import STANDARD_LEADS
from signalframe.session import default_partitions

FS = 100.0
N = 1000
BEFORE, AFTER = 40, 70  # extent of one beat around its peak, in samples
BEATS = 16
REACH = 131  # a beat starting this long before a sample cannot touch it
BATCH_SAMPLES = 1 << 20  # samples of all leads that are derived at once, 8 MB

# Per-record parameters as SQL text over ``k``; valid in Spark and in DuckDB.
PARAMETERS = {
    "period": "60 + (k * 7) % 60",
    "af": "k % 5 = 0",
    "p_amp": "CASE WHEN k % 5 = 0 THEN 0.0E0 WHEN k % 7 = 3 THEN 0.4E0 ELSE 0.15E0 END",
    "q_amp": "CASE WHEN k % 9 = 2 THEN -0.4E0 ELSE -0.1E0 END",
    "r_sigma": "CASE WHEN k % 11 = 4 THEN 4.0E0 ELSE 1.2E0 END",
    "t_amp": "CASE WHEN k % 6 = 1 THEN -0.3E0 ELSE 0.3E0 END",
    "noise": "(k % 10) * 0.01E0",
    "drift": "CASE WHEN k % 6 = 5 THEN 0.1E0 ELSE 0.0E0 END",
    "fwave": "CASE WHEN k % 5 = 0 THEN 0.05E0 ELSE 0.0E0 END",
    "age": "CAST(20 + k % 70 AS DOUBLE)",
    "sex": "CASE WHEN k % 10 = 9 THEN NULL WHEN k % 2 = 1 THEN 'male' ELSE 'Female' END",
}

# Per-lead factors and segment shifts as SQL text over ``k``.
GAIN = {
    "I": "CASE k % 4 WHEN 0 THEN 0.6E0 WHEN 1 THEN 0.7E0 WHEN 2 THEN -0.5E0 ELSE -0.6E0 END",
    "II": "1.0E0",
    "III": "0.4E0",
    "aVR": "-0.8E0",
    "aVL": "CASE WHEN k % 8 = 6 THEN 2.0E0 ELSE 0.1E0 END",
    "aVF": "CASE k % 4 WHEN 0 THEN 0.7E0 WHEN 1 THEN -0.6E0 WHEN 2 THEN 0.8E0 ELSE -0.5E0 END",
    "V1": "CASE WHEN k % 3 = 0 THEN 0.5E0 ELSE -0.5E0 END",
    "V2": "-0.3E0",
    "V3": "0.3E0",
    "V4": "CASE WHEN k % 17 = 0 THEN 0.0E0 ELSE 0.9E0 END",
    "V5": "CASE WHEN k % 8 = 5 THEN 3.3E0 ELSE 1.1E0 END",
    "V6": "CASE WHEN k % 3 = 0 THEN -0.35E0 ELSE 0.85E0 END",
}
SHIFT = {
    "I": "CASE k % 13 WHEN 2 THEN -0.15E0 WHEN 5 THEN 0.2E0 ELSE 0.0E0 END",
    "II": "CASE k % 13 WHEN 2 THEN 0.25E0 WHEN 6 THEN -0.2E0 ELSE 0.0E0 END",
    "III": "CASE k % 13 WHEN 2 THEN 0.25E0 WHEN 6 THEN -0.2E0 ELSE 0.0E0 END",
    "aVR": "0.0E0",
    "aVL": "CASE k % 13 WHEN 2 THEN -0.15E0 WHEN 5 THEN 0.2E0 ELSE 0.0E0 END",
    "aVF": "CASE k % 13 WHEN 2 THEN 0.25E0 WHEN 6 THEN -0.2E0 ELSE 0.0E0 END",
    "V1": "CASE k % 13 WHEN 1 THEN 0.3E0 ELSE 0.0E0 END",
    "V2": "CASE k % 13 WHEN 1 THEN 0.3E0 WHEN 8 THEN -0.2E0 ELSE 0.0E0 END",
    "V3": "CASE k % 13 WHEN 1 THEN 0.3E0 WHEN 8 THEN -0.2E0 ELSE 0.0E0 END",
    "V4": "CASE k % 13 WHEN 1 THEN 0.3E0 WHEN 8 THEN -0.2E0 ELSE 0.0E0 END",
    "V5": "CASE k % 13 WHEN 5 THEN 0.2E0 ELSE 0.0E0 END",
    "V6": "CASE k % 13 WHEN 5 THEN 0.2E0 ELSE 0.0E0 END",
}
# A lead is absent when this holds; a sample of V5 is missing when GAP holds.
ABSENT = {
    "I": "k % 23 = 8",
    "II": "k % 23 = 7 OR k % 23 = 8",
    "III": "k % 23 = 8",
    "aVR": "k % 23 = 8",
    "aVL": "k % 23 = 8",
    "aVF": "k % 23 = 8 OR k % 29 = 2",
    "V1": "k % 23 = 8",
}
# Binary steps keep sums exact. The rounding offset is not one half: the noise lies on a decimal
# lattice whose halves would fall either way.
STEPS = 1024.0
ROUNDING = 0.3333333
GAP = "k % 19 = 3 AND idx >= 500 AND idx < 510"


def _peaks(k: np.ndarray, period: np.ndarray, irregular: np.ndarray) -> np.ndarray:
    """Peak index per record and beat; beats past the end are pushed out of reach."""
    b = np.arange(BEATS + 3)
    jitter = np.where(irregular[:, None], (b * b * 17 + k[:, None] * 11) % 35 - 17, 0)
    peak = 50 + b * period[:, None] + jitter
    return np.where((peak < 960) & (b < BEATS), peak, 10 * N)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def true_peaks(k: pd.Series, period: pd.Series, irregular: pd.Series) -> pd.Series:
    peaks = _peaks(k.to_numpy(), period.to_numpy(), irregular.to_numpy(bool))
    return pd.Series([row[row < N] for row in peaks.astype("int32")])


def _sample_builder(leads: list[str]):
    """An Arrow function from the parameters to a struct of the samples of ``leads``.

    Samples are quantised to binary steps like a 16-bit record. A narrow batch of parameters leaves as many
    batches of bounded bytes, so that neither side holds the samples of a whole batch of 10,000 rows.
    """
    step = max(1, BATCH_SAMPLES // (N * len(leads)))
    kind = T.StructType([T.StructField(l, T.ArrayType(T.DoubleType())) for l in leads])

    def build(p: pa.StructArray) -> pa.StructArray:
        rows = len(p)
        col = {f.name: p.field(f.name).to_numpy(zero_copy_only=False)[:, None] for f in p.type}
        k, i, j = col["k"], np.arange(N)[None, :], np.arange(-BEFORE, AFTER + 1)[None, :]
        beat = (
            col["p_amp"] * np.exp(-((j + 16.0) ** 2) / 8.0)
            + col["q_amp"] * np.exp(-((j + 3.0) ** 2) / 2.0)
            + np.exp(-(j * j) / (2.0 * col["r_sigma"] ** 2))
            - 0.2 * np.exp(-((j - 3.0) ** 2) / 2.0)
            + col["t_amp"] * np.exp(-((j - 28.0) ** 2) / 32.0)
        )
        beat = np.concatenate([beat, np.zeros((rows, 1))], axis=1)
        bump = np.concatenate([np.exp(-((j - 10.0) ** 2) / 18.0), np.zeros((1, 1))], axis=1)[0]
        peaks = _peaks(k[:, 0], col["period"][:, 0], col["af"][:, 0].astype(bool))
        first = np.maximum(0, -((REACH - i) // col["period"]))
        base = (
            col["fwave"] * np.sin(0.12 * np.pi * i)
            + col["drift"] * np.sin(0.006 * np.pi * i)
            + col["noise"] * ((i * 7919 + k * 104729) % 1000 / 1000.0 - 0.5)
        )
        segment = np.zeros((rows, N))
        for step in range(3):  # at most three beats reach a sample
            at = i - np.take_along_axis(peaks, np.minimum(first + step, BEATS + 2), axis=1) + BEFORE
            at = np.where((at >= 0) & (at <= BEFORE + AFTER), at, BEFORE + AFTER + 1)
            base = base + np.take_along_axis(beat, at, axis=1)
            segment = segment + bump[at]
        ends = pa.array(np.arange(0, (rows + 1) * N, N, dtype="int32"))
        arrays = []
        for lead in leads:
            value = col[f"gain_{lead}"] * base + col[f"shift_{lead}"] * segment
            steps = np.floor(value * STEPS + ROUNDING) / STEPS
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(steps.ravel())))
        return pa.StructArray.from_arrays(arrays, names=leads)

    def run(batches: Iterator[pa.StructArray]) -> Iterator[pa.StructArray]:
        for p in batches:
            for at in range(0, len(p), step):
                yield build(p.slice(at, step))

    # Spark reads these to tell the kind of function; text annotations would not do.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def parameters(customers: DataFrame) -> DataFrame:
    """One row per customer with the parameters of its record."""
    keyed = customers.select(
        F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey")
    )
    return keyed.selectExpr("*", *[f"{sql} AS {name}" for name, sql in PARAMETERS.items()])


def waveforms(customers: DataFrame, leads: list[str] = STANDARD_LEADS, spread: int | None = None) -> DataFrame:
    """``records`` (see :func:`signalframe.schemas.records_schema`) plus the parameters.

    A narrow customer row becomes about 100 kB, so the narrow rows are spread first. Only ``leads``
    are derived; the names of a record always list all of them.
    """
    rows = parameters(customers).withColumn("record_id", F.col("k").cast("string"))
    if spread != 0:
        rows = rows.repartition(spread or default_partitions(rows), "record_id")
    shared = [F.col(c) for c in ("k", "period", "af", "p_amp", "q_amp", "r_sigma", "t_amp", "noise", "drift", "fwave")]
    factors = [
        F.expr(sql[l]).alias(f"{kind}_{l}") for l in leads for kind, sql in (("gain", GAIN), ("shift", SHIFT))
    ]
    if leads:
        rows = rows.withColumn("_samples", _sample_builder(leads)(F.struct(*shared, *factors)))

    def lead(name: str) -> Column:
        samples = F.col("_samples")[name]
        if name == "V5":
            samples = F.when(
                F.expr("k % 19 = 3"),
                F.transform(samples, lambda v, i: F.when(~((i >= 500) & (i < 510)), v)),
            ).otherwise(samples)
        if name in ABSENT:
            samples = F.when(~F.expr(ABSENT[name]), samples)
        return samples.alias(name)

    names = F.array(*[
        F.when(~F.expr(ABSENT[l]), F.lit(l)) if l in ABSENT else F.lit(l) for l in STANDARD_LEADS
    ])
    return rows.select(
        "record_id",
        "dataset",
        F.lit(FS).alias("fs"),
        F.lit(N).alias("n"),
        F.filter(names, lambda l: l.isNotNull()).alias("lead_names"),
        F.array_compact(
            F.array(
                F.concat(F.lit("age: "), F.col("age").cast("int").cast("string")),
                F.concat(F.lit("Sex: "), F.col("sex")),
            )
        ).alias("comments"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("metadata"),
        F.struct(*[lead(l) for l in leads]).alias("leads"),
        "k", "age", "sex",
        true_peaks("k", "period", "af").alias("truth"),
    )


def records(spark: SparkSession, sf_dir: str, leads: list[str] = STANDARD_LEADS) -> DataFrame:
    return waveforms(spark.read.parquet(f"{sf_dir}/customer.parquet"), leads)
