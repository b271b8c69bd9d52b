"""Calibration of scores: Platt's line for all datasets in one fit, and isotonic regression across ranges of scores.

Both work on cells, a row for each different score with its weight, so repeated scores cost nothing.

Platt: Newton's steps on slope and intercept. One aggregation gives gradient and curvature of every dataset; a
step's lines are a table with a row for each dataset, not numbers of the driver, so the jobs do not grow with
the datasets.

Isotonic: cells are dealt out by ranges of scores. Adjacent violators are pooled inside each range, which leaves
few blocks, and then inside pairs of neighbouring ranges, even and odd pairs by turns, until no border is
violated. A block stays a row; a task holds the blocks of two ranges at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalframe.operators.evaluation import OVERALL
from signalframe.session import materialise

STEPS = 60  # Newton's steps at most
SETTLED = 1e-11  # a step that moves no line by more is the last
LONGEST = 8.0  # of a step, so that separable scores end at a steep line instead of at infinity
DATASETS = 1_000_000  # whose lines are broadcast
RANGE = 500_000  # different scores of a range


def logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), p))
    return F.ln(safe / (1.0 - safe))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def platt_lines(predictions: DataFrame, key: str = "dataset") -> DataFrame:
    """``key, slope, intercept``: the label on the logit of the score, without penalty, for every key at once.

    Rows without score or label are left out; a key with one label only has the line that the last step reached.
    """
    cells = materialise(
        predictions.where("y_true is not null and y_score is not null")
        .groupBy(key, "y_score").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("hits"))
        .select(key, logit(F.col("y_score")).alias("x"), F.col("n").cast("double").alias("n"), F.col("hits").cast("double").alias("hits"))
    )
    lines = materialise(cells.groupBy(key).agg(F.lit(0.0).alias("slope"), F.lit(0.0).alias("intercept"), F.lit(float("inf")).alias("moved")))
    small = lines.count() <= DATASETS
    for _ in range(STEPS):
        beside = cells.join(F.broadcast(lines) if small else lines, key)
        p = sigmoid(F.col("slope") * F.col("x") + F.col("intercept"))
        w, r = F.col("n") * p * (1.0 - p), F.col("hits") - F.col("n") * p
        sums = beside.groupBy(key, "slope", "intercept").agg(
            F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"),
            F.sum(w * F.col("x") * F.col("x")).alias("h11"),
        )
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        able = det > 1e-12 * F.col("h00") * F.col("h11")  # else all scores are one, and only the intercept moves
        up = F.when(able, (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det).otherwise(F.try_divide(F.col("g0"), F.col("h00")))
        tilt = F.when(able, (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det).otherwise(0.0)
        stepped = sums.select(key, "slope", "intercept", F.coalesce(up, F.lit(0.0)).alias("up"), F.coalesce(tilt, F.lit(0.0)).alias("tilt"))
        size = F.greatest(F.abs("up"), F.abs("tilt"))
        share = F.when(size > LONGEST, LONGEST / size).otherwise(1.0)
        lines = materialise(stepped.select(
            key, (F.col("slope") + share * F.col("tilt")).alias("slope"), (F.col("intercept") + share * F.col("up")).alias("intercept"), size.alias("moved")
        ))
        if (lines.agg(F.max("moved")).first()[0] or 0.0) <= SETTLED:
            break
    return lines.drop("moved")


def with_overall(predictions: DataFrame) -> DataFrame:
    """Every row twice, under its dataset and under the whole; a row without dataset under the whole only."""
    named = F.filter(F.array(F.col("dataset"), F.lit(OVERALL)), lambda d: d.isNotNull())
    return predictions.select("y_true", "y_score", F.explode(named).alias("dataset"))


# --- isotonic ----------------------------------------------------------------------------------


def pool(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The first position of each block after pooling adjacent violators: blocks' means rise strictly."""
    start, w, s = [], [], []
    for i, (a, b) in enumerate(zip(weight.tolist(), total.tolist())):
        start.append(i)
        w.append(a)
        s.append(b)
        while len(w) > 1 and s[-2] * w[-1] >= s[-1] * w[-2]:  # means compared without dividing
            last_w, last_s = w.pop(), s.pop()
            start.pop()
            w[-1] += last_w
            s[-1] += last_s
    return np.array(start, dtype=np.int64)


_BLOCKS = "part long, low double, high double, weight double, total double"


def _pooled(table: pa.Table) -> pa.Table:
    """The blocks of one or two ranges, pooled; a block belongs to the range it begins in."""
    t = table.sort_by("low")
    weight, total = (t.column(c).to_numpy() for c in ("weight", "total"))
    start = pool(weight, total)
    last = np.append(start[1:], len(weight)) - 1
    return pa.table({
        "part": t.column("part").to_numpy()[start], "low": t.column("low").to_numpy()[start], "high": t.column("high").to_numpy()[last],
        "weight": np.add.reduceat(weight, start), "total": np.add.reduceat(total, start),
    })


def _borders(blocks: DataFrame) -> DataFrame:
    """A row for each range: its last block's mean, and the first one's of the next range, in order of ranges."""
    mean = F.col("total") / F.col("weight")
    ends = blocks.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
    order = Window.orderBy("part")  # a row for each range of a half million scores
    return ends.select("part", F.row_number().over(order).alias("at"), (F.col("last") >= F.lead("first").over(order)).alias("violated"))


def isotonic_blocks(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, blocks): different scores with their range, and the final blocks ``part, low, high, weight, total``."""
    cells = predictions.where("y_true is not null and y_score is not null").groupBy("y_score").agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col("y_true").cast("double")).alias("total")
    )
    cells = materialise(cells)
    parts = max(1, -(-cells.count() // RANGE))
    dealt = materialise(cells.repartitionByRange(parts, "y_score").withColumn("part", F.spark_partition_id().cast("long")))
    blocks = dealt.select("part", F.col("y_score").alias("low"), F.col("y_score").alias("high"), "weight", "total")
    blocks = materialise(blocks.groupBy("part").applyInArrow(_pooled, _BLOCKS))
    turn = 0
    while True:
        borders = materialise(_borders(blocks))
        if borders.where("violated").isEmpty():
            return dealt, blocks
        pairs = borders.select("part", F.floor((F.col("at") + turn % 2) / 2).alias("pair"))
        joined = blocks.join(F.broadcast(pairs), "part")
        blocks = materialise(joined.groupBy("pair").applyInArrow(lambda t: _pooled(t.drop_columns(["pair"])), _BLOCKS))
        turn += 1


def isotonic(predictions: DataFrame) -> DataFrame:
    """Add ``calibrated``: the rising step function of the score nearest to the labels, fitted on the same rows.

    Rows without a score have none; rows without a label take the step of their score, or none if it has no label.
    """
    cells, blocks = isotonic_blocks(predictions)
    value = F.col("total") / F.col("weight")
    # a block reaches into the ranges after its own: each range begins with the last block before it
    order = Window.orderBy("part")
    lasts = blocks.groupBy("part").agg(F.max_by(value, "low").alias("last"))
    every = cells.select("part").distinct().join(lasts, "part", "left")
    carried = every.select("part", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    marks = cells.select("part", F.col("y_score").alias("low"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("cell")).unionAll(
        blocks.select("part", "low", value, F.lit(False))
    )
    inside = Window.partitionBy("part").orderBy("low", "cell").rowsBetween(Window.unboundedPreceding, 0)
    steps = marks.withColumn("value", F.last("value", ignorenulls=True).over(inside)).where("cell")
    steps = steps.join(F.broadcast(carried), "part").select(F.col("low").alias("y_score"), F.coalesce("value", "carried").alias("calibrated"))
    return predictions.join(steps, "y_score", "left")
