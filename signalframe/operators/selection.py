"""Exact order statistics and exact seeded splits that never put a whole group into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

REFINE_ROWS = 2_000_000  # distinct candidate values that are ranked in one step


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact quantile (linear interpolation) of each column, missing values skipped.

    A sketch brackets the wanted ranks, a second pass counts what lies below the bracket and keeps
    what lies inside, and the bracket shrinks until the inside is small. Only a handful of numbers
    per column reaches the driver.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    live = [c for c in columns if counts[c]]
    result: dict[str, float | None] = {c: None for c in columns}
    bounds: dict[str, tuple[float, float]] = {}
    below = {c: 0 for c in live}
    size = {c: counts[c] for c in live}
    ranks = {c: (math.floor((counts[c] - 1) * q), math.ceil((counts[c] - 1) * q)) for c in live}
    margin = 3.0 / accuracy
    while live:
        wide = [c for c in live if size[c] > 0]
        sketch = df.agg(*[
            F.percentile_approx(
                F.when(_inside(c, bounds), F.col(c)),
                F.array(
                    F.lit(max(0.0, (ranks[c][0] - below[c]) / size[c] - margin)),
                    F.lit(min(1.0, (ranks[c][1] - below[c] + 1) / size[c] + margin)),
                ),
                F.lit(accuracy),
            ).alias(c)
            for c in wide
        ]).first()
        for c in wide:
            bounds[c] = (sketch[c][0], sketch[c][1])
        tally = df.agg(*[
            part
            for c in live
            for part in (
                F.count_if(F.col(c) < F.lit(bounds[c][0])).alias(f"{c}__below"),
                F.count_if(_inside(c, bounds)).alias(f"{c}__inside"),
            )
        ]).first()
        shrunk = False
        for c in live:
            shrunk |= tally[f"{c}__inside"] < size[c]
            below[c], size[c] = tally[f"{c}__below"], tally[f"{c}__inside"]
        if not shrunk or max(size[c] for c in live) <= REFINE_ROWS:
            break
    if live:
        inside = df.select(
            F.explode(
                F.filter(
                    F.array(*[
                        F.when(_inside(c, bounds), F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")))
                        for c in live
                    ]),
                    lambda s: s.isNotNull(),
                )
            ).alias("s")
        )
        cells = inside.groupBy("s.name", "s.value").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("name").orderBy("value"))
        ranked = cells.withColumn("upto", upto)
        wanted = []
        for c in live:
            for tag, rank in zip(("low", "high"), ranks[c]):
                at = rank - below[c]
                wanted.append(
                    F.min(F.when((F.col("name") == c) & (F.col("upto") > at), F.col("value"))).alias(f"{c}__{tag}")
                )
        found = ranked.agg(*wanted).first()
        for c in live:
            low, high = found[f"{c}__low"], found[f"{c}__high"]
            result[c] = low + (high - low) * ((counts[c] - 1) * q - ranks[c][0])
    return result


def _inside(column: str, bounds: dict[str, tuple[float, float]]) -> Column:
    if column not in bounds:
        return F.col(column).isNotNull()
    low, high = bounds[column]
    return (F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))


def seeded_order(key: Column, seed: int) -> Column:
    """A text that orders rows at random but reproducibly, in any engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(share * n)`` rows per label, chosen by a seeded order of the key.

    Per label only the count of each of a million slices of the order is needed, then the rows of the one
    slice in which the quota is reached. The cut-off is one text per label; the rows themselves are
    never moved.
    """
    order = seeded_order(F.col(key), seed)
    keyed = df.select(F.col(label).alias("_y"), order.alias("_o"), F.substring(order, 1, 5).alias("_slice"))
    slices = keyed.groupBy("_y", "_slice").agg(F.count(F.lit(1)).alias("n"))
    by_label = Window.partitionBy("_y")
    upto = F.sum("n").over(by_label.orderBy("_slice"))
    quota = F.ceil(F.sum("n").over(by_label) * F.lit(float(test_share)))
    edge = (
        slices.select("_y", "_slice", upto.alias("upto"), (upto - F.col("n")).alias("before"), quota.alias("quota"))
        .filter((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("upto")))
        .select("_y", "_slice", (F.col("quota") - F.col("before")).alias("take"))
    )
    # One row per label: the labels of a classification task are few by definition.
    last = Window.partitionBy("_y").orderBy("_o")
    cuts = (
        keyed.join(F.broadcast(edge), ["_y", "_slice"])
        .withColumn("_at", F.row_number().over(last))
        .filter(F.col("_at") == F.col("take"))
        .select(F.col("_y"), F.col("_o").alias("_cut"))
    )
    return (
        df.join(F.broadcast(cuts), df[label].eqNullSafe(F.col("_y")), "left")
        .withColumn("is_test", F.coalesce(order <= F.col("_cut"), F.lit(False)))
        .drop("_y", "_cut")
    )


def group_split(df: DataFrame, group: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Add ``is_test`` so that all rows of a group (a patient) fall on one side."""
    part = F.conv(F.substring(seeded_order(F.col(group), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", F.coalesce(part < int(2 ** 32 * test_percent / 100), F.lit(False)))
