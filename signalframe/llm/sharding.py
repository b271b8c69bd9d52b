"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each partition sends to each bucket is drawn first, from the law that a uniform shuffle obeys:
the matrix of counts is hypergeometric, with the partitions' and the buckets' sizes as margins. Then every
partition permutes its rows and deals them out by these counts, the rows are exchanged, and every bucket
permutes what it got. All permutations of the rows are equally likely, and no size is left to chance.

A shard is a run of buckets of bounded size, so a shard may hold any number of rows. No task draws the whole
matrix: a partition finds its row by splitting the buckets' sizes along a binary tree over the partitions,
each node with its own seed, so the halves agree wherever they are drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from signalframe.llm.common import column, materialise

BUCKET_ROWS = 1 << 20  # a shard is cut into buckets of this size, each permuted in one task
EXACT = 1_000_000_000  # rows up to which numpy draws from the hypergeometric law; more are drawn here


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; two differ by one at most."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def bucket_sizes(rows: int, shards: int, bucket_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, size) of all buckets, in order."""
    sizes = shard_sizes(rows, shards)
    parts = np.maximum(1, -(-sizes // bucket_rows))
    shard = np.repeat(np.arange(shards), parts)
    return shard, np.concatenate([shard_sizes(s, p) for s, p in zip(sizes, parts)]) if shards else sizes


def matrix_row(counts: np.ndarray, buckets: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """How many rows the partition sends to each bucket."""
    before = np.concatenate(([0], np.cumsum(counts)))
    lo, hi, left = 0, len(counts), buckets.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        own = _split(left, int(before[mid] - before[lo]), np.random.default_rng([seed, lo, hi]))
        lo, hi, left = (lo, mid, own) if partition < mid else (mid, hi, left - own)
    return left


def _split(colors: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of n."""
    total = int(colors.sum())
    if total < EXACT:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    out, rest = np.zeros_like(colors), total
    for k, c in enumerate(colors.tolist()):
        rest -= c
        out[k] = _marginal(c, rest, n, rng)
        n -= int(out[k])
    return out


def _marginal(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n are good."""
    if good + bad < EXACT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    return hypergeometric(good, bad, n, rng)


URN = 64  # draws that are made one by one


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """A draw from the hypergeometric law at any size.

    Few draws are made from an urn; else ratio of uniforms with Stadlober's hat, which accepts a place by the law's
    logarithm there less that at its mode, so that large factorials never have to be subtracted.
    """
    if good > bad:
        return n - hypergeometric(bad, good, n, rng)
    if 2 * n > good + bad:
        return good - hypergeometric(good, bad, good + bad - n, rng)
    if n > good:  # which are good and which are drawn may change places
        return hypergeometric(n, good + bad - n, good, rng)
    total = good + bad
    if n <= URN:
        found = 0
        for k in range(n):
            found += int(rng.integers(total - k)) < good - found
        return found
    share = good / total
    centre = n * share + 0.5
    width = math.sqrt((total - n) * n * share * (1 - share) / (total - 1) + 0.5)
    hat = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    mode = (n + 1) * (good + 1) // (total + 2)
    last = min(n, good, int(centre + 16 * width))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        place = centre + hat * (v - 0.5) / u
        if not 0 <= place < last + 1:
            continue
        k = int(place)
        log = _log_ratio(mode, k) + _log_ratio(good - mode, good - k) + _log_ratio(n - mode, n - k) + _log_ratio(bad - n + mode, bad - n + k)
        if 2 * math.log(u) <= log:
            return k


def _log_ratio(a: int, b: int) -> float:
    """ln(a! / b!), to the accuracy of the result however large both are."""
    if a == b:
        return 0.0
    if min(a, b) < 100:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return (a + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(b) - 1) + rest(a) - rest(b)


def shuffle(rows: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of `rows` with `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard).

    Counts of shards differ by one at most, and every arrangement is equally likely. The rows are stored
    once with their partition and their place in it, so that a repeated task deals them out as before; rows
    that are equal in all columns are still different rows, nulls are values like any other, and an empty
    table gives no rows. Input columns `shard` and `slot` are replaced.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    kept = [f"_shuffle_c{i}" for i in range(len(names))]
    stored = materialise(rows.select(*[column(c).alias(k) for c, k in zip(names, kept)], F.monotonically_increasing_id().alias("_shuffle_row")))
    part = F.shiftright("_shuffle_row", 33)  # the id's upper bits are the partition, the lower ones the place
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
    counts = np.array([r["n"] for r in sizes], dtype=np.int64)
    shard, buckets = bucket_sizes(int(counts.sum()), shards, bucket_rows)
    shared = spark.sparkContext.broadcast(({r["part"]: k for k, r in enumerate(sizes)}, counts, buckets))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, all_counts, all_buckets = shared.value
        known, to = None, None
        for batch in batches:
            row = batch.column("_shuffle_row").to_numpy()
            own, place = row >> 33, row & ((1 << 33) - 1)
            bucket = np.empty(len(row), dtype=np.int64)
            for p in np.unique(own).tolist():
                if p != known:
                    sent = matrix_row(all_counts, all_buckets, index[p], seed)
                    order = np.random.default_rng([seed, p, 1]).permutation(int(all_counts[index[p]]))
                    known, to = p, np.repeat(np.arange(len(sent)), sent)[order]
                mine = own == p
                bucket[mine] = to[place[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "_shuffle_bucket"])

    kind = StructType([*stored.schema.fields, StructField("_shuffle_bucket", LongType())])
    base = np.cumsum(buckets) - buckets
    starts = pd.DataFrame({
        "_shuffle_bucket": np.arange(len(buckets)), "shard": shard.astype(np.int32),
        "_shuffle_base": base - base[np.searchsorted(shard, shard)],
    })
    again = Window.partitionBy("_shuffle_bucket").orderBy(F.xxhash64(F.lit(seed), F.col("_shuffle_row")), "_shuffle_row")
    dealt = stored.mapInArrow(deal, kind).withColumn("_shuffle_rank", F.row_number().over(again) - 1)
    placed = dealt.join(spark.createDataFrame(starts), "_shuffle_bucket")
    return placed.select(*[F.col(k).alias(c) for c, k in zip(names, kept)], "shard", (F.col("_shuffle_base") + F.col("_shuffle_rank")).alias("slot"))
