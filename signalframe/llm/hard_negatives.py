"""Hard negatives by slots between the positives' limits.

An anchor's positives are its best rows of the same label. Each allows negatives in a window of scores between a
lower and an upper share of its own score; the windows of one anchor overlap. Their upper limits cut the scores
into disjoint slots. A task keeps the first `k` rows of each slot it sees, a combiner the first `k` of each slot
over all tasks, and a merge of the slots from the lowest up gives for each limit the first `k` rows below it.
So a row of the table is looked at once for all positives, and a window's answer is one of these merges, less
what lies below its lower limit.

Anchors and rows are dealt into blocks by hashes of their place, and a task meets one block of each; nothing
passes the driver but two counts. Scores are products of whole numbers: by doubles while these are exact, in
numbers of any length beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalframe.llm.common import column, materialise

POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # percent of the positive's score
SCALE = 256
ANCHORS = 2048  # of a block
ROWS = 8192  # of a block
NUMBERS = 1 << 20  # scores that a task holds at once

_EXACT = 1 << 53
_MOST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _numbers(part: pa.Table, name: str) -> np.ndarray:
    """The whole numbers of a block, one row per vector, as doubles."""
    chunks = part.column(name).combine_chunks()
    flat = chunks.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(flat * SCALE)).reshape(len(chunks), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; of Python's numbers where doubles would round, 64 bits at most."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    exact = whole(a).dot(whole(b).T)
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the places `at`: higher scores first, ties by id."""
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], same_label: bool, function, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, once; of one label only, where asked.

    Rows are sent once for each block of anchors, anchors once for each block of rows.
    """
    a, r = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # else Spark takes both sides' columns for the same
    left = fresh.withColumn("a", F.pmod(F.xxhash64("place"), F.lit(a)).cast("int")).withColumn("r", every(r))
    right = rows.withColumn("r", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(r)).cast("int")).withColumn("a", every(a))
    keys = ["a", "r", "dimension"] + (["label"] if same_label else [])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


_POSITIVE = pa.schema([("place", pa.int64()), ("positive_place", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([
    ("place", pa.int64()), ("slot", pa.int32()), ("negative_place", pa.int64()), ("negative_id", pa.int64()), ("score", pa.int64()),
])


def _scored(left: pa.Table, right: pa.Table):
    """Each anchor of the block, by number, with the scores of all rows of the block."""
    theirs, mine = _numbers(right, "embedding"), _numbers(left, "embedding")
    step = max(1, NUMBERS // right.num_rows)
    for at in range(0, left.num_rows, step):
        yield from enumerate(products(mine[at: at + step], theirs), at)


def _find_positives(k: int):
    """A function from a block of anchors and one of rows of their label to the first k rows of each anchor."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in _POSITIVE]
        if left.num_rows and right.num_rows:
            own, places, ids = (t.column(c).to_numpy() for t, c in ((left, "place"), (right, "place"), (right, "vec_id")))
            for i, scores in _scored(left, right):
                best = _best(scores, ids, np.flatnonzero(places != own[i]), k)
                for held, values in zip(out, (np.full(len(best), own[i]), places[best], ids[best], scores[best])):
                    held.append(values)
        return pa.table([pa.array(np.concatenate(held)) for held in out], schema=_POSITIVE)

    return run


def _find_negatives(k: int):
    """A function from a block of anchors with their limits to the first k rows of each slot.

    `uppers` fall; slot j holds the scores up to the j-th and above the next, the last one those down to `lowest`.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in _NEGATIVE]
        if left.num_rows and right.num_rows:
            own, places, ids = (t.column(c).to_numpy() for t, c in ((left, "place"), (right, "place"), (right, "vec_id")))
            mine, labels, lowest = (t.column(c).to_numpy() for t, c in ((left, "label"), (right, "label"), (left, "lowest")))
            uppers = [np.array(x, dtype=np.int64) for x in left.column("uppers").to_pylist()]
            for i, scores in _scored(left, right):
                at = np.flatnonzero((labels != mine[i]) & (scores <= uppers[i][0]) & (scores >= lowest[i]))
                slots = np.searchsorted(-uppers[i], -scores[at], side="right") - 1
                for slot in np.unique(slots).tolist():
                    best = _best(scores, ids, at[slots == slot], k)
                    n = len(best)
                    for held, values in zip(out, (np.full(n, own[i]), np.full(n, slot), places[best], ids[best], scores[best])):
                        held.append(values)
        return pa.table([pa.array(np.concatenate(held).astype(f.type.to_pandas_dtype())) for held, f in zip(out, _NEGATIVE)], schema=_NEGATIVE)

    return run


def _percent(score: Column, share: int, up: bool) -> Column:
    """`share` percent of a score of zero or more, rounded down or up, without leaving 64 bits."""
    rest = F.col("score") % 100 * share
    return F.expr("score div 100") * share + F.floor((rest + (99 if up else 0)) / 100)


def mine(
    vectors: DataFrame, anchor: Column, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` is a condition on the columns `vec_id` and `label`. A score is the inner product of the components'
    floor(256 * x); higher ones come first, ties by smaller id. An anchor's positives are its first `positives`
    other rows of its label. For each, the first `negatives` rows of another label whose score is between `lower`
    and `upper` percent of the positive's, both included; a positive with a negative score allows none.

    Rows with a null id, a null label, a null or empty vector, or any null or non-finite component take no part.
    Vectors meet those of their own length. Repeated rows are rows of their own, a copy of the anchor its
    positive. A score beyond 64 bits counts as the nearest number that has them. Other columns are not read; no
    anchors give no rows. `upper` is 100 at most.
    """
    v = F.col("embedding")
    base = vectors.select(
        column(id).cast("long").alias("vec_id"), column(label).cast("long").alias("label"), column(embedding).alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(v))
    rows = materialise(base.select("*", F.size(v).alias("dimension"), F.monotonically_increasing_id().alias("place")))
    anchors = rows.where(anchor)
    size = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors")).first()
    blocks = max(1, -(-size["anchors"] // ANCHORS)), max(1, -(-size["n"] // ROWS))

    near = _meet(anchors, rows, blocks, True, _find_positives(positives), "place long, positive_place long, positive_id long, score long")
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "positive_id", "positive_place")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # a positive below zero has its upper limit below its lower one
    limits = near.where("score >= 0").select(
        "place", "nth", "positive_id", "score", _percent(F.col("score"), upper, False).alias("high"), _percent(F.col("score"), lower, True).alias("low")
    )
    wanted = materialise(limits.groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score", "high", "low"))).alias("wanted"),  # `positives` at most
        F.min("low").alias("lowest"),
    ))
    asked = anchors.join(wanted.select("place", F.col("wanted.high").alias("uppers"), "lowest"), "place")
    found = _meet(asked, rows, blocks, False, _find_negatives(negatives), "place long, slot int, negative_place long, negative_id long, score long")
    order = Window.partitionBy("place", "slot").orderBy(F.col("score").desc(), "negative_id", "negative_place")
    first = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= negatives)
    slots = first.groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("slot", "nth", "negative_id", "score"))).alias("held")  # `positives` times `negatives` at most
    )
    answers = wanted.join(slots, "place").join(anchors.select("place", F.col("vec_id").alias("anchor_id")), "place")
    # from the lowest slot up: the first of what is held there and of the answer below
    merged = F.aggregate(
        F.reverse(F.sequence(F.lit(0), F.size("wanted") - 1)),
        F.array(F.slice("held", 1, 0)),
        lambda done, s: F.concat(
            F.array(F.slice(F.concat(F.filter("held", lambda h: h["slot"] == s), F.element_at(done, 1)), 1, negatives)), done
        ),
    )
    pairs = answers.select("anchor_id", F.posexplode("wanted").alias("nth", "w"), merged.alias("merged"))
    kept = F.filter(F.get("merged", F.col("nth")), lambda h: h["score"] >= F.col("w.low"))
    ranked = pairs.select("anchor_id", "w", F.posexplode(kept).alias("at", "n"))
    return ranked.select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.negative_id").alias("negative_id"),
        F.col("w.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
