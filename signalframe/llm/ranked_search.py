"""Ranked search by a pipeline of term owners.

The terms of the items are dealt to a few owners, from the rarest on, so that each owner holds as many postings.
A bundle of items starts without any document and visits one owner after the other: there it meets the owner's
postings by cogroup, and the items' accumulators, sparse over the documents, take up what these postings add.
After the last owner the accumulators hold the scores, and the best of each item are chosen.

Bundle and postings are cut into the same blocks of documents, so a frequent term is spread over all blocks and
no group grows with the corpus. All contributions are whole and none is negative. So the k-th best sum so far is
a lower bound of the k-th best score, and a document that cannot reach it with the most that the owners still to
come may add is let go. That changes no result.

Postings are kept for terms of the items only. The vocabulary goes to the tasks; it is that of a batch of items
of some megabytes of text. More items are more batches, each a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from signalframe.llm.common import column, materialise, rows, words

TOP = 20
OWNERS = 4
BATCH = 4 << 20  # bytes of items' text in a pass
BUNDLE = 256  # items whose accumulators travel together
PIECE = 1 << 20  # characters of a text that are cut into words at once

_INDEX = "block long, term int, at array<int>, tf array<int>, ids array<long>, n array<long>"
_BUNDLE = "block long, bundle int, item int, at array<int>, value array<long>, best array<long>"
_IDS, _LENGTHS = -2, -1  # rows of a bundle that are not items: the ids and the lengths of its documents


def term_counts(text: str | None) -> Counter:
    """How often each term occurs; a long text is cut between two terms, so that memory holds its counts only."""
    text, out, at = text or "", Counter(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end] >= "\x80" or text[end].isalnum()):
            end += 1
        out.update(words(text[at:end]))
        at = end
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents: a row with their ids and lengths (term -1), and one for each term that occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        known, blocks = shared.value, iter(range(1 << 33))
        task = TaskContext.get().partitionId() << 33

        def run(batch):
            at, tf, lengths = {}, {}, []
            for i, text in enumerate(batch["text"]):
                counts = term_counts(text)
                lengths.append(counts.total())
                for term in known.keys() & counts.keys():
                    t = known[term]
                    at.setdefault(t, []).append(i)
                    tf.setdefault(t, []).append(counts[term])
            terms = sorted(at)
            yield {
                "block": [task + next(blocks)] * (len(terms) + 1), "term": [-1, *terms],
                "at": [None, *(at[t] for t in terms)], "tf": [None, *(tf[t] for t in terms)],
                "ids": [batch["doc_id"], *[None] * len(terms)], "n": [lengths, *[None] * len(terms)],
            }

        return run

    return rows(docs, start, _INDEX, each_task=True)


def _norms(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """75 + (25 * n * count) div total, beyond 64 bits too."""
    if 25 * count * int(n.max(initial=0)) < 1 << 63:
        return 75 + 25 * n * count // total
    return np.array([75 + 25 * int(x) * count // total for x in n], dtype=np.int64)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    column = table.column(name).combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _add(left: pa.Table, right: pa.Table, asked: dict, count: int, total: int):
    """(ids, [(item, sums over the block's documents, changed)]): what a block's bundle holds after an owner's postings.

    `asked` has for each item of the bundle the owner's terms and how often the item holds them.
    """
    held = dict(zip(left.column("item").to_pylist(), zip(_lists(left, "at"), _lists(left, "value"))))
    ids, lengths = held.pop(_IDS)[1], held.pop(_LENGTHS)[1]
    norms = _norms(lengths, count, total)
    adds = {}
    for term, w, at, tf in zip(right.column("term").to_pylist(), right.column("weight").to_pylist(), _lists(right, "at"), _lists(right, "tf")):
        tf = tf.astype(np.int64)
        adds[term] = at, w * (1_000_000_000 * tf // (1000 * tf + 12 * norms[at]))

    def each():
        for item in sorted(asked.keys() | held.keys()):
            terms = [(q, *adds[t]) for t, q in asked.get(item, ()) if t in adds]
            if not terms and item not in held:
                continue
            sums = np.zeros(len(ids), dtype=np.int64)
            if item in held:
                sums[held[item][0]] = held[item][1]
            for q, at, add in terms:
                sums[at] += q * add
            yield item, sums

    return ids, lengths, each()


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, len(values) - k)[len(values) - k:] if len(values) > k else values


def _search(docs: DataFrame, items: list, top: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for a batch of items, given as counts of terms and numbered from 0."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for counts in items for t in counts}))}
    index = materialise(_index(docs, vocabulary))
    size = index.where("term = -1").agg(
        F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("n"),
        F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l"),
    ).first()
    count, total = int(size["n"] or 0), int(size["l"] or 0)
    # a row for each term of the batch
    found = index.where("term >= 0").groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(F.array_max("tf")).alias("most")).collect()
    if not found:
        return None

    found.sort(key=lambda r: (r["df"], r["term"]))
    weights = {r["term"]: weight(count, r["df"]) for r in found}
    mass, ends = sum(r["df"] for r in found), np.cumsum([r["df"] for r in found])
    owners = {r["term"]: min(OWNERS - 1, int((end - 1) * OWNERS // mass)) for r, end in zip(found, ends.tolist())}
    most = {r["term"]: weights[r["term"]] * (10 ** 9 * r["most"] // (1000 * r["most"] + 12 * 75)) for r in found}
    asked = [{} for _ in range(OWNERS)]  # of each owner: bundle, item, its terms
    rest = [[0] * len(items) for _ in range(OWNERS)]  # the most that the owners after it can add to an item
    for i, counts in enumerate(items):
        for term, q in counts.items():
            t = vocabulary[term]
            if weights.get(t):
                asked[owners[t]].setdefault(i // BUNDLE, {}).setdefault(i, []).append((t, q))
                for k in range(owners[t]):
                    rest[k][i] += q * most[t]

    bundles = -(-len(items) // BUNDLE)
    header = index.where("term = -1").withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    none = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<long>)")
    state = header.select("block", "bundle", F.lit(_IDS).alias("item"), none[0].alias("at"), F.col("ids").alias("value"), none[1].alias("best")).unionAll(
        header.select("block", "bundle", F.lit(_LENGTHS), none[0], F.col("n"), none[1])
    )
    bounds = [0] * len(items)
    for k in range(OWNERS):
        uses = [(t, b, weights[t]) for b, held in asked[k].items() for t in {t for terms in held.values() for t, _ in terms}]
        listed = pa.table([pa.array(c, x) for c, x in zip(zip(*uses) if uses else ([], [], []), (pa.int32(), pa.int32(), pa.int64()))], ["term", "bundle", "weight"])
        # new names for the columns, else Spark takes those of the two sides for the same
        postings = index.where("term >= 0").select(*[F.col(c).alias(c) for c in ("block", "term", "at", "tf")])
        owned = postings.join(F.broadcast(spark.createDataFrame(listed)), "term")
        given = spark.sparkContext.broadcast((asked[k], rest[k], bounds))

        def visit(key, left, right):
            asked, rest, bounds = given.value
            ids, lengths, sums = _add(left, right, asked.get(key[1].as_py(), {}), count, total)
            out = [(_IDS, [], ids, []), (_LENGTHS, [], lengths, [])]
            for item, values in sums:
                at = np.flatnonzero(values)
                best = _largest(values[at], top)
                bound = max(bounds[item], int(best.min()) if len(best) == top else 0)
                at = at[values[at] + rest[item] >= bound]
                if len(at):
                    out.append((item, at, values[at], best))
            columns = [[key[0].as_py()] * len(out), [key[1].as_py()] * len(out), *zip(*out)]
            return pa.table([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=_ARROW_NAMES)

        def choose(key, left, right):
            asked, rest, bounds = given.value
            ids, _, sums = _add(left, right, asked.get(key[1].as_py(), {}), count, total)
            out = [np.empty((3, 0), dtype=np.int64)]
            for item, values in sums:
                at = np.flatnonzero((values > 0) & (values >= bounds[item]) & (ids != _NAMELESS))
                if len(at) > top:
                    at = at[values[at] >= _largest(values[at], top).min()]
                at = at[np.lexsort((ids[at], -values[at]))][:top]
                out.append(np.stack((np.full(len(at), item), ids[at], values[at])))
            return pa.table(list(np.concatenate(out, axis=1)), names=["item", "doc_id", "score"])

        sides = state.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle"))
        if k == OWNERS - 1:
            return _ranked(sides.applyInArrow(choose, "item long, doc_id long, score long"), top)
        state = materialise(sides.applyInArrow(visit, _BUNDLE))
        # a number for each item of the batch
        order = Window.partitionBy("item").orderBy(F.col("best").desc())
        best = state.where("item >= 0").select("item", F.explode("best").alias("best"))
        for r in best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).where(F.col("rank") == top).collect():
            bounds[r["item"]] = r["best"]


_NAMELESS = -(1 << 63)
_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_ARROW_NAMES = ["block", "bundle", "item", "at", "value", "best"]


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents with a score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased. With N documents
    that have a term, L terms in all, n in a document, df documents that hold a term and tf times in one:
    w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 75 + (25nN) div L, and an item's score is the sum over its
    terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12m)).

    Null and empty texts have no terms: such an item finds nothing, such a document counts for nothing. A document
    with a null id (or the smallest 64-bit number) counts in N, L and df, and is not returned, as nothing names it. Repeated documents and items
    are rows of their own. Other columns are not read. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(column(id).cast("long"), F.lit(_NAMELESS)).alias("doc_id"), column(text).alias("text"))
    listed = materialise(items.select(column(item_id).alias("item_id"), column(item_text).alias("text"), F.monotonically_increasing_id().alias("place")))
    size = listed.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = max(1, -(-size // BATCH))
    schema = listed.select(F.lit(0).cast("long").alias("item"), "item_id").schema
    results = []
    for b in range(batches):
        batch = listed.where(F.pmod(F.xxhash64("place"), F.lit(batches)) == b).orderBy("place").collect()  # BATCH bytes, or one item that is longer
        counts = [term_counts(r["text"]) for r in batch]
        found = _search(base, counts, top) if any(counts) else None
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], schema)
            results.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return listed.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionAll, results)
