"""SimHash near-duplicates through a vantage-point tree over the fingerprints.

A tree built on a bounded sample of the different fingerprints cuts the Hamming space into shards: at each
node those within the median distance of a vantage point go left, the others right. A fingerprint lives in
one shard. It also visits each later shard that its ball of `radius` touches, which the triangle inequality
tells from its distance to the vantage points alone. Inside a shard the same rule prunes again, down to
blocks that are compared bit by bit. So the links are exact: none is missed, none is false.

Links leave a shard as a forest, not as pairs: a group of copies gives as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from signalframe.llm.common import BROADCAST_IDS, column, materialise, rows, spaced_words, without
from signalframe.llm.links import components, forest

RADIUS = 4
SHARD = 1 << 20  # different fingerprints that a shard may hold before there are more than 2^MIN_DEPTH shards
SAMPLES = 32  # fingerprints of the sample for each shard
MIN_DEPTH, MAX_DEPTH = 5, 14  # 32 to 16,384 shards: a tree of up to 256 kB, a sample of up to 4 MB
VISITORS = 1_000_000  # of one shard in one task; more are split over several
BLOCK = 256  # fingerprints that are compared with all their visitors at once

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: list[str | None], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' shingles in order, how many each text has).

    Shingles are `width` consecutive words, repeats included; a text of fewer words is one shingle, of none has none.
    """
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        found = spaced_words(text)
        if len(found) <= width:
            hashes += [digest(b" ".join(found), seed)] if found else []
            counts.append(min(len(found), 1))
            continue
        flat = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        hashes += [digest(flat[i:j], seed) for i, j in zip(starts.tolist(), ends[width - 1:].tolist())]
        counts.append(len(found) - width + 1)
    return np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)


def fingerprint_batch(texts: list[str | None], width: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 where over half of the hashes of all shingles have it; no shingles give 0."""
    return majority(*shingle_hashes(texts, width, seed))


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # sum eight bits at a time in the eight bytes of a word, over runs of at most 255 hashes of one text
    first = np.cumsum(n[full]) - n[full]
    runs = -(-n[full] // 255)
    owner = np.repeat(np.arange(len(full)), runs)
    at = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    ones = np.zeros((len(full), 64), dtype=np.int64)
    for k in range(8):
        summed = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
        lanes = summed[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(255)
        np.add.at(ones, (owner[:, None], np.arange(8) * 8 + k), lanes.astype(np.int64))
    bits = (2 * ones > n[full][:, None]).astype(np.uint64)
    out[full] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, bits): every row's fingerprint as a signed 64-bit number."""
    def run(batch):
        yield {"doc_id": batch["doc_id"], "bits": fingerprint_batch(batch["text"], width).view(np.int64)}

    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, "doc_id long, bits long")


# --- the tree ------------------------------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(vantage points, median distances) of a complete binary tree, nodes numbered 1, 2-3, 4-7, ..."""
    points, medians = np.zeros(1 << depth, dtype=np.uint64), np.zeros(1 << depth, dtype=np.int64)

    def split(node: int, own: np.ndarray) -> None:
        if node >= 1 << depth:
            return
        if len(own):
            points[node] = own[0]
            d = distance(own, own[0])
            # the cut that divides the sample most evenly; distances repeat, so the median itself may not
            values, n = np.unique(d, return_counts=True)
            medians[node] = values[np.abs(2 * np.cumsum(n) - len(d)).argmin()]
            near = d <= medians[node]
            split(2 * node, own[near]), split(2 * node + 1, own[~near])

    split(1, sample)
    return points, medians


def route(bits: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): each fingerprint in its own shard, and in those later ones its ball touches."""
    points, medians = tree
    row, node, home = np.arange(len(bits)), np.ones(len(bits), dtype=np.int64), np.ones(len(bits), dtype=bool)
    while len(node) and node[0] < len(points):
        d = distance(bits[row], points[node]).astype(np.int64)
        near = d <= medians[node]
        left, right = d - radius <= medians[node], d + radius > medians[node]
        # of a pair that is split the left one travels: it visits the shards on the right
        left &= near | ~home
        row, node, home = (
            np.concatenate((row[left], row[right])),
            np.concatenate((2 * node[left], 2 * node[right] + 1)),
            np.concatenate((home[left] & near[left], home[right] & ~near[right])),
        )
    return row, node - len(points), home


def near_pairs(own: np.ndarray, seen: np.ndarray, radius: int, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of own, of seen) within the radius, in blocks; pruned by vantage points."""
    open_ = [(np.arange(len(own)), np.arange(len(seen)))]
    while open_:
        mine, theirs = open_.pop()
        if not len(mine) or not len(theirs):
            continue
        if len(mine) > BLOCK:
            point = own[mine[0]]
            d = distance(own[mine], point).astype(np.int64)
            median = int(np.median(d))
            if (near := d <= median).all():
                near = d < median
            if 0 < near.sum() < len(d):
                median = int(d[near].max())
                far = distance(seen[theirs], point).astype(np.int64)
                open_.append((mine[near], theirs[far - radius <= median]))
                open_.append((mine[~near], theirs[far + radius > median]))
                continue
        for i in range(0, len(mine), BLOCK):
            part = mine[i: i + BLOCK]
            for j in range(0, len(theirs), step):
                other = theirs[j: j + step]
                a, b = np.nonzero(distance(own[part][:, None], seen[other][None, :]) <= radius)
                yield part[a], other[b]


def shard_forest(own: np.ndarray, visitors: np.ndarray, with_own: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins what the links of a shard join."""
    both = np.concatenate((own, visitors))
    root = np.arange(len(both))
    held, size = [], 0

    def join(root):
        return forest(len(both), *(np.concatenate(x) for x in zip(*held)), root) if held else root

    for a, b in near_pairs(own, both if with_own else visitors, radius):
        b = b if with_own else b + len(own)
        apart = a != b
        held.append((a[apart], b[apart]))
        size += len(a)
        if size > 1 << 20:
            root, held, size = join(root), [], 0
    root = join(root)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return both[linked], both[root[linked]]


def link_forest(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between different fingerprints (column `bits`) that join exactly what links join."""
    def compare(key, shard):
        bits, home = shard["bits"].to_numpy().view(np.uint64), shard["home"].to_numpy()
        a, b = shard_forest(bits[home], bits[~home], key[1] == 0, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _by_shard(distinct.select("bits"), radius, compare)


def _by_shard(distinct: DataFrame, radius: int, compare) -> DataFrame:
    """(a, b) that `compare` finds in each shard, among its residents and between them and its visitors.

    `distinct` has a row for each fingerprint, with `bits` and more columns of 64-bit numbers.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = int(min(MAX_DEPTH, max(MIN_DEPTH, np.ceil(np.log2(max(n, 1) / SHARD)))))
    wanted = SAMPLES << depth
    slot = F.pmod(F.xxhash64("bits"), F.lit(max(1, n // wanted)))
    found = distinct.where(slot == 0).orderBy(F.xxhash64("bits")).limit(4 * wanted).collect()  # bounded by MAX_DEPTH
    tree = build_tree(np.array([r["bits"] for r in found], dtype=np.int64).view(np.uint64), depth)
    shared, names = spark.sparkContext.broadcast(tree), distinct.columns
    slices = max(1, round(n * 0.84 ** depth / 2 / VISITORS))  # expected visitors of a shard, over the limit

    step = max(64, 1 << 20 >> depth)  # fingerprints routed at once; each may visit many shards

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("bits").to_numpy().view(np.uint64)
            for at in range(0, len(every), step):
                bits = every[at: at + step]
                row, shard, home = route(bits, shared.value, radius)
                spread = (bits[row] >> np.uint64(17)) % np.uint64(slices)
                for k in range(slices):  # a visitor goes to one slice of a shard, a resident to all
                    sent = home | (spread == k)
                    yield pa.RecordBatch.from_pydict({
                        "shard": shard[sent], "slice": np.full(sent.sum(), k, np.int32), "home": home[sent],
                        **{c: batch.column(c).to_numpy()[at + row[sent]] for c in names},
                    })

    columns = "".join(f", {c} long" for c in names)
    visits = distinct.mapInArrow(visit, "shard long, slice int, home boolean" + columns)
    return visits.groupBy("shard", "slice").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = 4
) -> DataFrame:
    """(doc_id, bits, fingerprint, component_id) for every row.

    Documents whose fingerprints differ in at most `radius` bits are linked; `component_id` is the smallest
    id reachable. Null, empty and blank texts have fingerprint zero and are linked like any other; a null
    id is never the smallest, and a component of null ids alone has a null component_id; repeated rows stay;
    other columns are not read; no documents give no rows.
    """
    made = materialise(fingerprints(docs, id, text, width))
    distinct = materialise(made.groupBy("bits").agg(F.min("doc_id").alias("first")))
    groups = components(link_forest(distinct, radius))
    joined = distinct.join(groups.withColumnRenamed("node", "bits"), "bits", "left")
    joined = joined.withColumn("group", F.coalesce("component", "bits"))
    smallest = joined.groupBy("group").agg(F.min("first").alias("component_id"))
    classes = joined.join(smallest, "group").select("bits", "component_id")
    return made.join(classes, "bits").select(
        "doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near copies: wider shingles, a larger radius, links confirmed -------------------------------

WIDTH, SIMILARITY = 5, 0.8
NEAR = 14  # bits of 64 in which the fingerprints of copies of that similarity differ at most, nearly always
BOTH = 26  # bits of 128, with a second fingerprint
SURE = 12  # of these; texts so near are copies
HELD = 1 << 18  # pairs of a shard that wait
SLICE = 2 << 20  # bytes of text whose shingles are hashed at once

_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles: the given ones mixed, so that no bit goes with any of theirs."""
    h = h.copy()
    for shift, factor in _MIX:
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h


def spanning(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of pairs that join what all pairs join, the nearest first; the smallest node that each reaches).

    `root` carries what earlier pairs have joined.
    """
    root, chosen = np.arange(n) if root is None else root, []
    for d in np.unique(far):
        left = np.flatnonzero(far == d)
        while len(left):
            left = left[root[a[left]] != root[b[left]]]
            _, first = np.unique(np.maximum(root[a[left]], root[b[left]]), return_index=True)
            # each of these hooks another root to a smaller one, so none closes a circle
            taken = left[first]
            root = forest(n, a[taken], b[taken], root.copy())
            chosen.append(taken)
    return np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64), root


def shard_candidates(own: np.ndarray, visitors: np.ndarray, with_own: bool, near: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of fingerprints, columns bits and check) within both limits, as many as join what all of them join.

    Pairs within SURE bits join at once, so that of a large group of copies no more is looked at than joins it;
    the others wait, HELD at most, until a nearest spanning forest is taken of them.
    """
    every = np.concatenate((own, visitors))
    seen, shift = (every, 0) if with_own else (visitors, len(own))
    n, root, out = len(every), np.arange(len(every)), []
    held = np.empty((3, 0), dtype=np.int64)
    for i, j in near_pairs(own[:, 0], seen[:, 0], near, 1024):
        apart = root[i] != root[j + shift]
        i, j = i[apart], j[apart]
        d = (distance(own[i, 0], seen[j, 0]) + distance(own[i, 1], seen[j, 1])).astype(np.int64)
        found = np.stack((i, j + shift, d))
        sure = found[:, d <= SURE]
        if sure.size:
            taken, root = spanning(n, *sure, root)
            out.append(sure[:2, taken])
        held = np.concatenate((held, found[:, (d > SURE) & (d <= both)]), axis=1)
        if held.shape[1] > HELD:
            held = held[:, spanning(n, *held, root)[0]]
    held = held[:, spanning(n, *held, root)[0]]
    a, b = np.concatenate([*out, held[:2]], axis=1)
    return every[a, 0], every[b, 0]


def shingle_sets(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The different shingles of each text, ascending."""
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit number for each set of shingles."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, bits, group) for every row: texts of one group are joined by links.

    Linked are texts whose sets of shingles of `width` words have a Jaccard similarity of `similarity` or more.
    Most are found where their fingerprints differ in at most NEAR bits, and BOTH bits with a second fingerprint of the
    same shingles; of the pairs found in a shard the nearest that join them are confirmed by the shingles themselves.
    The links that this misses between the groups so found come from :func:`missed`, so that none is lost.
    Texts with equal fingerprints count as copies, null and blank ones too.
    """
    def run(batch):
        h, n = shingle_hashes(batch["text"], width, 42)
        sets = shingle_sets(h, n)
        yield {
            "doc_id": batch["doc_id"], "bits": majority(h, n).view(np.int64), "check": majority(second(h), n).view(np.int64),
            "key": set_keys(sets), "size": [len(s) for s in sets], "head": [s[: head_size(len(s), similarity)].view(np.int64) for s in sets],
            "fold": [fold(s) for s in sets],
        }

    base = docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    made = materialise(rows(base, run, "doc_id long, bits long, check long, key long, size int, head array<long>, fold binary", SLICE))
    distinct = materialise(made.groupBy("bits").agg(F.min(F.struct("doc_id", "check")).alias("m")).select("bits", "m.check", F.col("m.doc_id").alias("first")))

    def compare(key, shard):
        pairs = np.stack((shard["bits"].to_numpy(), shard["check"].to_numpy()), axis=1).view(np.uint64)
        home = shard["home"].to_numpy()
        a, b = shard_candidates(pairs[home], pairs[~home], key[1] == 0, NEAR, BOTH)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = _by_shard(distinct.select("bits", "check"), NEAR, compare)
    edges = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # equal sets of shingles may have several fingerprints, as repeats count there
    twins = made.select("key", "bits").distinct()
    least = twins.groupBy("key").agg(F.min("bits").alias("a"), F.count("*").alias("n")).where("n > 1")
    equal = twins.join(least, "key").where("a <> bits").select("a", F.col("bits").alias("b"))
    known = materialise(confirmed(base, distinct, edges, width, similarity).unionByName(equal))
    groups = components(known).withColumnRenamed("node", "bits")
    texts = made.where("size > 0").drop("check").dropDuplicates(["key"]).join(groups, "bits", "left")
    texts = texts.select("doc_id", "key", "size", "head", F.coalesce("component", "bits").alias("group"))
    more = missed(base, materialise(texts), made.select("key", "fold"), width, similarity)
    if not more.isEmpty():
        groups = components(known.unionByName(more)).withColumnRenamed("node", "bits")
    joined = made.select("doc_id", "bits").join(groups, "bits", "left")
    return joined.select("doc_id", "bits", F.coalesce("component", "bits").alias("group"))


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `base` with one of these ids (column `doc_id`); a null id is one too."""
    wanted = materialise(ids.select(F.col("doc_id").alias("_id")).distinct())
    some = wanted.count() <= BROADCAST_IDS
    return base.join(F.broadcast(wanted) if some else wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def _sets_of(base: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(bits, key, shingles) of the texts with these ids."""
    def run(batch):
        h, n = shingle_hashes(batch["text"], width, 42)
        sets = shingle_sets(h, n)
        yield {"bits": majority(h, n).view(np.int64), "key": set_keys(sets), "shingles": [s.view(np.int64) for s in sets]}

    return rows(_texts_of(base, ids), run, "bits long, key long, shingles array<long>", SLICE)


def _alike(pairs: DataFrame, sets: DataFrame, by: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity; `by` is the column of `sets` that a and b name."""
    one, two = (sets.select(F.col(by).alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("_a", "_b")))
    return met.where(F.col("same") >= similarity * (F.size("_a") + F.size("_b") - F.col("same"))).select(*pairs.columns)


def confirmed(base: DataFrame, distinct: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges whose texts have that Jaccard similarity; a fingerprint's text is one that has the smallest id."""
    ends = edges.select(F.col("a").alias("bits")).union(edges.select(F.col("b"))).distinct()
    ids = distinct.join(ends, "bits").select(F.col("first").alias("doc_id"))
    sets = materialise(_sets_of(base, ids, width).dropDuplicates(["bits"]))
    return _alike(edges, sets, "bits", similarity)


# --- the links that fingerprints miss: texts that are alike share one of their rarest shingles ---

COMMON = 64  # texts with a shingle in their heads, beyond which it goes to the end of the order
LISTED = 1 << 20  # shingles at the end of the order, 16 MB to each task
ROUNDS = 1  # of looking for common shingles; what remains common is compared all the same
FOLDED = 1 << 22  # shingles of a block of texts, 8 MB folded; two blocks meet in a task
MET = 1 << 20  # pairs of two blocks that one task compares; more are split over several
CHUNK = 256  # texts of a group with one shingle that are listed together
TRIES = 3  # rounds of confirming the nearest pair of each group, before all that are left


def fold(own: np.ndarray) -> bytes:
    """The shingles of an ascending set by 16 bits of each, ascending: two bytes a shingle."""
    return np.sort((own & np.uint64(0xFFFF)).astype("<u2")).tobytes()


def places(folded: bytes) -> np.ndarray:
    """A different number for each shingle of a folded set; equal 16 bits are told apart by their count so far."""
    low = np.frombuffer(folded, "<u2").astype(np.int32)
    first = np.concatenate(([True], low[1:] != low[:-1]))[: len(low)]
    nth = np.arange(len(low), dtype=np.int32)
    return low + ((nth - np.maximum.accumulate(np.where(first, nth, 0))) << 16)


def head_size(n: int, similarity: float) -> int:
    """How many of n shingles, the first in an order that all texts share, hold one of any set so similar."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def head(own: np.ndarray, listed: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of an ascending set in the order: those not listed, then the listed (ascending) by place."""
    at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
    last = listed[at] == own
    ordered = np.concatenate((own[~last], own[last][np.argsort(place[at[last]])]))
    return ordered[: head_size(len(own), similarity)]


def missed(base: DataFrame, texts: DataFrame, folds: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): groups that a link of two of their texts joins, exactly. `texts` has a row for each set of shingles,
    `folds` one or more.

    Two sets so similar share a shingle of their heads (:func:`head_size`) in any order that both follow. The order is
    that of the hashes, but shingles common to more than COMMON heads of several groups come last, so that few texts
    meet. Pairs that share enough of their heads to leave the similarity within reach are compared by their folded
    sets, which share at least as many; what these leave is confirmed by the sets themselves.
    """
    spark, listed = base.sparkSession, []
    least = texts.select("key", "size", F.get("head", F.lit(0)).alias("least"))
    for k in range(ROUNDS + 1):
        heads = texts.select("group", F.explode("head").alias("shingle"))
        shared = heads.groupBy("shingle").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
        shared = materialise(shared.where("low < high").select("shingle", "n"))
        common = shared.where(F.col("n") > COMMON)
        room = LISTED - len(listed)
        # bounded by LISTED
        top = common.orderBy(F.desc("n"), "shingle").limit(LISTED).collect() if k < ROUNDS and room else []
        before = set(listed)
        new = [r["shingle"] for r in top if r["shingle"] not in before][:room]
        if not new:
            break
        listed = listed + new[::-1]
        texts = _headed(spark, base, texts, common, listed, width, similarity)
    met = texts.select("key", "size", "group", F.posexplode("head").alias("pos", "shingle")).join(shared.select("shingle"), "shingle", "left_semi")
    pairs = _within_reach(materialise(met), texts.select("key", "group"), similarity)
    pairs = pairs if pairs.isEmpty() else _within_folds(least, folds, pairs, similarity)
    if pairs.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    return _by_rounds(base, texts, pairs, width, similarity)


def _within_folds(least: DataFrame, folds: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ga, gb, near): the pairs whose folded sets leave that similarity within reach, and how similar these are.

    Each text lies in one block, with most of those like it (by its least shingle), of about FOLDED shingles. A text
    is sent to a pair of blocks if it has a pair there.
    """
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    own = materialise(least.join(ends, "key", "left_semi"))
    room = float(max(1, FOLDED))
    count = max(1, int(np.ceil((own.agg(F.sum("size")).first()[0] or 0) / room)))
    own = own.withColumn("home", F.pmod(F.xxhash64("least"), F.lit(count)))
    parts = own.groupBy("home").agg(F.ceil(F.sum("size") / room).alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    blocks = materialise(own.join(parts, "home").select("key", (F.col("home") * (1 << 31) + part).alias("block")))
    for c in "ab":
        pairs = pairs.join(blocks.select(F.col("key").alias(c), F.col("block").alias(f"_{c}")), c)
    pairs = materialise(pairs.select("a", "b", "ga", "gb", F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")))
    slices = pairs.groupBy("u", "v").agg(F.ceil(F.count("*") / float(MET)).alias("slices"))
    pairs = pairs.join(slices, ["u", "v"]).withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices"))).drop("slices")
    held = pairs.select("u", "v", "slice", F.explode(F.array("a", "b")).alias("key")).distinct()
    folds = folds.join(blocks.select("key"), "key", "left_semi").dropDuplicates(["key"])
    held = held.join(folds, "key").select(*[F.col(c).alias(f"_{c}") for c in ("u", "v", "slice")], "key", "fold")

    def compare(met, texts):
        sets = [places(x) for x in texts["fold"]]
        size = np.array([len(x) for x in sets])
        at = pd.Series(np.arange(len(sets)), index=texts["key"])
        met = met.sort_values("a", ignore_index=True)
        i, j = at[met["a"]].to_numpy(), at[met["b"]].to_numpy()
        same, has = np.zeros(len(met), dtype=np.int64), np.zeros(max(x.max() for x in sets) + 1, dtype=bool)
        cuts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
        for low, high in zip(cuts[:-1], cuts[1:]):
            has[sets[i[low]]] = True
            for k in range(low, high):
                same[k] = np.count_nonzero(has[sets[j[k]]])
            has[sets[i[low]]] = False
        met["near"] = same / (size[i] + size[j] - same)
        return met.loc[same >= similarity * (size[i] + size[j] - same) - 1e-6, ["a", "b", "ga", "gb", "near"]]

    near = pairs.groupBy("u", "v", "slice").cogroup(held.groupBy("_u", "_v", "_slice"))
    return materialise(near.applyInPandas(compare, "a long, b long, ga long, gb long, near double"))


def _within_reach(met: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ga, gb): texts of different groups whose common shingles in their heads leave that similarity within reach.

    `met` has a row for each shingle of a head, `pos` its place there; `groups` has the group of each key. Groups meet by
    shingle, each with its texts in lists of CHUNK, so that texts of one group do not meet and rows of pairs move once.
    """
    place = F.row_number().over(Window.partitionBy("shingle", "group").orderBy("key"))
    here = met.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("shingle", "group", "chunk")
    here = here.agg(F.collect_list(F.struct("key", "size", "pos")).alias("texts"))
    one, two = (here.select("shingle", F.col("group").alias(f"g{c}"), F.col("texts").alias(f"t{c}")) for c in "ab")
    both = one.join(two, "shingle").where("ga < gb").select(F.explode("ta").alias("a"), "tb").select("a", F.explode("tb").alias("b"))
    after = F.least(*[F.col(f"{c}.size") - F.col(f"{c}.pos") for c in "ab"])
    needed = (F.col("a.size") + F.col("b.size")) * (similarity / (1 + similarity)) - 1e-6
    # at most those before this shingle in the order that both follow are shared, and those from it on
    both = both.where(F.least("a.pos", "b.pos") + after >= needed)
    # beyond the last common one, or the head that ends first, no more can be shared than what the text has left there
    rest = F.greatest(*[F.ceil(F.col(f"{c}.size") * similarity - 1e-9) - 1 for c in "ab"])
    both = both.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), (F.least(after - 1, rest) - needed).alias("over"))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("over").alias("over")).where("n + over >= 0").select("a", "b")
    for c in "ab":
        pairs = pairs.join(groups.select(F.col("key").alias(c), F.col("group").alias(f"g{c}")), c)
    return materialise(pairs.select("a", "b", "ga", "gb"))


def _by_rounds(base: DataFrame, texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): groups that pairs of that similarity join, as many as join what all these pairs join.

    A round confirms the nearest pair of each group; pairs of groups that are joined by then need no look.
    """
    found = None
    for k in range(TRIES + 1):
        tried = pairs
        if k < TRIES:
            nearest = pairs.groupBy("gb").agg(F.max(F.struct("near", "a", "b", "ga")).alias("m"))
            tried = materialise(nearest.select("m.a", "m.b", "m.ga", "gb"))
        some = _joined(base, texts, tried, width, similarity)
        found = some if found is None else found.unionByName(some)
        if k == TRIES:
            break
        joined = components(found)
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        for c in "ab":
            pairs = pairs.join(joined.select(F.col("node").alias(f"g{c}"), F.col("component").alias(f"c{c}")), f"g{c}", "left")
        pairs = pairs.where(F.coalesce("ca", "ga") != F.coalesce("cb", "gb"))
        pairs = materialise(pairs.select("a", "b", "ga", "gb", "near"))
        if pairs.isEmpty():
            break
    return found


def _headed(spark, base: DataFrame, texts: DataFrame, common: DataFrame, listed: list[int], width: int, similarity: float) -> DataFrame:
    """The texts, those with common shingles in their heads with heads by the order that ends in the listed shingles."""
    last = np.array(listed, dtype=np.int64).view(np.uint64)
    order = spark.sparkContext.broadcast((np.sort(last), np.argsort(last)))

    def run(batch):
        sets = shingle_sets(*shingle_hashes(batch["text"], width, 42))
        yield {"key": set_keys(sets), "head": [head(s, *order.value, similarity).view(np.int64) for s in sets]}

    has = texts.select("key", "doc_id", F.explode("head").alias("shingle")).join(common, "shingle", "left_semi")
    has = materialise(has.select("key", "doc_id").distinct())
    again = rows(_texts_of(base, has), run, "key long, head array<long>", SLICE).dropDuplicates(["key"])
    own = texts.drop("head").join(has.select("key"), "key", "left_semi").join(again, "key")
    return materialise(texts.join(has.select("key"), "key", "left_anti").unionByName(own))


def _joined(base: DataFrame, texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): the groups (ga, gb) of the pairs of texts (a, b) that have that similarity."""
    ends = materialise(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    ids = texts.select("key", "doc_id").join(ends, "key", "left_semi")
    sets = _sets_of(base, ids, width).join(ends, "key", "left_semi").dropDuplicates(["key"])
    found = _alike(pairs.select("a", "b", "ga", "gb"), materialise(sets), "key", similarity)
    return materialise(found.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each group (:func:`near_copies`) one row with the smallest id stays.

    Rows are told apart by id and fingerprint: two texts under one id are two documents, each in its own group.
    Rows with a null id stay, as nothing tells them apart.
    """
    found = near_copies(docs, id, text, width, similarity).where("doc_id is not null")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "bits")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    marked = found.join(first, ["doc_id", "bits"], "left")
    ids = materialise(marked.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce("stays", F.lit(False))).alias("stays"), F.count("*").alias("n")))
    stay = without(docs, id, ids.where("not stays").select("_id"))
    repeated = materialise(ids.where("stays and n > 1").select("_id"))
    if repeated.isEmpty():
        return stay
    # the few rows that share an id are chosen by their own fingerprint
    own = docs.join(repeated, column(id).cast("long") == F.col("_id"), "left_semi")

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_batch([None if pd.isna(t) else t for t in texts], width).view(np.int64))

    keyed = own.select(F.struct(*map(column, docs.columns)).alias("row"), bits(column(text)).alias("bits"), column(id).cast("long").alias("doc_id"))
    once = keyed.join(first.select("doc_id", "bits"), ["doc_id", "bits"], "left_semi").dropDuplicates(["doc_id", "bits"]).select("row.*")
    return without(stay, id, repeated).unionByName(once)
