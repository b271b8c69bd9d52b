"""Spark's gradient-boosted trees, grown with one short job for each level of a tree.

``GBTClassifier`` runs two stages a level and builds its tables of rows anew for each tree, so that hundreds of rounds
spend their time between the jobs. Here the rows are binned once, by Spark's own cuts, into blocks of a byte a value
which stay in the executors' memory. A job gives the sums of a level: count, sum and squares of what is left to explain
for each node, input and bin. What a block has been told of earlier trees stays with the Python process that holds it;
a process that does not know the block catches up from the trees themselves, so nothing depends on where a task runs.
The driver sees sums only, a few hundred kB a level, whatever the rows are.

Cuts, row samples, gains, ties and leaves follow Spark's rules, so the trees are those that Spark grows, but for
rounding in the last bits, which may choose otherwise between two inputs of the same gain. The outcome is Spark's own model: it is saved, loaded and applied as any other.
"""

from __future__ import annotations

import functools
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 15  # rows of a block
BLOCKS = 64  # of a task at most, some 40 MB of bins
LANE = 32  # rows whose random numbers follow one another; lanes are made at once
EPSILON = 2.0 ** -52  # an impurity below this is none


# --- the row sample: Spark's XORShiftRandom, whose state is linear in its bits --------------------


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << np.uint64(21))
    s ^= s >> np.uint64(35)
    return s ^ (s << np.uint64(4))


def _hash_bytes(data: bytes, h: int) -> int:
    """MurmurHash3 of whole words, 32 bits."""
    low = 0xFFFFFFFF
    turned = lambda x, r: (x << r | x >> (32 - r)) & low
    for i in range(0, len(data), 4):
        k = turned(int.from_bytes(data[i: i + 4], "little") * 0xCC9E2D51 & low, 15) * 0x1B873593 & low
        h = (turned(h ^ k, 13) * 5 + 0xE6546B64) & low
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & low
    return h ^ h >> 16


def _first_state(seed: int) -> np.uint64:
    data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    low = _hash_bytes(data, 0x3C074A61)
    return np.uint64(_hash_bytes(data, low) << 32 | low)


def _applied(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = table[0][x & np.uint64(255)]
    for b in range(1, 8):
        out = out ^ table[b][x >> np.uint64(8 * b) & np.uint64(255)]
    return out


@functools.cache
def _jump(k: int) -> np.ndarray:
    """Tables that carry a state over LANE << k rows, two numbers each."""
    x = np.uint64(1) << np.arange(64, dtype=np.uint64)
    if k:
        x = _applied(_jump(k - 1), _applied(_jump(k - 1), x))
    else:
        for _ in range(2 * LANE):
            x = _step(x)
    table = np.zeros((8, 256), dtype=np.uint64)
    for b in range(8):
        for bit in range(8):
            table[b, 1 << bit: 2 << bit] = table[b, : 1 << bit] ^ x[8 * b + bit]
    return table


def sampled(seed: int, start: int, n: int, share: float) -> np.ndarray:
    """Which of n rows from row `start` (a multiple of LANE) of a partition its generator keeps."""
    state, lanes, k = np.array([_first_state(seed)]), start // LANE, 0
    while lanes:
        if lanes & 1:
            state = _applied(_jump(k), state)
        lanes, k = lanes >> 1, k + 1
    k = 0
    while len(state) * LANE < n:
        state, k = np.concatenate((state, _applied(_jump(k), state))), k + 1
    out = np.empty((len(state), LANE))
    for i in range(LANE):
        state = _step(state)
        high = (state & np.uint64((1 << 26) - 1)) << np.uint64(27)
        state = _step(state)
        out[:, i] = (high + (state & np.uint64((1 << 27) - 1))) * 2.0 ** -53
    return out.ravel()[:n] < share


# --- what tasks do with their blocks --------------------------------------------------------------


def _tree_kind(depth: int) -> np.dtype:
    """A tree as a record of fixed length, so that all trees so far travel as plain bytes."""
    return np.dtype([(name, kind, (1 << depth,)) for name, kind in (("feature", "<i4"), ("cut", "<i2"), ("value", "<f8"))])


def nodes_of(bins: np.ndarray, tree: np.void, levels: int) -> np.ndarray:
    """Each row's node after so many levels, numbered from 0; below a leaf rows go left."""
    at = np.zeros(bins.shape[1], dtype=np.intp)
    for level in range(levels):
        first = 1 << level
        right = np.stack([bins[tree["feature"][i]] > tree["cut"][i] for i in range(first, 2 * first)])
        at = 2 * at + right[at, np.arange(len(at))]
    return at


class _Block:
    """The rows of a block, and what the trees so far make of them."""

    def __init__(self, y: bytes, bins: bytes) -> None:
        self.y = np.frombuffer(y, np.int8).astype(float)
        self.bins = np.frombuffer(bins, np.uint8).reshape(-1, len(self.y))
        self.margin, self.trees, self.round = np.zeros(len(self.y)), 0, -1

    def turn(self, part: int, start: int, trees: np.ndarray, rate: float, depth: int, seed: int, share: float) -> None:
        """Ready for the tree after these."""
        m = len(trees)
        if self.round == m:
            return
        for k in range(self.trees, m):
            self.margin += trees[k]["value"][nodes_of(self.bins, trees[k], depth)] * (rate if k else 1.0)
        self.trees, self.round = m, m
        left = 4.0 * self.y / (1.0 + np.exp(2.0 * self.y * self.margin)) if m else self.y
        kept = sampled(seed + m + part + 1, start, len(self.y), share) if share < 1.0 else np.ones(len(self.y), dtype=bool)
        self.left, self.own = left[kept], np.ascontiguousarray(self.bins[:, kept])

    def sums(self, tree: np.void, level: int, width: list[int]) -> np.ndarray:
        """(count, sum, squares) for each node of the level and each bin of each input; an input of one bin is the node."""
        at = nodes_of(self.own, tree, level)
        out, squares, first = np.zeros((3, 1 << level, sum(width))), self.left * self.left, 0
        for f, w in enumerate(width):
            if w == 1 and f:
                first += w
                continue
            code, n = at * w + self.own[f], w << level
            for k, weights in enumerate((None, self.left, squares)):
                out[k, :, first: first + w] = np.bincount(code, weights, n).reshape(-1, w)
            first += w
        return out


def _held(fit_key: str) -> dict:
    """The blocks of this fit that this process knows."""
    here = sys.modules.setdefault("_signalframe_level_trees", types.ModuleType("_signalframe_level_trees"))
    if getattr(here, "fit_key", None) != fit_key:
        here.fit_key, here.blocks = fit_key, {}
    return here.blocks


def _level_of_blocks(
    fit_key: str, trees: bytes, tree: bytes, level: int, width: list[int], settings: tuple, blocks: Iterator[tuple]
) -> Iterator[bytes]:
    known, found, kind = _held(fit_key), [], _tree_kind(settings[1])
    before, own = np.frombuffer(trees, kind), np.frombuffer(tree, kind)[0]
    for _, (part, start, y, bins) in blocks:
        block = known.get((part, start))
        if block is None or block.trees > len(before):
            block = known[part, start] = _Block(y, bins)
        block.turn(part, start, before, *settings)
        found.append(((part, start), block.sums(own, level, width)))
    if found:
        yield sum(s for _, s in sorted(found, key=lambda x: x[0])).tobytes()


def _level_job(rows, fit_key: str, trees: np.ndarray, tree: np.ndarray, level: int, width: list[int], settings: tuple) -> np.ndarray:
    run = functools.partial(_level_of_blocks, fit_key, trees.tobytes(), tree.tobytes(), level, width, settings)
    parts = rows.mapPartitions(run).collect()
    return sum(np.frombuffer(p).reshape(3, 1 << level, sum(width)) for p in parts)


# --- the choice of splits -------------------------------------------------------------------------


def _impurity(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / s[0]) / s[0])


def best_split(sums: np.ndarray, width: list[int], known: float | None) -> dict | None:
    """The first split of the largest gain, over inputs and then cuts; `known` is the node's impurity, if it is."""
    best, first = None, 0
    for f, w in enumerate(width):
        if w > 1:
            summed = np.cumsum(sums[:, first: first + w], axis=1)
            left = summed[:, :-1]
            right = summed[:, -1:] - left
            known = float(_impurity(left[:, 0] + right[:, 0])) if known is None else known
            il, ir, total = _impurity(left), _impurity(right), left[0] + right[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = known - left[0] / total * il - right[0] / total * ir
            gain = np.where((left[0] < 1) | (right[0] < 1) | ~(gain >= 0.0), -np.inf, gain)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best["gain"]:
                best = {
                    "feature": f, "cut": i, "gain": float(gain[i]), "impurity": known, "stats": left[:, i] + right[:, i],
                    "children": [(left[:, i], float(il[i])), (right[:, i], float(ir[i]))],
                }
        first += w
    return best


def _grow(depth: int, width: list[int], level_sums) -> tuple[np.ndarray, dict]:
    """(tree for the tasks, its nodes by number from 1); `level_sums(tree, level)` gives the sums of a level."""
    record = np.zeros(1, _tree_kind(depth))
    tree = record[0]
    tree["cut"][:] = 255
    nodes: dict[int, dict] = {1: {"known": None}}
    for level in range(depth):
        wanted = [i for i in range(1 << level, 2 << level) if i in nodes and not nodes[i].get("leaf")]
        if not wanted:
            break
        sums = level_sums(record, level)
        for i in wanted:
            found = best_split(sums[:, i - (1 << level)], width, nodes[i]["known"])
            if found is None:  # no input has a cut
                total = sums[:, i - (1 << level), : width[0]].sum(axis=1)
                nodes[i] |= {"leaf": True, "stats": total, "impurity": float(_impurity(total))}
                continue
            nodes[i].setdefault("stats", found["stats"])
            nodes[i].setdefault("impurity", found["impurity"])
            if not found["gain"] > 0.0:
                nodes[i]["leaf"] = True
                continue
            nodes[i] |= {"feature": found["feature"], "cut": found["cut"], "gain": found["gain"], "leaf": False}
            tree["feature"][i], tree["cut"][i] = found["feature"], found["cut"]
            for k, (stats, impurity) in enumerate(found["children"]):
                leaf = level + 1 == depth or abs(impurity) < EPSILON
                nodes[2 * i + k] = {"known": impurity, "leaf": leaf, "stats": stats, "impurity": impurity}
    for i, node in nodes.items():
        if node["leaf"]:
            at = i
            while at < 1 << depth:
                at *= 2
            tree["value"][at - (1 << depth)] = _mean(node["stats"])
    return record, nodes


def _mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


# --- Spark's side ---------------------------------------------------------------------------------


def _cuts(ready: DataFrame, gbt: GBTClassifier):
    """Spark's cuts of each input, as Spark's objects."""
    jvm = ready.sparkSession.sparkContext._jvm
    gbt._transfer_params_to_java()
    ml, single = jvm.org.apache.spark.ml, lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    none = single(jvm.scala.collection.immutable, "Map").empty()
    strategy = gbt._java_obj.getOldBoostingStrategy(none, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression())
    instances = single(ml.util, "DatasetUtils").extractInstances(gbt._java_obj, ready._jdf, jvm.scala.Option.empty())
    metadata = single(ml.tree.impl, "DecisionTreeMetadata").buildMetadata(instances, strategy.treeStrategy(), 1, gbt.getFeatureSubsetStrategy())
    found = single(ml.tree.impl, "RandomForest").findSplits(instances, metadata, gbt.getSeed())
    return [[split for split in each] for each in found], metadata.numFeatures()


def _blocks(ready: DataFrame, gbt: GBTClassifier, cuts: list[np.ndarray]):
    """An RDD of (number, (partition, first row, labels, bins)), spread over the tasks and held."""
    sc = ready.sparkSession.sparkContext

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, y, x, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out(n: int) -> pa.RecordBatch:
            nonlocal y, x, held, start
            labels, values = np.concatenate(y), np.concatenate(x, axis=1)
            y, x, held = [labels[n:]], [values[:, n:]], len(labels) - n
            start += n
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "start": pa.array([start - n], pa.int64()),
                "y": pa.array([labels[:n].tobytes()], pa.binary()), "bins": pa.array([np.ascontiguousarray(values[:, :n]).tobytes()], pa.binary()),
            })

        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y.append((batch.column("y").to_numpy(zero_copy_only=False) * 2 - 1).astype(np.int8))
            x.append(np.stack([np.searchsorted(c, values[:, f]).astype(np.uint8) for f, c in enumerate(cuts)]))
            held += batch.num_rows
            while held >= BLOCK:
                yield out(BLOCK)
        if held:
            yield out(held)

    flat = ready.select(F.col(gbt.getLabelCol()).alias("y"), vector_to_array(gbt.getFeaturesCol()).alias("x"))
    made = flat.mapInArrow(binned, "part int, start long, y binary, bins binary").rdd
    made = made.map(lambda r: (r["part"], r["start"], bytes(r["y"]), bytes(r["bins"]))).persist(StorageLevel.DISK_ONLY)
    numbers = {k: i for i, k in enumerate(sorted(made.map(lambda b: b[:2]).collect()))}  # one of BLOCK rows
    tasks = max(min(len(numbers), sc.defaultParallelism), -(-len(numbers) // BLOCKS), 1)
    rows = made.map(lambda b: (numbers[b[:2]], b)).partitionBy(tasks, lambda n: n).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    made.unpersist()
    return rows


def _model(gbt: GBTClassifier, sc, grown: list[dict], cuts: list[list], weights: list[float], inputs: int) -> GBTClassificationModel:
    jvm, gateway = sc._jvm, sc._gateway
    ml, calculator = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def node(nodes: dict, i: int):
        own = nodes[i]
        stats = gateway.new_array(jvm.double, 3)
        for k in range(3):
            stats[k] = float(own["stats"][k])
        held, mean = calculator(stats, int(own["stats"][0])), _mean(own["stats"])
        if not own["leaf"]:
            left, right = node(nodes, 2 * i), node(nodes, 2 * i + 1)
            if not (left[1] and right[1] and left[2] == right[2]):
                split = cuts[own["feature"]][own["cut"]]
                return ml.tree.InternalNode(mean, float(own["impurity"]), own["gain"], left[0], right[0], split, held), False, mean
        return ml.tree.LeafNode(mean, float(own["impurity"]), held), True, mean

    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(grown))
    shares = gateway.new_array(jvm.double, len(grown))
    for k, nodes in enumerate(grown):
        trees[k] = ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(nodes, 1)[0], inputs)
        shares[k] = weights[k]
    java = ml.classification.GBTClassificationModel(gbt.uid, trees, shares, inputs, 2)
    gbt._java_obj.copyValues(java.setParent(gbt._java_obj), ml.param.ParamMap.empty())
    return gbt._copyValues(GBTClassificationModel(java))


def fit(ready: DataFrame, gbt: GBTClassifier) -> GBTClassificationModel:
    """The model that ``gbt.fit(ready)`` gives, for labels 0 and 1 without row weights; inputs hold neither NULL nor NaN."""
    sc, depth, rate = ready.sparkSession.sparkContext, gbt.getMaxDepth(), gbt.getStepSize()
    splits, inputs = _cuts(ready, gbt)
    cuts = [np.array([s.threshold() for s in each]) for each in splits]
    width = [len(c) + 1 for c in cuts]
    rows, fit_key = _blocks(ready, gbt, cuts), uuid.uuid4().hex
    settings = (rate, depth, gbt.getSeed(), gbt.getSubsamplingRate())
    trees, grown = np.zeros(gbt.getMaxIter(), _tree_kind(depth)), []
    try:
        for k in range(len(trees)):
            record, nodes = _grow(depth, width, lambda t, level, so_far=trees[:k]: _level_job(rows, fit_key, so_far, t, level, width, settings))
            trees[k] = record[0]
            grown.append(nodes)
    finally:
        rows.unpersist()
    return _model(gbt, sc, grown, splits, [1.0] + [rate] * (len(grown) - 1), inputs)
