"""Gradient-boosted trees over histograms, for inputs with missing values.

Inputs are cut into bins at quantiles of all rows; bin 0 is "missing". A level of a tree is one pass: each task sums
gradient, curvature and count of its rows by (node, input, bin), the sums meet by ``groupBy``, and the driver, to
which only these sums come, picks each node's split. A split learns to which side missing values go: both are tried.

The rows are stored once with their bins; what the trees so far say of a row is stored again every ROUND trees, and
the few trees since are applied in the pass. Trees are small arrays that travel with the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalframe.session import materialise

BINS = 64  # of an input, without the one for missing values
ROUND = 20


@dataclass
class Tree:
    """Nodes 1, 2-3, 4-7, ...; a node without an input is a leaf, and its rows stay there."""

    feature: list[int]
    bin: list[int]  # rows up to this bin go left
    missing_left: list[bool]
    value: list[float]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """Where rows (codes: one row per input) end."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        node = np.ones(codes.shape[1], dtype=np.int64)
        while True:
            open_ = np.flatnonzero(feature[node] >= 0)
            if not len(open_):
                return node
            at = node[open_]
            code = codes[feature[at], open_]
            goes_left = np.where(code == 0, left[at], code <= cut[at])
            node[open_] = 2 * at + ~goes_left


@dataclass
class Boosted:
    columns: list[str]
    edges: list[list[float]]
    prior: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of raw values, from 1; 0 where a value is missing."""
        out = np.zeros((len(columns), len(columns[0]) if columns else 0), dtype=np.uint8)
        for row, values, edges in zip(out, columns, self.edges):
            there = ~np.isnan(values)
            row[there] = 1 + np.searchsorted(np.array(edges), values[there], side="left")
        return out

    def add(self, codes: np.ndarray, margin: np.ndarray, first: int = 0) -> np.ndarray:
        for tree in self.trees[first:]:
            margin = margin + self.rate * np.array(tree.value)[tree.nodes(codes)]
        return margin


def quantile_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` cuts of each input, at quantiles of its values; a value equal to a cut is below it."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10_000)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(row[f"c{i}"] or [])) for i in range(len(columns))]


def binned(df: DataFrame, label: str, model: Boosted) -> DataFrame:
    """``y``, ``margin`` and ``codes`` (a byte for each input) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(model.columns))]
            codes = np.ascontiguousarray(model.codes(columns).T)
            yield pa.RecordBatch.from_pydict({
                "y": batch.column(0), "margin": pa.array(np.full(batch.num_rows, model.prior)),
                "codes": pa.array([r.tobytes() for r in codes], pa.binary()),
            })

    values = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(model.columns)]
    return df.select(F.col(label).cast("double").alias("y"), *values).mapInArrow(run, "y double, margin double, codes binary")


def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8)
    return flat.reshape(-1, width).T


def level_histogram(rows: DataFrame, model: Boosted, stored: int, grown: Tree, level: int) -> DataFrame:
    """``node, feature, bin, n, g, h``: sums over the rows of each node of a level, combined in the tasks first.

    ``stored`` trees are in the rows' margins; ``grown`` is the tree so far.
    """
    width, first = len(model.columns), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = first * width * 256
        sums = np.zeros((3, size))
        for batch in batches:
            codes = _codes(batch, width)
            margin = model.add(codes, batch.column("margin").to_numpy(), stored)
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = batch.column("y").to_numpy() - p, p * (1.0 - p)
            node = grown.nodes(codes)
            here = np.flatnonzero(node >= first)
            for f in range(width):
                at = ((node[here] - first) * width + f) * 256 + codes[f, here]
                for k, v in enumerate((np.ones(len(here)), g[here], h[here])):
                    sums[k] += np.bincount(at, weights=v, minlength=size)
        full = np.flatnonzero(sums[0])
        node, rest = np.divmod(full, width * 256)
        feature, code = np.divmod(rest, 256)
        yield pa.RecordBatch.from_pydict({
            "node": node + first, "feature": feature, "bin": code, "n": sums[0, full].astype(np.int64), "g": sums[1, full], "h": sums[2, full],
        })

    parts = rows.mapInArrow(run, "node long, feature long, bin long, n long, g double, h double")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best(table: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool]:
    """(gain, input, bin, missing left) of the best split, from sums by (n/g/h, input, bin)."""
    total = table[:, 0].sum(axis=1)
    score = lambda g, h: g * g / (h + l2)
    best = (0.0, -1, 0, True)
    for f in range(table.shape[1]):
        lost = table[:, f, 0]
        below = np.cumsum(table[:, f, 1:], axis=1)  # without the missing
        for missing_left in (True, False):
            left = below + lost[:, None] if missing_left else below
            right = total[:, None] - left
            able = (left[0] >= least) & (right[0] >= least)
            if not able.any():
                continue
            gain = np.where(able, score(left[1], left[2]) + score(right[1], right[2]) - score(total[1], total[2]), -np.inf)
            at = int(gain.argmax())
            if gain[at] > best[0] + 1e-12:
                best = (float(gain[at]), f, at + 1, missing_left)
    return best


def fit(
    train: DataFrame, label: str, columns: list[str], trees: int = 100, depth: int = 3, rate: float = 0.1, l2: float = 0.01,
    bins: int = BINS, least: int = 20,
) -> Boosted:
    """Trees for the log-odds of ``label`` (0 or 1) from ``columns``, missing values included.

    Rows without a label are left out. A leaf holds ``least`` rows at least; ``l2`` shrinks its value.
    """
    labelled = train.where(F.col(label).isNotNull())
    share = labelled.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    model = Boosted(list(columns), quantile_edges(labelled, columns, bins), float(np.log(share / (1 - share))), rate)
    rows, stored, width = materialise(binned(labelled, label, model)), 0, len(columns)
    for k in range(trees):
        grown = Tree([-1] * (2 << depth), [0] * (2 << depth), [True] * (2 << depth), [0.0] * (2 << depth))
        for level in range(depth + 1):
            if level and not any(grown.feature[n] >= 0 for n in range(1 << level - 1, 1 << level)):
                break
            table: dict[int, np.ndarray] = {}
            for r in level_histogram(rows, model, stored, grown, level).collect():  # nodes x inputs x bins, whatever the rows
                table.setdefault(r["node"], np.zeros((3, width, 256)))[:, r["feature"], r["bin"]] = r["n"], r["g"], r["h"]
            for node, sums in table.items():
                _, g, h = sums[:, 0].sum(axis=1)
                grown.value[node] = float(g / (h + l2))
                if level < depth:
                    gain, f, cut, left = _best(sums, l2, least)
                    if f >= 0:
                        grown.feature[node], grown.bin[node], grown.missing_left[node] = f, cut, left
        model.trees.append(grown)
        if (k + 1) % ROUND == 0 and k + 1 < trees:
            rows, stored = materialise(_with_margins(rows, model, stored)), k + 1
    return model


def _with_margins(rows: DataFrame, model: Boosted, stored: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = model.add(_codes(batch, len(model.columns)), batch.column("margin").to_numpy(), stored)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(margin), batch.column("codes")], names=["y", "margin", "codes"])

    return rows.mapInArrow(run, "y double, margin double, codes binary")


def score(df: DataFrame, model: Boosted, *keep: str) -> DataFrame:
    """The kept columns and ``boosting_probability``; missing inputs are scored as they are."""
    @F.pandas_udf("double")
    def probability(inputs: pd.DataFrame) -> pd.Series:
        codes = model.codes([inputs[c].to_numpy(dtype=np.float64) for c in inputs.columns])
        return pd.Series(1.0 / (1.0 + np.exp(-model.add(codes, np.full(len(inputs), model.prior)))))

    inputs = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(model.columns)])
    return df.select(*(keep or df.columns), probability(inputs).alias("boosting_probability"))


def save(spark: SparkSession, model: Boosted, folder: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load(spark: SparkSession, folder: str) -> Boosted:
    spec = json.loads(spark.read.text(folder).first()["value"])
    return Boosted(**spec | {"trees": [Tree(**t) for t in spec["trees"]]})
