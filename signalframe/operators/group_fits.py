"""Logistic models of several groups of inputs over the same rows, fitted together.

Newton's steps: a pass over the rows gives gradient and curvature of every group's model, summed in the tasks
before the shuffle, so the passes do not grow with the groups. Only sums reach the driver, for each group the
square of its inputs, and it solves as many small systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STEPS = 50
SETTLED = 1e-10


def _inputs(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' inputs with a column of ones."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.concatenate((x, np.ones((batch.num_rows, 1))), axis=1)


def fit_groups(rows: DataFrame, groups: dict[str, list[int]], penalty: float) -> dict[str, np.ndarray]:
    """Weights of each group, the intercept last, from ``x`` (array of inputs), ``y`` and ``w``.

    Least is the weighted mean of the loss plus half of ``penalty`` times the squared weights, the intercept's
    excepted. A group lists the positions of its inputs in ``x``. Inputs hold no missing values.
    """
    names = list(groups)
    width = len(rows.select("x").first()["x"])
    columns = [np.array([*groups[g], width]) for g in names]
    weights = [np.zeros(len(c)) for c in columns]
    total = rows.agg(F.sum("w")).first()[0]
    for _ in range(STEPS):
        def sums(batches: Iterator[pa.RecordBatch], at: list[np.ndarray] = weights) -> Iterator[pa.RecordBatch]:
            parts = [np.zeros((len(c), len(c) + 1)) for c in columns]
            for batch in batches:
                x, y, w = _inputs(batch), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                for part, c, b in zip(parts, columns, at):
                    own = x[:, c]
                    p = 1.0 / (1.0 + np.exp(-np.clip(own @ b, -700, 700)))
                    part[:, :-1] += own.T @ (own * (w * p * (1 - p))[:, None])
                    part[:, -1] += own.T @ (w * (y - p))
            flat = np.concatenate([part.ravel() for part in parts])
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat)), "v": flat})

        found = rows.select("x", "y", "w").mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        flat = np.array([r["v"] for r in found.orderBy("at").collect()]) / total  # a number for each pair of a group's inputs
        moved, start = 0.0, 0
        stepped = []
        for c, b in zip(columns, weights):
            n = len(c)
            part = flat[start: start + n * (n + 1)].reshape(n, n + 1)
            start += n * (n + 1)
            ridge = penalty * np.append(np.ones(n - 1), 0.0)
            step = np.linalg.solve(part[:, :-1] + np.diag(ridge), part[:, -1] - ridge * b)
            stepped.append(b + step)
            moved = max(moved, float(np.abs(step).max()))
        weights = stepped
        if moved <= SETTLED:
            break
    return dict(zip(names, weights))


def score_groups(rows: DataFrame, groups: dict[str, list[int]], weights: dict[str, np.ndarray]) -> DataFrame:
    """``dataset`` (the group), ``y_true``, ``y_score``: every row once for each group, from ``x`` and ``y``."""
    names = list(groups)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _inputs(batch), batch.column("y").to_numpy().astype(np.int32)
            for g in names:
                p = 1.0 / (1.0 + np.exp(-np.clip(x[:, [*groups[g], x.shape[1] - 1]] @ weights[g], -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(y)), pa.array(y), pa.array(p)], names=["dataset", "y_true", "y_score"]
                )

    return rows.select("x", "y").mapInArrow(score, "dataset string, y_true int, y_score double")
