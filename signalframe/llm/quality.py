"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics of a bounded sample of labelled documents are binned by quantiles; every level of a tree is
chosen from histograms of gradients by node, statistic and bin. The trees are complete and flattened into
three arrays, so that a batch of documents walks all trees at once by array look-ups.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from signalframe.llm.common import column, rows
from signalframe.llm.toxicity import labelled_sample

SAMPLE = 20_000  # labelled documents that are read for fitting, at most; the same number at every size
TREES, DEPTH, RATE, BINS, LEAF = 80, 4, 0.15, 64, 20.0
THRESHOLD = 0.5

NAMES = (
    "log_bytes", "words_per_line", "word_length", "distinct_words", "top_word", "repeated_word", "upper", "digit", "space", "wide",
    "exclaim", "pipe", "marks", "comma", "stop", "other", "distinct_lines", "ending_mark", "capital_words", "long_words",
    "one_letter_words", "line_length", "top_five_words", "end_stop_lines", "repeated_pair",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_LETTER = _UPPER + bytes(range(97, 123))
_WIDE = bytes(range(128, 256))
_MARKS = b"#$%&*@^~_=+<>{}[]\\/"
_SPACE = b" \t\r\n\v\f"


def statistics(text: str | None) -> list[float]:
    """The statistics NAMES of a whole text; those of an empty text are zero."""
    body = (text or "").encode("utf-8", "replace")
    found = body.split()
    if not found:
        return [0.0] * len(NAMES)
    size, n = len(body), len(found)
    lines = [line for line in body.split(b"\n") if line.strip()]

    def share(characters: bytes) -> float:
        return (size - len(body.translate(None, characters))) / size

    lengths = np.fromiter(map(len, found), np.int64, n)
    counts = Counter(found)
    top = sorted(counts.values(), reverse=True)[:5]
    pairs = Counter(zip(found, found[1:]))
    letters, upper, digit, space, wide = map(share, (_LETTER, _UPPER, _DIGIT, _SPACE, _WIDE))
    ends = Counter(w[-1] for w in found)
    return [
        float(np.log1p(size)), n / len(lines), float(lengths.mean()), len(counts) / n, top[0] / n,
        sum(map(eq, found, found[1:])) / n, upper / max(letters, 1e-9), digit, space, wide,
        body.count(b"!") / n, body.count(b"|") / n, share(_MARKS), body.count(b",") / n, body.count(b".") / n,
        max(0.0, 1 - letters - digit - space - wide), len(set(lines)) / len(lines),
        sum(c for b, c in ends.items() if b in b"!#$%&*@") / n,
        sum(w[0] in _UPPER for w in found) / n, float((lengths > 20).mean()), float((lengths == 1).mean()),
        float(np.log1p(size / len(lines))), sum(top) / n, sum(line.rstrip().endswith(b".") for line in lines) / len(lines),
        (max(pairs.values()) - 1) / n if pairs else 0.0,
    ]


@dataclass
class Trees:
    """Complete trees: inner node k of a tree has the children 2k+1 and 2k+2; the leaves follow the last level."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    limit: np.ndarray  # a value above it goes right; infinite where a node is not split
    leaf: np.ndarray  # (trees, 2^depth)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.start)
        tree = np.arange(len(self.feature))
        node = np.zeros((len(x), len(tree)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.start + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0
) -> Trees:
    """Trees for the logistic loss, from histograms."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 2 ** depth - 1), np.int64), np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)), start)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    flat = binned + np.arange(width) * bins
    features = np.zeros((trees, 2 ** depth - 1), np.int64)
    limits = np.full((trees, 2 ** depth - 1), np.inf)
    leaves = np.zeros((trees, 2 ** depth))
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            nodes, first = 2 ** level, 2 ** level - 1
            cell = ((node * width * bins)[:, None] + flat).ravel()
            sums = [np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins) for v in (gradient, curve)]
            (g, h), total = (s.cumsum(axis=2) for s in sums), [s.sum(axis=2, keepdims=True) for s in sums]
            gain = g ** 2 / (h + ridge) + (total[0] - g) ** 2 / (total[1] - h + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain = np.where((h > LEAF / 20) & (total[1] - h > LEAF / 20), gain, -np.inf)
            for f, c in enumerate(cuts):
                gain[:, f, len(c):] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                if gain[k].flat[best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), bins)
                    features[t, first + k], limits[t, first + k] = f, cuts[f][b]
            node = 2 * node + (x[np.arange(len(y)), features[t, first + node]] > limits[t, first + node])
        g, h = (np.bincount(node, v, 2 ** depth) for v in (gradient, curve))
        leaves[t] = rate * g / (h + ridge)
        margin += leaves[t, node]
    return Trees(features, limits, leaves, start)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text") -> Trees:
    """Trees from at most `sample` of the documents that `labels` (id, `quality`) marks.

    Only the statistics of the sample reach the driver. Without labels, or with one class alone, there are no trees.
    """
    def run(batch):
        yield {"label": batch["label"], "x": [statistics(t) for t in batch["text"]]}

    seen = rows(labelled_sample(docs, labels, "quality", sample, id, text), run, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in seen], dtype=float).reshape(-1, len(NAMES))
    y = np.array([r["label"] for r in seen], dtype=float)
    order = np.lexsort(np.column_stack([x, y]).T) if len(x) else []  # the order of rows differs from run to run
    return boost(x[order], y[order])


def score(docs: DataFrame, trees: Trees, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text; null is an empty text; repeated rows stay."""
    def run(batch):
        x = np.array([statistics(t) for t in batch["text"]], dtype=float)
        yield {"doc_id": batch["doc_id"], "score": trees.score(x)}

    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, "doc_id long, score double")
