"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicons and patterns. A lexicon entry is a word, or a beginning of words, that is common among the
toxic documents of a labelled sample and rare elsewhere; each is a voter of its own. Patterns vote on style.
The label model gives each voter a rate of voting in toxic and in clean documents, and estimates from what
the posterior leaves unexplained how far voters are correlated; correlated voters share their weight. It is
fitted by expectation and maximisation, anchored by the labels. The classifier then learns the mean of label
and posterior from counts of the same signs, and only it scores documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalframe.llm.common import column, rows, words

SAMPLE = 12_000  # labelled documents that are read for fitting, at most; the same number at every size
PREFIXES = (3, 4, 5, 6, 7, 8)  # characters
SUPPORT = 3  # least number of the sample's toxic documents that an entry is in, whatever their share
PRECISION = 0.5  # least lower bound of the share of toxic documents among those with an entry
THRESHOLD = 0.3
CHUNK = 512  # documents whose signs are held as dense rows at once

#: Words of abuse that vote whatever the labels say (fixed values).
ABUSE = frozenset(
    "idiot idiots moron morons loser losers scum trash clown clowns stupid pathetic worthless disgusting dumb imbecile "
    "cretin filthy vermin garbage freak freaks pig pigs subhuman parasite parasites".split()
)
#: Patterns on the style of a text (fixed values); they vote by how often they are found per 100 words.
PATTERNS = {
    "address": re.compile(r"\byou(?:'re| are)?\s+(?:a|an|such|all|so)\b", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|destroy|beat)\s+(?:you|him|her|them|yourself)\b", re.I),
    "shouting": re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,})+"),
    "exclaiming": re.compile(r"[!?]{2,}"),
    "masked": re.compile(r"\b[a-z]+[*@#$]+[a-z]+\b", re.I),
}


def held_out(id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(id.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `size` labelled documents, chosen by a hash of the id.

    Of several labels of a document the largest counts; null labels and null ids are left out. The chosen
    ids, at most `size`, are broadcast, so the documents are only scanned.
    """
    known = labels.select(column(id).cast("long").alias("_id"), column(label).cast("int").alias("label")).dropna()
    chosen = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(size)
    found = docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    return found.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


def signs(own: Iterable[str]) -> set[str]:
    """The different words of a text and the beginnings of longer ones, those with `*` behind."""
    different = set(own)
    return different | {w[:k] + "*" for w in different for k in PREFIXES if len(w) > k}


def _words(text: str | None) -> list[str]:
    return b" ".join(words(text)).decode("utf-8", "replace").split(" ") if text else []


def mine(sample: DataFrame) -> list[str]:
    """All signs that are in SUPPORT or more toxic documents of the sample and are precise enough.

    Of signs that are in the same documents one is left out only where the beginning of words that covers it stays.
    """
    def count(batch):
        seen, toxic, where = Counter(), Counter(), Counter()
        for id, body, label in zip(batch["doc_id"], batch["text"], batch["label"]):
            own = signs(_words(body))
            seen.update(own)
            # sums of 48 bits stay in a long; equal sums are equal sets of documents
            mark = xxhash.xxh64_intdigest(str(id)) >> 16
            for s in own:
                where[s] += mark
            if label:
                toxic.update(own)
        yield {"sign": list(seen), "n": list(seen.values()), "toxic": [toxic[s] for s in seen], "docs": [where[s] for s in seen]}

    counted = rows(sample.select("doc_id", "text", "label"), count, "sign string, n long, toxic long, docs long")
    counted = counted.groupBy("sign").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "docs")])
    p, z = F.col("toxic") / F.col("n"), 1.64
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt((p * (1 - p) + z * z / (4 * F.col("n"))) / F.col("n"))) / (1 + z * z / F.col("n"))
    good = counted.where(F.col("toxic") >= SUPPORT).where(bound >= PRECISION)
    found = good.orderBy(F.desc("toxic"), F.desc(bound), "sign").collect()  # bounded by the sample
    same = {(r["docs"], r["sign"]) for r in found}
    covered = lambda r: any((r["docs"], r["sign"][:k] + "*") in same for k in PREFIXES if len(r["sign"].rstrip("*")) > k)
    return [r["sign"] for r in found if not covered(r)]


@dataclass
class Lexicon:
    """What the voters look for; `found` gives the counts of all signs in a text."""

    mined: list[str]
    at: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.at = {s: i for i, s in enumerate(self.mined)}

    @property
    def voters(self) -> int:
        return len(self.mined) + 1 + len(PATTERNS)

    def found(self, text: str | None) -> np.ndarray:
        """Counts: mined signs, words of abuse, then patterns per 100 words; last the number of words."""
        own = _words(text)
        out = np.zeros(self.voters + 1)
        at = self.at.get
        for word, n in Counter(own).items():
            if (i := at(word)) is not None:
                out[i] += n
            for k in PREFIXES:
                if len(word) > k and (i := at(word[:k] + "*")) is not None:
                    out[i] += n
            if word in ABUSE:
                out[len(self.mined)] += n
        for j, pattern in enumerate(PATTERNS.values()):
            out[len(self.mined) + 1 + j] = 100 * len(pattern.findall(text or "")) / max(len(own), 1)
        out[-1] = len(own)
        return out

    def votes(self, found: np.ndarray) -> np.ndarray:
        """1 where a voter finds its sign: a word at all, a pattern once in 100 words or more."""
        least = np.where(np.arange(self.voters) <= len(self.mined), 1e-9, 1.0)
        return (found[:, :-1] >= least).astype(np.float32)

    def features(self, found: np.ndarray) -> np.ndarray:
        """Inputs of the classifier: votes, and the density of all lexicon hits."""
        hits = found[:, : len(self.mined) + 1].sum(axis=1)
        lengths = np.maximum(found[:, -1], 1)
        votes = self.votes(found)
        lexicon = votes[:, : len(self.mined) + 1]
        more = [np.log1p(hits), np.log1p(1000 * hits / lengths), lexicon.sum(axis=1) == 0, np.log1p(lengths) / 10]
        return np.column_stack([votes, *(m.astype(np.float32) for m in more)])


@dataclass
class LabelModel:
    """P(vote | class) of every voter, their shared weights, and the share of the toxic class."""

    rate: np.ndarray  # (2, voters)
    weight: np.ndarray
    prior: float

    @staticmethod
    def fit(votes: np.ndarray, labels: np.ndarray, rounds: int = 30, anchor: float = 0.5) -> LabelModel:
        """Expectation and maximisation; `anchor` is the share of a document's label in its posterior."""
        posterior = labels.astype(float)
        prior = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        model = LabelModel(np.full((2, votes.shape[1]), 0.5), np.ones(votes.shape[1]), prior)
        together = (votes.T @ votes).astype(float)
        for _ in range(rounds if len(votes) else 0):
            for k, part in enumerate((1 - posterior, posterior)):
                model.rate[k] = (part @ votes + 0.5) / (part.sum() + 1)
            # products of what the posterior leaves unexplained, votes - part @ rate, without a row for each document
            part = np.column_stack([1 - posterior, posterior])
            shared = np.vstack([part[:, k] @ votes for k in (0, 1)]).T @ model.rate
            residual = (together - shared - shared.T + model.rate.T @ (part.T @ part) @ model.rate) / len(votes)
            spread = np.sqrt(np.maximum(np.diag(residual), 0)) + 1e-9
            correlation = residual / np.outer(spread, spread)
            model.weight = 1 / np.maximum(1, np.where(correlation > 0.1, correlation, 0).sum(axis=1))
            new = anchor * labels + (1 - anchor) * model.posterior(votes)
            if np.abs(new - posterior).max(initial=0) < 1e-4:
                break
            posterior = new
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        for_ = np.log(self.rate[1] / self.rate[0]) * self.weight
        against = np.log((1 - self.rate[1]) / (1 - self.rate[0])) * self.weight
        z = math.log(self.prior / (1 - self.prior)) + against.sum() + votes @ (for_ - against)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on probabilities, by Newton steps."""
    weights = np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        slope, curve = -penalty @ weights, penalty.copy()
        for at in range(0, len(x), CHUNK):
            part = np.column_stack([x[at: at + CHUNK], np.ones(len(x[at: at + CHUNK]))]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ weights, -30, 30)))
            curve += (part * (p * (1 - p))[:, None]).T @ part
            slope += part.T @ (target[at: at + CHUNK] - p)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray

    def of(self, texts: list[str | None]) -> np.ndarray:
        parts = (texts[at: at + CHUNK] for at in range(0, len(texts), CHUNK))
        return np.concatenate([np.zeros(0), *(self.score(np.array([self.lexicon.found(t) for t in part])) for part in parts)])

    def score(self, found: np.ndarray) -> np.ndarray:
        x = self.lexicon.features(found)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text") -> Model:
    """Fits voters, label model and classifier on at most `sample` of the labelled documents.

    `labels`: the id and `toxic` (1 or 0). Without labelled documents nothing is toxic: all scores are near 0.
    """
    known = labelled_sample(docs, labels, "toxic", sample, id, text).cache()
    try:
        lexicon = Lexicon(mine(known))

        def look(batch):
            at, value = [], []
            for body in batch["text"]:
                found = lexicon.found(body)
                at.append(np.flatnonzero(found).tolist())
                value.append(found[at[-1]].tolist())
            yield {"label": batch["label"], "at": at, "value": value}

        seen = rows(known, look, "label int, at array<int>, value array<double>").collect()  # `sample` rows at most
    finally:
        known.unpersist()
    # the order of rows differs from run to run, sums of doubles would too
    seen.sort(key=lambda r: (r["at"], r["value"], r["label"]))
    target = np.array([r["label"] for r in seen], dtype=float)
    found = np.zeros((len(seen), lexicon.voters + 1))
    for k, r in enumerate(seen):
        found[k, r["at"]] = r["value"]
    votes, x = lexicon.votes(found), lexicon.features(found)
    del found, seen
    model = LabelModel.fit(votes, target)
    soft = 0.5 * target + 0.5 * model.posterior(votes)
    weights = fit_linear(x, soft)
    weights[-1] -= 0.0 if len(target) else 30.0
    return Model(lexicon, model, weights)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text; null and empty texts have no signs; repeated rows stay."""
    def run(batch):
        yield {"doc_id": batch["doc_id"], "score": model.of(batch["text"])}

    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they were."""
    names = docs.columns

    def run(batch):
        keep = np.flatnonzero(model.of(batch[text]) < threshold)
        yield {c: [batch[c][i] for i in keep] for c in names}

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows(docs.select(*[column(c) for c in names]), run, kind)
