"""Toxicity and quality: held-out accuracy on the given tables, exact traversal, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out_results(spark, name, label):
    got = queries.QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return got.join(labels, "doc_id").where("held_out").toPandas(), got.toPandas()


def auc(score, truth):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize("name,label,remainder,modulus,threshold,least", [
    ("op2_toxicity", "toxic", 2, 4, 0.3, 0.93), ("op9_quality", "quality", 1, 3, 0.5, 0.97),
])
def test_held_out_accuracy(spark, name, label, remainder, modulus, threshold, least):
    import zlib
    known, every = held_out_results(spark, name, label)
    assert len(every) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert every["score"].between(0, 1).all()
    assert (every["predicted"] == (every["score"] >= threshold)).all()
    assert (every["held_out"] == [zlib.crc32(str(d).encode()) % modulus == remainder for d in every["doc_id"]]).all()
    truth, predicted = known[label].to_numpy(), known["predicted"].to_numpy()
    hits = ((truth == 1) & (predicted == 1)).sum()
    assert 2 * hits / (truth.sum() + predicted.sum()) > least
    assert auc(known["score"].to_numpy(), truth) > least


def small(spark):
    rows = [(i, "you total idiot scum " + "word " * (i % 7) if i % 3 == 0 else "a calm text of words " * (1 + i % 5)) for i in range(120)]
    rows += [(500, None), (501, ""), (0, rows[0][1]), (None, "idiot scum")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(0, 1, 1), (9999, 1, 1), (None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_of_odd_rows(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 124
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[None] > 0.3 and by[3] > 0.3 and by[500] == by[501] < 0.3 and by[1] < 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 124 - 42
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs.limit(3), none).collect())
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_the_lexicon_is_mined_from_the_labels(spark):
    docs = spark.createDataFrame([(i, ("zorkal " if i % 4 == 0 else "") + f"plain text number{i}") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("zor") for s in model.lexicon.mined)
    new = spark.createDataFrame([(1, "a new zorkal"), (2, "nothing here")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert scores[1] > 0.3 > scores[2]


def test_label_model_shares_the_weight_of_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda rate: np.where(y, rng.random(4000) < rate, rng.random(4000) < 0.05).astype(float)
    one, two = vote(0.7), vote(0.7)
    model = toxicity.LabelModel.fit(np.column_stack([one, one, one, two]), y.astype(float))
    assert model.weight[:3].max() < 0.5 < model.weight[3]
    assert abs(model.rate[1, 3] - 0.7) < 0.05 and abs(model.rate[0, 3] - 0.05) < 0.03


def test_traversal_equals_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, len(quality.NAMES)))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(float)
    trees = quality.boost(x, y, trees=25, depth=4)
    for row in x[:60]:
        total = trees.start
        for t in range(25):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.limit[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        assert abs(total - trees.margin(row[None])[0]) < 1e-9
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_quality_of_odd_rows(spark):
    docs, labels = small(spark)
    trees = quality.fit(docs, labels)  # one class alone
    assert len(trees.feature) == 0
    assert quality.score(docs, trees).count() == 124 and quality.score(docs.limit(0), trees).count() == 0
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.NAMES)
    assert all(np.isfinite(quality.statistics(t)).all() for t in (" ", "\n", "a", "!", "é" * 100_000))


def test_rare_signs_vote_whatever_their_share(spark):
    texts = ["hatefulword in plain text" for _ in range(500)] + ["calm plain text in prose" for _ in range(500)]
    for word, at in (("strumfo", 0), ("strelki", 4), ("żółwiak", 8)):  # alike in their beginnings and counts
        texts[at:at + 4] = [f"plain text {word}"] * 4
    texts[12:16] = ["plain text braxo druzno"] * 4  # two words of the same documents
    extra = [f"plain manyword{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(260) for _ in range(4)]
    extra = [t.replace("manyword", f"{chr(97 + k // 4 % 26)}{chr(97 + k // 104)}q") for k, t in enumerate(extra)]
    docs = spark.createDataFrame(list(enumerate(texts + extra)), "doc_id long, text string")
    labels = docs.select("doc_id", ((F.col("doc_id") < 500) | (F.col("doc_id") >= 1000)).cast("int").alias("toxic"))
    mined = set(toxicity.mine(toxicity.labelled_sample(docs, labels, "toxic", 10_000)))
    assert all(toxicity.signs([w]) & mined for w in ("strumfo", "strelki", "żółwiak", "braxo", "druzno", "hatefulword"))
    assert all(toxicity.signs([t.split()[1]]) & mined for t in extra)
    assert not toxicity.signs(["calm", "prose"]) & mined
    # a beginning stands for longer ones of the same documents
    assert "hat*" in mined and "hate*" not in mined and "strumfo" not in mined
