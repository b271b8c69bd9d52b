"""The pipeline against its stages by hand."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from signalframe.llm import queries, secrets, toxicity
from tests.llm.test_links_and_copies import plain_near_groups
from tests.llm.test_texts import WORD, lower

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    out = tmp_path_factory.mktemp("sf")
    import random
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 8)))
    docs = []
    for i in range(160):
        body = [word() for _ in range(rng.randint(30, 120))]
        if i % 8 == 0:
            body[3:3] = ["idiot", "scum", "moron"]
        docs.append(" ".join(body))
    benchmark = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs[11] += " " + benchmark[2][1]
    docs[13] = docs[12] + " tail"
    docs[15] = docs[14]
    docs[21] += ' password = "Zx81kkq09aa2Pq" end'
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    for name, data, kind in (
        ("documents", rows, COLUMNS), ("benchmark", benchmark, "item_id long, text string"),
        ("labels", [(i, 1, int(i % 8 == 0)) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(data, kind).write.parquet(f"{out}/{name}.parquet")
    return str(out), docs, benchmark


def windows(text):
    own = WORD.findall(lower(text))
    return {tuple(own[i:i + 10]) for i in range(len(own) - 9)}


def test_run_equals_the_stages_by_hand(spark, folder):
    path, docs, benchmark = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    left = {i: t for i, t in enumerate(docs) if scores[i] < 0.3}
    assert not any(i in left for i in range(0, 160, 8)) and len(left) >= 130 and {11, 14, 15, 21} <= set(left)
    own = plain_near_groups(left)
    left = {i: t for i, t in left.items() if own[i] == i}
    assert 15 not in left and 14 in left and 13 not in left
    tests = set().union(*(windows(t) for _, t in benchmark))
    left = {i: t for i, t in left.items() if not windows(t) & tests}
    assert 11 not in left
    left = {i: secrets.redact(t, secrets.all_spans(t)) for i, t in left.items()}
    assert "Zx81kkq09aa2Pq" not in left[21]
    tokenizer = Tokenizer.from_str(queries.vocabulary())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in left.items()}

    got = defaultdict(list)
    fill = Counter()
    for r in corpus_pipeline.run(spark, path).collect():
        got[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
        fill[r["sequence_id"]] += r["length"]
    assert {i: np.frombuffer(b"".join(b for _, b in sorted(p)), "<u4").tolist() for i, p in got.items()} == want
    assert max(fill.values()) <= 2048


def test_stages_keep_the_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), path).count() == 0


def test_stages_take_nulls(spark, folder):
    path, *_ = folder
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, path)
        assert rows.count() >= 2
    assert pq.read_table(f"{path}/benchmark.parquet").num_rows == 5
