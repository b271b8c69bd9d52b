"""Encoding against the tokenizers library, hard negatives and ranked search against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalframe.llm import bpe, hard_negatives, queries, ranked_search

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(VOCABULARY)


def odd_texts(n):
    rng = random.Random(1)
    kinds = [
        "abc", "aaaa", "eeeinstheran", "0123456789", "'s't're'veé ü ß", "中文字🎉👍́", "\x1c\x85  ՘Ᲊ", " \n\t", "İΣς", "!!!...---",
        "<|endoftext|>", "<|startoftext|>", "<|endof", "<|STARTOFTEXT|>",
    ]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.choice(kinds)
            parts.append(kind if kind.startswith("<|") else "".join(rng.choice(kind) for _ in range(rng.randint(1, 30))))
            parts.append(rng.choice(["", " "]))
        yield "".join(parts)


def test_codec_equals_the_library(library):
    codec = bpe.Codec(VOCABULARY)
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(np.array(ids, dtype=np.int32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_small_tables_change_nothing(library, monkeypatch):
    for name in ("PAIRS", "WORDS", "IDS"):
        monkeypatch.setattr(bpe, name, 3)
    codec = bpe.Codec(VOCABULARY)
    for text in odd_texts(200):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(np.array(ids, dtype=np.int32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_a_long_word_takes_linear_time(library):
    codec, text = bpe.Codec(VOCABULARY), "a" * 100_000 + "ab" * 50_000 + "thethe" * 30_000
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aba": 3}, [["ab", "a"], ["a", "b"]], "")


def test_encoded_frames(spark, library):
    every = [None, "", " ", "Hello wörld's 42", "<|endoftext|>x"]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(every)] * 2, "doc_id long, text string, ids string")
    got = bpe.encode(docs, VOCABULARY, decoded=True)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in every]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got.collect()) == sorted(list(enumerate(want)) * 2)
    texts = {r["doc_id"] or 0: r["decoded"] for r in bpe.decode(got, VOCABULARY).collect()}
    assert texts == {i: library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(want)}
    strange = spark.createDataFrame([(1, None), (2, [320, None, -1, 10 ** 9])], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(strange, VOCABULARY).collect()} == {1: "", 2: library.decode([320])}
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_registered_encoding(spark, library):
    sf = "/root/testdata/sf0.001"
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe(spark, sf).collect()} == want


def mined(rows, anchors, positives=5, negatives=10):
    """Brute force over rows (id, vector, label); a score beyond 64 bits is the nearest number that has them."""
    most = (1 << 63) - 1
    whole = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all()]
    for a, (i, v, l) in enumerate(whole):
        if not anchors(i):
            continue
        score = lambda w: min(max(sum(x * y for x, y in zip(v, w)), -most), most)
        others = [(-score(w), j, m) for b, (j, w, m) in enumerate(whole) if b != a and len(w) == len(v)]
        for ps, j, _ in sorted(o for o in others if o[2] == l)[:positives]:
            fit = sorted((s, k) for s, k, m in others if m != l and -30 * ps <= -100 * s <= -90 * ps)
            for rank, (s, k) in enumerate(fit[:negatives], 1):
                yield i, j, rank, k, -ps, -s


@pytest.mark.parametrize("block", [8192, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(2, block // 8))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6)) + 0.5
    good = [[float(x) for x in np.round(base[rng.integers(12)] + rng.normal(scale=0.3, size=6), 1)] for _ in range(150)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(good)]
    rows += rows[:4] + rows[20:22]  # repeated rows, an anchor among them
    rows += [(300 + i, v, 0) for i, v in enumerate([None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0] * 4, [2.0] * 4])]
    rows += [(400, [1.0] * 6, None), (None, [1.0] * 6, 1), (40, [1.0] * 4, 1), (60, [-1.0] * 4, 1), (500, [0.0] * 6, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 20 == 0).collect()]
    want = list(mined(rows, lambda i: i % 20 == 0))
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_hard_negatives_of_huge_numbers_and_nothing(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** (i % 4 * 3)], i % 2) for i in range(60)]
    rows += [(100, [1e300, 1e300, 1.0], 0), (101, [1e305, 1.0, 1.0], 1), (102, [1e290, 0.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(mined(rows, lambda i: i % 10 == 0))
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame, F.col("vec_id") < 0).count() == 0


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c >= "\x80" or c.isalnum() else " " for c in low).split(" ")


def ranked(docs, items, top=20):
    held = [(d, Counter(w for w in terms(t) if w)) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for w, k in df.items()}
    for item, text in items:
        scores = []
        for d, c, x in held:
            m = 75 + 25 * x * n // total
            s = sum(weight[w] * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s and d is not None:
                scores.append((-s, d))
        yield from ((item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Äb", "x" * 30]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(2, "w7 w8"), (2, "w7 w8"), (None, "w40 w41 w42"), (5000, None), (5001, ""), (5002, "-- _ !")]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(90, None), (91, ""), (92, "nowhere"), (3, "w3 W3 w3"), (3, "w3 W3 w3")]
    return docs, items


@pytest.mark.parametrize("slice_bytes, bundle, batch", [(8 << 20, 256, 4 << 20), (600, 7, 4 << 20), (3000, 3, 500)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, slice_bytes, bundle, batch):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "BUNDLE", bundle)
    monkeypatch.setattr(ranked_search, "BATCH", batch)
    own = ranked_search.rows
    monkeypatch.setattr(ranked_search, "rows", lambda *a, **k: own(*a, **k, limit=slice_bytes))
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    got = [tuple(r) for r in ranked_search.search(left, right).collect()]
    assert sorted(got) == sorted(ranked(docs, items))


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a c")], "item_id string, text string")
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [("q", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.select("item_id", F.lit(None).cast("string").alias("text")))):
        empty = ranked_search.search(d, i)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 5)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aB9é -_\n") for _ in range(rng.randint(0, 60)))
        assert ranked_search.term_counts(text) == Counter(w.encode() for w in terms(text) if w)
