"""URL filter and sharding against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from signalframe.llm import sharding, url_filter

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def plain_canonical(url):
    host, path = split(url)
    if not host:
        return None
    for start in ("www.", "m."):
        if host.startswith(start):
            host = host[len(start):]
            break
    return host + path.removesuffix(".html").rstrip("/")


def plain_judge(url, listed):
    host, path = split(url)
    fits = [
        (len(h + p), v == "block", h + p, v) for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return max(fits)[2:]
    return None, "block" if plain_canonical(url) in listed else "allow"


def urls():
    rng = random.Random(3)
    out = [None, "", "no scheme", "http://", "://a.org/x", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org", "http://xexample.org/es/",
           "http://a.com/fr/://b.org/", "http://é.org/ß/1.html", "http://com/de/", "http://a.com:80/fr/", "http://example.org/en/1" + "9" * 3000]
    for _ in range(400):
        host = rng.choice(["a.org", "m.example.org", "example.org", "www.B.com", "x.y.com", "net", "a.net"])
        out.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randint(1, 40)}"
                   + rng.choice(["", "/", ".html", "?a=1", "#t", "/?x#y"]))
    return out


def test_judge_equals_plain_rules(spark):
    every = urls()
    listed = {plain_canonical(u) for u in every[20::9] if plain_canonical(u)}
    pages = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(every)], "page_id long, url string, `a.b` string, rule string")
    table = spark.createDataFrame([(c,) for c in [*listed, *listed, None]], "canonical string")
    rules = spark.createDataFrame(RULES * 2, "verdict string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, table, rules).collect()}
    assert len(got) == len(every)
    for i, u in enumerate(every):
        r = got[i]
        assert (r["host"], r["path"]) == split(u)
        assert (r["rule"], r["verdict"]) == plain_judge(u, listed), u
        assert r["canonical"] == plain_canonical(u) and r["in_list"] == (plain_canonical(u) in listed) and r["a.b"] == "kept"


def test_filter_lets_every_key_through_and_few_others(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    others = spark.range(20000).selectExpr("concat('o', id) as key")
    blocks = 5000 * url_filter.BITS_PER_KEY // 512
    made = url_filter.bloom(keys, blocks)
    assert url_filter.possible(keys, made, blocks).count() == 5000
    assert url_filter.possible(others, made, blocks).count() < 200


def test_empty_lists_and_repeated_pages(spark):
    none = spark.createDataFrame([], "canonical string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/")] * 3, "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(pages, none, rules).collect()] == ["allow"] * 3
    assert url_filter.judge(pages.limit(0), none, rules).count() == 0


@pytest.mark.parametrize("n,shards,bucket", [(0, 8, 10), (3, 8, 10), (1003, 8, 50), (800, 1, 1 << 20)])
def test_shards_are_exact(spark, n, shards, bucket):
    rows = spark.range(n, numPartitions=7).selectExpr("id", "'x' as shard", "cast(null as int) as `a.b`")
    got = sharding.shuffle(rows, shards, seed=5, bucket_rows=bucket).toPandas()
    assert sorted(got["id"]) == list(range(n))
    sizes = [int((got["shard"] == s).sum()) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(got.loc[got["shard"] == s, "slot"]) == list(range(sizes[s]))


def test_equal_rows_and_null_keys_stay_apart(spark):
    rows = spark.createDataFrame([(None, "a")] * 20 + [(1, "a")] * 20, "doc_id long, text string")
    got = sharding.shuffle(rows, 4).collect()
    assert Counter((r["shard"]) for r in got) == {0: 10, 1: 10, 2: 10, 3: 10}


def test_matrix_has_both_margins_and_the_right_law():
    counts, buckets = np.array([7, 0, 12, 1, 30]), np.array([10, 25, 15])
    drawn = []
    for seed in range(800):
        m = np.array([sharding.matrix_row(counts, buckets, p, seed) for p in range(5)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == buckets).all()
        drawn.append(m[2, 1])
    n, k, total = 12, 25, 50
    mean, variance = n * k / total, n * k / total * (1 - k / total) * (total - n) / (total - 1)
    assert abs(np.mean(drawn) - mean) < 4 * (variance / 800) ** 0.5
    assert 0.8 < np.var(drawn) / variance < 1.25


def test_large_margins_use_the_normal_law():
    counts, buckets = np.array([4_000_000_000, 2_000_000_000]), np.array([3_000_000_000, 3_000_000_000])
    row = sharding.matrix_row(counts, buckets, 0, 1)
    assert row.sum() == counts[0] and abs(row[0] - 2_000_000_000) < 300_000


def test_a_row_is_equally_likely_in_every_shard(spark):
    rows = spark.range(40, numPartitions=4)
    where = Counter()
    for seed in range(12):
        where.update((r["shard"]) for r in sharding.shuffle(rows, 4, seed=seed).where("id < 10").collect())
    assert all(10 <= where[s] <= 52 for s in range(4))


@pytest.mark.parametrize("good, bad, n", [
    (40, 60, 30), (500, 700, 400), (3, 5000, 2000), (5000, 3, 4990), (900, 100, 70), (100, 3000, 80), (2000, 2000, 3900), (300, 200, 100), (7, 9, 16),
])
def test_draws_follow_the_law(good, bad, n):
    rng, draws = np.random.default_rng(4), 20_000
    got = np.bincount([sharding.hypergeometric(good, bad, n, rng) for _ in range(draws)], minlength=n + 1)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    low, high = max(0, n - bad), min(n, good)
    want = np.zeros(len(got))
    want[low:high + 1] = [math.exp(log(good, k) + log(bad, n - k) - log(good + bad, n)) * draws for k in range(low, high + 1)]
    assert want.sum() == pytest.approx(draws) and not got[want == 0].any()
    large = want >= 8
    spread = (got[large] - want[large]) ** 2 / want[large]
    assert spread.sum() < large.sum() + 5 * (2 * large.sum()) ** 0.5 + 3
    assert abs(got[~large].sum() - want[~large].sum()) < 5 * max(want[~large].sum(), 1) ** 0.5 + 3


def test_draws_of_billions():
    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10 ** 11, 5 * 10 ** 12, 10 ** 12
    total, share = good + bad, good / (good + bad)
    draws = np.array([sharding.hypergeometric(good, bad, n, rng) for _ in range(4000)], dtype=float)
    spread = (n * share * (1 - share) * (total - n) / (total - 1)) ** 0.5
    assert abs(draws.mean() - n * share) < 5 * spread / 4000 ** 0.5 and abs(draws.std() / spread - 1) < 0.06
    few = [sharding.hypergeometric(10 ** 12, 10 ** 12, 3, rng) for _ in range(4000)]
    assert np.bincount(few, minlength=4) == pytest.approx([500, 1500, 1500, 500], abs=150)
    rare = [sharding.hypergeometric(10 ** 6, 10 ** 12, 10 ** 6, rng) for _ in range(4000)]  # one is expected
    assert np.mean(rare) == pytest.approx(1, abs=0.1) and np.var(rare) == pytest.approx(1, abs=0.15)
    assert sharding._log_ratio(10 ** 12 + 5, 10 ** 12) == pytest.approx(sum(math.log(10 ** 12 + k) for k in range(1, 6)), rel=1e-14)
