"""Components, SimHash and embedding links against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from signalframe.llm import embedding_dedup, links, simhash


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "empty"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(500, 600), (600, 7)],
        "random": [(rng.randint(-50, 300), rng.randint(0, 300)) for _ in range(200)],
        "cycle": [(i, (i * 7 + 1) % 97) for i in range(97)] + [(5, 5)], "empty": [],
    }[kind]
    edges = spark.createDataFrame(pairs + pairs[:3], "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
    want = groups({x for p in pairs for x in p if p[0] != p[1]}, [p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in links.components(edges).collect()} == want


def test_forest_keeps_earlier_joins():
    root = links.forest(6, np.array([1, 4]), np.array([3, 5]))
    assert links.forest(6, np.array([3]), np.array([5]), root).tolist() == [0, 1, 2, 1, 1, 1]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in "".join(" " if c in "\t\n\r\v\f" else c for c in low).split(" ") if w]
    shingles = [" ".join(own[i:i + 4]) for i in range(len(own) - 3)] if len(own) >= 4 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}é" for i in range(40)] + ["A", "b c", "Zz"]
    out = [None, "", " \t\n", "one", "one two three", "one two three four", "x " * 700, "x " * 701]
    for _ in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        out.append(" ".join(body))
        for _ in range(rng.randint(0, 4)):
            copy = list(body)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\n".join(copy))
    return out


def test_fingerprints_equal_plain_ones():
    every = texts()
    assert [int(v) for v in simhash.fingerprint_batch(every)] == [plain_fingerprint(t) for t in every]


def plain_near_groups(texts):
    """The smallest id that each text reaches over pairs with a Jaccard similarity of 0.8 of their 5-word shingles."""
    sets = {}
    for i, text in texts.items():
        own = [w for w in "".join(" " if c in "\t\n\r\v\f" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
        sets[i] = {tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))} if own else {()}
    return groups(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_rows_that_share_an_id_are_kept_by_their_text(spark):
    a, b, c, x, y = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcxy")
    schema = "doc_id long, text string, _bits string"
    of = lambda rows: sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(spark.createDataFrame([(i, t, "k") for i, t in rows], schema)).collect())
    assert of([(1, a), (1, b), (2, c), (3, a)]) == [(1, a), (1, b), (2, c)]
    assert of([(5, x), (7, x), (7, y)]) == [(5, x), (7, y)]
    assert of([(5, x), (5, x), (4, y), (5, y), (6, None), (8, "")]) == [(4, y), (5, x), (6, None)]


def near_corpus():
    """Texts of a few hundred words, and changed copies of them with a similarity between 0.6 and 1."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(4000)]
    out = []
    for _ in range(60):
        body = rng.choices(words, k=rng.randint(80, 400))
        out.append(" ".join(body))
        for _ in range(rng.randint(1, 4)):
            copy = list(body)
            for _ in range(rng.randint(1, max(1, len(body) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return dict(enumerate(out))


def test_near_copies_are_found_and_no_others(spark):
    texts = near_corpus()
    want = plain_near_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    goes = {i for i, g in want.items() if g != i}
    assert len(goes) > 60 and kept >= set(texts) - goes
    assert len(goes - kept) >= 0.9 * len(goes)


@pytest.mark.parametrize(("common", "cell"), [(64, 1 << 21), (2, 0)])
def test_no_link_at_the_threshold_is_lost(spark, monkeypatch, common, cell):
    """Pairs about the threshold, whatever their fingerprints; a passage that many texts share; repeats of one set."""
    for name, value in (("COMMON", common), ("CELL", cell), ("PAIRS", 0)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng = random.Random(7)
    words = [f"v{i}" for i in range(5000)]
    passage, out = rng.choices(words, k=40), []
    for k in range(110):
        body = rng.choices(words, k=rng.randint(12, 90)) + passage * (k % 2)
        out.append(" ".join(body))
        for _ in range(2):  # a run of changed words takes 4 shingles more than it has words
            n = max(1, round((len(body) - 4) * rng.uniform(0.07, 0.13)) - 4)
            at = rng.randrange(len(body) - n)
            out.append(" ".join([*body[:at], *rng.choices(words, k=n), *body[at + n:]]))
    out += ["p q r s t " * 4, "p q r s t " * 40]
    rng.shuffle(out)
    texts = dict(enumerate(out))
    want = plain_near_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == sorted(set(want.values()))


def test_heads_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    listed = np.sort(rng.choice(400, 60, replace=False).astype(np.uint64))
    place, met = rng.permutation(60), 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.93], rng.integers(0, 400, rng.integers(0, 4)).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        if not len(b) or same < 0.8 * (len(a) + len(b) - same):
            continue
        met += 1
        heads = [simhash.head(x, listed, place, 0.8) for x in (a, b)]
        n = len(np.intersect1d(*heads))
        assert n and n + max(len(x) - len(h) for x, h in zip((a, b), heads)) >= same
    assert met > 500


@pytest.mark.parametrize("chunk", [256, 2])
def test_few_pairs_beside_those_alike_are_within_reach(spark, monkeypatch, chunk):
    """A passage that texts of any size share brings few pairs together; no pair of the similarity goes."""
    monkeypatch.setattr(simhash, "CHUNK", chunk, raising=False)
    rng, sets, group = np.random.default_rng(5), [], []
    for k in range(40):
        body = rng.integers(1 << 40, 1 << 62, rng.integers(20, 300)).astype(np.uint64)
        for n, share in enumerate((1, 0.97, 0.93, 0.85, 0.6)):
            kept = body[rng.random(len(body)) < share]
            own = rng.integers(1 << 40, 1 << 62, len(body) - len(kept)).astype(np.uint64)
            sets.append(np.unique(np.concatenate((kept, own, np.arange(8 * (k % 2), dtype=np.uint64)))))
            group.append(5 * k if k % 3 == 0 and n < 3 else 5 * k + n)
    every = [(i, j) for i in range(200) for j in range(200) if group[i] < group[j]]
    same = {(i, j): len(np.intersect1d(sets[i], sets[j], True)) / len(np.union1d(sets[i], sets[j])) for i, j in every}
    want = {(i, j, group[i], group[j]) for i, j in every if same[i, j] >= 0.8}
    met = [(i, len(x), group[i], n, int(h)) for i, x in enumerate(sets) for n, h in enumerate(x[: simhash.head_size(len(x), 0.8)])]
    frame = spark.createDataFrame(met, "key long, size int, group long, pos int, shingle long")
    groups = spark.createDataFrame(list(enumerate(group)), "key long, group long")
    got = [tuple(r) for r in simhash._within_reach(frame, groups, 0.8).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 50 and len(got) <= len(every) // 20


@pytest.mark.parametrize(("cell", "met"), [(1 << 22, 1 << 20), (3000, 50)])
def test_pairs_are_compared_by_their_folded_sets(spark, monkeypatch, cell, met):
    """Few of the pairs that share enough of their heads need their whole sets; no pair of the similarity goes."""
    monkeypatch.setattr(simhash, "FOLDED", cell)
    monkeypatch.setattr(simhash, "MET", met)
    rng, sets = np.random.default_rng(4), []
    for _ in range(25):
        body = rng.integers(0, 1 << 62, rng.integers(20, 200)).astype(np.uint64)
        for share in (1, 0.95, 0.88, 0.6):
            kept = body[rng.random(len(body)) < share]
            sets.append(np.unique(np.concatenate((kept, rng.integers(0, 1 << 62, len(body) - len(kept)).astype(np.uint64)))))
    same = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    pairs = [(i, j) for i in range(100) for j in range(100) if i < j and (i // 4 == j // 4 or (i * j) % 7 == 0)]
    want = {p for p in pairs if same(*p) >= 0.8}
    least = spark.createDataFrame([(i, len(x), int(x[0])) for i, x in enumerate(sets)], "key long, size int, least long")
    folds = spark.createDataFrame([(i, simhash.fold(x)) for i, x in enumerate(sets)] * 2, "key long, fold binary")
    frame = spark.createDataFrame([(i, j, i, j) for i, j in pairs], "a long, b long, ga long, gb long")
    got = [(r["a"], r["b"]) for r in simhash._within_folds(least, folds, frame, 0.8).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and 20 < len(want) and len(got) <= 1.2 * len(want)


def test_a_folded_set_shares_no_less_than_the_set():
    rng = np.random.default_rng(6)
    for n in (0, 1, 50, 3000, 200_000):
        a, b = (np.unique(rng.integers(0, 1 << 18, n).astype(np.uint64) << np.uint64(9)) for _ in range(2))
        one, two = simhash.places(simhash.fold(a)), simhash.places(simhash.fold(b))
        assert len(np.unique(one)) == len(a) and len(np.intersect1d(one, two)) >= len(np.intersect1d(a, b))


def test_spanning_pairs_join_what_all_join():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 40
        a, b, far = rng.integers(0, n, 120), rng.integers(0, n, 120), rng.integers(0, 6, 120)
        chosen, root = simhash.spanning(n, a, b, far)
        assert (root == links.forest(n, a, b)).all()
        assert len(chosen) == n - len(np.unique(links.forest(n, a, b)))
        assert (links.forest(n, a[chosen], b[chosen]) == links.forest(n, a, b)).all()
        for limit in range(6):  # a nearest spanning forest spans each level too
            low, own = far <= limit, chosen[far[chosen] <= limit]
            assert (links.forest(n, a[own], b[own]) == links.forest(n, a[low], b[low])).all()


def test_a_large_group_of_near_copies_is_joined(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 500)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, 2), dtype=np.uint64)
    flips = lambda k: np.array([[sum(1 << int(b) for b in rng.choice(63, k // 2, replace=False)) for _ in range(2)] for _ in range(700)], dtype=np.uint64)
    every = np.concatenate([base[0] ^ flips(4), base[1] ^ flips(10), base[2:]])
    every = every[np.unique(every[:, 0], return_index=True)[1]]  # first fingerprints differ
    rng.shuffle(every)
    far = np.bitwise_count(every[:, None, :] ^ every[None, :, :]).astype(int)
    able = (far[:, :, 0] <= simhash.NEAR) & (far.sum(axis=2) <= simhash.BOTH)
    at = {int(v): i for i, v in enumerate(every[:, 0])}
    want = links.forest(len(every), *np.nonzero(able))
    for cut in (len(every), 500):
        pairs = [simhash.shard_candidates(every[:cut], every[cut:], True, simhash.NEAR, simhash.BOTH)]
        if cut < len(every):
            pairs.append(simhash.shard_candidates(every[cut:], every[:0], True, simhash.NEAR, simhash.BOTH))
        a, b = (np.array([at[int(v)] for p in pairs for v in p[k]]) for k in (0, 1))
        assert (links.forest(len(every), a, b) == want).all() and len(a) < 2 * len(every) and able[a, b].all()


def test_near_duplicates_equal_brute_force(spark):
    every = texts()
    docs = spark.createDataFrame([(i * 3 + 1, t, "s") for i, t in enumerate(every)], "doc_id long, text string, fingerprint string")
    prints = {i * 3 + 1: plain_fingerprint(t) for i, t in enumerate(every)}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(prints, pairs)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    near = plain_near_groups({i * 3 + 1: t for i, t in enumerate(every)})
    kept = simhash.deduplicate(docs)
    goes, gone = {i for i in near if near[i] != i}, set(near) - {r["doc_id"] for r in kept.collect()}
    assert gone <= goes and len(gone) >= 0.9 * len(goes) and kept.columns == docs.columns


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, None)], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 7), (7, 7), (7, 7), (9, 9)]
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(docs).collect()) == ["7", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_tree_shards_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(1200)], dtype=np.uint64)
    bits = np.unique(np.concatenate([base, base[rng.integers(0, 600, 1200)] ^ flips]))
    rng.shuffle(bits)
    want = {frozenset((int(a), int(b))) for i, a in enumerate(bits) for b in bits[i + 1:] if int(a ^ b).bit_count() <= 4}
    tree = simhash.build_tree(bits[:200], 4)
    row, shard, home = simhash.route(bits, tree, 4)
    assert home.sum() == len(bits)
    found = set()
    for s in range(16):
        own, seen = bits[row[(shard == s) & home]], bits[row[(shard == s) & ~home]]
        both = np.concatenate([own, seen])
        for a, b in simhash.near_pairs(own, both, 4):
            found |= {frozenset((int(own[i]), int(both[j]))) for i, j in zip(a, b) if own[i] != both[j]}
    assert found == want


def test_slices_of_a_shard_join_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "VISITORS", 40)
    rng = random.Random(9)
    bits = [rng.getrandbits(63) for _ in range(150)]
    bits += [b ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60) for b in bits]
    bits = sorted(set(bits))
    frame = spark.createDataFrame([(b,) for b in bits], "bits long")
    got = {(min(r), max(r)) for r in links.components(simhash.link_forest(frame)).collect()}
    want = groups(bits, [(a, b) for a in bits for b in bits if a < b and (a ^ b).bit_count() <= 4])
    linked = {n: g for n, g in want.items() if sum(v == g for v in want.values()) > 1}
    assert got == {(min(n, g), max(n, g)) for n, g in linked.items()}


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16)) + rng.normal(size=16)
    out = [*base, *(base[rng.integers(0, 60, 90)] + rng.normal(scale=0.25, size=(90, 16))), *base[:5], *(base[:3] * 4)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("rows_per_stripe", [256, 12])
def test_embedding_links_equal_brute_force(spark, monkeypatch, rows_per_stripe):
    monkeypatch.setattr(embedding_dedup, "STRIPE_ROWS", (rows_per_stripe, rows_per_stripe))
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    good = vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0] * 4]
    every = [*good, *odd]
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(every)], "vec_id long, embedding array<float>, n long")
    x = np.array(good)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    near[np.arange(len(x)), np.arange(len(x))] = False
    want = groups(range(len(every)), [tuple(map(int, p)) for p in np.argwhere(near)])
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(got) == len(every)
    for i in range(len(every)):
        assert got[i]["n_links"] == (int(near[i].sum()) if i < len(x) else 0)
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)


def test_embeddings_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.01])], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in rows if r["vec_id"]) == [(4, 2, 4, True)] * 2
    assert defaultdict(int, {r["vec_id"]: r["n_links"] for r in rows})[None] == 2


@pytest.mark.parametrize("small", [embedding_dedup.SMALL, 0])
def test_tiny_and_huge_doubles_link_like_others(spark, monkeypatch, small):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [-3.0, 1.0, 0.0]]
    sizes = [1.0, 1e-200, 1e200, 4e-320, 1e307]
    every = [[x * s for x in v] for s in sizes for v in base] + [[1e-200, 0.0, 0.0], [0.0] * 3]
    frame = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == {i: (9, 0) if i % 3 < 2 else (4, 2) for i in range(15)} | {15: (0, 15), 16: (0, 16)}


@pytest.mark.parametrize("small", [embedding_dedup.SMALL, 0])
def test_vectors_link_within_every_length(spark, monkeypatch, small):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    good = vectors()[:40]
    every = [*good, *good[:4], [None] * 65, [0.0] * 65, [1.0] * 70, [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [2.0, 4.0, 6.0], [3.0, -1.0, 0.0]]
    every += [[float(i == j) for j in range(80)] for i in (0, 0, 1)]
    frame = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<float>")
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    usable = [i for i, v in enumerate(every) if None not in v and any(v)]
    pairs = [(a, b) for a in usable for b in usable if a < b and len(every[a]) == len(every[b]) and cosine(every[a], every[b]) >= 0.95]
    want, n = groups(range(len(every)), pairs), Counter(i for p in pairs for i in p)
    assert n[0] and n[len(good) + 7] and n[len(every) - 2]
    got = embedding_dedup.near_duplicates(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i in range(len(every))}
