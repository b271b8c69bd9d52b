"""Benchmark decontamination with a positional inverted index.

The training documents are cut into segments; a segment is a row that holds, for every term the tests use,
the sorted positions at which it stands in the segment. The segments are stored, so further tests over the
same terms need no second pass over the texts. Segments are independent of each other: no posting is ever
shuffled, and a term that stands in every document is spread over all of them.

A test is a window of consecutive item words. Its terms are taken from the rarest of the corpus to the most
frequent: the positions of the rarest, moved to the window's start, are the candidates, and each further
term's list is intersected with them after moving by its own offset. What is left are exact matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalframe.llm.common import column, materialise, without, words

WIDTH = 10
SEGMENT_WORDS = 1 << 20  # words of a segment; a longer document is one of its own
WINDOWS = 100_000  # windows that are broadcast at a time: 8 MB at ten words
SLICE = 32  # documents read at a time


def item_words(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words): the words of every item that has some."""
    plain = F.translate(column(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return benchmark.select(column(id).alias("item_id"), found.alias("words")).where("size(words) > 0")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, terms, items): the different windows of all items with the ids of the items they stand in."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("terms"))
    return each.groupBy("terms").agg(F.collect_set("item_id").alias("items")).withColumn(
        "window", F.monotonically_increasing_id()
    )


def build_index(
    docs: DataFrame, vocabulary: dict[bytes, int], id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS
) -> DataFrame:
    """The stored index: a row per segment.

    (segment, doc_ids, lengths, terms, counts, positions): `lengths` are the documents' numbers of words; the
    documents follow each other with an empty position behind each, so that no phrase crosses documents;
    `positions` are those of terms[0], terms[1], ..., `counts` of each, in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = "segment string, doc_ids array<long>, lengths array<int>, terms array<int>, counts array<int>, positions array<int>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        ids, lengths, parts, filled, made = [], [], [], 0, 0
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()

        def segment() -> pa.RecordBatch:
            term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            at = np.flatnonzero(term >= 0).astype(np.int32)
            order = np.argsort(term[at], kind="stable")
            terms, counts = np.unique(term[at], return_counts=True)
            values = [f"{task}-{made}", ids, np.array(lengths, np.int32), terms.astype(np.int32), counts.astype(np.int32), at[order]]
            kinds = [pa.string(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=k) for v, k in zip(values, kinds)],
                names=["segment", "doc_ids", "lengths", "terms", "counts", "positions"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for doc, body in zip(part["doc_id"], part["text"]):
                    found = words(body)
                    if filled and filled + len(found) > segment_words:
                        yield segment()
                        ids, lengths, parts, filled, made = [], [], [], 0, made + 1
                    parts.append(np.array([number(w, -1) for w in found] + [-1], dtype=np.int32))
                    ids.append(doc)
                    lengths.append(len(found))
                    filled += len(found) + 1
        if ids:
            yield segment()

    source = docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    return materialise(source.mapInArrow(build, schema))


class _Segment:
    """A segment's postings, for look-ups of many (term, position) pairs at once."""

    def __init__(self, row: dict) -> None:
        self.terms, self.counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
        self.positions = np.asarray(row["positions"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.key = np.repeat(self.terms, self.counts) << 32 | self.positions  # sorted

    def _there(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, term)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == term[there]
        return at, there

    def number(self, term: np.ndarray) -> np.ndarray:
        """Postings of each term."""
        at, there = self._there(term)
        out = np.zeros(len(term), np.int64)
        out[there] = self.counts[at[there]]
        return out

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, position) of all postings of the terms."""
        at, there = self._there(term)
        own = np.flatnonzero(there)
        n, first = self.counts[at[own]], self.first[at[own]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(own, n), self.positions[np.repeat(first, n) + within]

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = term << 32 | np.maximum(position, 0)
        at = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        return (self.key[at] == wanted) & (position >= 0) if len(self.key) else np.zeros(len(term), bool)


def exact_matches(segment: _Segment, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window index, start) of all occurrences; `terms` and `offsets` from the rarest term on, -1 where none is left."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    # windows in runs of about two million candidates, which bounds the memory
    run = np.cumsum(segment.number(terms[:, 0])) >> 21
    for k in np.unique(run):
        own = np.flatnonzero(run == k)
        window, at = segment.lists(terms[own, 0])
        window = own[window]
        start = at - offsets[window, 0]
        for k in range(1, terms.shape[1]):
            term = terms[window, k]
            good = (term < 0) | segment.holds(term, start + offsets[window, k])
            window, start = window[good], start[good]
        found.append((window, start))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(windows: DataFrame, frequency: dict[int, int], vocabulary: dict[bytes, int], width: int):
    """Blocks of (terms, offsets, length, window ids), rarest terms first."""
    n = windows.count()
    count = max(1, -(-n // WINDOWS))
    for b in range(count):
        found = windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == b).select("window", "terms").collect()
        terms = np.full((len(found), width), -1, dtype=np.int64)
        offsets = np.zeros((len(found), width), dtype=np.int64)
        for i, r in enumerate(found):
            own = [vocabulary[t.encode()] for t in r["terms"]]
            for k, j in enumerate(sorted(range(len(own)), key=lambda j: frequency.get(own[j], 0))):
                terms[i, k], offsets[i, k] = own[j], j
        yield terms, offsets, np.array([len(r["terms"]) for r in found], np.int64), np.array([r["window"] for r in found], np.int64)


def vocabulary_of(items: DataFrame) -> dict[bytes, int]:
    """Numbers of the terms of the tests. The tests must fit the driver; the corpus need not."""
    terms = items.select(F.explode("words").alias("w")).distinct().orderBy("w").collect()
    return {r["w"].encode(): i for i, r in enumerate(terms)}


def phrase_matches(index: DataFrame, windows: DataFrame, vocabulary: dict[bytes, int], width: int = WIDTH) -> DataFrame:
    """(segment, ordinal, window, start): every exact occurrence of every window; start counts the document's words."""
    spark = index.sparkSession
    totals = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    frequency = {r["terms"]: r["n"] for r in totals.collect()}  # a row per term of the tests
    out = None
    for terms, offsets, _, names in _blocks(windows, frequency, vocabulary, width):
        shared = spark.sparkContext.broadcast((terms, offsets, names))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, offsets, names = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = _row(batch, k)
                    window, start = exact_matches(_Segment(row), terms, offsets)
                    ordinal = np.searchsorted(row["ends"], start, side="right")
                    begins = np.concatenate(([0], row["ends"] + 1))[ordinal]
                    yield pa.RecordBatch.from_pydict({
                        "segment": [batch.column("segment")[k].as_py()] * len(window), "ordinal": ordinal.astype(np.int32),
                        "window": names[window], "start": (start - begins).astype(np.int32),
                    }, schema=arrow)

        arrow = pa.schema([("segment", pa.string()), ("ordinal", pa.int32()), ("window", pa.int64()), ("start", pa.int32())])
        found = index.mapInArrow(search, "segment string, ordinal int, window long, start int")
        out = found if out is None else out.unionAll(found)
    return out


def _row(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    row = {c: batch.column(c)[k].values.to_numpy() for c in ("lengths", "terms", "counts", "positions")}
    return row | {"ends": np.cumsum(row["lengths"].astype(np.int64) + 1) - 1}


def proximity_matches(
    index: DataFrame, windows: DataFrame, vocabulary: dict[bytes, int], terms: int = 4, slop: int = 20, width: int = WIDTH
) -> DataFrame:
    """(segment, ordinal, window, start): places where the window's `terms` rarest different terms stand,
    in any order, each within `slop` words of the rarest one, which stands at `start`."""
    spark = index.sparkSession
    totals = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    frequency = {r["terms"]: r["n"] for r in totals.collect()}
    arrow = pa.schema([("segment", pa.string()), ("ordinal", pa.int32()), ("window", pa.int64()), ("start", pa.int32())])
    out = None
    for all_terms, _, _, names in _blocks(windows, frequency, vocabulary, width):
        rare = np.full((len(all_terms), terms), -1, dtype=np.int64)
        for i, own in enumerate(all_terms):
            different = list(dict.fromkeys(t for t in own.tolist() if t >= 0))[:terms]
            rare[i, :len(different)] = different
        shared = spark.sparkContext.broadcast((rare, names))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rare, names = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = _row(batch, k)
                    segment = _Segment(row)
                    window, at = segment.lists(rare[:, 0])
                    ordinal = np.searchsorted(row["ends"], at, side="right")
                    begins = np.concatenate(([0], row["ends"] + 1))
                    for j in range(1, terms):
                        term = rare[window, j]
                        # the next posting of the term from the left edge on, which must not pass the right one
                        left = np.maximum(at - slop, begins[ordinal])
                        right = np.minimum(at + slop, row["ends"][ordinal] - 1)
                        next_ = np.searchsorted(segment.key, term << 32 | left)
                        there = next_ < len(segment.key)
                        there[there] = segment.key[next_[there]] <= (term[there] << 32 | right[there])
                        good = (term < 0) | there
                        window, at, ordinal = window[good], at[good], ordinal[good]
                    yield pa.RecordBatch.from_pydict({
                        "segment": [batch.column("segment")[k].as_py()] * len(window), "ordinal": ordinal.astype(np.int32),
                        "window": names[window], "start": (at - begins[ordinal]).astype(np.int32),
                    }, schema=arrow)

        found = index.mapInArrow(search, "segment string, ordinal int, window long, start int")
        out = found if out is None else out.unionAll(found)
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for every document.

    A window is `width` consecutive item words, an item of fewer words is one window; words inside an
    occurrence of a window are hit. `items` are the ids of the items that have an occurring window.
    Null and empty texts have no words and hit nothing, nor do such items; a null item id counts as hit words
    but is not listed; repeated rows are judged alike and stay; other columns are not read.
    """
    items = materialise(item_words(benchmark, item_id, item_text))
    windows = materialise(item_windows(items, width))
    vocabulary = vocabulary_of(items)
    index = build_index(docs, vocabulary, id, text)
    matches = materialise(phrase_matches(index, windows, vocabulary, width))
    known = windows.select("window", F.size("terms").alias("length"), "items")
    found = matches.join(known, "window").withColumn("stop", F.col("start") + F.col("length"))
    # a document's matches are at most its words times the windows that can start at one: one
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["stop"]).alias("end"),
        ),
    )["n"]
    hit = found.groupBy("segment", "ordinal").agg(
        merged.alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    each = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("ordinal", "d"))
    each = each.select("segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return each.join(hit, ["segment", "ordinal"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array()).alias("items"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without an occurrence of a benchmark window; documents with a null id stay."""
    bad = contamination(docs, benchmark, width, id, text).where("contaminated and doc_id is not null")
    return without(docs, id, bad.select(F.col("doc_id").alias("_id")).distinct())
