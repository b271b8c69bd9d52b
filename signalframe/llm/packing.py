"""Best-fit packing of tokenised documents by linear grouping.

Two sides. The rows: every document is tokenised where it lies, cut into pieces, and the pieces are stored.
The plan: only the number of pieces of each length (at most `capacity` numbers) goes to the driver, which
plans whole classes of equal sequences, whatever their number:

1. lengths above a share of the capacity are put into groups of equal cardinality and rounded up to their
   group's largest;
2. a linear program over configurations (how many of each rounded size go into a sequence) is solved by
   column generation, its whole part is kept;
3. the actual lengths take the places of the rounded ones, longest first;
4. what is left over, and all short pieces, go one length at a time into the fullest sequences they fit.

Where "large" begins is tried at a half, a third and a quarter of the capacity; the plan with the fewest
sequences is kept.

Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from signalframe.llm.common import column, kept, materialise, rows

CAPACITY = 2048
GROUPS = 48  # of equal cardinality, at most
LARGE = (2, 3, 4)  # lengths above capacity / LARGE are grouped
CACHE = 300_000  # words whose ids a worker keeps, the first that it meets: about 60 MB

#: The rule by which the byte-level tokenizer cuts texts before it merges bytes (a fixed value).
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Below this code point the character classes are the same in every version of Unicode in use.
STABLE = 0x250


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells the characters below STABLE: a printable letter for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(STABLE)}


class _Ids(dict):
    """Ids (little-endian 32-bit) of the words that follow a blank, by word; made when first asked for.

    A blank that stands between two non-blank characters, or ends a run of blanks before one, always
    begins a new unit of the tokenizer's split. So the ids of a text are those of its pieces at such
    blanks. Where a piece is empty or begins with white space this does not hold, and KeyError sends the
    text to the tokenizer as a whole.
    """

    def __init__(self, tokenizer, lead: str = " ") -> None:
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        # strings that are tokens of their own; a text that holds one goes to the tokenizer as a whole
        self.special = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.marks = {mark: self.unit(mark) for mark in ".,\n"}
        self.lead, self.opening = lead, _Ids(tokenizer, "") if lead else None  # words that open a line

    def unit(self, text: str) -> bytes:
        """Ids of one unit of the split, all of it below STABLE."""
        return array("I", [t.id for t in self.merge(text.translate(self.letters))]).tobytes()

    def plain(self, text: str) -> bytes:
        if text and ord(max(text)) < STABLE:
            return b"".join(map(self.unit, SPLIT.findall(text)))
        return self.whole(text)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or not word[0].isprintable():
            raise KeyError(word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self.marks[word[-1]]
        if self.lead and not word.isalpha():
            end, line, next = word.partition("\n")
            if line and end and not end[-1].isspace() and next[:1].isalpha() and "\n" not in next:
                return self[end] + self.marks[line] + self.opening[next]
        stable = word.isalpha() and ord(max(word)) < STABLE
        ids = self.unit(self.lead + word) if stable else self.plain(self.lead + word)
        if len(self) < CACHE and len(word) <= 64:
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *words = text.split(" ")
        try:
            return (self.opening[first] if first.isalpha() else self.plain(first)) + b"".join(map(self.__getitem__, words))
        except KeyError:
            return self.plain(text)


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")


def _ids(tokenizer_json: str, special_as_text: bool = False) -> _Ids:
    """The worker's tokenizer; the words it has met stay known to the process's later tasks."""
    def make() -> _Ids:
        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = special_as_text
        return _Ids(tokenizer)

    return kept(f"tokenizer {zlib.crc32(tokenizer_json.encode())} {special_as_text}", make)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, the first one shorter where n asks for it."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text",
    end_id: int = 0, keep_ids: bool = True, special_as_text: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, local[, ids]): the pieces of every document, stored.

    `part` is the task that made the piece, `local` its rank among the task's pieces of that length.
    A null text is empty and so holds `end_id` alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"

    def start():
        ids_of, part, seen = _ids(shared.value, special_as_text), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()

        def run(batch: dict[str, list]) -> Iterator[dict[str, list]]:
            out = defaultdict(list)
            for doc, body in zip(batch["doc_id"], batch["text"]):
                ids = ids_of.of(body or "") + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * at: 4 * (at + n)]
                    for name, value in zip(names, (doc, k, at, n, zlib.crc32(own), part, seen[n], own)):
                        out[name].append(value)
                    seen[n] += 1
            if out:
                yield out

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
        return run

    source = docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    return materialise(rows(source, start, schema + ", ids binary" * keep_ids, each_task=True))


# --- the plan ------------------------------------------------------------------------------------


def _group(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, number), longest first, in groups of equal cardinality; the first group is never empty."""
    total, out, filled = sum(counts.values()), [], 0
    size = -(-total // groups) if total else 1
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if filled % size == 0:
                out.append([])
            take = min(n, size - filled % size)
            out[-1].append((length, take))
            filled, n = filled + take, n - take
    return out


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, number of such sequences): the whole part of the best fractional cover."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every sequence costs one
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.where(sizes <= c, best[c - np.minimum(sizes, c)] + price, -1.0)
            i = int(fits.argmax())
            if fits[i] > best[c - 1] + 1e-12:
                best[c], choice[c] = fits[i], i
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        entering, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                entering[choice[c]] += 1
                c -= int(sizes[choice[c]])
        way = inverse @ entering
        ratio = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * way, 0)
        amount[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[:, out] = entering
    whole = np.floor(amount + 1e-7).astype(np.int64)
    taken = columns.astype(np.int64)
    while (over := taken @ whole > demand).any():  # rounding noise on very large numbers
        whole[np.flatnonzero(taken[over.argmax()] * whole)[0]] -= 1
    return [(taken[:, j], int(whole[j])) for j in range(k) if whole[j]]


class _Places:
    """Sequences as runs of equal ones; plan rows (length, first rank, number, first sequence, offset)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = defaultdict(int)
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.mask = 0  # bit r: some sequence has r tokens free

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], n, sequence, offset))
        self.rank[length] += n

    def open(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self.put(length, n, self.sequences, offset)
            offset += length
        self.leave(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def leave(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.free[room].append((sequence, n))
            self.mask |= 1 << room

    def fit(self, length: int, n: int) -> None:
        """Place n pieces of this length, each where the least room is left."""
        while n:
            above = self.mask >> length
            if not above:
                self.open([length], -(-n // (self.capacity // length)))
                n -= self.rows[-1][2]
                continue
            room = length + (above & -above).bit_length() - 1
            sequence, there = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
            take = min(there, -(-n // (room // length)))
            self.put(length, take, sequence, self.capacity - room)
            self.leave(room - length, sequence, take)
            self.leave(room, sequence + take, there - take)
            n -= take


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Plan rows (length, first rank, number, first sequence, offset) and the number of sequences.

    The work and the rows depend on the capacity and the number of groups, not on the number of pieces.
    """
    best = min((_plan(histogram, capacity, groups, capacity // part) for part in LARGE), key=lambda p: p.sequences)
    table = np.array(best.rows, dtype=np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], best.sequences


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> _Places:
    """Lengths up to `small` and the ends of groups by best fit, all others by configurations."""
    places = _Places(capacity)
    if histogram.get(capacity):
        places.open([capacity], histogram[capacity])
    large = {n: c for n, c in histogram.items() if small < n < capacity and c}
    left = defaultdict(int, {n: c for n, c in histogram.items() if 0 < n <= small and c})
    grouped = _group(large, groups)
    if grouped:
        sizes = np.array([g[0][0] for g in grouped])
        demand = np.array([sum(n for _, n in g) for g in grouped], dtype=float)
        runs = [list(reversed(g)) for g in grouped]  # pop() gives the longest
        for configuration, n in _configurations(sizes, demand, capacity):
            slots: list[list[tuple[int, int]]] = []
            for i in np.flatnonzero(configuration):
                for _ in range(configuration[i]):
                    slot, need = [], n
                    while need:
                        length, there = runs[i].pop()
                        take = min(there, need)
                        slot.append((length, take))
                        need -= take
                        if there > take:
                            runs[i].append((length, there - take))
                    # every other slot the other way round: the long ones of one beside the short ones of the next
                    slots.append(slot if len(slots) % 2 else slot[::-1])
            while n:
                take = min(slot[-1][1] for slot in slots)
                places.open([slot[-1][0] for slot in slots], take)
                for slot in slots:
                    length, there = slot.pop()
                    if there > take:
                        slot.append((length, there - take))
                n -= take
        for run in runs:
            for length, n in run:
                left[length] += n
    for length in sorted(left, reverse=True):
        places.fit(length, left[length])
    return places


def place(made: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to stored pieces; drops `part` and `local`.

    The rank of a piece is its rank within its task plus the pieces of that length in earlier tasks: a
    table with a row per task and length, at most. Nothing is sorted by length, so it does not matter
    that one length may hold a third of all pieces.
    """
    spark = made.sparkSession
    per_task = materialise(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    table, _ = plan(histogram, capacity, groups)
    shared = spark.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    names = [c for c in made.columns if c not in ("part", "local")]
    ranked = made.join(base, ["part", "length"]).select(*names, (F.col("base") + F.col("local")).alias("rank"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        wide = np.int64(1 << 48)  # more than the pieces of one length
        first = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row = t[np.searchsorted(first, length * wide + rank, side="right") - 1] if len(t) else t
            made_ = [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + made_, names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, kind + ", sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text",
    end_id: int = 0, keep_ids: bool = True, groups: int = GROUPS, special_as_text: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document in sequences.

    A document is its tokens and `end_id`; longer ones than `capacity` are cut into whole sequences, the
    first piece may be shorter. Null and empty texts are one token; a null id stays null; repeated rows are
    packed each; other columns are not read, whatever their names; no documents give no rows. The strings of
    the vocabulary's added tokens are these tokens, or with `special_as_text` text like any other.
    """
    return place(pieces(docs, tokenizer_json, capacity, id, text, end_id, keep_ids, special_as_text), capacity, groups)
