"""Exact byte-pair encoding by backtracking, and decoding through an offset table.

A word's encoding by merges is the only way to cut it into tokens so that each token encodes to itself and each
two neighbours are compatible: no merge across their border comes before the merges that use up its two sides.
So the encoder never merges. An Aho-Corasick automaton of the reversed tokens finds the longest token at every
place of a word; the encoder goes from left to right with the longest token that is compatible with the one
before, tries the next shorter one where none fits behind it, and marks a place from which nothing led to the
end. As the encoding of a beginning is unique, a place is entered once: the time is linear in the word.

Two tokens are compatible or not by the merge table alone; the answers are kept as a table in the worker.

Decoding looks ids up in an array of offsets into one string of all tokens, all ids of a piece at once.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from signalframe.llm.common import column, kept, rows

SLICE = 1 << 20  # bytes of text that are encoded at once
PAIRS = 1 << 20  # answers about pairs that a worker keeps; these three change speed and memory only
WORDS = 1 << 18  # encoded words that a worker keeps, and as many that it has kept before
WORD = 64  # longest such word
IDS = 1 << 16  # decoded at once

_NEVER = 1 << 62
_COMPOSING = re.compile("[^\x00-\u02ff]")  # below are no combining characters


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The tables of a merge list; a token is a string of symbols, a byte or, at the end of a word, 256 + a byte."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        letters = _byte_letters()
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        self.symbols: list[str | None] = [None] * size
        for letter, byte in letters.items():
            for text, symbol in ((letter, byte), (letter + suffix, 256 + byte))[: 2 if suffix else 1]:
                if text in vocab:
                    self.symbols[vocab[text]] = chr(symbol)
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            parts = (self.symbols[x], self.symbols[y])
            if None in parts or self.symbols[z] is not None or max(self.rank[x], self.rank[y]) >= rank:
                raise ValueError(f"{a!r} and {b!r} do not form a new token out of earlier ones.")
            self.rank[z], self.left[z], self.right[z], self.pair[x, y] = rank, x, y, z
            self.symbols[z] = parts[0] + parts[1]
        own = [s is not None for s in self.symbols]
        for (x, y), z in self.pair.items():  # in order of rank, so the parts are known
            own[z] = own[x] and own[y] and not self._crossed(x, y, self.rank[z])
        self.places = {self.symbols[t]: t for t, ok in enumerate(own) if ok}
        self.length = [len(s or "") for s in self.symbols]
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for text, t in self.places.items():
            self.automaton.add_word(text[::-1], t)
            for n in range(len(text) - 1, 0, -1):
                if (s := self.places.get(text[:n])) is not None:
                    self.shorter[t] = s
                    break
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def _crossed(self, a: int, b: int, end: int) -> bool:
        """Whether a merge across the border of a and b comes before both sides are used up, or before `end`.

        Of equal merges the left one comes first, so on the left a side used up by that very merge is gone.
        """
        x, gone_x = a, end
        while x >= 0:
            y, gone_y = b, end
            while y >= 0:
                z = self.pair.get((x, y))
                if z is not None and self.rank[z] < gone_x and self.rank[z] <= gone_y:
                    return True
                y, gone_y = self.left[y], self.rank[y]
            x, gone_x = self.right[x], self.rank[x]
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a; the answer is kept in the table `known`."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        found = self.known[a << 32 | b] = not self._crossed(a, b, _NEVER)
        return found

    def encode(self, word: str) -> list[int]:
        """The tokens of a word given in symbols."""
        if (whole := self.places.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        for at, t in self.automaton.iter(word[::-1]):
            start = n - 1 - at
            if longest[start] < 0 or self.length[t] > self.length[longest[start]]:
                longest[start] = t
        dead, out, pos = bytearray(n + 1), [], 0
        t = longest[0] if n else -1
        length, shorter, known, compatible = self.length, self.shorter, self.known, self.compatible
        while pos < n:
            while t >= 0:
                if not dead[pos + length[t]]:
                    if not out:
                        break
                    fits = known.get(out[-1] << 32 | t)
                    if compatible(out[-1], t) if fits is None else fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                pos += length[t]
                t = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("The vocabulary has no token for a byte of the text.")
                t = out.pop()
                pos -= length[t]
                t = shorter[t]
        return out


class Codec:
    """Encodes and decodes texts as a byte-level vocabulary file with word ends says.

    The library's normaliser is asked for texts with characters from U+0300 on, and its splitter for texts with
    characters that the pattern module classes otherwise, as the two follow different editions of Unicode. Below
    U+0300 lower-casing is all that the normaliser does to a word, which is checked when the tables are built.
    """

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("Only plain merges are encoded.")
        if split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("Only files that keep the matches of a pattern and join decoded tokens by blanks are read.")
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["vocab"], model["merges"], self.suffix)
        self.library = Tokenizer.from_str(vocabulary)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        ascii_form = split["pattern"]["Regex"].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        self.ascii_pattern = self.pattern if r"\p" in ascii_form else re.compile(ascii_form, re.ASCII)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("Only added tokens that stand as they are are read.")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.words: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.agreed: set[str] = set()
        same = lambda c: self.library.normalizer.normalize_str(c) == c.lower() or c.isspace()
        self.lowers = all(same(chr(i)) for i in range(0x300))
        if any(self.ascii_pattern.findall(f"a{chr(i)}{chr(i)}!") != self._split(f"a{chr(i)}{chr(i)}!") for i in range(128)):
            self.ascii_pattern = self.pattern
        self.letters = {chr(b): letter for letter, b in _byte_letters().items()}
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        text = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in text]))).astype(np.int32)
        self.table = np.frombuffer(b"".join(text), dtype=np.uint8)

    def _agrees(self, char: str) -> bool:
        """Whether pattern module and library class a character alike: beside a letter, itself and a sign."""
        probe = f"a{char}{char}!"
        same = self.pattern.findall(probe) == self._split(probe)
        if same:
            self.agreed.add(char)
        return same

    def _split(self, text: str) -> list[str]:
        """The words as the library cuts them; it writes bytes as letters, so the places are taken instead."""
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _words(self, text: str) -> list[str]:
        text = text.lower() if self.lowers and not _COMPOSING.search(text) else self.library.normalizer.normalize_str(text)
        if text.isascii():
            return self.ascii_pattern.findall(text)
        strange = set(text) - self.agreed
        if strange and not all([self._agrees(c) for c in strange]):
            return self._split(text)
        return self.pattern.findall(text)

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.before.get(word)
        if found is None:
            symbols = word.encode().decode("latin-1")
            if self.suffix:
                symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
            found = tuple(self.merges.encode(symbols))
        if len(word) <= WORD:
            if len(self.words) >= WORDS:
                self.before.clear()
                self.before, self.words = self.words, self.before
            self.words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        marks = [(m.start(), m.end()) for m in self.marks.finditer(text)]
        for start, end in [*marks, (len(text), len(text))]:
            for word in self._words(text[at:start]):
                out.extend(self.words.get(word) or self._word(word))
            if end > start:
                out.append(self.special[text[start:end]])
            at = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens with blanks between; ids that name no token are left out."""
        parts = []
        for at in range(0, len(ids), IDS):
            part = ids[at: at + IDS]
            part = part[(part >= 0) & (part < len(self.offsets) - 1)]
            size = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size, dtype=np.int32)
            place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
            parts.append(self.table[place + np.repeat(self.offsets[part] - (ends - size), size)].tobytes())
        return b"".join(parts)[:-1]


def codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary file's content, built once in a worker process."""
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    return kept(f"bpe-{name}", lambda: Codec(vocabulary))


def encode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for every row, and with `decoded` also `decoded`, the text that the ids give back.

    The ids are those of the tokenizers library without added marks, cutting or filling; strings of added tokens
    in the text become these tokens. Null and empty texts have no ids and decode to the empty text; a null id
    stays; repeated rows stay; other columns are not read; no rows give no rows. A narrow operation.
    """
    def run(batch):
        own = codec(vocabulary)
        found = [own.encode(t or "") for t in batch["text"]]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.fromiter((i for ids in found for i in ids), np.int32, ends[-1])
        out = [pa.array(batch["doc_id"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        if decoded:
            out.append(pa.array([own.decode(flat[a:b]).decode() for a, b in zip(ends, ends[1:])], pa.string()))
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][: len(out)])

    schema = "doc_id long, ids array<int>" + (", decoded string" if decoded else "")
    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, schema, SLICE)


def decode(encoded: DataFrame, vocabulary: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded) for every row; null ids, as a list or in one, and unknown ones give nothing."""
    def run(batch):
        own = codec(vocabulary)
        lists = [np.array([i for i in found or [] if i is not None], dtype=np.int64) for found in batch["ids"]]
        yield {"doc_id": batch["doc_id"], "decoded": [own.decode(found).decode() for found in lists]}

    taken = encoded.select(column(id).cast("long").alias("doc_id"), column(ids).cast("array<long>").alias("ids"))
    return rows(taken, run, "doc_id long, decoded string", SLICE)
