"""Secret scan: an assignment-aware lexer over source and configuration syntax.

Texts are read as name-literal pairs wherever they assign: `name = "x"`, `name: x`, `"name": "x"`,
`name := x`, `name => x`, `<name>x</name>`, `--name x`. Between name and operator there may be subscripts, the end
of one (`c["name"] = "x"`), a type (`name: str = "x"`, `var name string = "x"`) or another name. A literal may
have a prefix (`b"x"`), run over lines (triple quotes, backticks, a YAML block), be of any length, and be built with
`+` from literals and names; names that were given a literal anywhere in the text stand for it. Every literal
that reaches a name is scored by how sensitive the name's words are and how random the literal looks; a private
key block is a secret under any name. Three fixed patterns are reported as well.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from signalframe.llm.common import column, rows

KINDS = ("assign", "access", "hex", "named")  # their order among spans that start together
THRESHOLD = 0.6
MARK = "[secret]"

# The patterns that are always reported, with the least length of what they must have caught.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

# Words of names, and how strongly they say that a secret is named.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "secrets": 0.9, "token": 0.9,
    "tokens": 0.7, "apikey": 1.0, "key": 0.6, "keys": 0.4, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.9,
    "auth": 0.6, "authorization": 0.7, "bearer": 0.9, "private": 0.7, "signature": 0.5, "salt": 0.6, "session": 0.4,
    "cookie": 0.5, "cert": 0.4, "access": 0.4, "encryption": 0.6, "webhook": 0.5, "dsn": 0.6, "connection": 0.4, "pin": 0.4,
}
# Words that say a name holds something else, and literals that only stand for a secret.
HARMLESS = {"public", "file", "path", "name", "id", "url", "type", "length", "size", "count", "primary", "foreign", "sort", "hint", "policy", "field", "label"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|changeme|example.*|your.*|test|dummy|none|null|true|false|todo|<.*>|\$\{.*\}|%\(.*\)s?|\{\{.*\}\})$", re.I)

_GATE = re.compile(r"pass|pwd|secret|token|key|cred|auth|bearer|private|signature|salt|session|cookie|cert|access|encrypt|webhook|dsn|connection|pin", re.I)
# Repetitions are possessive and of characters that end them, so a scan is linear in the text.
_NAME = r"[A-Za-z_][\w.-]*"
_PREFIX = r"(?:(?<!\w)(?:[A-Za-z]{1,2}|u8|b?r)\#*+|[@$]{1,2})?"
_LITERAL = rf"""{_PREFIX}(?:"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')"""
_LITERALS = rf"(?:{_LITERAL}|{_NAME})(?:[ \t]*\+\s*+(?:{_LITERAL}|{_NAME}))*"
_OPERATOR = r"[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+"
_HEAD = rf"""(?P<quote>["']?)(?P<name>(?<![\w.-]){_NAME})(?P=quote)"""
# a type, or another name, between a name and the `=` of its literal
_TYPE = r"""(?:[^\s="'{}();:]|::|'\w++(?!')|(?<=[,|\[])[ \t]|[ \t](?=\|)|(?<='static)[ \t]|(?<=mut)[ \t])++"""
_TYPED = rf"""(?P<type>[ \t]*+[:=](?![:=>/])[ \t]*+{_TYPE}|[ \t]++(?:[*&]|\[\w*+\])*+[A-Za-z_][\w.]*+)[ \t]*+=(?![=>])[ \t]*+"""
_PAIR = re.compile(
    rf"""{_HEAD}(?:{_OPERATOR}(?={_PREFIX}["'])|{_TYPED}(?={_PREFIX}["'])|{_OPERATOR})(?P<value>{_LITERALS}|[^\s"',;<>()\[\]{{}}]+)"""
)
# names inside subscripts do not start one, so a chain of them is read once
_INDEX = rf"(?:(?<![\w.\-\[])(?P<name>{_NAME})|(?<=\)))(?P<subscripts>(?:\[[^\[\]\n]*+\])++)(?:{_TYPED}|{_OPERATOR})"
_INDEXED = re.compile(rf"""{_INDEX}(?P<value>(?={_PREFIX}["']){_LITERALS})""")
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>")
_FLAG = re.compile(rf"""(?<!\S)--(?P<name>{_NAME})[ \t]+(?P<value>{_LITERAL}|[^\s"'-][^\s"']*)""")
_TERM = re.compile(rf"{_LITERAL}|{_NAME}")
_LONG = _PREFIX + r"""(?:"{3}(?P<a>(?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}(?P<b>(?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}|`(?P<c>(?:[^`\\]|\\[\s\S])*+)`)"""
_LINES = re.compile(rf"{_HEAD}(?:{_TYPED}|{_OPERATOR}){_LONG}"), re.compile(_INDEX + _LONG)
_BLOCK = re.compile(rf"""(?P<indent>^[ \t]*+(?:-[ \t]++)*+){_HEAD}[ \t]*+:[ \t]++[|>][-+0-9]{{0,2}}[ \t]*+\r?\n""", re.M)
_TYPE_NAMES = {"string", "str", "byte", "char", "rune"}
_WORD = re.compile(_NAME)
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY")


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the fixed patterns, leftmost and not overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    # a run of 16 or more is the only match of the open-ended pattern that is long enough
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How strongly a name says that it holds a secret, by its words: `dbPassword`, `API_KEY`, `auth.token`."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    doubt = 1.0
    for part in parts:
        doubt *= 1 - SENSITIVE.get(part, 0.0)
    if "api" in parts and "key" in parts:
        doubt = 0.0
    return (1 - doubt) * (0.3 if parts and parts[-1] in HARMLESS else 1.0)


def literal_score(value: str) -> float:
    """How random a literal looks: its length, its entropy and the kinds of characters it has; lines are joined."""
    if _KEY_BLOCK.search(value):
        return 1.0
    if "\n" in value:
        value = "".join(line.strip().removesuffix("\\") for line in value.split("\n"))
    if len(value) < 6 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * min(1.0, len(value) / 12) * (0.4 if kinds == 1 and not value.isdigit() and len(value) < 24 else 1.0)


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], str, list[str]]]:
    """(name, spans of its own literals, their text, names it takes over) of every assignment."""
    out = []
    for pattern in (_PAIR, *([_INDEXED] if "]" in text else []), _ELEMENT, _FLAG):
        for m in pattern.finditer(text):
            at, value = m.start("value"), m["value"]
            terms = list(_TERM.finditer(value))
            quoted = [t for t in terms if t[0][-1] in "\"'"]
            if quoted:
                # the text between the quotes, without a prefix
                spans = [(at + t.start() + t[0].index(t[0][-1]) + 1, at + t.end() - 1) for t in quoted]
                names = [t[0] for t in terms if t[0][-1] not in "\"'"]
            else:
                spans = [(at, at + len(value))]
                names = [value] if re.fullmatch(_NAME, value) else []
            literal = "".join(text[a:b] for a, b in spans)
            out += [(name, spans, literal, names) for name in _names(m)]
    long = [p for p in _LINES if any(mark in text for mark in ('"""', "'''", "`"))]
    for m in [m for p in long for m in p.finditer(text)]:
        span = next(m.span(g) for g in "abc" if m[g] is not None)
        out += [(name, [span], text[slice(*span)], []) for name in _names(m)]
    for m in _BLOCK.finditer(text) if "|" in text or ">" in text else ():
        at = end = m.end()
        while at < len(text):  # lines that are indented further than the name
            after = text.find("\n", at) + 1 or len(text)
            line = text[at:after]
            if line.strip():
                if len(line) - len(line.lstrip(" \t")) <= len(m["indent"]):
                    break
                end = at + len(line.rstrip())
            at = after
        start = m.end() + len(text[m.end():end]) - len(text[m.end():end].lstrip())
        out.append((m["name"], [(start, end)], text[start:end], []))
    return out


def _names(m: re.Match) -> list[str]:
    """What an assignment names: its name, and the words of its subscripts and of what stands before the `=`.

    Words of subscripts and types get a colon before them: they are scored, but no later name means them.
    """
    groups = m.groupdict()
    between = groups.get("type") or ""
    mark = ":" if ":" in between else ""
    more = [mark + w if w not in _TYPE_NAMES else ":" + w for w in _WORD.findall(between)]
    more += [":" + w for w in _WORD.findall(groups.get("subscripts") or "")]
    return [n for n in dict.fromkeys([groups["name"], *more]) if n]


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, int]]:
    """(start, end, "named", start) of literals that a sensitive name is given, directly or through other names."""
    if not _GATE.search(text):
        return []
    found = assignments(text)
    if not found:
        return []
    constants: dict[str, list[int]] = {}
    for k, (name, *_rest) in enumerate(found):
        constants.setdefault(name, []).append(k)
    strengths = [1.0 if _KEY_BLOCK.search(value) else name_score(name) for name, _, value, _ in found]
    # of every name the two strongest assignments that mean it, directly or through the constants they name; two, as
    # one may be the assignment that is asked about. A name hands on what it has been given, so it is open twice at most
    meant: dict[str, list[int]] = {}
    for k in sorted((k for k, s in enumerate(strengths) if s), key=lambda k: -strengths[k]):
        open_ = list(found[k][3])
        while open_:
            name = open_.pop()
            by = meant.setdefault(name, [])
            if name in constants and len(by) < 2 and k not in by:
                by.append(k)
                for j in constants[name]:
                    open_ += found[j][3]
    spans = set()
    for k, (name, own, value, names) in enumerate(found):
        strength = max((strengths[by] for by in meant.get(name, ()) if by != k), default=0.0)
        resolved = any(constants.get(n, [k]) != [k] for n in names) and not any(text[a - 1:a] in "\"'" for a, _ in own)
        if not resolved:  # a bare name that stands for a constant is no literal
            strength = max(strength, strengths[k])
        if strength and strength * literal_score(value) >= threshold:
            spans.update(own)
    return [(a, b, "named", a) for a, b in spans if a < b]


def all_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """All spans by start, then kind as in KINDS, then end."""
    text = text or ""
    return sorted(base_spans(text) + named_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with every found value replaced by a mark; overlapping values become one mark."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, end, _, value in spans):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans: array of (kind, start, end), code points, end exclusive.

    Null and empty texts have none; repeated rows stay; other columns are not read.
    """
    def run(batch):
        yield {"doc_id": batch["doc_id"], "spans": [
            [{"kind": k, "start": a, "end": b} for a, b, k, _ in all_spans(body)] for body in batch["text"]
        ]}

    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, schema)


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of the text replaced by a mark; null stays null."""
    names = docs.columns

    def run(batch):
        yield batch | {text: [body and redact(body, all_spans(body)) for body in batch[text]]}

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows(docs.select(*[column(c) for c in names]), run, kind)
