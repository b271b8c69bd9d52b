"""License scan: ordered signature rules behind a keyword prefilter.

Each licence's names and addresses stand in a table; templates of licence statements turn them into some
hundreds of regular expressions, every one with a priority and a keyword without which it cannot match. An
automaton finds the keywords of a text in one pass, and only their rules run. Detections are then taken by
priority, longer ones first; one whose interval lies inside a taken one, or around it, is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from signalframe.llm.common import column, kept, lower_ascii, rows, words

# Licence, its names (any of `-`, blanks and line breaks at a blank), its addresses.
LICENCES = """
mit|mit;expat|opensource.org/licenses/mit
apache-1.1|apache software license 1.1;apache-1.1|apache.org/licenses/license-1.1
apache-2.0|apache license, version 2.0;apache license version 2.0;apache license 2.0;apache-2.0;apache 2.0|apache.org/licenses/license-2.0
bsd-2-clause|bsd 2-clause;bsd 2 clause;simplified bsd;freebsd|opensource.org/licenses/bsd-2-clause
bsd-3-clause|bsd 3-clause;bsd 3 clause;new bsd;modified bsd;revised bsd|opensource.org/licenses/bsd-3-clause
bsd-4-clause|bsd 4-clause;original bsd|
0bsd|0bsd;zero-clause bsd|opensource.org/licenses/0bsd
isc|isc|opensource.org/licenses/isc
gpl-2.0|gnu general public license, version 2;gnu gpl v2;gnu gpl version 2;gplv2;gpl-2.0;gpl 2.0;gpl v2|gnu.org/licenses/gpl-2.0
gpl-3.0|gnu general public license, version 3;gnu gpl v3;gnu gpl version 3;gplv3;gpl-3.0;gpl 3.0;gpl v3|gnu.org/licenses/gpl-3.0
gpl|gnu general public license;gnu gpl|gnu.org/licenses/gpl
lgpl-2.1|gnu lesser general public license, version 2.1;lgplv2.1;lgpl-2.1;lgpl 2.1|gnu.org/licenses/lgpl-2.1
lgpl-3.0|gnu lesser general public license, version 3;lgplv3;lgpl-3.0;lgpl 3.0|gnu.org/licenses/lgpl-3.0
lgpl|gnu lesser general public license;gnu library general public license;gnu lgpl|gnu.org/licenses/lgpl
agpl-3.0|gnu affero general public license, version 3;gnu affero general public license;agplv3;agpl-3.0;agpl 3.0|gnu.org/licenses/agpl
gfdl|gnu free documentation license;gfdl|gnu.org/licenses/fdl
mpl-1.1|mozilla public license, version 1.1;mpl 1.1;mpl-1.1|mozilla.org/mpl/1.1
mpl-2.0|mozilla public license, version 2.0;mozilla public license, v. 2.0;mpl 2.0;mpl-2.0|mozilla.org/mpl/2.0
epl-1.0|eclipse public license, version 1.0;eclipse public license 1.0;epl-1.0|eclipse.org/legal/epl-v10
epl-2.0|eclipse public license, version 2.0;eclipse public license 2.0;epl-2.0|eclipse.org/legal/epl-2.0
cddl-1.0|common development and distribution license;cddl 1.0;cddl-1.0|opensource.org/licenses/cddl-1.0
cpl-1.0|common public license, version 1.0;common public license;cpl-1.0|
eupl-1.2|european union public licence;european union public license;eupl 1.2;eupl-1.2|joinup.ec.europa.eu/software/page/eupl
bsl-1.0|boost software license, version 1.0;boost software license;bsl-1.0|boost.org/license_1_0.txt
zlib|zlib;zlib/libpng|opensource.org/licenses/zlib
unlicense|the unlicense;unlicense|unlicense.org
wtfpl|wtfpl;do what the fuck you want to public license|wtfpl.net
artistic-2.0|artistic license 2.0;artistic license, version 2.0;artistic-2.0|opensource.org/licenses/artistic-2.0
artistic-1.0|artistic license 1.0;perl artistic license;artistic-1.0|
psf-2.0|python software foundation license;psf license;psf-2.0|python.org/psf/license
ofl-1.1|sil open font license, version 1.1;sil open font license;ofl-1.1|scripts.sil.org/ofl
postgresql|postgresql|opensource.org/licenses/postgresql
openssl|openssl|openssl.org/source/license
ms-pl|microsoft public license;ms-pl|opensource.org/licenses/ms-pl
odbl-1.0|open database license;odbl 1.0;odbl-1.0;odbl|opendatacommons.org/licenses/odbl
odc-by-1.0|open data commons attribution license;odc-by-1.0;odc-by|opendatacommons.org/licenses/by
cc0-1.0|cc0 1.0;cc0-1.0;cc0;creative commons zero|creativecommons.org/publicdomain/zero
cc-by|cc by;creative commons attribution|creativecommons.org/licenses/by/
cc-by-sa|cc by-sa;cc by sa;creative commons attribution-sharealike;creative commons attribution share alike|creativecommons.org/licenses/by-sa/
cc-by-nc|cc by-nc;cc by nc;creative commons attribution-noncommercial;creative commons attribution non-commercial|creativecommons.org/licenses/by-nc/
cc-by-nd|cc by-nd;cc by nd;creative commons attribution-noderivatives;creative commons attribution-noderivs|creativecommons.org/licenses/by-nd/
cc-by-nc-sa|cc by-nc-sa;cc by nc sa;creative commons attribution-noncommercial-sharealike|creativecommons.org/licenses/by-nc-sa/
cc-by-nc-nd|cc by-nc-nd;cc by nc nd;creative commons attribution-noncommercial-noderivatives;creative commons attribution-noncommercial-noderivs|creativecommons.org/licenses/by-nc-nd/
""".strip()

# Priority, confidence, the statement around a licence's name `@`, its keyword where the name is not to be one.
TEMPLATES = """
900|1.0|spdx-license-identifier:[ \\t]*@|spdx-license-identifier
700|0.95|(?:dual[- ])?licen[sc]ed\\s+(?:under|with)\\s+(?:the\\s+)?(?:terms\\s+of\\s+)?(?:the\\s+)?@(?:\\s+licen[sc]e)?|icen
690|0.95|(?:released|distributed|available|published|provided|shared|covered)\\s+(?:under|by)\\s+(?:the\\s+)?(?:terms\\s+of\\s+)?(?:the\\s+)?@(?:\\s+licen[sc]e)?|
680|0.9|under\\s+(?:the\\s+)?terms\\s+of\\s+(?:the\\s+)?@(?:\\s+licen[sc]e)?|terms
670|0.9|["']?licen[sc]e["']?\\s*[:=]\\s*["']?@|icen
600|0.8|@\\s+licen[sc]e|icen
500|0.5|@|
""".strip()

# Statements that name no licence: label, priority, confidence, keyword, expression.
STATEMENTS = """
all-rights-reserved|300|0.6|rights|all\\s+rights\\s+reserved
public-domain|300|0.7|public|(?:released|dedicated|placed)\\s+(?:in)?to\\s+the\\s+public\\s+domain|in\\s+the\\s+public\\s+domain
copyright-notice|200|0.4|copyright|copyright\\s+(?:\\(c\\)|©)?\\s*(?:19|20)\\d\\d
proprietary|300|0.7|proprietary|proprietary\\s+and\\s+confidential
permissive-grant|400|0.7|permission|permission\\s+is\\s+hereby\\s+granted,?\\s+free\\s+of\\s+charge
warranty-disclaimer|200|0.4|warranty|without\\s+warranty\\s+of\\s+any\\s+kind
redistribution-clause|400|0.6|redistribution|redistribution\\s+and\\s+use\\s+in\\s+source\\s+and\\s+binary\\s+forms
no-derivatives|250|0.5|derivative|no\\s+derivative\\s+works?
non-commercial-use|250|0.5|commercial|(?:for\\s+)?non-?commercial\\s+(?:use|purposes)\\s+only
""".strip()

#: Phrases whose places are always reported: words that stand consecutively, and the label (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE = 1000  # their priority

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern
    base: bool = False


def _name(text: str) -> str:
    """The expression of a name: blanks and hyphens as in print, a comma may be missing."""
    return re.sub(r"(?:\\ |\\-)+", r"[\\s-]+", re.escape(text)).replace(",", ",?")


def _keyword(text: str) -> str:
    """The longest word of a name that every form of it has."""
    return max(re.findall(r"[^\s,-]+", text), key=len)


def build_rules() -> list[Rule]:
    """All rules, by priority."""
    rules = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        expression = rf"(?<!{_WORD})" + rf"{_SEPARATOR}+".join(own) + rf"(?!{_WORD})"
        rules.append(Rule(label, BASE, 1.0, max(own, key=len), re.compile(expression), True))
    table = [line.split("|") for line in LICENCES.split("\n")]
    names_of = {name: label for label, names, _ in table for name in names.split(";")}
    for label, names, addresses in table:
        for name in names.split(";"):
            # a name that goes on to another licence's name is that one: `cc by` in `cc by-nc`
            longer = [m[len(name):] for m, other in names_of.items() if m.startswith(name) and other != label]
            ahead = "(?!" + "|".join(_name(m) for m in longer) + ")" if longer else ""
            for template in TEMPLATES.split("\n"):
                priority, confidence, statement, keyword = re.split(r"\|(?![^(]*\))", template)
                if statement == "@" and not re.search(r"[\s\d-]", name):
                    continue  # a single plain word is no statement by itself
                expression = r"(?<![a-z0-9])" + statement.replace("@", "(?:" + _name(name) + ahead + ")") + r"(?![a-z0-9])"
                gate = keyword if statement.startswith("spdx") or (keyword and len(_keyword(name)) < 4) else _keyword(name)
                # of equally strong statements the longer, more special name goes first
                rules.append(Rule(label, int(priority) + min(len(name), 9), float(confidence), gate, re.compile(expression)))
        for address in filter(None, addresses.split(";")):
            rules.append(Rule(label, 800, 1.0, address, re.compile(r"(?:https?://)?(?:www\.)?" + re.escape(address) + r"[\w./-]*", re.A)))
    for line in STATEMENTS.split("\n"):
        label, priority, confidence, keyword, expression = line.split("|", 4)
        rules.append(Rule(label, int(priority), float(confidence), keyword, re.compile(rf"\b(?:{expression})", re.A)))
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    """Detections (start, end, label, priority, confidence, base) in lower-cased texts."""

    def __init__(self, rules: list[Rule] | None = None) -> None:
        self.rules = build_rules() if rules is None else rules
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, own in by_keyword.items():
            self.keywords.add_word(keyword, own)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, str, int, float, bool]]:
        """What is left after suppression, by place."""
        due = sorted({i for _, own in self.keywords.iter(text) for i in own})
        found = [
            (m.start(), m.end(), r.label, r.priority, r.confidence, r.base)
            for r in map(self.rules.__getitem__, due) for m in r.pattern.finditer(text)
        ]
        found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        return sorted(self._apart(found))

    @staticmethod
    def _apart(found: list[tuple]) -> list[tuple]:
        taken: list[tuple] = []
        # intervals of taken detections in buckets of 256 characters, so that many detections stay cheap
        near: dict[int, list[tuple]] = {}
        for d in found:
            cells = range(d[0] >> 8, (d[1] >> 8) + 1)
            around = {t for c in cells for t in near.get(c, ())}
            inside = any(t[0] <= d[0] and d[1] <= t[1] or d[0] <= t[0] and t[1] <= d[1] for t in around)
            if d[5] or not inside:
                taken.append(d)
                for c in cells:
                    near.setdefault(c, []).append(d)
        return taken


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, detections, first_word, last_word, n_base, score) for every row.

    `detections`: array of (start, end, label, priority, confidence, base), offsets in code points, after
    suppression; detections of PHRASES are never suppressed. `first_word` and `last_word`: the smallest and
    largest number of the word at which such a phrase starts, null without one. `score`: the chance that at
    least one detection is right, from their confidences. Null is an empty text: no words, no detections,
    score 0. Repeated rows stay; other columns are not read.
    """
    schema = (
        "doc_id long, n_words long, detections array<struct<start: int, end: int, label: string, priority: int, "
        "confidence: double, base: boolean>>, first_word long, last_word long, n_base long, score double"
    )

    def run(batch):
        scanner, out = kept("licence rules", Scanner), []
        for doc, body in zip(batch["doc_id"], batch["text"]):
            plain = lower_ascii(body).decode()
            found = scanner.detections(plain)
            base = [d[0] for d in found if d[5]]
            doubt = 1.0
            for d in found:
                doubt *= 1 - d[4]
            first, last = (len(words(plain[:base[k]])) for k in (0, -1)) if base else (None, None)
            named = [dict(zip(("start", "end", "label", "priority", "confidence", "base"), d)) for d in found]
            out.append((doc, len(words(body)), named, first, last, len(base), 1 - doubt))
        if out:
            yield dict(zip(("doc_id", "n_words", "detections", "first_word", "last_word", "n_base", "score"), map(list, zip(*out))))

    return rows(docs.select(column(id).cast("long").alias("doc_id"), column(text).alias("text")), run, schema)
