"""2. Licence scan: Aho-Corasick over words finds notices and identifier tags; a shunting-yard parser evaluates expressions.

Every text is lower-cased (A-Z) and cut into words of ASCII letters and digits and of all characters above 0x7F. One
automaton over the words' text, each word between single spaces, finds all phrases at once, overlapping ones included.
After an identifier tag the licence expression (ids joined by AND, OR, WITH, in brackets) is parsed.

Defined results: null or empty text has 0 words, no labels, null first_word and last_word, score 0. Labels are distinct and
sorted; no label is the empty string. After a tag an id of the table IDS (as it stands, or with `+`, -only or -or-later) or with
LicenseRef- is a label; any other is the label `unknown:` and the id, if the expression is all that its line has. The restriction is the strictest of all well-formed
expressions (each as a whole) and of all other labels, those of malformed expressions included; null without labels. A tag
without an id adds nothing to the score. Very long texts are scanned whole, one at a time. Repeated rows and rows of a null id are scanned
alike; other columns of the input pass through, whatever their names, except those named as a result. An empty table gives an
empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parchmint.llm.common import numbered, read

#: Phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Other notices.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2.0",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution 4 0": "cc-by-4.0",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Families of licence ids with their versions ("" for none), by how much they restrict a user: 0 free, 1 weak
#: copyleft, 2 strong copyleft, 3 no commerce or no use.
FAMILIES = {
    0: {
        "0bsd": "", "afl": "1.1 1.2 2.0 2.1 3.0", "apache": "1.0 1.1 2.0 2", "artistic": "1.0 1.0-cl8 1.0-perl 2.0", "blueoak": "1.0.0", "bsd": "", "bsd-1-clause": "", "bsd-2-clause": "", "bsd-2-clause-patent": "",
        "bsd-3-clause": "", "bsd-3-clause-clear": "", "bsd-4-clause": "", "bsd-source-code": "", "bsl": "1.0", "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc0": "1.0", "curl": "", "ecl": "1.0 2.0", "fsfap": "", "hpnd": "", "icu": "",
        "isc": "", "libpng": "2.0", "mit": "", "mit-0": "", "mit-modern-variant": "", "ms-pl": "", "mulanpsl": "1.0 2.0", "ncsa": "", "ofl": "1.0 1.1", "openssl": "", "php": "3.0 3.01", "postgresql": "", "psf": "2.0",
        "public-domain": "", "python": "2.0 2.0.1", "ruby": "", "unicode-dfs-2016": "", "unicode": "3.0", "unlicense": "", "upl": "1.0", "vim": "", "w3c": "", "wtfpl": "", "x11": "", "zlib": "", "zpl": "1.1 2.0 2.1",
    },
    1: {"cc-by-sa": "1.0 2.0 2.5 3.0 4.0", "cddl": "1.0 1.1", "cpl": "1.0", "epl": "1.0 2.0", "lgpl": "2.0 2.1 3.0", "mpl": "1.0 1.1 2.0 2.0-no-copyleft-exception", "ms-rl": ""},
    2: {"agpl": "1.0 3.0", "cecill": "1.0 1.1 2.0 2.1", "eupl": "1.0 1.1 1.2", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "osl": "1.0 1.1 2.0 2.1 3.0", "sleepycat": ""},
    3: {
        "busl": "1.1", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0", "nposl": "3.0",
        "polyform-noncommercial": "1.0.0", "proprietary": "", "sspl": "1.0",
    },
}
#: Names without a version that notices give to families.
BARE = ("apache", "lgpl", "agpl", "epl", "cc-by-nc", "cc-by-sa", "cc-by-nd")
#: Id -> restriction.
IDS = {f"{name}-{v}" if v else name: how for how, names in FAMILIES.items() for name, versions in names.items() for v in (versions.split() or [""])}
IDS |= {name: how for how, names in FAMILIES.items() for name in names if name in BARE}
UNKNOWN = 3
#: What a notice of each kind adds to the belief that the document is licensed.
WEIGHTS = {"tag": 0.95, "base": 0.9, "notice": 0.8}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
_TAG_TEXT = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.I | re.A)
#: What may stand between an expression and the end of its line.
_CLOSING = " \t*/>\"'#;,.-)]}"
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def plain(ident: str) -> str:
    """An id without the marks of later versions."""
    return re.sub(r"(\+|-only|-or-later)$", "", ident)


def restriction(ident: str) -> int:
    """0 to 3; an unknown id counts as 3."""
    return IDS.get(ident, IDS.get(plain(ident), UNKNOWN))


def known(ident: str) -> bool:
    return ident in IDS or plain(ident) in IDS or ident.startswith("licenseref-")


def postfix(text: str) -> tuple[list[str], bool, int]:
    """Reverse Polish form of the expression that `text` starts with, whether it is well-formed, and where it ends (shunting-yard)."""
    out, ops, operand, pos = [], [], True, 0
    while m := _TOKEN.match(text, pos):
        t = m[1]
        word = t.lower()
        if operand:
            if t == "(":
                ops.append(t)
            elif t == ")" or word in _BINDS:
                return [x for x in out if x not in _BINDS], False, pos
            else:
                out.append(word.rstrip(".-"))
                operand = False
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif word in _BINDS:
            while ops and _BINDS.get(ops[-1], 0) >= _BINDS[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = True
        else:
            break
        pos = m.end()
    if operand or "(" in ops:
        return [x for x in out if x not in _BINDS], False, pos
    return out + ops[::-1], True, pos


def evaluate(rpn: list[str]) -> int:
    """Restriction that a user meets at least: of `or` the milder side, of `and` the stricter; an exception (`with`) takes one off."""
    stack: list[int] = []
    names: list[str] = []
    for t in rpn:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "or" else max(a, b) if t == "and" else max(0, a - 1))
        else:
            stack.append(restriction(t))
            names.append(t)
    return stack[0]


def licence_ids(rpn: list[str]) -> list[str]:
    """The licences of an expression: operands but for the exceptions after `with`."""
    stack: list[list[str]] = []
    for t in rpn:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a + b)
        else:
            stack.append([t])
    return [x for part in stack for x in part]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    a.make_automaton()
    return a


def scan(text: str | None, found) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, restriction) of a text."""
    text = text or ""
    words = WORD.findall(text.translate(LOWER) if not text.islower() else text)
    line = f" {' '.join(words)} "
    base, method, doubt, starts, kinds = set(), set(), 1.0, [], set()
    n_base = 0
    for end, (kind, label, back) in found.iter(line):
        kinds.add((kind, label))
        if kind == "base":
            n_base += 1
            base.add(label)
            starts.append(end - back)
        elif kind == "notice":
            method.add(label)
    verdicts, loose, tagged = [], base | method, set()
    if ("tag", "") in kinds:
        for m in _TAG_TEXT.finditer(text):
            rpn, whole, end = postfix(m[1])
            ids = set(licence_ids(rpn) if whole else rpn)
            named = set(filter(known, ids))
            if whole and not m[1][end:].strip(_CLOSING):
                named |= {f"unknown:{x}" for x in ids - named}
            tagged |= named
            if whole and named:
                verdicts.append(evaluate(rpn))
            else:
                loose = loose | named
    method |= tagged
    for kind, _ in kinds:
        doubt *= 1 - WEIGHTS[kind] * (kind != "tag" or bool(tagged))
    labels = base | method
    strict = max([*verdicts, *map(restriction, loose)], default=None)
    at = [line.count(" ", 0, s + 1) - 1 for s in ((min(starts), max(starts)) if starts else ())] or [None, None]
    return len(words), n_base, at[0], at[1], ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, strict


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restriction int"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32()]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` other than the text, with what the scan finds: one narrow pass, no shuffle."""
    from pyspark.sql import functions as F

    keep = [c for c in docs.columns if c != text and c not in _NAMES]

    def scanned(batches):
        found = automaton()
        for batch in batches:
            rows = [scan(x.as_py(), found) for x in batch.column(batch.num_columns - 1)]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*keep, *_NAMES])

    given = numbered(docs, [*keep, text])
    schema = T.StructType([docs.schema[c] for c in keep] + list(T.StructType.fromDDL(_FIELDS)))
    return given.mapInArrow(scanned, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
