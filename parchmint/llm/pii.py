r"""8. Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Patterns of four kinds are matched leftmost and without overlap, each in linear time. The field's variables are the tokens with a
digit or an @ (personal data spelt without either can't be added); all others are fixed as being outside. Neighbouring tokens share
potentials (chain), and so does each token with the last and with the first one in the document that is alike (same last
digits, same word or same name of an address: skip), however far away. Tokens in base spans are known. Loopy message passing over
all graphs of a batch at once, until messages change by less than TOLERANCE, gives each other token's label; tokens of one label side
by side make a span, which is added unless it meets a base span.

All weights (of shapes, chain and skip) are fitted together by the gradient of the conditional likelihood, with the marginals
of message passing. The labels come from the base patterns: in a sample of some SAMPLE documents, their matches are rewritten
into forms that the patterns miss (other separators, prefix or brackets gone), and repeated elsewhere in the document, with the label that
the match had.

Defined results: null or empty text has no spans (empty string; digest of the empty string). Repeated rows and rows of a null id
are searched alike; fields that look like numbers in other scripts (superscripts, circled digits) are no digits. If the
sample has no personal data, or the table is empty, the field adds nothing. Very long texts are searched whole. Other columns of the
input pass through, whatever their names, except those named as a result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm.common import numbered, read, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Documents that the field is fitted on, chosen by hash, each different one once: some 20,000, whole; about a fifth have any variable.
SAMPLE = 20_000
#: Messages are passed until none changes by more than this, or so many times.
TOLERANCE, ROUNDS = 1e-3, 200
#: Least probability of a label that makes a span.
LEAST = 0.9
#: Steps of the fit, rounds of messages in each, and the penalty of large weights.
STEPS, FIT_ROUNDS, PENALTY = 150, 12, 1e-3
#: What a base span adds to the belief in its label.
KNOWN = 12.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that can't start a match can't start one further in either: only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+: from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _HINT.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or an @."""
    found, stop = [], 0
    n = len(text)
    for m in _HINT.finditer(text):
        if (at := m.start()) >= stop:
            start, stop = at, at + 1
            while start and not text[start - 1].isspace() and (not found or start > found[-1][1]):
                start -= 1
            while stop < n and not text[stop].isspace():
                stop += 1
            found.append((start, stop))
    return found


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """0/1 per token: its shape, and the shapes of its neighbours."""
    out = np.zeros((len(spans), FEATURES), np.float64)
    for i, (s, e) in enumerate(spans):
        t = text[s:e].strip(".,;:!?\"'")
        d = _NOT_DIGIT.sub("", t)
        n, at, dots = len(d), t.find("@"), t.count(".")
        parts = t.split(".")
        quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
        letters = any(c.isalpha() for c in t)
        touch_l = i > 0 and s - spans[i - 1][1] <= 1
        touch_r = i + 1 < len(spans) and spans[i + 1][0] - e <= 1
        out[i, :20] = (
            1, at >= 0, at > 0 and "." in t[at:], quad, quad and all(len(p) < 4 and int(p) < 256 for p in parts), t.startswith("+"), "(" in t, "-" in t,
            n <= 2, 3 <= n <= 4, 5 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19, 14 <= n <= 19 and luhn(d), letters, letters and n > 0 and at < 0, "=" in t or '"' in text[s:e], touch_l, touch_r,
        )
        for k, j, near in ((20, i - 1, touch_l), (24, i + 1, touch_r)):
            if near:
                u = text[spans[j][0] : spans[j][1]]
                out[i, k : k + 4] = u.startswith("+"), "(" in u, "-" in u, any(c.isalpha() for c in u)
    return out


FEATURES = 28


def alike(token: str) -> list[str]:
    """What tokens have in common that are mentions of the same thing."""
    t = token.strip(".,;:!?\"'()[]")
    digits = _NOT_DIGIT.sub("", t)
    name, at, _ = t.lower().partition("@")
    keys = [f"@{name}"] if at and len(name) > 3 else [f"#{digits[-7:]}"] if len(digits) >= 7 else []
    return [*keys, t.lower()] if len(t) > 3 else keys


def graph(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges between tokens side by side, skip edges from each token to the last and to the first one that is alike)."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 1]
    seen: dict[str, tuple[int, int]] = {}
    skip = set()
    for i, (s, e) in enumerate(spans):
        for key in alike(text[s:e]):
            first, last = seen.get(key, (i, i))
            skip |= {(j, i) for j in (first, last) if j < i}
            seen[key] = first, i
    return chain, sorted(skip)


def met(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each span by a base span that it meets (0: none); base is sorted by start. Linear but for a binary search."""
    if not base or not spans:
        return np.zeros(len(spans), np.int64)
    starts, ends = np.array([b[0] for b in base]), np.array([b[2] for b in base])
    furthest = np.maximum.accumulate(ends)
    which = np.maximum.accumulate(np.where(ends == furthest, np.arange(len(base)), 0))
    at = np.searchsorted(starts, [e for _, e in spans]) - 1
    hit = (at >= 0) & (furthest[at] > np.array([s for s, _ in spans]))
    return np.where(hit, np.array([b[1] for b in base])[which[at]] + 1, 0)


def hidden(match: str, kind: int, form: int) -> str:
    """A base match in a form that the base patterns miss."""
    digits = _NOT_DIGIT.sub("", match)
    if kind == 0:
        return (match.replace("@", " @ "), match.replace("@", "@ "), match.replace("@", "[@]"))[form % 3]
    if kind == 1:
        return (match.replace(".", "[.]"), match.replace(".", ","), match.replace(".", "(.)"))[form % 3]
    if kind == 2:
        return "./_"[form % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    return (match.lstrip("+"), f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}")[form % 4]


def masked(text: str, base: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """(text with some matches rewritten and some repeated at the end, where they are now)."""
    rng = np.random.default_rng(seed)
    parts, spans, done, size, tail = [], [], 0, 0, []

    def put(piece: str, kind: int | None = None):
        nonlocal size
        if kind is not None:
            spans.append((size, kind, size + len(piece)))
        parts.append(piece)
        size += len(piece)

    for start, kind, end in base:
        if start < done:
            continue
        put(text[done:start])
        # A third each: hidden here, as it was and hidden further on, as it was.
        how = rng.integers(3)
        put(hidden(text[start:end], kind, int(rng.integers(12))) if how == 0 else text[start:end], kind)
        if how == 1:
            tail.append((hidden(text[start:end], kind, int(rng.integers(12))), kind))
        done = end
    put(text[done:])
    for piece, kind in tail:
        put(" and again ")
        put(piece, kind)
    return "".join(parts), spans


_COLUMNS = ("x", "y", "known", "chain", "skip")


def _examples(texts) -> tuple[np.ndarray, ...] | None:
    """Features, labels and known labels of all tokens of some texts with masked matches, and the edges between them."""
    rows, size = [[] for _ in _COLUMNS], 0
    for n, t in enumerate(texts):
        if not t or not _HINT.search(t):
            continue
        t, truth = masked(t, base_spans(t), n)
        spans = tokens(t)
        chain, skip = graph(t, spans)
        made = features(t, spans).astype(np.uint8), met(spans, truth), met(spans, base_spans(t))
        for out, part in zip(rows, (*made, *(np.array(e, np.int64).reshape(-1, 2) + size for e in (chain, skip))), strict=True):
            out.append(part)
        size += len(spans)
    return tuple(map(np.concatenate, rows)) if size else None


def train(x: np.ndarray, y: np.ndarray, known: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights: features x labels, chain potentials, skip potentials) that raise the likelihood of the labels, all at once (Adam)."""
    labels = len(LABELS)
    theta = [np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros((labels, labels))]
    first, second = ([np.zeros_like(t) for t in theta] for _ in range(2))
    x, fixed, goal = x.astype(np.float64), _known(known), np.eye(labels)[y]

    def pairs(edges):
        n = np.zeros((labels, labels))
        np.add.at(n, (y[edges[:, 0]], y[edges[:, 1]]), 1.0)
        return n

    seen = [x.T @ goal, pairs(chain), pairs(skip)]
    for step in range(1, STEPS + 1):
        nodes, edges = beliefs(x @ theta[0] + fixed, [(chain, theta[1]), (skip, theta[2])], FIT_ROUNDS)
        expected = [x.T @ nodes, *(e.sum(axis=0) for e in edges)]
        for k, t in enumerate(theta):
            g = (seen[k] - expected[k]) / len(y) - PENALTY * t
            # Alike tokens are alike both ways.
            g = (g + g.T) / 2 if k == 2 else g
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            t += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return tuple(theta)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The field's weights. Only the tokens of the sampled documents reach the driver."""
    total = docs.count()
    if not total:
        return None
    rows = docs.select(F.xxhash64(F.col(doc_id).cast("string"), text).alias("h"), F.col(text).alias("text"))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(8), "h"), F.lit(1 << 40)) < min(1 << 40, int(SAMPLE / total * (1 << 40)))).dropDuplicates(["h"]).sortWithinPartitions("h").select("h", "text")

    def described(batches):
        tidy()
        for batch in batches:
            if (found := _examples(batch.column(1).to_pylist())) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()]), *(pa.array([np.ascontiguousarray(c).tobytes()]) for c in found)], ["h", *_COLUMNS])

    found = sorted(sample.mapInArrow(described, "h long, " + ", ".join(f"{c} binary" for c in _COLUMNS)).collect(), key=lambda r: r["h"])
    parts = [[np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, FEATURES), *(np.frombuffer(bytes(r[c]), np.int64) for c in _COLUMNS[1:])] for r in found]
    size = 0
    for part in parts:
        part[3:] = [e.reshape(-1, 2) + size for e in part[3:]]
        size += len(part[1])
    if not size or not any(part[1].any() for part in parts):
        return None
    return train(*(np.concatenate([part[k] for part in parts]) for k in range(len(_COLUMNS))))


def _known(labels: np.ndarray) -> np.ndarray:
    return np.eye(len(LABELS))[labels] * (labels > 0)[:, None] * KNOWN


def beliefs(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(probabilities of the labels, of the pairs of labels of each edge) by loopy belief propagation; edges: (pairs, potentials) of each kind."""

    def shared(z, axes):
        z = np.exp(z - z.max(axis=axes, keepdims=True))
        return z / z.sum(axis=axes, keepdims=True)

    pairs = np.concatenate([np.asarray(p, np.int64).reshape(-1, 2) for p, _ in edges]) if edges else np.zeros((0, 2), np.int64)
    kinds = np.concatenate([[0], np.cumsum([len(p) for p, _ in edges])]).astype(int)
    n = len(pairs)
    if not n:
        return shared(unary, 1), [np.zeros((0, unary.shape[1], unary.shape[1])) for _ in edges]
    psi = np.concatenate([np.broadcast_to(w, (len(p), *w.shape)) for p, w in edges])
    sources, goals = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    potentials = np.concatenate([psi, psi.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    message = np.zeros((2 * n, unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, goals, message)
        out = (belief[sources] - message[back])[:, :, None] + potentials
        top = out.max(axis=1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        change = np.abs(new - message).max()
        message = new
        if change < TOLERANCE:
            break
    belief = unary.copy()
    np.add.at(belief, goals, message)
    both = (belief[pairs[:, 0]] - message[n:])[:, :, None] + psi + (belief[pairs[:, 1]] - message[:n])[:, None, :]
    both = shared(both, (1, 2))
    return shared(belief, 1), [both[kinds[k] : kinds[k + 1]] for k in range(len(edges))]


def _added(texts: list[str], bases: list[list], model) -> list[list[tuple[int, int, int]]]:
    """Spans of each text that the field adds; the graphs of some texts are solved together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    held, size = [], 0
    for k, t in enumerate(texts):
        if t and _HINT.search(t):
            held.append((k, tokens(t)))
            size += len(held[-1][1])
            if size >= AT_ONCE:
                _solved(texts, bases, held, model, out)
                held, size = [], 0
    _solved(texts, bases, held, model, out)
    return out


#: Tokens whose graphs are solved together (or those of one text).
AT_ONCE = 20_000


def _solved(texts, bases, held, model, out) -> None:
    if not held:
        return
    w, chain, skip = model
    x, known, ends, size = [], [], ([], []), 0
    for k, spans in held:
        for kind, edges in enumerate(graph(texts[k], spans)):
            ends[kind].append(np.array(edges, np.int64).reshape(-1, 2) + size)
        x.append(features(texts[k], spans))
        known.append(met(spans, bases[k]))
        size += len(spans)
    known = np.concatenate(known)
    p, _ = beliefs(np.concatenate(x) @ w + _known(known), [(np.concatenate(e), psi) for e, psi in zip(ends, (chain, skip), strict=True)])
    best = np.where((p.max(axis=1) >= LEAST) & (known == 0), p.argmax(axis=1), 0)
    at = 0
    for k, spans in held:
        found, i = [], 0
        while i < len(spans):
            j = i + 1
            if kind := best[at + i]:
                while j < len(spans) and best[at + j] == kind and spans[j][0] - spans[j - 1][1] <= 1:
                    j += 1
                start, end = spans[i][0], spans[j - 1][1]
                while start < end and texts[k][start] in ".,;:!?\"'[]<>":
                    start += 1
                while start < end and texts[k][end - 1] in ".,;:!?\"'([]<>":
                    end -= 1
                if start < end:
                    found.append((start, int(kind) - 1, end))
            i = j
        clear = met([(s, e) for s, _, e in found], bases[k]) == 0
        out[k] = [span for span, free in zip(found, clear, strict=True) if free]
        at += len(spans)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def find_personal_data(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """`docs` without the text, with the base spans' numbers, the base spans and all spans (kind:start:end). No shuffle."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c != text and c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        tidy()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = _added(texts, bases, shared.value)
            columns = [pa.array([sum(k == kind for _, k, _ in b) for b in bases], pa.int64()) for kind in range(4)]
            columns += [pa.array([_joined(b) for b in bases], pa.string()), pa.array([_joined(b + a) for b, a in zip(bases, added, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], [*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep])
    for x in _SCHEMA.split(", "):
        schema = schema.add(*x.split())
    return numbered(docs, [*keep, text]).mapInArrow(found, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
