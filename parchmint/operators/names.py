"""Names of organisations and people by an averaged structured perceptron: features of tokens, tags O, B, I, Viterbi decoding.

It is trained over labelled texts (text, spans of names): in each pass every partition corrects the weights that it was given on its own
texts, and the corrections of all partitions are averaged by one aggregate over features; what is kept is the mean of the weights
after each pass. Weights are hashed to 2^BITS rows, so the model, and what reaches the driver, has a fixed size.

Defined results: null or empty text has no names. The order of texts within a partition is by their hash, so that a rerun gives the same weights
for the same partitions.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
PASSES, PARTS = 8, 4
#: Labelled texts that are fitted, at most: those first by a hash.
LABELLED = 4000
O, B, I = range(3)
#: Words (short capitalised ones with the dot of an abbreviation), numbers, line ends, other signs.
_TOKEN = re.compile(r"[A-Z][a-z]{0,3}\.|[A-Za-z][A-Za-z'&-]*|\d[\d,.]*|\n|[^\sA-Za-z\d]")
ENTITIES = "array<struct<name:string,start:int,context:string>>"


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _shape(word: str) -> str:
    if word == "\n":
        return "n"
    return "d" if word[0].isdigit() else "p" if not word[0].isalpha() else "A" if word.isupper() and len(word) > 1 else "a" if word[0].islower() else "Aa"


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows of weights that each token looks at, tokens x features."""
    words = [text[a:b] for a, b in spans]
    low, shapes = [w.lower().rstrip(".") for w in words], [_shape(w) for w in words]
    near = lambda seq, i: seq[i] if 0 <= i < len(seq) else "^"
    rows = []
    for i, w in enumerate(low):
        p, n = near(low, i - 1), near(low, i + 1)
        sp, s, sn = near(shapes, i - 1), shapes[i], near(shapes, i + 1)
        named = (
            "b", f"w{w}", f"s{s}", f"x{w[-3:]}", f"p{p}", f"n{n}", f"ps{sp}{s}", f"sn{s}{sn}", f"psn{sp}{s}{sn}", f"ppsp{near(low, i - 2)} {p} {s}",
            f"np{n}{s}", f"nn{near(low, i + 2)} {s}", f"l{near(shapes, i - 2)}{sp}{s}",
        )
        rows.append([crc32(f.encode()) & ((1 << BITS) - 1) for f in named])
    return np.array(rows, np.int64).reshape(len(words), -1)


def gold(spans: list[tuple[int, int]], names: list[tuple[int, int]]) -> np.ndarray:
    """The tag of each token by the names that it lies in."""
    tags = np.zeros(len(spans), np.int64)
    for start, end in names:
        inside = [i for i, (a, b) in enumerate(spans) if a >= start and b <= end]
        tags[inside] = I
        tags[inside[:1]] = B
    return tags


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags; I never follows O or stands first."""
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    barred = moves.copy()
    barred[O, I] = -np.inf
    best, back = scores[0].copy(), np.zeros((n, 3), np.int64)
    best[I] = -np.inf
    for i in range(1, n):
        way = best[:, None] + barred
        back[i] = way.argmax(axis=0)
        best = way.max(axis=0) + scores[i]
    tags = np.empty(n, np.int64)
    tags[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


class Names:
    """Weights of features and of moves between tags."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def tags(self, rows: np.ndarray) -> np.ndarray:
        return viterbi(self.weights[rows].sum(axis=1), self.moves)

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(name, start, end) in order."""
        text = text or ""
        spans = tokens(text)
        found, tags = [], self.tags(features(text, spans)) if spans else []
        for (a, b), tag in zip(spans, tags, strict=True):
            if tag == B:
                found.append([a, b])
            elif tag == I:
                found[-1][1] = b
        return [(text[a:b], a, b) for a, b in found]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        return self.find(text)


def _corrections(texts: list, model: Names) -> tuple[np.ndarray, np.ndarray]:
    """What one pass over some labelled texts changes."""
    own = Names(model.weights.copy(), model.moves.copy())
    for text, names in texts:
        spans = tokens(text)
        if not spans:
            continue
        rows, want = features(text, spans), gold(spans, names)
        got = own.tags(rows)
        for i in np.flatnonzero(got != want):
            np.add.at(own.weights, (rows[i], want[i]), 1.0)
            np.add.at(own.weights, (rows[i], got[i]), -1.0)
        np.add.at(own.moves, (want[:-1], want[1:]), 1.0)
        np.add.at(own.moves, (got[:-1], got[1:]), -1.0)
    return own.weights - model.weights, own.moves - model.moves


def train(labelled: DataFrame, passes: int = PASSES, parts: int = PARTS, most: int = LABELLED) -> Names:
    """labelled: text, names (array of struct of start and end). Of more than `most` texts, those first by a hash are fitted."""
    rows = labelled.select("text", "names", F.xxhash64("text").alias("h")).filter("text IS NOT NULL").orderBy("h").limit(most)
    rows = rows.repartition(parts, "h").sortWithinPartitions("h").persist()
    size = (1 << BITS) * 3
    model, total = Names(np.zeros((1 << BITS, 3)), np.zeros((3, 3))), [np.zeros((1 << BITS, 3)), np.zeros((3, 3))]
    for _ in range(passes):
        given = labelled.sparkSession.sparkContext.broadcast((model.weights, model.moves))

        def corrected(batches, given=given):
            texts = [(t, [(n["start"], n["end"]) for n in names]) for b in batches for t, names in zip(b["text"], b["names"], strict=True)]
            weights, moves = _corrections(texts, Names(*given.value))
            flat = np.concatenate([weights.reshape(-1), moves.reshape(-1)])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"at": at, "x": flat[at]})

        step = np.zeros(size + 9)
        # As many rows as the model has weights, at most.
        for r in rows.select("text", "names").mapInPandas(corrected, "at long, x double").groupBy("at").agg((F.sum("x") / parts).alias("x")).collect():
            step[r["at"]] = r["x"]
        model = Names(model.weights + step[:size].reshape(-1, 3), model.moves + step[size:].reshape(3, 3))
        total[0] += model.weights
        total[1] += model.moves
        given.unpersist()
    rows.unpersist()
    return Names(total[0] / passes, total[1] / passes)


def entities(text: Column, names, chars: int, most: int = 15) -> Column:
    """Array of (name, start, context): distinct names of three characters or more in the first `chars`, in order of their first mention."""

    @F.pandas_udf(ENTITIES)
    def scan(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            seen = {}
            for name, a, b in names(t[:chars]):
                if len(name) >= 3 and name not in seen:
                    seen[name] = {"name": name, "start": a, "context": t[max(0, a - 60) : b + 60].strip()[:200]}
            return list(seen.values())[:most]

        return texts.map(one)

    return scan(text)
