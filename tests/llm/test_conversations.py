"""Repair of conversations: brute force over all edits, pieces against whole searches, defined results."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from parchmint.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, start=0, ends=cv.ENDS):
    """Cheapest (cost, audit) by dynamic programming over all ways, with two insertions anywhere."""
    ways = {start: (0, "")}

    def insert(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (cost, audit) in list(out.items()):
                to = cv.ASKS[s][1]
                out[to] = min(out.get(to, (cost + 2, audit + "I")), (cost + 2, audit + "I"))
        return out

    for first, gone, cut in rows:
        nxt = {}
        for s, (cost, audit) in insert(ways).items():
            options = [(s, cost + 3, "D")]
            asked, to = cv.ASKS[s]
            if not gone:
                options.append((to, cost + cut + (0 if first == asked else 2), "K" if first == asked else "R"))
                if s == 0 and first == "s":
                    options.append((1, cost + cut, "K"))
            for to, c, e in options:
                nxt[to] = min(nxt.get(to, (c, audit + e)), (c, audit + e))
        ways = nxt
    ways = insert(ways)
    return min(ways[e] for e in ends if e in ways)


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        rows = [(rng.choice("suaux "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(9))]
        (found,) = cv.a_star(rows, 0, cv.ENDS).values()
        assert found == brute(rows), rows


def sql_free(rows):
    """The contract's figures in plain Python."""
    made = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate({ord(k): None for k in ".!?"}) if kind == 2 else x
        made += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in made if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, r, x in own:
            bare = x.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((r, x))
            judged.append((r[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            if fault:
                counts[fault] += 1
        cost, audit = brute(judged)
        state, lines, at = 0, [], 0
        for e in audit:
            asked, to = cv.ASKS[state]
            if e == "I":
                lines.append(cv.ROLES[asked] + ":")
                state = to
                continue
            _, _, r, x = own[at]
            at += 1
            if e == "D":
                continue
            if e == "K" and r[:1] == "s" and state == 0:
                to = 1
            lines.append(f"{cv.ROLES[asked] if e == 'R' else r}:{x}")
            state = to
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[c] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def judged(spark, rows, tmp_path, name, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return {r[0]: tuple(r)[1:] for r in cv.op13_conversations(spark, f"{tmp_path}/{name}").collect()}


@pytest.mark.parametrize("piece", [cv.PIECE, 3])
def test_query_equals_plain_python(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(cv, "PIECE", piece)
    rng = random.Random(5)
    words = ["Yes.", "no", "Why?", "", "  ", "Well then!", None, "Yes."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(words)) for c in range(40) for t in range(rng.randrange(12))]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y.")]
    # One conversation of most rows spans all partitions; nulls first.
    rows += [(77, t, rng.choice(["user", "assistant"]), f"Text {t % 50}.") for t in range(600)] + [(77, None, "system", "Rules.")]
    assert judged(spark, rows, tmp_path, f"t{piece}") == sql_free(rows)


def test_repaired_rows_make_the_digest(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again"), (1, 3, "user", ""), (2, 1, "system", "S."), (3, 5, "user", "Hi."), (3, 6, "user", "Hi."), (3, 7, "assistant", "Ho.")]
    verdicts, fixed = cv.repair(spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit(1), "t": F.lit(2), "kind": F.lit(3), "verdict": F.lit(4), "body": F.lit(5), "copies": F.lit(6)}))
    audits = {r["conv_id"]: (r["cost"], r["audit"]) for r in verdicts.collect()}
    got = {}
    for r in fixed.orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append((r["position"], r["edit"], r["role"], r["text"]))
    (one,) = {brute([("a", False, False), ("a", False, True), ("u", True, False)])}
    assert audits == {1: one, 2: (3, "D"), 3: (3, "KDK")}
    assert got[3] == [(1, "K", "user", "Hi."), (2, "K", "assistant", "Ho.")] and 2 not in got
    assert [r[0] for r in got[1]] == list(range(1, len(got[1]) + 1))


def test_empty_table_and_repeated_and_long_rows(spark, tmp_path):
    assert judged(spark, [], tmp_path, "empty") == {}
    long = "word " * 400_000 + "end."
    rows = [(1, 5, "user", long), (1, 5, "user", long), (1, 6, "assistant", long), (2, None, "user", "A."), (2, None, "user", "A.")]
    assert judged(spark, rows, tmp_path, "long") == sql_free(rows)
