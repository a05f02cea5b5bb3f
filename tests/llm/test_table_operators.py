"""Operators over whole tables, held against brute force on small fixtures."""

import hashlib
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchmint.llm import embeddings, jaccard, linededup, minhash, mixing
from parchmint.llm.components import _star, components

TEXTS = ["", None, " ", "one", "one two", "a b c d e f", "A b c d e f", "x\ny", "w " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "s", 1), (None, "a b c d e f", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def union_find(nodes, links):
    to = {n: n for n in nodes}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 99), (99, 100), (7, 7), (200, 150), (150, 180)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == union_find({n for link in links for n in link if link != (7, 7)} | {7}, links)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_hubs(spark):
    """Hubs with thousands of ties, small and large ids, joined by a path; no task of the join gets all ties of a hub."""
    links = [(0, i) for i in range(10, 4000)] + [(9_000, i) for i in range(4000, 8000)] + [(3999, 8500), (8500, 4000), (20_000, 20_001)]
    edges = spark.createDataFrame(links, "u long, v long")
    got = dict(components(edges).collect())
    assert got == union_find({n for link in links for n in link}, links)
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    plan = _star(flat, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan.split("Join Inner")[1].splitlines()[0]


def test_line_dedup_sql(spark, docs, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(linededup.ORACLE_OP4).fetchall()
    found = linededup.op4_linededup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want) and sum(w[2] for w in want) > 0


def test_line_dedup_odd(spark):
    long = "this is a line of many words É"
    rows = [(1, f" {long.replace('t', 'T')}\t\nshort\n"), (2, f"{long}\n{long}"), (3, long), (3, long), (None, long), (9, None), (10, ""), (11, long.lower())]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)))
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["kept"]))
    assert by[1] == [(3, 1, "short\n")] and by[2] == [(2, 2, "")] and by[3] == [(1, 0, long)] * 2 and by[None] == [(1, 1, "")]
    assert by[9] == by[10] == [(1, 0, "")] and by[11] == [(1, 0, long.lower())]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("cell", [4096, 3])
def test_jaccard_brute_force(spark, docs, cell):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, int(rng.integers(4, 150))))
        for _ in range(8):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = "new"
            rows.append(" ".join(copy))
    extra = spark.createDataFrame([(10000 + i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    sets = {r["doc_id"]: shingles(r["text"], 3) for r in df.collect()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, cell=cell).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_odd(spark, odd):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect())
    assert got == sorted([("0", 0, 0), ("1", 0, 1), ("2", 0, 2), ("3", 1, 3), ("4", 1, 4), ("5", 4, 5), ("5", 4, 5), ("6", 4, 5), ("7", 1, 7), ("8", 1, 8), ("None", 4, None)])
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0
    kept = [r["doc_id"] for r in jaccard.stage(spark, odd, "").collect()]
    assert sorted(map(str, kept)) == sorted(["0", "1", "2", "3", "4", "5", "5", "7", "8", "None"])


def test_fingerprints(spark, docs):
    got = docs.transform(minhash.with_next).mapInArrow(minhash._compared, minhash._SCHEMA).toPandas().sort_values("doc_id")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for i, r in enumerate(got.itertuples()):
        new = minhash.edited(texts[i], texts[(i + 1) % len(texts)])
        a, b = shingles(texts[i], 5), shingles(new, 5)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(texts[i])
        assert abs(r.near_edited - len(a & b) / max(1, len(a | b))) < 0.25
    by = {}
    for t, f in zip(texts, got.fingerprint, strict=True):
        assert by.setdefault(t, f) == f


def test_fingerprints_odd(spark, odd):
    got = odd.transform(minhash.with_next).mapInArrow(minhash._compared, minhash._SCHEMA).collect()
    assert len(got) == odd.count() and all(0 <= r["near_next"] <= 1 for r in got)
    one = odd.filter("doc_id = 3").transform(minhash.with_next).mapInArrow(minhash._compared, minhash._SCHEMA).collect()
    assert [r["near_next"] for r in one] == [1.0]
    assert odd.limit(0).transform(minhash.with_next).mapInArrow(minhash._compared, minhash._SCHEMA).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base), (2, base), (3, base.replace("w200 ", "zz ")), (4, "other words that are not near to it at all"), (5, None)]
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_near_duplicates_near_the_threshold(spark):
    """Groups whose members are near some others only: no false link, and nearly all that brute force finds."""
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(8):
            words = list(base)
            for at in rng.choice(200, rng.integers(1, 5), replace=False):
                words[at] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    got = dict(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if label[a] == label[b]]
    assert all(label[a] == label[b] for a, b in combinations(range(len(texts)), 2) if got[a] == got[b])
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) > 0


@pytest.mark.parametrize("cell", [2048, 3])
def test_embeddings(spark, cell):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(20):
        c = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(x) for x in c + rng.standard_normal(16) * 0.12], g % 3) for k in range(6)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], None), (902, None, 1), (903, [0.0] * 16, 1), (904, [float("nan")] * 16, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and i < 901}
    links = [(a, b) for a, b in combinations(sorted(good), 2) if good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, cell=cell).collect()}
    n = {i: sum(i in link for link in links) for i in good}
    assert len(got) == len(rows) and all(got[i]["n_links"] <= n[i] for i in good)
    assert sum(got[i]["n_links"] for i in good) >= 0.9 * sum(n.values()) > 0
    for i in (901, 902, 903, 904, 905, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["kept"] is False and got[900]["component_id"] == got[0]["component_id"]


def shares(sizes, weights=(1, 2, 3), most=3):
    """Brute force: what a target exceeds its limit is shared among the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while free := [s for s in order if s not in target]:
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > most * sizes[s]]
        target |= {s: most * sizes[s] for s in over} or want
        left -= sum(target[s] for s in over)
    return target


def test_mixing_targets(spark):
    rng = np.random.default_rng(2)
    for sizes in ({"a": 10, "b": 0, None: 90}, {"é": 5, "z": 7, "\U0001f600": 3, "\uffee": 4}, {f"s{i}": int(x) for i, x in enumerate(rng.pareto(0.7, 50) * 10)}):
        table, n = mixing.ordered(spark.createDataFrame([(k, v) for k, v in sizes.items()], "s string, words long"))
        got = {r["s"]: r["target"] for r in mixing.targets(table).collect()}
        assert n == len(sizes) and got == pytest.approx(shares(sizes))


def test_mixing_inclusion(spark):
    """Frequencies over seeds come near the intended probabilities (size ** -TILT, small documents certain), the fill included."""
    rng = np.random.default_rng(4)
    sizes = [3, 5, 8, *rng.integers(20, 200, 37).tolist()]
    total, rest = sum(sizes), sum(sizes) * 0.6
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(100 + i, "w " * 50, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    # Two sources: of a's words 0.6 are wanted, b gets what is left.
    weights = (rest, total + 2000 - rest)
    n, most = 16, 0
    hits = np.zeros(len(sizes))
    for seed in range(n):
        got = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df, weights=weights, seed=seed).filter("source = 'a'").select("doc_id", "copies").collect()}
        hits += [got[i] for i in range(len(sizes))]
        most = max(most, abs(sum(got[i] * k for i, k in enumerate(sizes)) - rest))
    lo, hi = 0.0, 100.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(k * min(1, mid * k**-mixing.TILT) for k in sizes) < rest else (lo, mid)
    p = np.array([min(1, lo * k**-mixing.TILT) for k in sizes])
    # What stays of the gap is less than half of any document that could fill it.
    assert abs(hits / n - p).mean() < 0.12 and most <= max(sizes) / 2
    small, large = np.argsort(sizes)[:20], np.argsort(sizes)[20:]
    assert abs((hits / n - p)[small].mean()) < 0.08 and abs((hits / n - p)[large].mean()) < 0.08


def test_mixing(docs, odd):
    got = mixing.mix_sources(docs.select("doc_id", "source", "text")).toPandas()
    again = mixing.mix_sources(docs.select("doc_id", "source", "text")).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 3 * got["size"]).all() and abs(got.groupby("source").target.first().sum() - got["size"].sum()) < 1e-3
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((sums.taken - sums.target).abs() <= sums.most).all()
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(odd.limit(0)).count() == 0


def test_pipeline(spark, docs, sf_dir):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf_dir).count() == rows.count() > 0
