"""Hard negatives: bit-planes, the pruned search and the query against brute force; defined results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.llm import hardneg as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def test_planes_make_the_numbers_again():
    rng = np.random.default_rng(0)
    for v in (rng.integers(-300, 300, (20, 5)), np.zeros((3, 2), np.int64), np.array([[-1, -256, 255, 256]]), np.array([[-(1 << 40), 1 << 41]])):
        m, bits = hn.planes(v)
        assert (sum((1 << j) * bits[j].astype(np.int64) for j in range(m)) - (1 << m) * bits[m].astype(np.int64) == v).all()


@pytest.mark.parametrize(("large", "few"), [(200, 0.0), (200, 0.05), (200, 2.0), (1 << 20, 0.05), (1 << 29, 0.05)])
def test_search_keeps_the_best_of_every_window(monkeypatch, large, few):
    monkeypatch.setattr(hn, "FEW", few)
    rng = np.random.default_rng(large)
    for _ in range(10):
        a, v = rng.integers(-large, large, (7, 6)), rng.integers(-large, large, (90, 6))
        v[rng.integers(0, 90, 30)] = v[0]
        eligible, scores = rng.random((7, 90)) < 0.7, a @ v.T
        least = np.sort(rng.choice(scores.reshape(-1), (7, 3)), axis=1)
        most = least + 10 * large
        floor = np.where(rng.random((7, 3)) < 0.3, least + large, np.iinfo(np.int64).min)
        rows, cols, found = hn.search(a, v, eligible, least, most, floor)
        got = dict(zip(zip(rows.tolist(), cols.tolist(), strict=True), found.tolist(), strict=True))
        assert all(scores[k] == s and eligible[k] for k, s in got.items())
        for i in range(7):
            for w in range(3):
                fit = sorted((-scores[i, j], j) for j in range(90) if eligible[i, j] and max(least[i, w], floor[i, w]) <= scores[i, j] <= most[i, w])
                last = fit[min(len(fit), hn.BEST) - 1][0] if fit else 0
                assert all((i, j) in got for s, j in fit if s <= last), (i, w)


def brute(rows):
    table = []
    for n, (vec_id, label, x) in enumerate(rows):
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        table.append((n, vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, vec_id, label, v in table:
        if vec_id is None or vec_id % 100:
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=True))
        others = [(score(w), o, lab == label) for m, o, lab, w in table if m != n and len(w) == len(v)]
        for p, pid, _ in sorted((s for s in others if s[2]), key=order)[: hn.BEST]:
            fit = sorted((s for s in others if not s[2] and 80 * p <= 100 * s[0] <= 100 * p), key=order)[: hn.BEST]
            out += [(vec_id, pid, rank, nid, p, s) for rank, (s, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/embeddings.parquet")
    return sorted((tuple(r) for r in hn.op12_hardneg(spark, str(folder)).collect()), key=repr)


def odd_rows():
    rng = random.Random(2)
    point = lambda: [rng.choice([-0.5, 0.1, 0.3, 0.30001, 0.7, 1.5]) for _ in range(6)]
    rows = [(i, rng.randrange(10), point()) for i in range(0, 900, 3)] + [(i, rng.randrange(4), point()) for i in range(0, 900, 100)]
    rows += [(100, 1, rows[0][2])] * 3 + [(None, 3, point()), (None, 5, point()), (200, None, point()), (300, 2, None), (400, 2, [0.1, None, 0.2, 0.3, 0.1, 0.1]), (500, 1, [float("nan")] * 6)]
    return rows + [(600, 1, [float("inf")] * 6), (700, 1, [1.0, 2.0]), (701, 1, [1.0, 2.0]), (702, 2, [1.0, 1.9]), (800, 4, []), (801, 4, []), (802, 3, []), (900, 2, [-1.0] * 6), (901, 2, [1.0] * 6)]


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks, sub-blocks and steps
        for name, value in (("ANCHOR_BYTES", 1), ("BLOCK_ROWS", 16), ("SUB_ANCHORS", 2), ("SUB", 5)):
            monkeypatch.setattr(hn, name, value)
    rows = odd_rows()
    got = mined(spark, rows, tmp_path)
    assert got == brute(rows) and len(got) > 50


def test_empty_table_other_names_and_large_numbers(spark, tmp_path):
    assert mined(spark, [], tmp_path) == []
    rows = spark.createDataFrame([(0, "a", [4e9, 1.0]), (1, "a", [1e-9, 1.0]), (2, "b", [0.0, 0.9])], "id long, kind string, e array<double>").withColumns({c: F.lit(1) for c in ("uid", "x", "v", "dims", "cell", "a", "b")})
    assert hn.hard_negatives(rows, F.col("vec_id") == 5, "e", "kind", "id").collect() == []
    found = hn.hard_negatives(rows, F.col("vec_id") == 0, "e", "kind", "id").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 65536, 58880)]
    rows = [(0, 1, [1e7, 1.0]), (1, 1, [1e7, 3.0]), (2, 2, [9e6, 5.0]), (3, 2, [1e7, 3.0]), (4, 2, [1e7, 4.0])]
    found = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    exact = lambda x, y: (256 * 10**7) * (256 * x) + 256 * 256 * y
    assert [tuple(r)[1:] for r in found] == [(1, 1, 3, exact(10**7, 3), exact(10**7, 3)), (1, 2, 2, exact(10**7, 3), exact(9 * 10**6, 5))]
