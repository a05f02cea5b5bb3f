"""12. Hard-negative mining by bit-sliced integer products.

Components are whole numbers. A row's are cut into bit-planes: a sign plane and planes of falling weight. Planes are processed most
significant first, each as one product of anchors with zeros and ones; after each, what the planes to come can add lies between their weight times the
anchor's negative and positive sums, so every pair has an interval of scores. Pairs whose interval can't reach the window any
more, or lies below the last of the best that are already certain, are dropped; once few are left, the rest of the planes is
added pair by pair. After the last plane intervals are scores.

Anchors are the stated query set: they meet all rows in blocks of anchors by blocks of rows, a cell of the grid each, so that no
label or vector gathers anywhere; a task holds a block of anchors and SUB rows, and gives the best of each anchor in its cell. A window
over anchors then takes the best of all cells. The same search runs twice: for positives (same label, no window) and, with the
positives' scores, for negatives (other labels, a window per positive).

Defined results: rows with a null label, a null vector, or a null, NaN or infinite component take no part. Vectors are compared with vectors of
their own length only; empty ones have the score 0. A row with a null vec_id is no anchor, and comes last among equals. Repeated rows are rows of their own,
anchors too. Scores are longs; one that isn't raises an error. Other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.common import checkpointed, partitions, read, tidy

BEST = 5
#: Least and largest score of a negative, in per cent of the positive's.
LEAST, MOST = 80, 100
SCALE = 256
#: Bytes of a block of anchors, rows of a block of rows; anchors and rows that are multiplied at a time.
ANCHOR_BYTES, BLOCK_ROWS = 1 << 22, 1 << 16
SUB_ANCHORS, SUB = 512, 2048
#: Share of pairs below which planes are added pair by pair, and pairs at a time.
FEW, PAIRS = 0.05, 1 << 15
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def components(rows: DataFrame, vector: str, label: str, vec_id: str) -> DataFrame:
    """(uid, vec_id, label, dims, v) of the rows that take part; v are floor(SCALE * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = rows.schema[label].dataType.typeName() in ("byte", "short", "integer", "long")
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))).alias("label"), x.alias("x"))
    named = named.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", number))
    v = F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long"))
    # Rows are told apart by a number of their own, which must not change: the table is written once.
    return checkpointed(named.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.size("x").alias("dims"), v.alias("v")))


def planes(v: np.ndarray) -> tuple[int, np.ndarray]:
    """(m, bits): v = sum of 2^j * bits[j] for j < m, less 2^m * bits[m], for rows of whole numbers."""
    m = max(int(v.max(initial=0)).bit_length(), int(-(v.min(initial=0) + 1)).bit_length(), 1)
    return m, np.stack([(v >> min(j, 63)) & 1 for j in range(m + 1)]).astype(bool)


def _number_type(dims: int, largest: int, m: int):
    """The fastest type in which all sums are exact."""
    most = max(dims, 1) * max(largest, 1) << (m + 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _kth(groups: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n groups, the smallest number for smaller groups."""
    order = np.lexsort((-values, groups))
    g = groups[order]
    starts = np.searchsorted(g, np.arange(n))
    at = starts + k - 1
    out = np.full(n, -np.inf)
    full = (at < len(g)) & (np.searchsorted(g, np.arange(n), side="right") > at)
    out[full] = values[order][at[full]]
    return out


def search(a: np.ndarray, v: np.ndarray, eligible: np.ndarray, least: np.ndarray, most: np.ndarray, floor: np.ndarray, best: int = BEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the eligible pairs that may be among the best `best` of some window of their anchor.

    least, most: windows of scores, anchors x windows, as longs; floor: scores below which a window has enough already.
    """
    m, bits = planes(v)
    kind = _number_type(a.shape[1], int(np.abs(a).max(initial=0)), m)
    weights, windows = a.astype(kind), range(least.shape[1])
    # Where sums are floats they are below 2^53, so bounds cut there are exact too.
    least, most, floor = (x.astype(object) if kind is object else np.clip(x, -(1 << 53), 1 << 53).astype(np.float64) for x in (least, most, floor))
    up, down = np.maximum(weights, 0).sum(axis=1), np.minimum(weights, 0).sum(axis=1)
    lowest, highest = np.maximum(least, floor).min(axis=1), most.max(axis=1)
    part = (weights @ bits[m].T.astype(kind)) * -(1 << m)
    alive, j = eligible & (lowest <= highest)[:, None], m
    while j > 0 and alive.sum() > FEW * alive.size:
        j -= 1
        part = part + (weights @ bits[j].T.astype(kind)) * (1 << j)
        rest = (1 << j) - 1
        # An interval is [part + rest * down, part + rest * up]: compared on the anchor's side, without matrices of bounds.
        alive &= (part >= (lowest - rest * up)[:, None]) & (part <= (highest - rest * down)[:, None])
    rows, cols = np.nonzero(alive)
    score = part[rows, cols]
    while j > 0:
        j -= 1
        score = score + np.concatenate([_added(weights, bits[j], rows[i : i + PAIRS], cols[i : i + PAIRS]) for i in range(0, len(rows), PAIRS)] or [score]) * (1 << j)
        rest = (1 << j) - 1
        low, high = score + rest * down[rows], score + rest * up[rows]
        wanted = np.zeros(len(rows), bool)
        for w in windows:
            inside = (low >= least[rows, w]) & (high <= most[rows, w])
            enough = floor[:, w] if kind is object else np.maximum(floor[:, w], _kth(rows[inside], low[inside], len(a), best))
            wanted |= (high >= np.maximum(least[:, w], enough)[rows]) & (low <= most[rows, w])
        rows, cols, score = rows[wanted], cols[wanted], score[wanted]
    return rows, cols, _longs(score)


def _added(weights: np.ndarray, plane: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return (weights[rows] * plane[cols]).sum(axis=1)


def _longs(score: np.ndarray) -> np.ndarray:
    if score.dtype == object and len(score) and (max(score) > _HIGH or min(score) < _LOW):
        raise OverflowError("a score of these vectors is no long")
    return score.astype(np.int64)


class _Best:
    """The best scores of each window of each anchor so far: higher first, then smaller ids, null ids last."""

    def __init__(self, n: int, windows: int, best: int):
        self.n, self.windows, self.best = n, windows, best
        self.group, self.score, self.ids, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.floor = np.full((n, windows), _LOW)

    def add(self, anchors, scores, ids, null, least, most) -> None:
        for w in range(self.windows):
            fit = (scores >= least[anchors, w]) & (scores <= most[anchors, w])
            self.group = np.concatenate([self.group, anchors[fit] * self.windows + w])
            self.score, self.ids, self.null = (np.concatenate([old, new[fit]]) for old, new in ((self.score, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((self.ids, self.null, -self.score, self.group))
        group = self.group[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        kept = order[nth < self.best]
        self.group, self.score, self.ids, self.null = self.group[kept], self.score[kept], self.ids[kept], self.null[kept]
        last = group[nth == self.best - 1]
        self.floor.reshape(-1)[last] = self.score[np.searchsorted(self.group, last, side="right") - 1]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dims)


class _Cell:
    """A block of anchors and what was found for them in a block of rows."""

    def __init__(self, key: tuple, best: int, same: bool):
        self.key, self.best, self.same, self.anchors = key, best, same, []

    def begin(self) -> None:
        table = pa.Table.from_batches(self.anchors).combine_chunks()
        self.uid, self.ids, self.label = (table.column(c).combine_chunks() for c in ("uid", "vec_id", "label"))
        self.v = _vectors(table.column("v").combine_chunks(), self.key[1])
        self.uid, self.label = self.uid.to_numpy(), self.label.to_numpy()
        scores = table.column("scores").to_pylist()
        windows = 1 if self.same else max(map(len, scores), default=1)
        self.least, self.most = np.full((len(self.v), windows), _LOW), np.full((len(self.v), windows), _HIGH)
        if not self.same:
            # No score lies in the window of a negative positive.
            none = (_HIGH, _LOW)
            bounds = [[(-(-LEAST * p // 100), MOST * p // 100) if p >= 0 else none for p in own] + [none] * (windows - len(own)) for own in scores]
            self.least, self.most = (np.array([[b[i] for b in own] for own in bounds], np.int64).reshape(-1, windows) for i in (0, 1))
        self.found = [_Best(len(self.v[i : i + SUB_ANCHORS]), windows, self.best) for i in range(0, len(self.v), SUB_ANCHORS)]

    def meet(self, rows: pa.RecordBatch) -> None:
        uid, label = rows.column("uid").to_numpy(), rows.column("label").to_numpy()
        ids, null = rows.column("vec_id").fill_null(0).to_numpy(), rows.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        v = _vectors(rows.column("v"), self.key[1])
        for i, found in enumerate(self.found):
            own = slice(i * SUB_ANCHORS, i * SUB_ANCHORS + found.n)
            alike = self.label[own, None] == label[None, :]
            eligible = alike & (self.uid[own, None] != uid[None, :]) if self.same else ~alike
            least, most = self.least[own], self.most[own]
            anchors, at, scores = search(self.v[own], v, eligible, least, most, found.floor, self.best)
            found.add(anchors, scores, ids[at], null[at], least, most)

    def result(self) -> pa.RecordBatch:
        anchor = np.concatenate([f.group // f.windows + i * SUB_ANCHORS for i, f in enumerate(self.found)])
        window = np.concatenate([f.group % f.windows for f in self.found])
        ids, null, score = (np.concatenate([getattr(f, k) for f in self.found]) for k in ("ids", "null", "score"))
        columns = [pa.array(self.uid[anchor]), self.ids.take(pa.array(anchor)), pa.array(window.astype(np.int32)), pa.array(ids, mask=null), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["uid", "anchor_id", "window", "other_id", "score"])


def grid(anchors: DataFrame, rows: DataFrame, same: bool, best: int) -> DataFrame:
    """(uid, anchor_id, window, other_id, score): the best of each anchor and window in each cell. anchors: as rows, with scores (array of long)."""
    spark = rows.sparkSession
    n = partitions(spark)
    size = rows.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    width = max(64, ANCHOR_BYTES // (8 * max(size["dims"] or 1, 1)))
    across, down = -(-max(anchors.count(), 1) // width), max(n, -(-size["n"] // BLOCK_ROWS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    mine = lambda k: F.pmod(F.xxhash64("uid"), F.lit(k)).cast("int")
    left = anchors.withColumns({"a": mine(across), "kind": F.lit(0)}).withColumn("b", every(down))
    right = rows.withColumns({"b": mine(down), "kind": F.lit(1), "scores": F.lit(None).cast("array<bigint>")}).withColumn("a", every(across))
    cells = left.unionByName(right).withColumn("cell", F.col("a").cast("long") * down + F.col("b"))
    cells = cells.select("cell", "dims", "kind", "uid", "vec_id", "label", "v", "scores")
    dealt = cells.repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("cell", "dims", "kind")

    def made(batches):
        tidy()
        cell = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            bounds = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]]).astype(int)
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                key, run = tuple(int(k) for k in keys[:2, start]), batch.slice(start, stop - start)
                if cell is None or cell.key != key:
                    if cell is not None and cell.anchors and hasattr(cell, "found"):
                        yield cell.result()
                    cell = _Cell(key, best, same)
                if keys[2, start] == 0:
                    cell.anchors.append(run)
                elif cell.anchors:
                    if not hasattr(cell, "found"):
                        cell.begin()
                    for i in range(0, run.num_rows, SUB):
                        cell.meet(run.slice(i, SUB))
        if cell is not None and cell.anchors and hasattr(cell, "found"):
            yield cell.result()

    return dealt.mapInArrow(made, "uid long, anchor_id long, window int, other_id long, score long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    """The best of all cells, with their rank."""
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", best: int = BEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor is a condition on vec_id."""
    table = components(rows, vector, label, vec_id)
    anchors = table.filter(is_anchor)
    positives = checkpointed(_ranked(grid(anchors.withColumn("scores", F.array().cast("array<bigint>")), table, True, best), best))
    scores = positives.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    found = _ranked(grid(checkpointed(anchors.join(scores, "uid")), table, False, best), best)
    own = positives.select("uid", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(own, ["uid", "window"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


ORACLE_OP12 = f"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, other_id NULLS LAST) AS nth FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.uid, p.nth ORDER BY s.score DESC, s.other_id NULLS LAST) AS rank
  FROM p JOIN s ON p.uid = s.uid AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score WHERE p.nth <= {BEST}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {BEST}
"""
