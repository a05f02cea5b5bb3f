"""13. Conversation structure repair: A* on the lattice of edits of a conversation's rows.

A node of the lattice is (rows read, state); the states are 0 nothing yet, 1 after a system row, 2 after a user's, 3 after an
assistant's. Edits are Keep, Rerole to the role that the state asks for, Delete (the only one for a blank or repeated row) and
Insert of an empty row. The heuristic is the suffix sum of what no path can avoid: deletions of blank and repeated rows, the charge
of truncated ones. It is consistent, so a node's first visit is its cheapest; with the audit (initials of the edits) as the second
key it is also the ASCII-least among the cheapest, as no audit of a node is a proper prefix of another of the same cost.

What is judged are light rows (no text: hashes, flags), with alike rows of a turn as one row with a number. They are ordered by
range partitions, so a conversation of a third of all rows is spread over many; a conversation that lies within one partition is
searched whole. Of one that doesn't, each piece of at most PIECE rows is searched from every state to every state, and pieces are
chained afterwards, in (min, +) over four states. Repeated rows are found by one aggregate over (conversation, role, hash), given
back by salt. The texts are shuffled once, to be walked along their audit in order: one task streams one conversation, as the
digest of a conversation is a chain, and holds a batch of it and its audit, which is one value of the result.

Defined results: a null text or role is one space, so such a row is blank, or has an initial that no state asks for. Rows are in order
of turn (nulls first), then role, then hash of the text; alike rows stand side by side. Rows with a null conv_id are one conversation. Turns are
longs; gaps wrap as longs do. Very long texts are hashed, and walked one batch at a time. Other columns are passed over. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm.common import checkpointed, partitions, read

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: State -> (initial that it asks for, state after it); the roles that edits give.
ASKS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
#: Rows of a piece of a conversation that spans partitions.
PIECE = 512
_WHITE = " \t\n\x0b\f\r"
_LEGAL = {"su", "ua", "au"}
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_PIECE_SCHEMA = (
    "pid int, seq int, whole boolean, n long, lo long, hi long, turns long, first_turn long, last_turn long, first string, last string,"
    " blank long, duplicate long, truncated long, illegal long, moves array<struct<start:int,end:int,cost:long,audit:string>>"
)


def a_star(rows: list[tuple[str, bool, bool]], start: int, ends: tuple[int, ...], every: bool = False) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} over rows (initial, must go, cut): of the best end, or with `every` of all of them."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] else CUT if rows[i][2] else 0)
    heap, seen, found = [(rest[0], "", 0, start)], set(), {}
    while heap:
        total, audit, i, state = heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        cost = total - rest[i]
        if i == len(rows) and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        asked, after = ASKS[state]
        heappush(heap, (total + INSERT, audit + "I", i, after))
        if i == len(rows):
            continue
        initial, gone, cut = rows[i]
        heappush(heap, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
        if not gone:
            cost += rest[i + 1] + CUT * cut
            if initial == asked:
                heappush(heap, (cost, audit + "K", i + 1, after))
            else:
                heappush(heap, (cost + REROLE, audit + "R", i + 1, after))
                if initial == "s" and state == 0:
                    heappush(heap, (cost, audit + "K", i + 1, 1))
    return found


def _named(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(c, t, r, body, copies, h1, h2) whatever the columns' names."""
    some = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    named = rows.select(F.col(conv_id).alias("c"), F.col(turn).cast("long").alias("t"), spaced(role).alias("r"), spaced(text).alias("body"), some.alias("copies"))
    return named.withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(1), "body")})


def faults(named: DataFrame) -> DataFrame:
    """Light rows (c, t, r, h1, h2, first, blank, cut, later, copies): later where role and text stand in an earlier turn."""
    bare = F.btrim("body", F.lit(_WHITE))
    light = named.select("c", "t", "r", "h1", "h2", "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy("c", "t", "r", "h1", "h2").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("copies").alias("copies"))
    salt = F.pmod(F.xxhash64("t"), F.lit(partitions(named.sparkSession))).cast("int")
    light = checkpointed(light.withColumn("salt", salt))
    often = light.filter("copies > 0 AND NOT blank").groupBy("c", "r", "h1", "h2").agg(
        F.count("*").alias("n"), F.min("t").alias("earliest"), F.bool_or(F.col("t").isNull()).alias("unnumbered"), F.collect_set("salt").alias("salts"),
    ).filter("n > 1")
    often = often.select(F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "earliest", "unnumbered", F.explode("salts").alias("salt2"))
    alike = F.col("c").eqNullSafe(F.col("c2")) & (F.col("r") == F.col("r2")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("salt") == F.col("salt2"))
    later = F.coalesce(F.col("t").isNotNull() & (F.col("unnumbered") | (F.col("t") > F.col("earliest"))), F.lit(False))
    return light.join(often, alike, "left").select("c", "t", "r", "h1", "h2", F.left("r", F.lit(1)).alias("first"), "blank", "cut", later.alias("later"), "copies")


class _Piece:
    """What is known of some rows of a conversation in order."""

    def __init__(self, c, seq: int, opens: bool):
        self.c, self.seq, self.opens, self.rows, self.turns, self.last_turn = c, seq, opens, [], [], None
        self.counts = dict.fromkeys(_COUNTS[:3], 0)

    def add(self, turn, first: str, kind: str | None) -> None:
        self.rows.append((first, kind in ("blank", "duplicate"), kind == "truncated"))
        if kind:
            self.counts[kind] += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, closes: bool) -> dict:
        whole = self.opens and closes
        if whole:
            moves = [(0, end, *best) for end, best in a_star(self.rows, 0, ENDS).items()]
        else:
            moves = [(start, end, *best) for start in ASKS for end, best in a_star(self.rows, start, tuple(ASKS), True).items()]
        firsts = [r[0] for r in self.rows]
        ends = self.turns or [None]
        return {
            "c": self.c, "seq": self.seq, "whole": whole, "n": len(self.rows), "lo": ends[0], "hi": ends[-1], "turns": len(self.turns), "first_turn": ends[0], "last_turn": ends[-1],
            "first": firsts[0] if firsts else None, "last": firsts[-1] if firsts else None, **self.counts, "illegal": sum(a + b not in _LEGAL for a, b in zip(firsts, firsts[1:], strict=False)),
            "moves": [dict(zip(("start", "end", "cost", "audit"), m, strict=True)) for m in moves],
        }


def pieces(light: DataFrame) -> DataFrame:
    """Pieces of conversations in order of their rows, (c, pid, seq, ...): one, whole, where its partition holds all of it."""
    c_type = light.schema["c"].dataType
    ordered = light.repartitionByRange(partitions(light.sparkSession), "c", "t", "r", "h1", "h2").sortWithinPartitions("c", "t", "r", "h1", "h2")
    ordered = ordered.select("c", "t", "first", "blank", "cut", "later", "copies", F.spark_partition_id().alias("pid"))
    schema = T.StructType().add("c", c_type)
    for field in T.StructType.fromDDL(_PIECE_SCHEMA):
        schema.add(field)

    def made(batches):
        piece, pid, seq, out = None, 0, 0, []
        fields = None
        for batch in batches:
            fields = fields or pa.schema([("c", batch.schema.field("c").type), *_arrow_piece()])
            for c, t, first, blank, cut, later, copies, pid in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if piece is None or piece.c != c:
                    if piece is not None:
                        out.append(piece.row(True) | {"pid": pid})
                    # The first conversation of a partition may have begun in the one before.
                    seq, piece = seq + 1, _Piece(c, seq, piece is not None)
                for nth in range(copies):
                    if len(piece.rows) == PIECE:
                        out.append(piece.row(False) | {"pid": pid})
                        seq, piece = seq + 1, _Piece(c, seq, False)
                    piece.add(t, first, "blank" if blank else "duplicate" if later or nth else "truncated" if cut else None)
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, fields)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.row(False) | {"pid": pid}], fields)

    return ordered.mapInArrow(made, schema)


def _arrow_piece() -> list[tuple[str, pa.DataType]]:
    """Fields of a piece after its conversation, as Arrow has them."""
    longs, text = pa.int64(), pa.string()
    move = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", longs), ("audit", text)])
    own = {"pid": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), "first": text, "last": text, "moves": pa.list_(move)}
    return [(f.split()[0], own.get(f.split()[0], longs)) for f in _PIECE_SCHEMA.split(" moves")[0].rstrip(",").split(",")] + [("moves", own["moves"])]


def chain(parts: list[dict]) -> dict:
    """A conversation's figures from its pieces in order."""
    best, turns, illegal, last, before = {0: (0, "")}, 0, 0, None, None
    lo = hi = None
    for p in parts:
        nxt = {}
        for m in p["moves"]:
            if m["start"] in best:
                cost, audit = best[m["start"]]
                made = (cost + m["cost"], audit + m["audit"])
                nxt[m["end"]] = min(nxt.get(m["end"], made), made)
        best = nxt
        if not p["n"]:
            continue
        illegal += p["illegal"] + (before is not None and before + p["first"] not in _LEGAL)
        before = p["last"]
        if p["turns"]:
            turns += p["turns"] - (last is not None and last == p["first_turn"])
            last = p["last_turn"]
            lo, hi = p["lo"] if lo is None else lo, p["hi"]
    cost, audit = min(best[e] for e in ENDS if e in best)
    gaps = 0 if lo is None else (hi - lo + 1 - turns + (1 << 63)) % (1 << 64) - (1 << 63)
    return {"gaps": gaps, **{k: sum(p[k] for p in parts) for k in _COUNTS[:3]}, "illegal": illegal, "cost": cost, "audit": audit}


def judge(named: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation, those without rows (copies 0) too."""
    found = checkpointed(pieces(faults(named)))
    whole = found.filter("whole").select("c", F.array(F.struct(*[f for f in found.columns if f != "c"])).alias("parts"))
    spanning = found.filter("NOT whole").groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*[f for f in found.columns if f != "c"]))).alias("parts"))
    schema = T.StructType().add("c", named.schema["c"].dataType)
    for name in ("gaps", *_COUNTS):
        schema.add(name, "long")
    schema.add("audit", "string")

    def made(batches):
        for batch in batches:
            rows = [chain(parts) for parts in batch.column(1).to_pylist()]
            columns = [batch.column(0)] + [pa.array([r[k] for r in rows], pa.int64()) for k in ("gaps", *_COUNTS)] + [pa.array([r["audit"] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["c", "gaps", *_COUNTS, "audit"])

    return whole.unionByName(spanning).mapInArrow(made, schema)


def _walks(named: DataFrame, judged: DataFrame) -> DataFrame:
    """Each conversation's verdict and then its rows in order, a conversation within a partition."""
    verdict = judged.select("c", F.lit(0).alias("kind"), F.struct(*[k for k in judged.columns if k != "c"]).alias("verdict"))
    rows = named.filter("copies > 0").withColumn("kind", F.lit(1))
    both = verdict.unionByName(rows, allowMissingColumns=True).select("c", "kind", "verdict", "t", "r", "h1", "h2", "body", "copies")
    return both.repartition(partitions(named.sparkSession), "c").sortWithinPartitions("c", "kind", "t", "r", "h1", "h2").select("c", "kind", "verdict", "t", "r", "body", "copies")


class _Walk:
    """Applies an audit to rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            asked, self.state = ASKS[self.state]
            self.at += 1
            yield ("I", None, ROLES[asked], "")

    def row(self, turn, role: str, text: str):
        """(edit, turn, role, text) of what the row becomes, inserted rows before it included."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        asked, after = ASKS[self.state]
        if edit == "K" and role[:1] == "s" and self.state == 0:
            self.state = 1
        else:
            self.state = after
        yield (edit, turn, ROLES[asked] if edit == "R" else role, text)


def repaired(named: DataFrame, judged: DataFrame) -> DataFrame:
    """(c, position, edit, turn, role, text): the rows of the repaired conversations, in order from 1."""
    schema = T.StructType().add("c", named.schema["c"].dataType)
    for name, kind in (("position", "long"), ("edit", "string"), ("turn", "long"), ("role", "string"), ("text", "string")):
        schema.add(name, kind)

    def made(batches):
        walk, c, n, kinds = None, None, 0, None
        for batch in batches:
            kinds, out = (batch.schema.field("c").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), []
            for own, kind, verdict, t, r, body, copies in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 0:
                    out += [(c, n + i, *x) for i, x in enumerate(walk.inserted(), 1)] if walk else []
                    walk, c, n = _Walk(verdict["audit"]), own, 0
                else:
                    for x in (x for _ in range(copies) for x in walk.row(t, r, body)):
                        n += 1
                        out.append((c, n, *x))
            yield from _listed(out, kinds)
        if walk:
            yield from _listed([(c, n + i, *x) for i, x in enumerate(walk.inserted(), 1)], kinds)

    def _listed(rows, kinds):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["c", "position", "edit", "turn", "role", "text"])

    return _walks(named, judged).mapInArrow(made, schema)


def digests(named: DataFrame, judged: DataFrame) -> DataFrame:
    """judged with repaired_sha256: the digest of the repaired `role:text`, joined by line ends."""
    schema = T.StructType([*judged.schema]).add("repaired_sha256", "string")
    names = [k for k in judged.columns if k != "c"]

    def made(batches):
        walk, head, digest, begun, kinds = None, None, None, False, None
        for batch in batches:
            kinds = [batch.schema.field("c").type, *(pa.string() if k == "audit" else pa.int64() for k in names), pa.string()]
            out = []
            for own, kind, verdict, _, r, body, copies in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 0:
                    if walk:
                        _feed(digest, walk.inserted(), begun)
                        out.append((*head, digest.hexdigest()))
                    walk, head, digest, begun = _Walk(verdict["audit"]), (own, *(verdict[k] for k in names)), hashlib.sha256(), False
                else:
                    for _ in range(copies):
                        begun = _feed(digest, walk.row(None, r, body), begun)
            yield from _batch(out, kinds)
        if walk:
            _feed(digest, walk.inserted(), begun)
            yield from _batch([(*head, digest.hexdigest())], kinds)

    def _feed(digest, rows, begun) -> bool:
        for _, _, role, text in rows:
            digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
            begun = True
        return begun

    def _batch(rows, kinds):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["c", *names, "repaired_sha256"])

    return _walks(named, judged).mapInArrow(made, schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts by conversation, rows of the repaired conversations). `copies` names a column with how often a row counts (0: not)."""
    named = _named(rows, conv_id, turn, role, text, copies)
    judged = checkpointed(judge(named))
    return judged.withColumnRenamed("c", conv_id), repaired(named, judged).withColumnRenamed("c", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32 of `conv_id:turn` modulo 20: n copies, empty texts, no ends of sentences, role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "conv_id", "turn", "role", "text", "copies")
    found = digests(named, checkpointed(judge(named)))
    return found.select(F.col("c").alias("conv_id"), "gaps", *_COUNTS[:4], "cost", "audit", "repaired_sha256")


def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}), 4294967295)"


def _oracle() -> str:
    """The best way into each state (cost, audit, lines) row by row; at most one insertion stands between two rows, as two are never cheapest."""
    add = lambda s, cost, edit, line: f"{{'k': {s}.k + {cost}, 'a': {s}.a || '{edit}', 't': {line}}}"
    said = lambda s, line: f"list_append({s}.t, {line})"
    # After an insertion or none: i0..i3 from s0..s3.
    ins = {
        "i0": "s0", "i1": "s1",
        "i2": "list_min([s2, " + ", ".join(add(s, INSERT, "I", said(s, "'user:'")) for s in ("s0", "s1", "s3")) + "])",
        "i3": "list_min([s3, " + add("s2", INSERT, "I", said("s2", "'assistant:'")) + "])",
    }
    far = "1000000000"
    keep = lambda s, ok: add(s, f"cut + CASE WHEN {ok} AND NOT gone THEN 0 ELSE {far} END", "K", said(s, "role || ':' || text"))
    rer = lambda s, name: add(s, f"{REROLE} + cut + CASE WHEN gone THEN {far} ELSE 0 END", "R", said(s, f"'{name}:' || text"))
    gone = lambda s: add(s, DELETE, "D", f"{s}.t")
    u, a = "left(role, 1) = 'u'", "left(role, 1) = 'a'"
    out = {
        "s0": gone("i0"), "s1": f"list_min([{gone('i1')}, {keep('i0', chr(39).join(('left(role, 1) = ', 's', '')))}])",
        "s2": "list_min([" + ", ".join([gone("i2"), *(keep(s, u) for s in ("i0", "i1", "i3")), *(rer(s, "user") for s in ("i0", "i1", "i3"))]) + "])",
        "s3": "list_min([" + ", ".join([gone("i3"), keep("i2", a), rer("i2", "assistant")]) + "])",
    }
    none = f"{{'k': CAST({far} AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}"
    begin = "{'k': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), placed AS (
  SELECT *, trim(text, {white}) AS bare, row_number() OVER w AS pos, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), judged AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END AS cut FROM faulty
), convs AS (SELECT DISTINCT conv_id FROM conversations), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {begin} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM convs
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{e} AS {s}" for s, e in out.items())}
  FROM (SELECT p.conv_id, j.pos, role, text, gone, cut, {", ".join(f"{e} AS {s}" for s, e in ins.items())} FROM paths p JOIN judged j ON j.conv_id = p.conv_id AND j.pos = p.pos + 1)
), last AS (
  SELECT conv_id, list_min([s0, s3, {add("s2", INSERT, "I", said("s2", "'assistant:'"))}]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM paths) WHERE back = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.k AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM last LEFT JOIN counts USING (conv_id)"""


ORACLE_OP13 = _oracle()
