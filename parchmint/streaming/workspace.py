"""A document's workspace folded from stage events: per stage its last status and error, last detail and data that aren't empty.

A stage that is pending or running when a later stage's event came after its own last is complete, with the detail CAUGHT_UP. A document is
completed once its risk stage was; else failed while a stage's last event is an error. The order of events is (ts, seq), so events
that are shuffled, late or repeated give the same workspace, in a batch as in the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parchmint.dims import STAGES

CAUGHT_UP = "Completed successfully"
OPEN = ("pending", "running")
#: Before its first event, the first stage counts as running, others as pending.
AT_FIRST = dict.fromkeys(STAGES, "pending") | {STAGES[0]: "running"}
SCHEMA = "client_id {0}, stages array<struct<stage:string,status:string,detail:string,data:string,error:string>>, document_status string, expired boolean"
_STATE = "status string, error string, at long, seq long, detail string, detail_at long, detail_seq long, data string, data_at long, data_seq long"


def fold(events: DataFrame) -> DataFrame:
    """(client_id, stages, document_status): one aggregate per client with partial sums, so that a hot client isn't gathered."""
    order, blank = F.struct("ts", "seq"), lambda c: F.nullif(F.col(c), F.lit(""))

    def last(value: Column, of: Column) -> Column:
        return F.max_by(F.when(of, value), F.when(of, order))

    sums = []
    for s in STAGES:
        own = F.col("stage") == s
        sums += [
            last(F.struct("status", blank("error").alias("error")), own).alias(s), F.max(F.when(own, order)).alias(f"{s}_at"),
            last(blank("detail"), own & blank("detail").isNotNull()).alias(f"{s}_detail"), last(blank("data"), own & blank("data").isNotNull()).alias(f"{s}_data"),
        ]
    done = F.bool_or((F.col("stage") == "risk") & (F.col("status") == "complete")).alias("done")
    rows = events.groupBy("client_id").agg(*sums, done)

    def stage(i: int, s: str) -> Column:
        later = [F.coalesce(F.col(f"{t}_at") > F.col(f"{s}_at"), F.col(f"{t}_at").isNotNull()) for t in STAGES[i + 1 :]]
        passed = F.coalesce(F.greatest(*(x.cast("int") for x in (*later, F.lit(False), F.lit(False)))), F.lit(0)) == 1
        status = F.coalesce(F.col(f"{s}.status"), F.lit(AT_FIRST[s]))
        up = passed & status.isin(*OPEN)
        return F.struct(
            F.lit(s).alias("stage"), F.when(up, "complete").otherwise(status).alias("status"), F.when(up, CAUGHT_UP).otherwise(F.col(f"{s}_detail")).alias("detail"),
            F.col(f"{s}_data").alias("data"), F.col(f"{s}.error").alias("error"),
        )

    rows = rows.select("client_id", "done", F.array(*(stage(i, s) for i, s in enumerate(STAGES))).alias("stages"))
    failed = F.exists("stages", lambda x: x["status"] == "error")
    return rows.select("client_id", "stages", F.when(F.col("done"), "completed").when(failed, "failed").otherwise("processing").alias("document_status"))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


class WorkspaceState(StatefulProcessor):
    """One client's workspace as state: a row per stage, whether risk was complete, and one timer for its end.

    A finished document (risk complete and the last stage ended) leaves the state `keep` after its last event, any other after
    `idle`, in event time; the last row that it gives has expired = true. An event that comes after that begins anew.
    """

    def __init__(self, keep: timedelta, idle: timedelta):
        self.keep, self.idle = (int(t.total_seconds() * 1000) for t in (keep, idle))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", _STATE)
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = {k[0]: list(v) for k, v in self.stages.iterator()}
        done = bool(self.done.exists() and self.done.get()[0])
        for r in rows:
            done = done or (r.stage == "risk" and r.status == "complete")
            if r.stage not in STAGES:
                continue
            own, at = held.setdefault(r.stage, [None] * 10), (r.at, r.seq)
            if own[2] is None or at >= (own[2], own[3]):
                own[:4] = [r.status, r.error or None, *at]
            for i, value in ((4, r.detail), (7, r.data)):
                if value and (own[i + 1] is None or at >= (own[i + 1], own[i + 2])):
                    own[i : i + 3] = [value, *at]
        for stage, own in held.items():
            self.stages.updateValue((stage,), tuple(own))
        self.done.update((done,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        shown, last = self._shown(held), max((own[2] for own in held.values()), default=None)
        if last is not None:
            ended = done and shown[-1]["status"] in ("complete", "error")
            self.handle.registerTimer(last // 1000 + (self.keep if ended else self.idle))
        yield self._row(key, shown, done, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        held, done = {k[0]: list(v) for k, v in self.stages.iterator()}, bool(self.done.exists() and self.done.get()[0])
        self.stages.clear()
        self.done.clear()
        yield self._row(key, self._shown(held), done, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _shown(held: dict) -> list[dict]:
        out, latest = [], None
        for s in reversed(STAGES):
            own = held.get(s)
            status, at = (own[0], (own[2], own[3])) if own else (AT_FIRST[s], None)
            up = status in OPEN and latest is not None and (at is None or latest > at)
            out.append({"stage": s, "status": "complete" if up else status, "detail": CAUGHT_UP if up else own and own[4], "data": own and own[7], "error": own and own[1]})
            if at is not None:
                latest = at if latest is None else max(latest, at)
        return out[::-1]

    @staticmethod
    def _row(key, shown: list[dict], done: bool, expired: bool) -> Row:
        status = "completed" if done else "failed" if any(s["status"] == "error" for s in shown) else "processing"
        return Row(client_id=key[0], stages=[Row(**s) for s in shown], document_status=status, expired=expired)


def stream(events: DataFrame, lateness: str = "10 minutes", keep: timedelta = timedelta(hours=1), idle: timedelta = timedelta(days=7)) -> DataFrame:
    """The workspaces that changed in each batch of a stream of events (as streaming.stages.EVENTS), in update mode.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Events later than `lateness` are dropped.
    """
    kind = events.schema["client_id"].dataType.simpleString()
    timed = events.withWatermark("ts", lateness).withColumn("at", _micros("ts"))
    return timed.groupBy("client_id").transformWithState(WorkspaceState(keep, idle), SCHEMA.format(kind), "Update", "EventTime")


def runs(events: DataFrame) -> DataFrame:
    """(client_id, stage, run, outcome, seconds): each `running` paired with the end that follows it, as a stage may run again.

    A run whose next event is another `running` was given up (outcome restarted), one without a next event is running; both have no seconds.
    """
    order = Window.partitionBy("client_id", "stage").orderBy("ts", "seq")
    rows = events.withColumns({"next": F.lead("status").over(order), "ended": F.lead("ts").over(order), "run": F.count_if(F.col("status") == "running").over(order)})
    rows = rows.filter("status = 'running'")
    outcome = F.when(F.col("next") == "running", "restarted").when(F.col("next").isNull(), "running").otherwise(F.col("next"))
    seconds = F.when(F.col("next").isin("complete", "error"), (_micros("ended") - _micros("ts")) / 1e6)
    return rows.select("client_id", "stage", "run", outcome.alias("outcome"), seconds.alias("seconds"))
