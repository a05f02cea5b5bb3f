"""Stream state against the batch fold, expiry, and a table of upserts with bounded reading."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from parchmint.dims import STAGES
from parchmint.streaming import stages, upserts, workspace

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(client, seq, stage, status, minute, **more):
    return {"client_id": client, "seq": seq, "ts": (START + timedelta(minutes=minute)).isoformat().replace("+00:00", "Z"), "stage": stage, "status": status} | more


def shown(row):
    return [tuple(s) for s in row.stages], row.document_status


def test_fold_by_hand(spark):
    rows = [
        event("a", 1, "ingestion", "running", 0, detail="reading"), event("a", 2, "ingestion", "complete", 1, data='{"pages": 2}'), event("a", 3, "classification", "running", 2, detail="typing"),
        event("a", 4, "extraction", "error", 3, error="bad"), event("a", 5, "crm", "complete", 9), event("b", 1, "risk", "complete", 0), event("b", 2, "anomaly", "running", 1), event("c", 1, "crm", "running", 1),
    ]
    frame = spark.read.schema(stages.EVENTS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = {r.client_id: shown(r) for r in workspace.fold(frame).collect()}
    up = workspace.CAUGHT_UP
    assert got["a"] == ([
        ("ingestion", "complete", "reading", '{"pages": 2}', None), ("classification", "complete", up, None, None), ("extraction", "error", None, None, "bad"),
        ("anomaly", "pending", None, None, None), ("risk", "pending", None, None, None), ("cross_document", "pending", None, None, None),
    ], "failed")
    # A stage that runs again after a later one has ended is running.
    assert [s[1] for s in got["b"][0]] == ["complete", "complete", "complete", "running", "complete", "pending"] and got["b"][1] == "completed"
    assert [s[1] for s in got["c"][0]] == ["running", *["pending"] * 5] and got["c"][1] == "processing"


def streamed(spark, folder, batches, **how):
    """The last row of each client after all batches, and the rows that expired."""
    source, out = folder / "events", []
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, rows in enumerate(batches):
            (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            query = workspace.stream(stages.read_events(spark, str(source)), **how).writeStream.outputMode("update")
            query.option("checkpointLocation", str(folder / "point")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return {r.client_id: r for r in out if not r.expired}, [r for r in out if r.expired]


def test_stream_equals_batch_on_shuffled_late_and_repeated_events(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for seq in range(rng.randrange(1, 25)):
            more = {k: rng.choice(["", None, f"{k} {seq}"]) for k in ("detail", "data", "error")}
            rows.append(event(f"c{c}", seq, rng.choice([*STAGES, "crm"]), rng.choice(["running", "complete", "error"]), rng.randrange(60), **more))
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    third = len(rows) // 3
    last, gone = streamed(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :]], lateness="2 hours")
    frame = spark.read.schema(stages.EVENTS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    assert not gone and {c: shown(r) for c, r in last.items()} == {r.client_id: shown(r) for r in workspace.fold(frame).collect()}


def test_finished_documents_leave_the_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    first = [event("a", 1, "risk", "complete", 0), event("a", 2, "cross_document", "complete", 1), event("b", 1, "ingestion", "running", 0)]
    later, last = [event("z", 1, "ingestion", "running", 200)], [event("a", 3, "risk", "running", 300), event("z", 2, "ingestion", "complete", 300)]
    rows, gone = streamed(spark, tmp_path, [first, later, last], lateness="1 minute", keep=timedelta(hours=1), idle=timedelta(days=1))
    assert [(r.client_id, r.document_status) for r in gone] == [("a", "completed")]
    # It began anew: what came before is out of the state.
    assert rows["a"].document_status == "processing" and rows["b"].document_status == "processing"


def test_upserts_read_a_bounded_number_of_folders(spark, tmp_path):
    path, want = str(tmp_path / "table"), {}
    rng = random.Random(6)
    for n in range(12):
        rows = [(f"k{rng.randrange(40)}", n * 100 + i, f"v{n}-{i}") for i in range(rng.choice([1, 5, 30]))]
        for k, version, value in rows:
            want[k] = (version, value, want.get(k, (0, 0, 0))[2] + 1)
        upserts.merge(spark.createDataFrame(rows, "content_hash string, created_at int, name string"), n, path, buckets=4)
        assert len(upserts.versions(spark, path)) <= upserts.KEPT
    got = upserts.current(spark, path)
    assert {r.content_hash: (r.created_at, r.name, r.n_versions) for r in got.collect()} == want
    assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) <= 4
    folders = [b for load in (tmp_path / "table" / "data").iterdir() for b in load.iterdir() if b.name.startswith("bucket=")]
    assert len(folders) <= 4 * upserts.KEPT


def test_a_batch_that_is_stopped_halfway_and_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    frame = lambda *rows: spark.createDataFrame(list(rows), "content_hash string, created_at int, name string")
    upserts.merge(frame(("a", 1, "x"), ("b", 1, "y")), 0, path, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(upserts, "tidy", lambda *a: None)
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        batch = upserts.current(spark, path).filter("content_hash = 'a'").select("content_hash", (F.col("created_at") + 1).alias("created_at"), F.lit("z").alias("name"))
        with pytest.raises(RuntimeError):
            upserts.merge(batch, 1, path, buckets=2)
    read = lambda: {(r.content_hash, r.created_at, r.name, r.n_versions) for r in upserts.current(spark, path).collect()}
    assert read() == {("a", 1, "x", 1), ("b", 1, "y", 1)}
    for _ in range(2):  # the second time it is committed already
        upserts.merge(frame(("a", 2, "z")), 1, path, buckets=2)
    assert read() == {("a", 2, "z", 2), ("b", 1, "y", 1)}
    # An older version that comes late changes nothing but the count; a new column is null in older rows.
    upserts.merge(spark.createDataFrame([("b", 0, "old", 7), ("c", 5, "new", 8)], "content_hash string, created_at int, name string, size int"), 2, path, buckets=2)
    assert {(r.content_hash, r.name, r.size, r.n_versions) for r in upserts.current(spark, path).collect()} == {("a", "z", None, 2), ("b", "y", None, 2), ("c", "new", 8, 1)}


def test_runs(spark):
    rows = [event("a", i, "risk", s, m) for i, (s, m) in enumerate([("running", 0), ("complete", 2), ("complete", 3), ("running", 5), ("running", 6), ("error", 9), ("running", 20)])]
    frame = spark.read.schema(stages.EVENTS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    assert [tuple(r)[2:] for r in workspace.runs(frame).orderBy("run").collect()] == [(1, "complete", 120.0), (2, "restarted", None), (3, "error", 180.0), (4, "running", None)]
