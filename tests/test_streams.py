"""Streams: restarts, timers, markers, and what compaction writes."""

import datetime as dt
import json

import pytest

from quarry.streaming import ledger as L
from quarry.streaming import pipes
from quarry.streaming import shards as SH

EVENTS = "run long, seq long, kind string, units array<string>, at timestamp"


def at(seconds):
    return dt.datetime.fromtimestamp(1_700_000_000 + seconds, dt.timezone.utc).replace(tzinfo=None)


def replayed(spark, tmp_path, lots, keep_ms):
    """Each lot of events is a file; the stream is stopped after each and begun again."""
    for rows in lots:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
        pipes.drain(L.replay_stream(stream, most=2, keep_ms=keep_ms), f"{tmp_path}/out", f"{tmp_path}/cp")
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))


def test_staged_batches_expire_by_event_and_by_timer(spark, tmp_path):
    lots = [
        [(1, 0, "stage", ["a", "b"], at(0)), (2, 0, "stage", ["x"], at(0)), (3, 0, "stage", ["p"], at(5))],
        [(1, 1, "commit", ["a"], at(8)), (2, 1, "stage", ["y"], at(30)), (3, 1, "commit", ["p"], at(12))],
        [(2, 2, "commit", ["y"], at(31)), (9, 0, "stage", ["z"], at(40))],
        [(9, 1, "commit", [], at(1000))],
    ]
    got = replayed(spark, tmp_path, lots, keep_ms=10_000)
    assert got == [
        (1, 1, "a", "committed", ""),
        (1, 1, "b", "rejected", L.UNSELECTED),
        (2, 1, "x", "rejected", "expired"),  # by its next event, which comes too late
        (2, 2, "y", "committed", ""),
        (3, 1, "p", "committed", ""),
        (9, 1, "z", "rejected", "expired"),  # the same, as one run's own event comes before its timer
    ]


def test_a_timer_needs_no_event_of_its_run(spark, tmp_path):
    lots = [[(1, 4, "stage", ["a", "a", "b"], at(0))], [(2, 0, "commit", [], at(100))]]
    assert replayed(spark, tmp_path, lots, keep_ms=10_000) == [(1, 5, "a", "rejected", "expired"), (1, 5, "b", "rejected", "expired")]


def shard(folder, name, rows, ready=True):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))
    if ready:
        SH.mark(str(folder), name + SH.READY)


def test_only_ready_shards_are_read_and_only_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "id long, text string"
    shard(src, "a.jsonl", [{"id": i, "text": "é" * i} for i in range(5)])
    shard(src, "b.jsonl", [{"id": 10, "text": None}], ready=False)
    drain = lambda: pipes.drain(SH.ready(spark, str(src), schema), out, cp)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    drain()
    assert ids() == [0, 1, 2, 3, 4]
    shard(src, "c.jsonl", [{"id": 20}])
    drain()
    drain()
    assert ids() == [0, 1, 2, 3, 4, 20]
    SH.mark(str(src), "b.jsonl" + SH.READY)
    SH.mark(str(src), SH.DONE)
    got = SH.watch(spark, str(src), schema, lambda d: d, out, cp, pause=0.1)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4, 10, 20]


def test_a_producer_that_gives_up_and_a_damaged_line_are_errors(spark, tmp_path):
    src = tmp_path / "in"
    shard(src, "a.jsonl", [{"id": 1}])
    SH.mark(str(src), SH.FAIL)
    with pytest.raises(Exception, match="given up"):
        SH.watch(spark, str(src), "id long", lambda d: d, f"{tmp_path}/out", f"{tmp_path}/cp")
    other = tmp_path / "other"
    shard(other, "b.jsonl", [{"id": 1}])
    (other / "b.jsonl").write_text('{"id": 1}\n{"id"')
    with pytest.raises(Exception, match="b.jsonl, line 2"):
        pipes.drain(SH.ready(spark, str(other), "id long"), f"{tmp_path}/out2", f"{tmp_path}/cp2")


LOG = "jkey string, ts timestamp, event_id long, failed boolean, grade int"


def test_compaction_rewrites_a_record_once_a_tier(spark, tmp_path):
    from quarry.operators.judging import latest

    out, batches = str(tmp_path / "runs"), 20
    log = spark.createDataFrame([(f"k{i % 37}-{i // 10 if i % 2 else 0}", at(i), i, i % 11 == 0, i % 4) for i in range(10 * batches)], LOG)
    written = 0
    for n in range(batches):
        pipes.add_run(spark, out, n, log.filter(f"event_id >= {10 * n} AND event_id < {10 * n + 10}"), latest)
        last, runs = pipes.live_runs(spark, out)
        assert last == n and all(sum(r[1] == t for r in runs) < pipes.FAN for t in range(5))
        written += sum(r[2] for r in runs if r[0] == n) if n % pipes.FAN == pipes.FAN - 1 else next(r[2] for r in runs if r[0] == n)
    key = lambda d: sorted(map(str, d.select(*log.columns).collect()))
    assert key(pipes.merged(spark, out, LOG, latest)) == key(latest(log))
    assert written <= 3 * 10 * batches  # a snapshot a batch would have written half of them again and again
    before = key(pipes.merged(spark, out, LOG, latest))
    pipes.add_run(spark, out, batches - 1, log.limit(3), latest)  # the last batch once more, as after a failure
    assert key(pipes.merged(spark, out, LOG, latest)) == before
    assert len(pipes.folders(spark, f"{out}/manifest")) <= 2


def test_a_restart_without_new_files(spark, tmp_path):
    log = spark.createDataFrame([("a", at(1), 1, False, 2), ("a", at(2), 2, True, None), ("b", at(3), 3, False, 1)], LOG)
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda: sorted((r["jkey"], r["grade"]) for r in pipes.compact_log(spark, f"{tmp_path}/in", log.schema, f"{tmp_path}/out", f"{tmp_path}/cp", files=1).collect())
    assert run() == [("a", 2), ("b", 1)]
    assert run() == [("a", 2), ("b", 1)]
    spark.createDataFrame([("b", at(9), 9, False, 3)], LOG).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [("a", 2), ("b", 3)]


def test_a_run_asks_its_state_twice_a_batch():
    from types import SimpleNamespace as N

    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

    keeper = L.Keeper(3, None)
    keeper.init(N(getValueState=lambda *a: Value()))
    out = []
    for lot in (range(0, 200), range(200, 400)):
        events = [N(seq=i, kind="commit" if i % 2 else "stage", units=[f"u{i // 2}", f"u{i // 4}"]) for i in lot]
        out += keeper.handleInputRows((1,), iter(events[::-1]), None)
    assert calls == ["get", "update"] * 2  # each unit was a call of a map state before
    ledger = L.Ledger(3)
    want = [r for i in range(400) for r in ledger.apply(i, "commit" if i % 2 else "stage", [f"u{i // 2}", f"u{i // 4}"])]
    assert [tuple(r) for r in out] == [(1, *r) for r in want] and any(r.outcome == "duplicate" for r in out)
