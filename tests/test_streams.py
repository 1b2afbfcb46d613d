"""Streams over several micro-batches against their batch twins."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.expand import expand_with
from tallyspark.plans.bindings import BOUND_RULES
from tallyspark.sources import snapshots
from tallyspark.streaming import deadlines, live, monitors, runs

CHANGES = "boq_item_id long, total double, rate double, material_name string, ts timestamp, event_id long"
OBJECTS = "id long, project_id long, drawing_id long, object_type string, label string, quantity_estimate double"
LOG = "key long, event_id long, failed boolean, ts timestamp"


def at(spark, rows, schema):
    """Rows whose `ts` is given in seconds from a day on."""
    plain = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long"))
    return plain.withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_006_400)) if "ts" in plain.columns else plain


def files(spark, tmp_path, batches, schema):
    """One file per batch, in order of time, read one file per micro-batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        at(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"b{i}"))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        target = folder / f"{i:03d}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    schema_of = at(spark, batches[0], schema).schema
    return runs.read_stream(spark, str(folder), schema_of, files_per_batch=1)


def test_live_lines_over_batches(spark, tmp_path):
    batches = [
        [(1, 10.0, None, None, 1, 1), (2, None, 5.0, "A", 2, 2)],
        [(1, None, 7.0, None, 5, 3), (1, 12.0, None, None, 4, 4)],
        [(2, None, None, "B", 3, 5), (9, 1.0, None, None, 9, 6)],
    ]
    stream = live.last_values(files(spark, tmp_path, batches, CHANGES))
    sent = runs.drained(stream, "t-live", ["boq_item_id"])
    twin = live.last_values(at(spark, [r for b in batches for r in b], CHANGES))
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, twin.collect()))
    lines = spark.createDataFrame(
        [(1, 1, 100.0, 1.0, "x"), (2, 1, 50.0, 2.0, "y"), (3, 2, 5.0, 3.0, None)],
        "id long, project_id long, total double, rate double, material_name string",
    )
    merged = live.live_lines(lines, sent)
    assert [tuple(r) for r in merged.orderBy("id").collect()] == [
        (1, 1, 12.0, 7.0, "x"), (2, 1, 50.0, 5.0, "B"), (3, 2, 5.0, 3.0, None),
    ]
    assert {r["project_id"]: r["total"] for r in live.live_totals(merged).collect()} == {1: 62.0, 2: 5.0}


def test_live_totals_over_batches(spark, tmp_path):
    batches = [[(1, 10.0, None, None, 1, 1)], [(2, None, 5.0, "A", 2, 2)], [(1, 30.0, None, None, 3, 3), (3, 7.0, None, None, 4, 4)]]
    lines = spark.createDataFrame(
        [(1, 1, 100.0, 1.0, "x"), (2, 1, 50.0, 2.0, "y"), (3, 2, 5.0, 3.0, None), (4, 3, 8.0, 1.0, None)],
        "id long, project_id long, total double, rate double, material_name string",
    )
    handle, path = live.total_batches(lines, "t")
    runs.drain(live.last_values(files(spark, tmp_path, batches, CHANGES)), "t-totals", "update", handle)
    got = {r["project_id"]: r["total"] for r in live.current_totals(lines, path).collect()}
    assert got == {1: 80.0, 2: 7.0, 3: 8.0}
    written = spark.read.parquet(f"{path}/totals").groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in written} == {0: 1, 1: 1, 2: 2}


def test_batches_read_only_what_they_touch(spark, tmp_path, monkeypatch):
    """Over many batches the pieces read stay as many as the buckets touched, and the totals stay right."""
    lines = spark.range(200).select("id", (F.col("id") % 10).alias("project_id"), F.lit(1.0).alias("total"), F.lit(1.0).alias("rate"), F.lit("x").alias("material_name"))
    handle, root = live.total_batches(lines, "many", rows_per_bucket=25, keep=2)
    pieces = []
    real = snapshots._read
    monkeypatch.setattr(snapshots, "_read", lambda s, r, n, t, w=None: (pieces.append(sum(len(t.folders.get(b, ())) for b in w or ())), real(s, r, n, t, w))[1])
    for i in range(12):
        batch = spark.createDataFrame([(7, float(i), None, None), (8, None, 2.0, None), (999, 5.0, None, None)], "boq_item_id long, total double, rate double, material_name string")
        handle(batch, i)
        if i == 5:
            handle(batch, i)  # replayed
    assert len(pieces) == 13 * 4 and max(pieces) <= 3
    assert {r["project_id"]: r["total"] for r in live.current_totals(lines, root).collect()} == {p: 30.0 if p == 7 else 20.0 for p in range(10)}
    assert len(snapshots.versions(spark, root)) <= 5
    again, same = live.total_batches(lines, "many", root)
    again(spark.createDataFrame([(7, 1.0, None, None)], batch.schema), 12)
    assert same == root and live.current_totals(lines, root).where("project_id = 7").first()["total"] == 20.0


def test_reexpansion_replaces_drawings(spark, tmp_path):
    batches = [
        [(1, 1, 10, "LARGE", "a", 1.0), (2, 1, 11, "PROMO", "b", 1.0), (3, 2, 20, "MEDIUM", "c", 1.0)],
        [(4, 1, 10, "MEDIUM", "d", 1.0), (5, 1, 11, "SMALL", "no rule", 1.0)],
    ]
    stream = files(spark, tmp_path, batches, OBJECTS)
    handle, path = live.expand_batches(spark, lambda b: expand_with(b, BOUND_RULES), "t-expand")
    runs.drain(stream, "t-expand", "append", handle)
    schema = expand_with(spark.createDataFrame(batches[0], OBJECTS), BOUND_RULES).schema
    got = {(r["drawing_id"], r["trade"]) for r in live.current_lines(spark, path, schema).collect()}
    assert got == {(10, "Modular Furniture"), (20, "Modular Furniture")}


def test_failure_rates_over_batches(spark, tmp_path):
    rows = [[(1, i * 10 + b, i % 3 == 0, b * 100 + i * 20) for i in range(12)] for b in range(3)]
    stream = monitors.failure_rates(files(spark, tmp_path, rows, LOG))
    got = runs.drained(stream, "t-rates", ["window_start"])
    twin = monitors.failure_rates(at(spark, [r for b in rows for r in b], LOG))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def test_limits(spark):
    rows = at(spark, [(k, i, False, i * 7) for i in range(20) for k in (1, 2) if k == 1 or i < 3], LOG)
    got = {(r["key"], r["requests"]) for r in monitors.over_limit(rows, 4).collect()}
    assert {k for k, _ in got} == {1}
    assert monitors.over_limit(rows, 4, slide="10 seconds").count() > monitors.over_limit(rows, 4).count()


def test_uploads_once(spark, tmp_path):
    batches = [[("a", 1, "p"), ("b", 2, "q"), ("a", 3, "r"), ("a", 3, "s")], [("b", 10, "t"), ("c", 11, "u")]]
    stream = files(spark, tmp_path, batches, "sha256 string, ts timestamp, path string")
    got = runs.appended(monitors.first_uploads(stream), "t-uploads")
    assert sorted(r["sha256"] for r in got.collect()) == ["a", "b", "c"]


def test_uploads_once_however_far_apart(spark):
    """Repeats of any age are found in the store; a replayed batch adds nothing; appended pieces are merged."""
    schema = "sha256 string, ts timestamp, path string"
    batches = [[("a", 9, "p"), ("a", 9, "o"), ("b", 2, "q"), (None, 1, "n")], [("b", 10**7, "t"), ("c", 11, "u")], [("a", 1, "z"), (None, 5, "m")], [("d", 3, "v")], []]
    handle, root = monitors.upload_batches(spark, at(spark, batches[0], schema).schema, "t", rows_per_bucket=2, pieces=1)
    for i, rows in enumerate(batches):
        frame = at(spark, rows, schema)
        handle(frame, i)
        handle(frame, i)
    kept = {r["sha256"]: r["path"] for r in snapshots.read(spark, root, "uploads").collect()}
    assert kept == {"a": "o", "b": "q", None: "n", "c": "u", "d": "v"}
    table = snapshots.manifest(spark, root)[1]["uploads"]
    assert table.buckets > 1 and max(map(len, table.folders.values())) == 1
    assert snapshots.read(spark, root, "uploads").count() == 5


FAILURES = "FFSFFFFSFSFFF"


def test_breaker(spark, tmp_path):
    """Runs of four and three failures open the breaker, also across micro-batches."""
    rows = [(7, i, c == "F", i * 10) for i, c in enumerate(FAILURES)] + [(8, 100, True, 5), (8, 101, True, 6)]
    found = deadlines.failure_runs(at(spark, rows, LOG), block_seconds=25).orderBy("opened").collect()
    assert [(r["key"], r["failures"], r["opened"].second + 60 * r["opened"].minute) for r in found] == [(7, 4, 50), (7, 3, 120)]
    assert (found[0]["closes"] - found[0]["opened"]).total_seconds() == 30
    runs.use_rocksdb(spark)
    end = [(-1, 0, False, 1_000_000)]
    stream = files(spark, tmp_path, [rows[:5], rows[5:11], rows[11:], end], LOG)
    opened, left = run_to_end(deadlines.breaker_stream(stream), tmp_path, "breaker")
    assert sorted(opened) == sorted((r["key"], r["opened"]) for r in found)
    assert left <= 1  # of the closing row


def run_to_end(stream, tmp_path, name):
    """All rows a stream appends, and the rows of state it keeps in the end."""
    out = str(tmp_path / f"out-{name}")
    query = runs.start(stream, runs.batch_writer(out), str(tmp_path / f"progress-{name}"), "append", availableNow=True)
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(out)
    return [tuple(r) for r in rows.select(*stream.columns).collect()], query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_late_rows_are_put_in_order(spark, tmp_path):
    """A success that comes a batch later, but lies between three failures, keeps the breaker shut; pauses end runs."""
    runs.use_rocksdb(spark)
    batches = [
        [(1, 1, True, 10), (1, 2, True, 20), (1, 4, True, 40), (2, 5, True, 10), (3, 8, True, 10), (3, 9, True, 20)],
        [(1, 3, False, 30), (2, 6, True, 20), (2, 7, True, 15), (1, 10, True, 50)],
        [(3, 11, True, 5000), (1, 12, True, 60), (1, 13, True, 60)],
        [(-1, 0, False, 100_000)],
    ]
    for least, pause in ((3, 1000.0), (2, 25.0)):
        stream = files(spark, tmp_path / str(least), batches, LOG) if (tmp_path / str(least)).mkdir() is None else None
        found, left = run_to_end(deadlines.breaker_stream(stream, least, "100 seconds", pause), tmp_path / str(least), "late")
        assert sorted((k, int(ts.timestamp()) % 100_000 - 6400 % 100_000) for k, ts in found) == sorted(
            (k, (1_700_006_400 + s) % 100_000 - 6400) for k, s in ([(1, 60), (2, 20)] if least == 3 else [(1, 20), (1, 50), (2, 15), (3, 20)])
        )
        assert left <= 1


def test_readiness_and_stuck_work_out_of_order(spark, tmp_path):
    runs.use_rocksdb(spark)
    reports = [
        [(1, "processed", 50), (2, "error", 500), (3, "detected", 20)],
        [(1, "uploaded", 0), (2, "uploaded", 0), (3, "error", 10), (4, "uploaded", 30)],
        [(1, "error", 5000), (-1, "x", 100_000)],
        [(-1, "y", 300_000)],
    ]
    stream = files(spark, tmp_path, reports, "drawing_id long, status string, ts timestamp")
    for forget, again in ((0.0, [(2, "error"), (1, "error")]), (50_000.0, [])):
        (tmp_path / str(forget)).mkdir()
        found, left = run_to_end(deadlines.readiness_stream(stream, 60.0, delay="1000 seconds", forget_seconds=forget), tmp_path / str(forget), "ready")
        want = [(1, "processed"), (2, "timeout"), (3, "error"), (4, "timeout"), *again]
        assert sorted(r for r in found if r[0] >= 0) == sorted(want)
        assert left <= 1
    (tmp_path / "stuck").mkdir()
    log = [
        [(1, 1, "STARTED", 0), (2, 2, "STARTED", 0), (1, 3, "STARTED", 900)],
        [(2, 4, "DONE", 200), (1, 5, "DONE", 1300), (3, 6, "STARTED", 1000), (3, 7, "DONE", 1300)],
        [(-1, 0, "x", 100_000)],
    ]
    stream = files(spark, tmp_path / "stuck", log, "key long, event_id long, status string, ts timestamp")
    found, left = run_to_end(deadlines.stuck_work_stream(stream, "STARTED", delay="2000 seconds"), tmp_path / "stuck", "stuck")
    assert sorted(found) == [(1, 1), (1, 3)] and left <= 1


def test_readiness(spark, tmp_path):
    budget = 60.0
    batches = [
        [(1, "uploaded", 0), (2, "pending", 0), (3, "uploaded", 0)],
        [(1, "processed", 30), (2, "processing", 40)],
        [(3, "error", 200), (4, "uploaded", 400)],
    ]
    schema = "drawing_id long, status string, ts timestamp"
    twin = deadlines.readiness(at(spark, [r for b in batches for r in b], schema), budget)
    assert {r["drawing_id"]: r["outcome"] for r in twin.collect()} == {1: "processed", 2: "timeout", 3: "timeout", 4: "timeout"}
    runs.use_rocksdb(spark)
    stream = deadlines.readiness_stream(files(spark, tmp_path, batches, schema), budget)
    got = {r["drawing_id"]: r["outcome"] for r in runs.appended(stream, "t-ready").collect()}
    # drawing 4 is still within its time when the stream ends
    assert got == {1: "processed", 2: "timeout", 3: "timeout"}
    assert deadlines.polling_budget() == pytest.approx(307.171875)


def test_stuck_work(spark, tmp_path):
    rows = [(1, 1, "STARTED", 0), (1, 2, "DONE", 100), (1, 3, "STARTED", 1000), (1, 4, "DONE", 1400), (2, 5, "STARTED", 7)]
    log = at(spark, rows, "key long, event_id long, status string, ts timestamp")
    for seconds in (50, None):
        found = deadlines.stuck_work(log, "STARTED", block_seconds=seconds).collect()
        assert sorted(r["event_id"] for r in found) == [3, 5]
    runs.use_rocksdb(spark)
    later = [(9, 6, "DONE", 5000)]
    stream = files(spark, tmp_path, [rows[:3], rows[3:4], rows[4:], later], "key long, event_id long, status string, ts timestamp")
    got = runs.appended(deadlines.stuck_work_stream(stream, "STARTED"), "t-stuck")
    # the entry of key 2 comes in behind the watermark and is dropped
    assert sorted(r["event_id"] for r in got.collect()) == [3]
