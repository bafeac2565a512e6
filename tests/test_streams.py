"""Streams that stop and start again, timers, and tables of several writers."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tallyvine.sources import files, schemas
from tallyvine.streaming import work


def test_batches_are_appended_once_over_a_restart(spark, tmp_path):
    """A stream fails after a batch stands in the log and before its checkpoint says so; the restart replays the batch."""
    rows, log = tmp_path / "rows", str(tmp_path / "log")
    rows.mkdir()
    line = '{"id": "%d", "gen": %d, "error": %s}\n'
    (rows / "0.json").write_text("".join(line % (i, 0, '"e"' if i == 3 else "null") for i in range(5)))
    append = work.append_once(log, ["id", "gen"], "q")

    def breaks(batch, number):
        append(batch, number)
        raise RuntimeError("lost after the write")

    def run(each):
        stream = spark.readStream.schema(schemas.TRACE).option("maxFilesPerTrigger", 1).json(str(rows))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after the write"):
        run(breaks).awaitTermination()
    assert files.load_log(spark, log).count() == 5
    (rows / "1.json").write_text("".join(line % (i, 0, "null") for i in (2, 3, 3, 7)))
    run(append).awaitTermination()
    run(append).awaitTermination()  # nothing new
    found = files.load_log(spark, log)
    assert sorted((r.id, r.error or "") for r in found.collect()) == [("0", ""), ("1", ""), ("2", ""), ("3", ""), ("3", "e"), ("4", ""), ("7", "")]
    assert {r.batch for r in found.select("batch").distinct().collect()} == {"q-0", "q-1"}


def test_append_batch_takes_odd_rows(spark, tmp_path):
    """Null keys, repeated rows, a clashing column, an empty batch, a batch whose draft was left by a lost writer."""
    log = str(tmp_path / "log")
    kind = "id string, gen int, _key string"
    assert files.load_log(spark, log) is None
    assert files.append_batch(spark.createDataFrame([], kind), log, "a-0", ["id", "gen"]) and files.load_log(spark, log).count() == 0
    assert files.append_batch(spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), ("a", None, "y")], kind), log, "a-1", ["id", "gen"])
    spark.createDataFrame([("lost", 1, "z")], kind).write.parquet(f"{log}/_draft-lost")
    again = spark.createDataFrame([(None, 1, "x"), ("a", None, "y"), ("a", 1, "w"), (None, None, "v")], kind)
    assert files.append_batch(again, log, "b-0", ["id", "gen"]) and not files.append_batch(again, log, "b-0", ["id", "gen"])
    assert sorted(r._key for r in files.load_log(spark, log).collect()) == ["v", "w", "x", "y"]


def test_two_writers_lose_no_update(spark, tmp_path):
    path, faults = str(tmp_path / "state"), []

    def write(name):
        try:
            merge = work.upsert(path, "slug", "at")
            for k in range(6):
                merge(spark.createDataFrame([(f"{name}{k}", k), ("shared", 10 * k + ord(name))], "slug string, at int"), k)
        except Exception as e:
            faults.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not faults
    found = {r.slug: r.at for r in files.load_state(spark, path).collect()}
    assert found == {f"{n}{k}": k for n in "ab" for k in range(6)} | {"shared": 50 + ord("b")}
    assert len(list((tmp_path / "state").glob("version=*"))) == 2 and not list((tmp_path / "state" / "_commits").glob("_next*"))


def test_a_name_is_claimed_by_one(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
        (tmp_path / f"{name}.d").mkdir()
    assert files.claim(spark, str(tmp_path / "one"), str(tmp_path / "taken")) and not files.claim(spark, str(tmp_path / "two"), str(tmp_path / "taken"))
    assert (tmp_path / "taken").read_text() == "one" and (tmp_path / "two").exists()
    assert files.claim(spark, str(tmp_path / "one.d"), str(tmp_path / "taken.d")) and not files.claim(spark, str(tmp_path / "two.d"), str(tmp_path / "taken.d"))


def test_old_commits_go_and_a_late_writer_starts_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "KEPT_COMMITS", 3)
    path, calls = str(tmp_path / "state"), []
    for k in range(3):
        files.save_state(spark.range(k + 1), path)

    def slow(old):
        calls.append(old.count())
        if len(calls) == 1:  # so many commits come first that the late writer's number is free again
            for k in range(10, 15):
                files.save_state(spark.range(k), path)
        return spark.range(old.count() + 1) if len(calls) > 1 else spark.range(1)

    files.update_state(spark, path, slow)
    assert calls == [3, 14] and files.load_state(spark, path).count() == 15
    assert len(list((tmp_path / "state" / "_commits").glob("0*"))) <= 4


def test_a_try_is_due_without_an_event(spark, tmp_path):
    """A waiting slug asks for its next try by a timer, an ended one does not, and its state is dropped after a while."""
    (tmp_path / "in").mkdir()
    line = '{"slug": "%s", "outcome": "%s", "event_time": "2024-01-01 00:0%d:00", "err": null}\n'
    (tmp_path / "in" / "0.json").write_text(line % ("a", "error", 0) + line % ("b", "ok", 0))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", work.ROCKSDB)
    try:
        events = spark.readStream.schema("slug string, outcome string, event_time timestamp, err string").json(str(tmp_path / "in"))
        run = work.timed_submissions(events, cycle_ms=500, keep_ms=3000).writeStream.outputMode("update").format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

        def wait(done):
            end = time.monotonic() + 90
            while not done() and time.monotonic() < end and run.exception() is None:
                time.sleep(0.3)
            assert run.exception() is None, run.exception()
            assert done()

        seen = lambda: [(r.slug, r.status, r.attempts) for r in spark.table("timed").collect()]
        wait(lambda: ("a", work.DUE, 1) in seen())
        assert ("a", work.RETRY, 1) in seen() and ("b", work.DONE, 1) in seen()
        (tmp_path / "in" / "1.json").write_text(line % ("a", "ok", 1))
        wait(lambda: ("a", work.DONE, 2) in seen())
        due = sum(s == work.DUE for _, s, _ in seen())
        held = lambda: run.lastProgress["stateOperators"][0]["customMetrics"].get("numValuesRemovedDueToTTLExpiry", 0)
        gone = []
        wait(lambda: gone.append(held()) or sum(gone) > 0)
        assert sum(s == work.DUE for _, s, _ in seen()) == due and all(slug != "b" or status == work.DONE for slug, status, _ in seen())
        (tmp_path / "in" / "2.json").write_text(line % ("b", "error", 2))  # forgotten, so it begins anew
        wait(lambda: ("b", work.RETRY, 1) in seen())
    finally:
        for query in spark.streams.active:
            query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
