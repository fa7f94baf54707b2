"""The durable table of replies and the paged data source."""

import threading
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.sources import paged_source as S
from siltstone.sources import replies as R


def requests_of(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("prompt "), "id").alias("prompt"))
    return rows.withColumn("key", R.request_key(F.lit("stub"), "prompt"))


def logging_fetch(log, fail_on=()):
    """A service that writes down what it is asked, and dies at some prompts."""

    def fetch(batches):
        for b in batches:
            for key, prompt in zip(b["key"], b["prompt"]):
                if prompt in fail_on:
                    raise RuntimeError("the service is gone")
                with open(f"{log}/{key}", "a") as f:
                    f.write("x")
            yield pd.DataFrame({"key": b["key"], "reply": b["prompt"], "ok": ~b["prompt"].str.endswith("7"), "error": "", "latency_s": 0.1})

    return fetch


def asked(log):
    return {p.name: len(p.read_text()) for p in Path(log).iterdir()}


def test_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    log, store, n = tmp_path / "log", R.ReplyStore(spark, str(tmp_path / "store")), 120
    log.mkdir()
    req = requests_of(spark, n)
    parts = req.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(6)))
    last = parts.filter("part = 4").orderBy("key").first().prompt
    with pytest.raises(Exception, match="the service is gone"):
        store.ask(req, logging_fetch(log, (last,)), part_rows=20)
    done = {r.key for r in store.read().collect()}
    finished = {r.key for r in parts.filter("part < 4 and prompt not like '%7'").collect()}
    assert done == finished and store.version() == 4
    first = asked(log)
    got = store.ask(requests_of(spark, n), logging_fetch(log), part_rows=20).collect()
    assert len(got) == n and {r.key for r in got if r.cached} == done
    second = asked(log)
    assert all(second[k] == first[k] == 1 for k in done)  # nothing that was committed was asked again
    # failures are returned and asked again, all others come from the store
    assert store.read().count() == n - 12 and {r.reply for r in got if not r.ok} == {f"prompt {k}" for k in range(n) if k % 10 == 7}
    store.ask(requests_of(spark, n), logging_fetch(log), part_rows=20)
    third = asked(log)
    assert {k for k in third if third[k] > second[k]} == {r.key for r in got if not r.ok}


def test_requests_are_read_a_few_times_whatever_the_parts(spark, tmp_path):
    """What was asked before was read again for each part, and so was the whole store."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    n, req = 300, requests_of(spark, 300)
    for part_rows in (300, 15):
        store = R.ReplyStore(spark, str(tmp_path / f"store{part_rows}"))
        before, read = seen.value, []
        real = store._read
        store._read = lambda files: (read.append(len(files)), real(files))[1]  # noqa: B023
        got = store.ask(req.mapInPandas(counted, req.schema), R.stub_replies, part_rows=part_rows)
        assert seen.value - before <= 3 * n, part_rows
        assert sum(read) <= 20 * store.version(), part_rows
        assert got.count() == n == store.read().count()


def test_two_runs_at_once_store_each_key_once(spark, tmp_path):
    errors, stores = [], [R.ReplyStore(spark, str(tmp_path / "store")) for _ in range(3)]

    def run(store):
        try:
            store.ask(requests_of(spark, 60), R.stub_replies, part_rows=15)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = stores[0].read()
    assert not errors and rows.count() == 60 == rows.select("key").distinct().count()


def test_lost_race_leaves_out_what_came_between(spark, tmp_path):
    a, b = R.ReplyStore(spark, str(tmp_path / "store")), R.ReplyStore(spark, str(tmp_path / "store"))
    row = lambda *keys: spark.createDataFrame([(k, "a", True, "", 0.0) for k in keys], R.REPLY)
    real, tries = a._created, []

    def late(number, entry):
        if not tries:
            b.commit(row("x", "y"))
        tries.append(number)
        return real(number, entry)

    a._created = late
    assert a.commit(row("y", "z")) == 2 and tries == [1, 2]
    assert sorted(r.key for r in a.read().collect()) == ["x", "y", "z"] and a.read(1).count() == 2
    assert not a._created(2, {"files": [], "gone": []})
    version = a.compact()
    assert a.read().count() == 3 and len(a.files()) == 1 and a.read(version - 1).count() == 3
    assert a.commit(row("x", "x", None)) == version + 1 and a.read().count() == 3


def test_absences_and_large_replies(spark, tmp_path):
    store = R.ReplyStore(spark, str(tmp_path / "store"), "key string, reply string")
    fetch = lambda batches: (pd.DataFrame({"key": b["key"], "reply": b["prompt"].map(lambda p: p * 5)}) for b in batches)
    got = store.ask(requests_of(spark, 12), fetch, largest=40).collect()
    assert sorted(r.reply for r in got) == ["", ""] + [f"prompt {k}" * 5 for k in range(10)]
    assert all(r.cached for r in store.ask(requests_of(spark, 12), fetch).collect())
    assert store.ask(requests_of(spark, 0), fetch).collect() == []


def service(counter, broken=None):
    def fetch(start, stop, place, size):
        mark = f"{counter}/{start}-{place}"
        with open(mark, "a") as f:
            f.write("x")
        if str(start) == broken and len(open(mark).read()) < 3:
            raise RuntimeError("try the task again")
        total = start.day % 7 + 2
        return [f"{start}:{k}" for k in range(place, min(total, place + size))], total

    return fetch


def test_paged_source(spark, tmp_path):
    options = {"start": "2024-01-01", "stop": "2024-02-20", "days": "10", "size": "2"}
    (tmp_path / "calls").mkdir()
    S.register_paged(spark, "pages_a", service(str(tmp_path / "calls")))
    batch = spark.read.format("pages_a").options(**options).load()
    rows = sorted(map(tuple, batch.collect()))
    assert batch.rdd.getNumPartitions() == 6 and len({r[0] for r in rows}) == 6 and str(max(r[1] for r in rows)) == "2024-02-20"
    assert all([r[2] for r in rows if r[0] == d] == list(range(d.day % 7 + 2)) for d in {r[0] for r in rows})
    stream = spark.readStream.format("pages_a").options(**options, per_batch="2").load()
    out = {"path": str(tmp_path / "out"), "checkpointLocation": str(tmp_path / "checkpoint")}
    stream.writeStream.format("parquet").options(**out).trigger(availableNow=True).start().awaitTermination(120)
    again = spark.readStream.format("pages_a").options(**options, per_batch="2").load()
    q = again.writeStream.format("parquet").options(**out).trigger(processingTime="0 seconds").start()
    for _ in range(200):
        if spark.read.schema(S.SCHEMA).parquet(out["path"]).count() >= len(rows):
            break
        q.awaitTermination(0.5)
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(out["path"]).collect())) == rows


def test_windows_are_checked():
    with pytest.raises(ValueError):
        S.Pages(None, {"start": "2024-02-01", "stop": "2024-01-01"})
    assert [(str(w.start), str(w.stop)) for w in S.Pages(None, {"start": "2024-01-01", "stop": "2024-01-03", "days": "2"}).windows()] == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-03")]
