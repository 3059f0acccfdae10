"""Caches, job lives and schedules against plain loops."""

from __future__ import annotations

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestitch.operators import schedule as W
from lodestitch.streaming import jobs
from lodestitch.streaming import state as streams

START = datetime.datetime(2024, 1, 1)
HOUR = streams.HOUR


def run(spark, tmp, rows, schema, stream, parts):
    """The stream's rows, fed in ``parts`` runs of one query."""
    path, out, checkpoint = (f"{tmp}/{x}-{uuid.uuid4().hex}" for x in ("in", "out", "state"))
    own = streams.state_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).write.mode("append").parquet(path)
        df = stream(own.readStream.schema(spark.read.parquet(path).schema).parquet(path))
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).collect()


def plain_cache(accesses, ttl, most, sliding):
    """What a dictionary does that keeps the order of loading."""
    entries, out = {}, {}
    for i, key, at in accesses:
        entry = entries.get(key)
        hit = entry is not None and at - entry[1 if sliding else 0] <= ttl
        if hit:
            entries[key] = (entry[0], at)
        else:
            entries.pop(key, None)
            if len(entries) >= most:
                for old in list(entries)[: max(1, most // 2)]:
                    del entries[old]
            entries[key] = (at, at)
        out[i] = hit
    return out


@pytest.mark.parametrize(("most", "sliding", "parts"), [(1000, True, 2), (1000, False, 1), (6, True, 2)])
def test_cache(spark, tmp_path, most, sliding, parts):
    rng = random.Random(most)
    at, accesses = 0, []
    for i in range(300):
        at += rng.choice([1, 60, 600, 1800]) * 1_000_000
        accesses.append((i, f"k{rng.randrange(12)}", at))
    rows = [("c", k, i, START + datetime.timedelta(microseconds=t)) for i, k, t in accesses]
    got = run(spark, tmp_path, rows, "cache string, key string, id long, ts timestamp_ntz", lambda s: streams.cache_stream(s, HOUR, most, sliding, shards=1), parts)
    assert {r.id: r.hit for r in got} == plain_cache(accesses, HOUR, most, sliding)


def test_job_lives(spark, tmp_path):
    hour = lambda h: START + datetime.timedelta(hours=h)
    told = [
        ("a", 1, hour(0), "submit"), ("a", 2, hour(1), "start"), ("a", 3, hour(2), "pause"), ("a", 4, hour(3), "pause"), ("a", 5, hour(4), "resume"), ("a", 6, hour(5), "done"), ("a", 7, hour(5.5), "cancel"),
        ("b", 8, hour(0), "submit"), ("b", 9, hour(1), "start"),
        ("c", 10, hour(0), "submit"), ("c", 11, hour(1), "start"), ("c", 12, hour(2), "remote"), ("c", 13, hour(20), "done"),
        ("d", 14, hour(0), "start"), ("d", 15, hour(1), "submit"), ("d", 16, hour(1), "start"), ("d", 17, hour(2), "pause"), ("e", 18, hour(0), "submit"), ("e", 19, hour(9), "start"), ("z", 20, hour(30), "submit"), ("z", 21, hour(30), "cancel"),
    ]
    told.sort(key=lambda r: r[2])
    for parts in (1, 3):
        got = run(spark, tmp_path, told, "job string, id long, ts timestamp_ntz, event string", streams.job_stream, parts)
        zero = round((START - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        lives = {}
        for r in sorted(got, key=lambda r: (r.job, r.at)):
            lives.setdefault(r.job, []).append(((r.at - zero) / HOUR, r.state, r.worked / HOUR))
        assert lives["a"] == [(0, "queued", 0), (1, "running", 0), (2, "paused", 1), (4, "running", 1), (5, "done", 2)]
        assert lives["b"] == [(0, "queued", 0), (1, "running", 0), (6, "failed", 5)]  # nobody said more
        assert lives["c"][-1] == (20, "done", 19)
        assert lives["d"] == [(1, "queued", 0), (1, "running", 0), (2, "paused", 1), (7, "failed", 1)]
        assert lives["e"] == [(0, "queued", 0), (9, "running", 0), (9, "failed", 0)]
        assert sorted(s for _, s, _ in lives["z"]) == ["canceled", "queued"]


def test_spaced_starts(spark):
    rng = random.Random(1)
    calls = [(k, i, rng.randrange(10_000_000)) for k in ("a", None) for i in range(60)]
    got = {(r.key, r.id): r.start for r in W.spaced_starts(spark.createDataFrame(calls, "key string, id int, at long"), "key", ["at", "id"], seconds=0.2).collect()}
    for key in ("a", None):
        last = None
        for k, i, at in sorted((c for c in calls if c[0] == key), key=lambda c: (c[2], c[1])):
            last = at if last is None else max(at, last + 200_000)
            assert got[k, i] == last
    assert W.spaced_starts(spark.createDataFrame([], "key string, at long"), "key", ["at"]).count() == 0


def test_attempts(spark):
    s = W.SECOND
    calls = [
        ("j", "fine", 0, s, "busy", 0), ("j", "twice", 0, s, "busy", 2), ("j", "never", 0, s, "busy", 99), ("j", "refused", 0, s, "refused", 1),
        ("k", "denied", 10 * s, s, "denied", 5), ("k", "before", 0, s, "busy", 1), ("k", "sibling", 0, s, "busy", 9), ("l", "backup", 0, s, "denied", 1), (None, "alone", 0, s, None, None),
    ]
    made = W.attempts(spark.createDataFrame(calls, "job string, call string, start long, took long, kind string, failures int"), most=4)
    got = {}
    for r in made.orderBy("at").collect():
        got.setdefault(r.call, []).append((r.at / s, r.model, r.outcome))
    assert got["fine"] == [(0, "primary", "done")] and got["alone"] == [(0, "primary", "done")]
    assert got["twice"] == [(0, "primary", "again"), (3, "primary", "again"), (8, "primary", "done")]  # 1 of work, 2 of waiting; 1 and 4
    assert [x[2] for x in got["never"]] == ["again", "again", "again", "kept"] and got["never"][-1][0] == 15
    assert got["refused"] == [(0, "primary", "empty")]
    assert got["denied"] == [(10, "primary", "again"), (11, "backup", "failed")] and got["backup"][-1] == (1, "backup", "done")
    assert [x[0] for x in got["sibling"]] == [0, 3, 8]  # the attempt at 15 comes after the job has failed at 12
    assert {(r.job, r.calls, r.state) for r in W.job_outcomes(made).collect()} == {("j", 4, "done"), ("k", 3, "failed"), ("l", 1, "done"), (None, 1, "done")}


def plain_admission(ticks, slots, per_tick):
    waiting, running, out = {}, {}, []
    for tick, changes in enumerate(ticks):
        for queue, i, at, status, pages in changes:
            if status == "queued":
                waiting.setdefault(queue, []).append((at, i, pages))
            else:
                running.get(queue, {}).pop(i, None)
        for queue in waiting:
            held = running.setdefault(queue, {})
            for at, i, pages in sorted(waiting[queue], key=lambda x: x[:2])[:per_tick]:
                large, small = (sum(p is not None and (p > 25) == want for p in held.values()) for want in (True, False))
                place = pages is None or (large < 2 if pages > 25 else small < 4 - large)
                if len(held) >= slots or not place:
                    break
                held[i] = pages
                waiting[queue].remove((at, i, pages))
                out.append((tick, queue, i))
    return sorted(out)


@pytest.mark.parametrize("compact", [2, 16])
def test_admission(spark, tmp_path, monkeypatch, compact):
    """Ends, classes and late comers, with what waits written anew every so many ticks."""
    monkeypatch.setattr(jobs, "COMPACT", compact)
    rng = random.Random(5)
    ticks, known = [], []
    for tick in range(6):
        came = [(rng.choice("ab"), 100 * tick + i, rng.randrange(50), "queued", rng.choice([None, 3, 40])) for i in range(9)]
        ends = [(q, i, at, rng.choice(["done", "failed"]), p) for q, i, at, _, p in rng.sample(known, len(known) // 3)]
        known += came
        ticks.append(came + ends)
    schema = "queue string, id long, at int, status string, pages int"
    for changes in ticks:
        df = spark.createDataFrame(changes, schema).withColumn("created_at", F.timestamp_seconds("at")).drop("at")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        jobs.admit_stream(stream, 5, f"{tmp_path}/out", f"{tmp_path}/state", per_tick=3).awaitTermination()
    got = sorted((r.epoch, r.queue, r.id) for r in spark.read.parquet(f"{tmp_path}/out/started").collect())
    assert got == plain_admission(ticks, 5, 3)
    assert len(list((tmp_path / "out" / "waiting").glob("epoch=*"))) <= 2
