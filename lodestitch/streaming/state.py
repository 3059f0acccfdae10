"""Keyed state with event-time timers: caches with a life time, and the life of jobs.

Both are ``transformWithState`` processors, so state is in the store of the stream and survives lost
executors with its checkpoint. They need the RocksDB store: ``state_session`` gives a session of the same
application that has it, so no other query's settings change. Rows of a key are taken in the order
of time and id within a micro-batch; rows behind the watermark are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestitch.operators.queueing import micros_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000
#: A part of a cache is read in one go where it holds at most so many entries for each key that a micro-batch asks for.
WHOLE = 4


def state_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class TtlCache(StatefulProcessor):
    """Accesses to caches: a key that was used (``sliding``) or loaded at most ``ttl`` microseconds ago is
    a hit, any other access loads it. A full part of a cache gives up the half that was loaded first."""

    def __init__(self, ttl: int, most: int, sliding: bool) -> None:
        self.ttl, self.most, self.sliding = ttl, most, sliding

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "loaded long, used long, turn long")
        self.counts = handle.getValueState("counts", "held long, turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Every call of the store is a round trip, so an entry is read and written once for a micro-batch; where the store
        holds little beside what is asked for, it is read in one go."""
        held, turn = self.counts.get() or (0, 0)
        rows = sorted(rows, key=lambda r: (r["at"], r["id"]))
        last, known, changed = 0, {}, set()
        whole = held <= WHOLE * len({row["key"] for row in rows})
        if whole:
            known = {k[0]: tuple(v) for k, v in self.entries.iterator()} if held else {}
        for row in rows:
            name, at = row["key"], row["at"]
            if name not in known:
                known[name] = None if whole else self.entries.getValue((name,))
            entry = known[name]
            hit = entry is not None and at - (entry[1] if self.sliding else entry[0]) <= self.ttl
            if hit:
                known[name] = (entry[0], at, entry[2])
            else:
                if entry is not None:
                    held -= 1  # an entry that has run out goes, and is loaded behind all others
                    known[name] = None
                if held >= self.most:
                    held -= self._halve(known, changed, name)
                turn += 1
                known[name] = (at, at, turn)
                held += 1
            changed.add(name)
            last = max(last, at)
            yield Row(cache=key[0], id=row["id"], hit=hit)
        for name in changed:
            self.entries.updateValue((name,), known[name])
        self.counts.update((held, turn))
        self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def _halve(self, known: dict, changed: set, name: str) -> int:
        """Takes out the half that was loaded first, and ``name`` if it has run out; the number of that half."""
        for x in changed - {name}:
            self.entries.updateValue((x,), known[x])
        changed.clear()
        self.entries.removeKey((name,))
        oldest = sorted((v[2], k[0]) for k, v in self.entries.iterator())[: max(1, self.most // 2)]
        for _, gone in oldest:
            self.entries.removeKey((gone,))
            known[gone] = None
        return len(oldest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What has run out by now goes; the next look is when the first of the rest runs out."""
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        turn = self.counts.get()[1]
        found = [(v[1 if self.sliding else 0] + self.ttl, tuple(k), tuple(v)) for k, v in self.entries.iterator()]
        left = [e for e in found if e[0] >= now]
        if len(left) < len(found) - len(left):
            self.entries.clear()
            for _, name, entry in left:
                self.entries.updateValue(name, entry)
        else:
            for _, gone, _ in (e for e in found if e[0] < now):
                self.entries.removeKey(gone)
        self.counts.update((len(left), turn))
        if left:
            self.handle.registerTimer(min(left)[0] // 1000 + 1)
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(accesses: DataFrame, ttl: int = HOUR, most: int = 20_000, sliding: bool = True, shards: int = 16, late: str = "10 minutes") -> DataFrame:
    """cache, id, hit of every access (cache, key, id, ts). A cache is held in ``shards`` parts by its keys' hashes,
    so that a busy one is not a single task; each holds at most its share of ``most`` keys."""
    keyed = accesses.withColumn("at", micros_of(accesses, "ts")).withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    rows = keyed.select(F.col("cache").cast("string").alias("cache"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), "at", "time")
    return rows.groupBy("cache", "shard").transformWithState(TtlCache(ttl, max(1, most // shards), sliding), "cache string, id long, hit boolean", "append", "eventTime")


class JobLife(StatefulProcessor):
    """One job: submitted jobs start, pause, resume and end; what is told in a state that does not allow it
    changes nothing. A started job that has no remote id ``limit`` microseconds after it was submitted (or when it
    starts, where that is later) fails by a timer.

    Time in work is without pauses."""

    #: The states in which an event counts, and the one that it leads to.
    MOVES = {
        "submit": ((None,), "queued"), "start": (("queued",), "running"), "pause": (("running",), "paused"), "resume": (("paused",), "running"),
        "cancel": (("queued", "running", "paused"), "canceled"), "done": (("running", "paused"), "done"), "fail": (("queued", "running", "paused"), "failed"),
    }

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "state string, submitted long, started long, since long, worked long, remote boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, submitted, started, since, worked, remote = self.life.get() or (None, None, None, None, 0, False)
        begun = False
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            at, event = row["at"], row["event"]
            if state in ("running", "paused") and not remote and at > (end := max(submitted + self.limit, started)):
                worked += end - since if state == "running" else 0
                state, since = "failed", end
                yield Row(job=key[0], at=end, state=state, worked=worked)
            if event == "remote":
                remote = remote or state is not None
            if event not in self.MOVES or state not in self.MOVES[event][0]:
                continue
            if state == "running":
                worked += at - since
            state, since = self.MOVES[event][1], at
            if event == "submit":
                submitted = at
            if event == "start":
                started, begun = at, True
            yield Row(job=key[0], at=at, state=state, worked=worked)
        if begun and state in ("running", "paused") and not remote:
            self.handle.registerTimer(max(submitted + self.limit, started) // 1000 + 1)
        if state is not None:
            self.life.update((state, submitted, started, since, worked, remote))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, submitted, started, since, worked, remote = self.life.get()
        if state in ("running", "paused") and not remote:
            at = max(submitted + self.limit, started)
            worked += at - since if state == "running" else 0
            self.life.update(("failed", submitted, started, at, worked, remote))
            yield Row(job=key[0], at=at, state="failed", worked=worked)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, limit: int = 6 * HOUR, late: str = "10 minutes") -> DataFrame:
    """job, at (microseconds), state, worked: every change of state of the jobs that ``events`` (job, id, ts, event)
    tell of; ids order what happens at the same time."""
    keyed = events.withColumn("at", micros_of(events, "ts")).withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    rows = keyed.select(F.col("job").cast("string").alias("job"), F.col("id").cast("long").alias("id"), "event", "at", "time")
    return rows.groupBy("job").transformWithState(JobLife(limit), "job string, at long, state string, worked long", "append", "eventTime")
