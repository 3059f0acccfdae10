"""Streaming twins of the queue operators.

Sliding windows are keyed state: ``applyInPandasWithState`` keeps the calls of a key's last
window. Waiting jobs are tables by epoch, as a queue has no bound. Simple rates use event-time
windows with a watermark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestitch.operators.queueing import CALLS_PER_MINUTE, LARGE_PAGES, MAX_LARGE, MAX_SMALL, micros_of


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, start, n: events per key and tumbling window; later ones than the watermark fall away."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Ticks after which what waits is written anew; between them a tick writes only what came and what started.
COMPACT = 16


def admit_stream(changes: DataFrame, slots: int, out: str, checkpoint: str, per_tick: int | None = None, languages: bool = False) -> object:
    """Jobs as they start, under ``out``/started/epoch=. ``changes`` (queue, id, created_at, status) brings queued jobs
    and ends (done, failed) that free the slot of a running job; every micro-batch is a tick.

    Each queue runs at most ``slots``, and starts at most ``per_tick`` a tick, oldest first. With a column pages, documents of
    more than 25 of them are at most 2 of the running ones and smaller ones at most 4 less the large; the first that has no
    place blocks those behind it. With ``languages`` only jobs start whose lang and target_lang are known.

    What waits is a table and what came and started since, so a tick writes little, and every ``COMPACT`` ticks
    they become one table again and older ones go. A queue's head is a top-k (each task keeps its first rows), so no queue is
    held by one task; of what runs there are at most ``slots`` rows a queue. A batch that is run again writes the same."""
    paged = "pages" in changes.columns
    columns = ["queue", "id", "created_at", *(["pages"] if paged else [])]
    head = min(slots, per_tick) if per_tick else slots

    def step(batch: DataFrame, epoch: int) -> None:
        spark, base = batch.sparkSession, epoch // COMPACT * COMPACT
        schema = batch.select(*columns).schema

        def part(name: str, at: int) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{out}/{name}/epoch={at}") if at >= 0 else batch.select(*columns).limit(0)

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
            return part(name, epoch)

        def since(name: str, first: int) -> DataFrame:
            df = part(name, -1)
            for at in range(max(first, 0), epoch):
                df = df.unionByName(part(name, at))
            return df

        ready = batch.where("status = 'queued'")
        came = put((ready.where("lang IS NOT NULL AND target_lang IS NOT NULL") if languages else ready).select(*columns), "came")
        # The table of the last compaction holds what waited before that epoch.
        last = base if epoch > base else base - COMPACT
        waiting = part("waiting", last).unionByName(since("came", last)).join(since("started", last).select("queue", "id"), ["queue", "id"], "left_anti")
        if epoch == base:
            waiting = put(waiting, "waiting")
        waiting = waiting.unionByName(came)
        ends = batch.where("status IN ('done', 'failed')").select("queue", "id")
        running = put(part("running", epoch - 1).join(ends, ["queue", "id"], "left_anti"), "kept")

        large = (F.col("pages") > LARGE_PAGES).cast("int") if paged else F.lit(0)
        small = (F.col("pages") <= LARGE_PAGES).cast("int") if paged else F.lit(0)
        of = lambda c: F.coalesce(c, F.lit(0))
        counts = running.groupBy("queue").agg(F.count("*").alias("n"), F.sum(of(large)).alias("large"), F.sum(of(small)).alias("small"))
        order = Window.partitionBy("queue").orderBy("created_at", "id")
        first = waiting.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= head)
        upto = Window.partitionBy("queue").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        joined = first.join(counts, "queue", "left").withColumns({"larges": F.sum(of(large)).over(upto) + of(F.col("large")), "smalls": F.sum(of(small)).over(upto) + of(F.col("small"))})
        place = F.when(large == 1, F.col("larges") <= MAX_LARGE).when(small == 1, F.col("smalls") <= MAX_SMALL - F.col("larges")).otherwise(True)
        fits = F.min((place & (F.col("turn") + of(F.col("n")) <= slots)).cast("int")).over(upto) == 1
        started = put(joined.withColumn("fits", fits).where("fits").select(*columns), "started")
        put(running.unionByName(started), "running")
        for name, keep in (("running", epoch - 1), ("kept", epoch - 1), ("came", last), ("waiting", last)):
            _drop_epoch(spark, f"{out}/{name}", keep)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def waiting_jobs(spark, out: str) -> DataFrame:
    """What waits after the last tick of ``admit_stream``."""
    table = lambda name: spark.read.parquet(f"{out}/{name}")
    last = max(_epochs(spark, f"{out}/waiting")[1])
    came, started = (table(name).where(F.col("epoch") >= last).drop("epoch") for name in ("came", "started"))
    held = spark.read.schema(came.schema).parquet(f"{out}/waiting/epoch={last}")
    return held.unionByName(came).join(started.select("queue", "id"), ["queue", "id"], "left_anti")


def _epochs(spark, folder: str) -> tuple:
    """The folder's file system, and the path of each epoch in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    paths = [status.getPath() for status in system.listStatus(at)] if system.exists(at) else []
    return system, {int(path.getName()[6:]): path for path in paths if path.getName().startswith("epoch=")}


def _drop_epoch(spark, folder: str, keep: int) -> None:
    """Deletes the epochs of a folder before ``keep``, which no batch that may be run again reads."""
    system, epochs = _epochs(spark, folder)
    for epoch, path in epochs.items():
        if epoch < keep:
            system.delete(path, True)


def rate_stream(calls: DataFrame, limit: int = CALLS_PER_MINUTE, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, at (microseconds), in_window, over_limit per call; state holds the calls of a key's
    last window, and goes once the watermark has passed that window."""
    width = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        out = []
        for t in sorted(int(t) for b in batches for t in b["at"]):
            while held and held[0] < t - width:
                held.popleft()
            held.append(t)
            out.append((key[0], t, len(held), len(held) > limit))
        state.update((list(held),))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "in_window", "over_limit"])

    keyed = calls.withColumn("at", micros_of(calls, "ts")).withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    return keyed.select(F.col("key").cast("string").alias("key"), "at", "time").groupBy("key").applyInPandasWithState(
        step, "key string, at long, in_window long, over_limit boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def translate_stream(files: DataFrame, out: str, checkpoint: str, work) -> object:
    """Text micro-batches through ``work(df, epoch)``-style translation, each written once under
    its epoch; a failed batch stops the stream and is taken up again from the checkpoint."""

    def each(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
