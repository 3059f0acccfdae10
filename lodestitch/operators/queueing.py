"""Queue, rate and expiry semantics in batch form (the streaming twins are in ``streaming``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RUNNING = 12
STARTS_PER_TICK = 5
LARGE_PAGES = 25
MAX_LARGE, MAX_SMALL = 2, 4
CALLS_PER_MINUTE = 1200


def micros_of(df: DataFrame, column: str) -> Column:
    """Microseconds of a time column; one without a zone is counted as it stands, so that no
    clock change of the session's zone moves it."""
    at = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(at)
    seconds = F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def spaced_calls(calls: DataFrame, key: str, at: str = "ts", seconds: float = 0.05) -> DataFrame:
    """For each call the microseconds since the one before it of its key, and whether that is
    less than the least spacing."""
    order = Window.partitionBy(key).orderBy(micros_of(calls, at))
    gap = micros_of(calls, at) - F.lag(micros_of(calls, at)).over(order)
    return calls.withColumn("gap", gap).withColumn("too_close", F.coalesce(F.col("gap") < int(seconds * 1_000_000), F.lit(False)))


def admit(jobs: DataFrame, slots: int, per_tick: int | None = STARTS_PER_TICK) -> DataFrame:
    """The queued jobs that start now, oldest first: as many as slots and tick allow.

    A top-k (each task keeps its first rows), then a rank over those few."""
    n = max(0, min(slots, per_tick if per_tick is not None else slots))
    first = jobs.where("status = 'queued'").orderBy("created_at", "id").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))


def queue_status(jobs: DataFrame, pages: str = "pages") -> DataFrame:
    """Counts of queued, running and converting jobs, of running PDFs by class, free slots."""
    running = F.col("status").isin("process", "changing")
    large = F.count_if(running & (F.col(pages) > LARGE_PAGES))
    return jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status") == "process").alias("process"),
        F.count_if(F.col("status") == "changing").alias("changing"),
        large.alias("large_running"),
        F.count_if(running & (F.col(pages) <= LARGE_PAGES)).alias("small_running"),
        F.greatest(F.lit(MAX_SMALL) - large, F.lit(0)).alias("small_slots"),
    )


def admit_pdfs(queue: DataFrame, large_running: int = 0, small_running: int = 0) -> DataFrame:
    """Queued PDFs that may start under the class quotas: at most 2 large in all, and small
    ones up to 4 less the large; the first that has no slot blocks those behind it.

    At most 4 can start, so only the first 5 of the queue (a top-k) are looked at."""
    head = queue.orderBy("created_at", "id").limit(MAX_SMALL + MAX_LARGE + 1)
    order = Window.orderBy("created_at", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_large = (F.col("pages") > LARGE_PAGES).cast("int")
    counted = head.withColumn("large", large_running + F.sum(is_large).over(upto)).withColumn("small", small_running + F.sum(1 - is_large).over(upto))
    fits = F.when(is_large == 1, F.col("large") <= MAX_LARGE).otherwise(F.col("small") <= F.greatest(MAX_SMALL - F.col("large"), F.lit(0)))
    return counted.withColumn("open", F.min(fits.cast("int")).over(upto)).where("open = 1").drop("open")


def calls_last_minute(calls: DataFrame, key: str, at: str = "ts", seconds: int = 60, limit: int = CALLS_PER_MINUTE) -> DataFrame:
    """For each call the calls of its key within the sliding window that ends with it, and
    whether the limit is passed."""
    micros = micros_of(calls, at)
    frame = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return calls.withColumn("in_window", F.count("*").over(frame)).withColumn("over_limit", F.col("in_window") > limit)


def zombies(jobs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Processing jobs without a remote id that were created more than ``hours`` ago."""
    return jobs.where((F.col("status") == "process") & F.col("remote_id").isNull() & (F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS")))


def fan_out(jobs: DataFrame, languages: str = "languages") -> DataFrame:
    """One row per job and distinct target language."""
    return jobs.withColumn("language", F.explode(F.array_distinct(F.filter(F.transform(F.split(languages, ","), lambda x: F.trim(x)), lambda x: x != ""))))


def image_state(remote: Column, current: Column) -> Column:
    return F.when(remote == "SUCCEEDED", "completed").when(remote.isin("FAILED", "CANCELED", "UNKNOWN"), "failed").otherwise(current)


def image_error(code: Column, message: Column) -> Column:
    """``code: message``, or whichever there is."""
    return F.nullif(F.concat_ws(": ", F.nullif(code, F.lit("")), F.nullif(message, F.lit(""))), F.lit(""))


def video_callback(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """Jobs that a callback names by id and remote id: 3 completes for 7 days, 4 fails."""
    joined = jobs.join(calls.select("id", "remote_id", "remote_status", "called_at"), ["id", "remote_id"])
    state = F.when(F.col("remote_status") == 3, "completed").when(F.col("remote_status") == 4, "failed").otherwise(F.col("status"))
    return joined.withColumn("status", state).withColumn(
        "expires_at", F.when(F.col("remote_status") == 3, F.col("called_at") + F.expr("INTERVAL 7 DAYS"))
    )


def conversion_progress(phase: Column, polls: Column) -> Column:
    """Parsing up to 90 in 60 polls, exporting 95, downloading 98, converted 100, then 0 again."""
    parsing = F.least(F.lit(90), F.floor(polls / 60 * 90).cast("int"))
    return F.when(phase == "parse", parsing).when(phase == "export", 95).when(phase == "download", 98).when(phase == "converted", 100).otherwise(0)


def final_state(current: Column, wanted: Column) -> Column:
    """``done`` is never overwritten."""
    return F.when(current == "done", current).otherwise(wanted)


def final_progress(current: Column, status: Column) -> Column:
    """100 on success, else as it was."""
    return F.when(status == "done", F.lit(100.0)).otherwise(current)


def restarted(jobs: DataFrame) -> DataFrame:
    """Failed and done jobs set back to the start."""
    back = F.col("status").isin("failed", "done")
    new = {"status": F.when(back, "none").otherwise(F.col("status"))}
    new |= {name: F.when(~back, F.col(name)) for name in ("start_at", "end_at", "failed_reason") if name in jobs.columns}
    for name in ("process", "failed_count"):
        if name in jobs.columns:
            new[name] = F.when(back, F.lit(0).cast(jobs.schema[name].dataType)).otherwise(F.col(name))
    return jobs.withColumns(new)
