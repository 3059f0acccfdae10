"""Queries with state over time: caches, job lives, schedules of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.operators import queueing as Q
from lodestitch.operators import schedule as W
from lodestitch.sources import tables as T
from lodestitch.sources.shared import shared_path
from lodestitch.streaming import state as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _in_turns(spark: SparkSession, df: DataFrame, label: str, stream, turns: list) -> DataFrame:
    """What ``stream`` of ``df`` gives, whose rows come in several runs of one query: those of each condition in
    ``turns`` after the other, with the state of the runs before from the checkpoint."""
    path, out, checkpoint = (shared_path(spark, f"{label}-{x}") for x in ("in", "out", "state"))
    own = streams.state_session(spark)
    for turn in turns:
        df.where(turn).write.mode("append").parquet(path)
        made = stream(own.readStream.schema(df.schema).parquet(path))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


THIRDS = ["day(ts) <= 10", "day(ts) > 10 AND day(ts) <= 20", "day(ts) > 20"]


@query(
    """SELECT event_type AS cache, event_id AS id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)) <= 21600000000, false) AS hit FROM events"""
)
def stream_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in caches of six hours, one per event type; every access keeps an entry alive."""
    events = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return _in_turns(spark, events, "cache", lambda s: streams.cache_stream(s, ttl=6 * streams.HOUR, most=1 << 24), THIRDS)


#: Events as what is told of jobs: a user's events of three days are a job.
TOLD = ("submit", "start", "pause", "submit", "start", "resume", "remote", "pause", "start", "done", "submit", "fail", "resume", "cancel", "start")
_TOLD_SQL = "[" + ", ".join(f"'{x}'" for x in TOLD) + "]"
_JOB_SQL = f"""e AS (SELECT user_id || ':' || (day(ts) - 1) // 3 AS job, event_id AS id, epoch_us(ts) AS moment, {_TOLD_SQL}[event_id % {len(TOLD)} + 1] AS event FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY moment, id) AS k FROM e)"""


@query(
    f"""WITH RECURSIVE {_JOB_SQL},
    s AS (SELECT job, 0::BIGINT AS k, NULL::VARCHAR AS state, NULL::BIGINT AS submitted, NULL::BIGINT AS started, NULL::BIGINT AS since, 0::BIGINT AS worked, false AS remote, []::STRUCT("at" BIGINT, state VARCHAR, worked BIGINT)[] AS said FROM (SELECT DISTINCT job FROM n)
      UNION ALL
      SELECT job, k, CASE WHEN moved IS NULL THEN was ELSE moved END, CASE WHEN moved = 'queued' THEN moment ELSE submitted END, CASE WHEN was = 'queued' AND moved = 'running' THEN moment ELSE started END, CASE WHEN moved IS NULL THEN since ELSE moment END,
        worked + CASE WHEN moved IS NOT NULL AND was = 'running' THEN moment - since ELSE 0 END, remote OR (event = 'remote' AND was IS NOT NULL),
        said || CASE WHEN moved IS NULL THEN [] ELSE [{{'at': moment, 'state': moved, 'worked': worked + CASE WHEN was = 'running' THEN moment - since ELSE 0 END}}] END
      FROM (SELECT *, CASE WHEN event = 'submit' AND was IS NULL THEN 'queued' WHEN event = 'start' AND was = 'queued' THEN 'running' WHEN event = 'pause' AND was = 'running' THEN 'paused'
          WHEN event = 'resume' AND was = 'paused' THEN 'running' WHEN event = 'cancel' AND was IN ('queued', 'running', 'paused') THEN 'canceled'
          WHEN event = 'done' AND was IN ('running', 'paused') THEN 'done' WHEN event = 'fail' AND was IN ('queued', 'running', 'paused') THEN 'failed' END AS moved
        FROM (SELECT n.job, n.k, n.moment, n.event, submitted, started, remote, CASE WHEN dead THEN 'failed' ELSE s.state END AS was, CASE WHEN dead THEN last ELSE since END AS since,
            worked + CASE WHEN dead AND s.state = 'running' THEN last - since ELSE 0 END AS worked,
            said || CASE WHEN dead THEN [{{'at': last, 'state': 'failed', 'worked': worked + CASE WHEN s.state = 'running' THEN last - since ELSE 0 END}}] ELSE [] END AS said
          FROM (SELECT *, greatest(submitted + 21600000000, started) AS last FROM s) s JOIN n ON n.job = s.job AND n.k = s.k + 1,
            LATERAL (SELECT coalesce(s.state IN ('running', 'paused') AND NOT remote AND n.moment > last, false) AS dead)))),
    ended AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1),
    late AS (SELECT job, greatest(submitted + 21600000000, started) AS "at", 'failed' AS state, worked + CASE WHEN state = 'running' THEN greatest(submitted + 21600000000, started) - since ELSE 0 END AS worked FROM ended
      WHERE state IN ('running', 'paused') AND NOT remote AND greatest(submitted + 21600000000, started) // 1000 + 1 <= (SELECT max(moment) // 1000 FROM e) - 600000)
    SELECT job, x['at'] AS "at", x.state AS state, x.worked AS worked FROM (SELECT job, unnest(said) AS x FROM ended) UNION ALL SELECT * FROM late"""
)
def stream_job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that start, pause, resume and end, and those that time out after six hours without a remote id."""
    told = F.element_at(F.array(*[F.lit(x) for x in TOLD]), (F.col("event_id") % len(TOLD) + 1).cast("int"))
    job = F.concat_ws(":", "user_id", F.floor((F.dayofmonth("ts") - 1) / 3))
    events = T.table(spark, sf_dir, "events").select(job.alias("job"), F.col("event_id").alias("id"), "ts", told.alias("event"))
    return _in_turns(spark, events, "lives", streams.job_stream, THIRDS)


@query(
    """WITH RECURSIVE c AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT key, id, k, tm, tm AS start FROM c WHERE k = 1 UNION ALL SELECT c.key, c.id, c.k, c.tm, greatest(c.tm, s.start + 1800000000) FROM s JOIN c ON c.key = s.key AND c.k = s.k + 1)
    SELECT key, id, start, start - tm AS waited FROM s"""
)
def call_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a key that keep half an hour between them."""
    events = T.table(spark, sf_dir, "events")
    calls = events.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), Q.micros_of(events, "ts").alias("at"))
    return W.spaced_starts(calls, "key", ["at", "id"], seconds=1800).select("key", "id", "start", (F.col("start") - F.col("at")).alias("waited"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_partkey") % 97 == 0, "denied").when(F.col("l_partkey") % 10 == 1, "refused").otherwise("busy")
    failures = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 13).otherwise(0)
    call = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)"))
    start = F.unix_date(F.to_date("l_shipdate")).cast("long") % 3 * W.SECOND
    return lines.select(F.col("l_orderkey").alias("job"), call.alias("call"), start.alias("start"), (F.col("l_quantity") * 100_000).cast("long").alias("took"), kind.alias("kind"), failures.alias("failures"))


ATTEMPTS_SQL = """WITH RECURSIVE c AS (SELECT l_orderkey AS job, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::DECIMAL(12,2) AS call,
      ((epoch_us(l_shipdate::DATE::TIMESTAMP) // 86400000000) % 3) * 1000000 AS start, (l_quantity * 100000)::BIGINT AS took,
      CASE WHEN l_partkey % 97 = 0 THEN 'denied' WHEN l_partkey % 10 = 1 THEN 'refused' ELSE 'busy' END AS kind, CASE WHEN l_returnflag = 'R' THEN l_suppkey % 13 ELSE 0 END AS failures FROM lineitem),
    a AS (SELECT *, 0::BIGINT AS attempt, start AS tm FROM c UNION ALL
      SELECT job, call, start, took, kind, failures, attempt + 1, tm + took + CASE WHEN kind = 'busy' THEN (attempt + 1) * 2000000 ELSE 0 END FROM a
      WHERE attempt < failures AND ((kind = 'busy' AND attempt < 9) OR (kind = 'denied' AND attempt < 1))),
    o AS (SELECT *, CASE WHEN attempt >= failures THEN 'done' WHEN kind = 'refused' THEN 'empty' WHEN kind = 'busy' AND attempt = 9 THEN 'kept' WHEN kind = 'denied' AND attempt = 1 THEN 'failed' ELSE 'again' END AS outcome FROM a),
    m AS (SELECT o.*, CASE WHEN kind = 'denied' AND attempt > 0 THEN 'backup' ELSE 'primary' END AS model FROM o
      LEFT JOIN (SELECT job, min(tm + took) AS stop FROM o WHERE outcome = 'failed' GROUP BY job) f USING (job) WHERE stop IS NULL OR tm < stop)"""


@query(ATTEMPTS_SQL + ' SELECT job, call, attempt, tm AS "at", model, outcome FROM m')
def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt with its time: waits, the backup, jobs that stop."""
    return W.attempts(_calls(spark, sf_dir))


@query(ATTEMPTS_SQL + " SELECT job, count(DISTINCT call) AS calls, count(*) AS attempts, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'done' END AS state FROM m GROUP BY job")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.job_outcomes(W.attempts(_calls(spark, sf_dir)))
