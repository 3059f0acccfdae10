"""Job, tenant, token and queue queries over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.functions import labels, times
from lodestitch.operators import jobs as J
from lodestitch.operators import queueing as Q
from lodestitch.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
JOBS_SQL = """(SELECT o_orderkey AS id, o_custkey AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'process' ELSE 'queued' END AS status,
  o_orderdate AS created_at, o_totalprice AS size, o_orderpriority AS priority FROM orders)"""
NOW_SQL = f"TIMESTAMP '{T.NOW}'"
EVENTS_NOW_SQL = f"TIMESTAMP '{T.EVENTS_NOW}'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(
    f"""SELECT d.status, coalesce(n, 0)::BIGINT AS n
    FROM (VALUES ('done'), ('process'), ('failed'), ('queued'), ('none')) d(status)
    LEFT JOIN (SELECT status, count(*) n FROM {JOBS_SQL} GROUP BY 1) c ON c.status = d.status"""
)
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_distribution(T.jobs(spark, sf_dir))


@query(
    f"""SELECT count(*) FILTER (created_at >= TIMESTAMP '1998-06-15 00:00:00') AS today_jobs,
    count(DISTINCT CASE WHEN created_at >= TIMESTAMP '1998-06-15 00:00:00' THEN customer_id END) AS active_users,
    round(100.0 * count(*) FILTER (status = 'done') / count(*)::DOUBLE, 2) AS success_rate,
    (SELECT round(sum(c_acctbal), 2) FROM customer) AS used_storage,
    (SELECT round(100.0 * sum(c_acctbal) / 1e9::DOUBLE, 2) FROM customer) AS used_percent FROM {JOBS_SQL}"""
)
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.dashboard_stats(T.jobs(spark, sf_dir), T.memberships(spark, sf_dir), T.NOW, 1e9)


def _trend_sql(last: str) -> str:
    return f"""SELECT d.day, coalesce(n, 0)::BIGINT AS n FROM
    (SELECT unnest(generate_series(DATE '1998-06-15' - INTERVAL 30 DAY, DATE '{last}', INTERVAL 1 DAY))::DATE AS day) d
    LEFT JOIN (SELECT created_at::DATE AS day, count(*) n FROM {JOBS_SQL} GROUP BY 1) c ON c.day = d.day"""


@query(_trend_sql("1998-06-14"))
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.daily_trend(T.jobs(spark, sf_dir), T.NOW, 30)


@query(_trend_sql("1998-06-15"))
def daily_trend_with_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.daily_trend(T.jobs(spark, sf_dir), T.NOW, 30, include_today=True)


@query(f"SELECT id, customer_id, status, created_at, round(size, 2) AS size FROM {JOBS_SQL} ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent_jobs(T.jobs(spark, sf_dir)).select("id", "customer_id", "status", "created_at", F.round("size", 2).alias("size"))


def _with_failures(jobs: DataFrame) -> DataFrame:
    """Jobs of which every eleventh has failed."""
    return jobs.withColumn("status", F.when(F.col("id") % 11 == 0, "failed").otherwise(F.col("status")))


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'done' AND id % 11 <> 0) AS done, count(*) FILTER (status = 'process' AND id % 11 <> 0) AS processing,
    count(*) FILTER (id % 11 = 0) AS failed FROM {JOBS_SQL}"""
)
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_statistics(_with_failures(T.jobs(spark, sf_dir)))


@query(f"SELECT customer_id, count(*) AS finished FROM {JOBS_SQL} WHERE status = 'done' GROUP BY 1")
def finished_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.finished_per_user(T.jobs(spark, sf_dir))


@query(
    f"""WITH u AS (SELECT customer_id, greatest(coalesce(sum(size::DECIMAL(28,6)), 0), 0)::DECIMAL(38,6) AS s FROM {JOBS_SQL} GROUP BY 1),
    h AS (SELECT *, ((20000 * (s * 1000000)::HUGEINT + 10000000000000) // 20000000000000)::BIGINT AS h FROM u)
    SELECT customer_id, round(s, 2)::DOUBLE AS used, printf('%d.%02d', h // 100, h % 100) AS percent FROM h"""
)
def storage_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.storage_per_user(T.jobs(spark, sf_dir), 1e7)


@query(
    f"""SELECT c_custkey AS customer_id, round(c_acctbal, 2) AS stored, round(greatest(coalesce(r, 0), 0), 2) AS recomputed,
    round(c_acctbal - greatest(coalesce(r, 0), 0), 2) AS diff
    FROM customer LEFT JOIN (SELECT customer_id, sum(size) r FROM {JOBS_SQL} GROUP BY 1) j ON j.customer_id = c_custkey
    WHERE round(c_acctbal - greatest(coalesce(r, 0), 0), 2) <> 0"""
)
def storage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.storage_repair(T.jobs(spark, sf_dir), T.memberships(spark, sf_dir))


@query(
    """SELECT n_nationkey AS tenant_id, n_name AS tenant_name, coalesce(m, 0)::BIGINT AS members, round(coalesce(a, 0), 2) AS allocated,
    round(1e6::DOUBLE - coalesce(a, 0), 2) AS available, round(100.0 * coalesce(a, 0) / 1e6::DOUBLE, 2) AS usage_percent
    FROM nation LEFT JOIN (SELECT c_nationkey, count(*) m, sum(c_acctbal) a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"""
)
def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.tenant_quota(T.memberships(spark, sf_dir), T.tenants(spark, sf_dir), 1e6)


def _rollup_sql(where: str) -> str:
    return f"""SELECT l_orderkey AS translate_id, round(sum(l_quantity), 2) AS input_tokens, round(sum(l_extendedprice), 2) AS output_tokens,
    round(sum(l_quantity + l_extendedprice), 2) AS total_tokens, count(*) AS calls FROM lineitem {where} GROUP BY 1"""


@query(_rollup_sql(""))
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.token_rollup(T.token_calls(spark, sf_dir))


@query(_rollup_sql("WHERE l_returnflag <> 'R'"))
def token_rollup_success_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.token_rollup(T.token_calls(spark, sf_dir), ["success"])


@query(
    """SELECT l_orderkey AS translate_id, count(*) FILTER (l_returnflag <> 'R') AS complete, count(*) AS total,
    round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*)::DOUBLE, 1) AS progress FROM lineitem GROUP BY 1
    HAVING count(*) FILTER (l_returnflag <> 'R') <> count(*)"""
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_progress(T.token_calls(spark, sf_dir))


@query(
    f"""SELECT j.id, j.customer_id, j.priority, c_name AS email FROM {JOBS_SQL} j JOIN customer ON c_custkey = customer_id
    WHERE priority ILIKE '%urgent%' OR c_name ILIKE '%urgent%'"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.jobs(spark, sf_dir).select("id", "customer_id", "priority")
    return J.search_jobs(jobs, T.memberships(spark, sf_dir), "urgent", ["priority"]).select("id", "customer_id", "priority", "email")


@query(f"SELECT id, status, created_at FROM {JOBS_SQL} WHERE status = 'done' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def paged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = T.jobs(spark, sf_dir).where(F.col("status") == J.check_status("done"))
    return J.page_of(done, [F.desc("created_at"), F.desc("id")], 3, 20).select("id", "status", "created_at")


@query(f"SELECT priority, count(*) AS n FROM {JOBS_SQL} WHERE priority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1")
def excluded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.without(T.jobs(spark, sf_dir), "priority", ["1-URGENT", "5-LOW"]).groupBy("priority").agg(F.count("*").alias("n"))


@query(f"SELECT id, customer_id, status FROM {JOBS_SQL} WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def tenant_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.of_tenant(T.jobs(spark, sf_dir), T.memberships(spark, sf_dir), 7).select("id", "customer_id", "status")


@query(
    """SELECT n_nationkey AS base, n_name AS title, coalesce(n, 0)::BIGINT AS terms FROM nation
    LEFT JOIN (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
)
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("base"), F.col("n_name").alias("title"))
    children = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("base"), F.col("s_suppkey").alias("term_id"))
    return J.term_counts(bases, children)


@query(
    """SELECT p_brand AS base, p_partkey AS term_id, p_name AS source, p_type AS target, place FROM
    (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC)::INTEGER AS place FROM part) WHERE place <= 5"""
)
def top_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.top_children(T.terms(spark, sf_dir), "base", "term_id")


@query(
    """SELECT p.p_partkey AS item_id, coalesce(f.n, 0)::BIGINT AS favs, coalesce(o.own, 0)::INTEGER AS own FROM part p
    LEFT JOIN (SELECT user_id + 1 AS k, count(*) n FROM events GROUP BY 1) f ON f.k = p_partkey
    LEFT JOIN (SELECT DISTINCT user_id + 1 AS k, 1 AS own FROM events WHERE user_id = 17) o ON o.k = p_partkey
    ORDER BY favs DESC, item_id DESC LIMIT 50"""
)
def shared_list_by_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    favs = T.table(spark, sf_dir, "events").select("user_id", (F.col("user_id") + 1).alias("item_id"))
    return J.shared_list(items, favs, 17, "fav", 1, 50).select("item_id", "favs", "own")


@query(
    """SELECT user_id, event_id, ts, event_type FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1"""
)
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_per_key(T.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


@query(
    f"""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events
    WHERE date_diff('microsecond', ts, {EVENTS_NOW_SQL}) BETWEEN 0 AND 1440 * 60 * 1000000::BIGINT) WHERE r = 1"""
)
def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.valid_code(T.table(spark, sf_dir, "events"), T.EVENTS_NOW, 1440).select("user_id", "event_id", "ts")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.duplicate_groups(T.table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query(
    """WITH s AS (SELECT p_brand AS alias, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 5 END AS tenant_id,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS value FROM part)
    SELECT alias, coalesce(max(CASE WHEN tenant_id = 2 THEN nullif(value, '') END), max(CASE WHEN tenant_id IS NULL THEN value END)) AS value
    FROM s WHERE tenant_id IS NULL OR tenant_id = 2 GROUP BY 1"""
)
def effective_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.table(spark, sf_dir, "part")
    settings = part.select(
        F.col("p_brand").alias("alias"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5).alias("tenant_id"),
        F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")).alias("value"),
    )
    return J.effective_settings(settings, 2)


@query("SELECT user_id, event_type, (count(*) % 2)::INTEGER AS favourite FROM events GROUP BY 1, 2")
def favourite_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.toggled(T.table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    """WITH t AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type = 'purchase' THEN -3 * value ELSE value END)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
    SELECT event_id, user_id, round(total - least(min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS balance FROM t"""
)
def storage_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", -3 * F.col("value")).otherwise(F.col("value"))
    out = J.running_floor(events.withColumn("amount", amount), "user_id", ["ts", "event_id"], "amount")
    return out.select("event_id", "user_id", F.round("balance", 4).alias("balance"))


@query(
    f"""SELECT id, CASE status WHEN 'done' THEN '已完成' WHEN 'process' THEN '进行中' ELSE '队列中' END AS status_label,
    CASE id % 6 WHEN 0 THEN 'Word' WHEN 1 THEN 'PDF' WHEN 2 THEN '文本' WHEN 3 THEN 'Excel' WHEN 4 THEN '其他' ELSE '未知' END AS file_type FROM {JOBS_SQL}"""
)
def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(x) for x in ("a.b.DOCX", "x.pdf", "n.Md", "t.xls", "noext", "")]), (F.col("id") % 6 + 1).cast("int"))
    return J.job_listing(T.jobs(spark, sf_dir)).select("id", "status_label", labels.file_type(names).alias("file_type"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, o_orderdate AS created, l_shipdate AS fin,
      CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_shipdate - INTERVAL (l_partkey % 90000) SECOND ELSE l_shipdate + INTERVAL 5 SECOND END AS st
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    e AS (SELECT *, date_diff('second', st, fin) AS own, date_diff('second', created, fin) AS fb FROM d),
    f AS (SELECT *, CASE WHEN own >= 0 THEN own WHEN fb >= 0 THEN fb END AS s FROM e)
    SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL THEN '--' ELSE concat(s // 60, '分', s % 60, '秒') END AS elapsed,
    CASE WHEN own >= 0 THEN concat(own // 60, '分', own % 60, '秒') ELSE '--' END AS elapsed_admin,
    CASE WHEN own IS NULL THEN NULL WHEN own < 60 THEN concat(own, '秒') WHEN own < 3600 THEN concat(own // 60, '分', own % 60, '秒')
      ELSE concat(own // 3600, '小时', (own % 3600) // 60, '分') END AS tiers FROM f"""
)
def elapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "lineitem").join(T.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    third, end = F.col("l_linenumber") % 3, F.col("l_shipdate")
    start = F.when(third == 1, end - F.make_dt_interval(secs=(F.col("l_partkey") % 90000).cast("decimal(18,6)"))).when(
        third == 2, end + F.expr("INTERVAL 5 SECONDS")
    )
    lines = lines.withColumn("st", start.cast("timestamp_ntz"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        times.elapsed(F.col("o_orderdate"), F.col("st"), end).alias("elapsed"),
        times.elapsed_started(F.col("st"), end).alias("elapsed_admin"),
        times.elapsed_tiers(F.col("st"), end).alias("tiers"),
    )


@query(
    f"""WITH e AS (SELECT event_id, ts, date_diff('second', {EVENTS_NOW_SQL}, ts + INTERVAL 7 DAY) AS s FROM events)
    SELECT event_id, (CASE WHEN s <= 0 THEN 0 ELSE least(greatest(s // 86400 + 1, 1), 7) END)::INTEGER AS days_left, s <= 0 AS expired,
    date_diff('second', ts, {EVENTS_NOW_SQL}) > 86400 AS over_a_day FROM e"""
)
def media_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, expires = J.stamp(T.EVENTS_NOW), F.col("ts") + F.expr("INTERVAL 7 DAYS")
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return events.select(
        "event_id", times.days_left(expires, now).alias("days_left"), times.is_expired(expires, now).alias("expired"), times.older_than(F.col("ts"), now, 24).alias("over_a_day")
    )


ORACLE_SQL["media_expiry"] = ORACLE_SQL["media_expiry"].replace("FROM events)", "FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))")


@query(
    f"""WITH s AS (SELECT id, size * 200 AS b, (id % 20000) AS w FROM {JOBS_SQL})
    SELECT id, b / 1048576 > 5 OR w > 10000 AS streaming, (CASE WHEN NOT (b / 1048576 > 5 OR w > 10000) THEN 10 WHEN b / 1048576 > 50 THEN 5
    WHEN b / 1048576 > 20 THEN 8 ELSE 10 END)::INTEGER AS chunk FROM s"""
)
def streaming_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = times.streaming_policy(F.col("size") * 200, F.col("id") % 20000)
    return T.jobs(spark, sf_dir).select("id", policy.alias("p")).select("id", "p.streaming", "p.chunk")


@query(
    """WITH s AS (SELECT event_id, (value * 1000)::BIGINT AS s FROM events)
    SELECT event_id, '用时' || CASE WHEN s >= 86400 THEN (s // 86400) || '天' ELSE '' END || CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || '小时' ELSE '' END
    || CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || '分钟' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60) || '秒' ELSE '' END AS spent FROM s"""
)
def spent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.round(F.col("value") * 1000).cast("long")
    return T.table(spark, sf_dir, "events").select("event_id", times.spent_text(seconds).alias("spent"))


ORACLE_SQL["spent_labels"] = ORACLE_SQL["spent_labels"].replace("(value * 1000)::BIGINT", "round(value * 1000)::BIGINT")


@query(f"SELECT id, created_at, row_number() OVER (ORDER BY created_at, id)::INTEGER AS place FROM {JOBS_SQL} WHERE status = 'queued' ORDER BY created_at, id LIMIT 5")
def fifo_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.admit(T.jobs(spark, sf_dir), slots=9).select("id", "created_at", "place")


@query(
    f"""WITH p AS (SELECT *, id % 60 AS pages FROM {JOBS_SQL}), r AS (SELECT *, status IN ('process', 'changing') AS run FROM p)
    SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'process') AS process, count(*) FILTER (status = 'changing') AS changing,
    count(*) FILTER (run AND pages > 25) AS large_running, count(*) FILTER (run AND pages <= 25) AS small_running,
    greatest(4 - count(*) FILTER (run AND pages > 25), 0) AS small_slots FROM r"""
)
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.queue_status(T.jobs(spark, sf_dir).withColumn("pages", F.col("id") % 60))


@query(
    """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events"""
)
def call_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.calls_last_minute(T.table(spark, sf_dir, "events"), "user_id", seconds=3600, limit=2).select("event_id", "user_id", "in_window", "over_limit")


@query(f"SELECT id, created_at FROM {JOBS_SQL} WHERE status = 'process' AND id % 2 = 0 AND created_at < {NOW_SQL} - INTERVAL 6 HOUR")
def zombie_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = T.jobs(spark, sf_dir).withColumn("remote_id", F.when(F.col("id") % 2 != 0, F.col("id")))
    return Q.zombies(jobs, J.stamp(T.NOW)).select("id", "created_at")


@query(
    f"""SELECT id, CASE WHEN status = 'done' OR id % 11 = 0 THEN 'none' ELSE status END AS status, CASE WHEN status = 'done' OR id % 11 = 0 THEN 0.0 ELSE 50.0 END AS process FROM {JOBS_SQL}"""
)
def restarted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.restarted(_with_failures(T.jobs(spark, sf_dir)).withColumn("process", F.lit(50.0))).select("id", "status", "process")


@query(
    f"""SELECT DISTINCT id, unnest(CASE id % 3 WHEN 0 THEN ['en', 'fr'] WHEN 1 THEN ['de'] ELSE ['en', 'de', 'es'] END) AS language FROM {JOBS_SQL}"""
)
def language_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.element_at(F.array(F.lit("en, fr,en"), F.lit("de,,"), F.lit("en,de,es")), (F.col("id") % 3 + 1).cast("int"))
    return Q.fan_out(T.jobs(spark, sf_dir).withColumn("languages", lists)).select("id", "language")


@query(
    f"""SELECT tenant_id, status, count(*) AS n, round(sum(size), 2) AS size FROM
    (SELECT c_nationkey AS tenant_id, j.status, j.size FROM {JOBS_SQL} j JOIN customer ON c_custkey = customer_id) GROUP BY ROLLUP (tenant_id, status)"""
)
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = T.jobs(spark, sf_dir).join(T.memberships(spark, sf_dir).select("tenant_id", "customer_id"), "customer_id")
    return both.rollup("tenant_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("size"))


@query(
    f"""SELECT batch, count(*) AS jobs, count(*) FILTER (status = 'done') AS done FROM
    (SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY id) - 1) // 3 AS batch FROM {JOBS_SQL}) GROUP BY 1"""
)
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy("id")) - 1
    batched = T.jobs(spark, sf_dir).withColumn("batch", F.floor(place / 3))
    return batched.groupBy("batch").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "done").alias("done"))
