"""Job, tenant and token analytics over job-shaped DataFrames.

Functions take DataFrames with the columns they name and return lazy plans. Optional
filters apply only where their argument is given; ``tenant_id`` None means every tenant and
is meant for super administrators alone (callers fail closed otherwise). Orders carry the id
as last key, so results are the same on every run.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import labels

TREND_STATUSES = ("done", "process", "failed", "queued", "none")
USER_FILTER = ("none", "changing", "process", "done", "failed")
ADMIN_FILTER = ("none", "process", "done", "failed")


def stamp(value: str | Column) -> Column:
    return F.to_timestamp_ntz(F.lit(value)) if isinstance(value, str) else value


# ---- guards --------------------------------------------------------------------------


def check_page(page: int, limit: int) -> tuple[int, int]:
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1 and limit from 1 to 100")
    return page, limit


def check_range(start: str | None, end: str | None) -> None:
    if start and end and datetime.fromisoformat(start) > datetime.fromisoformat(end):
        raise ValueError("start lies after end")


def check_ids(ids, most: int = 100) -> list[int]:
    out = [int(x) for x in ids]
    if not out or len(out) > most:
        raise ValueError(f"1 to {most} ids are accepted")
    return out


def check_status(status: str, domain=USER_FILTER) -> str:
    if status not in domain:
        raise ValueError(f"unknown status {status!r}")
    return status


# ---- filters -------------------------------------------------------------------------


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted (all, where the table has no such flag)."""
    return df.where(F.col("deleted_flag") == "N") if "deleted_flag" in df.columns else df


def of_tenant(jobs: DataFrame, members: DataFrame, tenant_id: int | None) -> DataFrame:
    """Jobs of a tenant's customers; membership is unique, so a semi join suffices."""
    if tenant_id is None:
        return jobs
    return jobs.join(members.where(F.col("tenant_id") == tenant_id).select("customer_id"), "customer_id", "left_semi")


def matching(df: DataFrame, columns: list[str], keyword: str | None, case: bool = False) -> DataFrame:
    """Containment in any of the columns, case-blind unless ``case`` is set; ``%`` and ``_`` in the
    keyword are wildcards."""
    if not keyword:
        return df
    out = F.lit(False)
    for c in columns:
        held = F.col(c).like(f"%{keyword}%") if case else F.col(c).ilike(f"%{keyword}%")
        out = out | F.coalesce(held, F.lit(False))
    return df.where(out)


def without(df: DataFrame, column: str, skipped: list) -> DataFrame:
    """NOT IN; an empty list, or one that opens with an empty value, filters nothing."""
    return df.where(~F.col(column).isin(*skipped)) if skipped and skipped[0] not in ("", None) else df


def page_of(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    page, limit = check_page(page, limit)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


# ---- dashboards ----------------------------------------------------------------------


def status_distribution(jobs: DataFrame) -> DataFrame:
    """status, n for the fixed domain; missing ones 0, others (``changing``) left out."""
    domain = jobs.sparkSession.createDataFrame([(s,) for s in TREND_STATUSES], "status string")
    counts = live(jobs).groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(F.lit(0.0))


def dashboard_stats(jobs: DataFrame, members: DataFrame, now: str, quota: float) -> DataFrame:
    """One row: jobs and active users today, success rate, used storage and its share."""
    today = F.date_trunc("day", stamp(now)).cast("timestamp_ntz")
    fresh = F.col("created_at") >= today
    stats = live(jobs).agg(
        F.count_if(fresh).alias("today_jobs"),
        F.count_distinct(F.when(fresh, F.col("customer_id"))).alias("active_users"),
        percent(F.count_if(F.col("status") == "done"), F.count("*")).alias("success_rate"),
    )
    used = members.agg(F.coalesce(F.sum("storage"), F.lit(0.0)).alias("used"))
    return stats.join(used, F.lit(True)).select(
        "today_jobs", "active_users", "success_rate", F.round("used", 2).alias("used_storage"), percent(F.col("used"), F.lit(quota)).alias("used_percent")
    )


def daily_trend(jobs: DataFrame, now: str, days: int, include_today: bool = False) -> DataFrame:
    """day, n for each of the ``days`` days before today, days without jobs as 0."""
    today = F.to_date(stamp(now))
    last = today if include_today else F.date_sub(today, 1)
    spine = jobs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days), last)).alias("day"))
    counts = (
        live(jobs)
        .where((F.col("created_at") >= F.date_sub(today, days).cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(today, 1).cast("timestamp_ntz")))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    return F.broadcast(spine).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def recent_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return live(jobs).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def job_statistics(jobs: DataFrame) -> DataFrame:
    """total, done, processing, failed over all rows, deleted ones included."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.agg(F.count("*").alias("total"), count("done").alias("done"), count("process").alias("processing"), count("failed").alias("failed"))


def finished_per_user(jobs: DataFrame) -> DataFrame:
    return live(jobs).where("status = 'done'").groupBy("customer_id").agg(F.count("*").alias("finished"))


def storage_per_user(jobs: DataFrame, quota: float) -> DataFrame:
    """Summed sizes, never below 0, with the share of the quota as text, both half up. Sizes count to a millionth
    (what is no number or over 22 digits counts nothing), so sums are exact and do not depend on their order."""
    size = F.col("size").try_cast("decimal(28,6)")
    used = F.greatest(F.coalesce(F.sum(size), F.lit(0)), F.lit(0))
    summed = live(jobs).groupBy("customer_id").agg(used.cast("decimal(38,6)").alias("used"))
    hundredths = F.expr(f"(20000 * used + {quota:.6f}BD) div (2 * {quota:.6f}BD)") if quota else F.lit(0)
    share = F.concat(F.expr("h div 100").cast("string"), F.lit("."), F.lpad((F.col("h") % 100).cast("string"), 2, "0"))
    return summed.withColumn("h", hundredths).select("customer_id", F.round("used", 2).cast("double").alias("used"), share.alias("percent"))


def storage_repair(jobs: DataFrame, members: DataFrame) -> DataFrame:
    """Customers whose stored usage differs from their jobs' sizes, and by how much."""
    real = live(jobs).groupBy("customer_id").agg(F.sum("size").alias("real"))
    both = members.select("customer_id", "storage").join(real, "customer_id", "left")
    real = F.greatest(F.coalesce("real", F.lit(0.0)), F.lit(0.0))
    return both.select("customer_id", F.round("storage", 2).alias("stored"), F.round(real, 2).alias("recomputed"), F.round(F.col("storage") - real, 2).alias("diff")).where(
        "diff != 0"
    )


def tenant_quota(members: DataFrame, tenants: DataFrame, quota: float) -> DataFrame:
    """Allocated, available and used share of every tenant; tenants without members show 0."""
    allocated = members.groupBy("tenant_id").agg(F.sum("storage").alias("allocated"), F.count("*").alias("members"))
    out = tenants.join(allocated, "tenant_id", "left").withColumn("allocated", F.coalesce("allocated", F.lit(0.0)))
    return out.select(
        "tenant_id",
        "tenant_name",
        F.coalesce("members", F.lit(0)).alias("members"),
        F.round("allocated", 2).alias("allocated"),
        F.round(quota - F.col("allocated"), 2).alias("available"),
        percent(F.col("allocated"), F.lit(quota)).alias("usage_percent"),
    )


def quota_exceeded(allocated: Column, extra: Column, quota: Column) -> Column:
    """struct(exceeded, message): whether the extra storage still fits, in GB with two decimals."""
    over = allocated + extra > quota
    gb = lambda c: F.format_string("%.2f", c / float(1 << 30))
    return F.struct(over.alias("exceeded"), F.when(over, F.concat(gb(allocated + extra), F.lit(" > "), gb(quota))).alias("message"))


def token_rollup(calls: DataFrame, statuses: str | list[str] = "all") -> DataFrame:
    """Tokens per job over all calls, or over those of the given statuses."""
    if statuses != "all":
        calls = calls.where(F.col("status").isin(*statuses))
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return calls.groupBy("translate_id").agg(
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.round(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0.0)), 2).alias("total_tokens"),
        F.count("*").alias("calls"),
    )


def job_progress(calls: DataFrame) -> DataFrame:
    """Completed share of each job's calls in percent, one decimal, for jobs under way."""
    done = F.count_if(F.col("status") == "success")
    counted = calls.groupBy("translate_id").agg(done.alias("complete"), F.count("*").alias("total"))
    return counted.where("complete != total").select("translate_id", "complete", "total", F.round(100.0 * F.col("complete") / F.col("total"), 1).alias("progress"))


# ---- lists and searches --------------------------------------------------------------


def search_jobs(jobs: DataFrame, owners: DataFrame, keyword: str | None, columns: list[str]) -> DataFrame:
    """Jobs with their owner's email (``--`` if unknown). With a keyword, jobs without a
    known owner are left out, and job or email must contain it."""
    named = jobs.join(owners.select("customer_id", "email"), "customer_id", "inner" if keyword else "left")
    return matching(named, [*columns, "email"], keyword).withColumn("email", F.coalesce("email", F.lit("--"))).distinct()


def term_counts(bases: DataFrame, terms: DataFrame) -> DataFrame:
    """Every base with the number of its terms, 0 for none."""
    counts = terms.groupBy("base").agg(F.count("term_id").alias("terms"))
    return bases.join(counts, "base", "left").select(*bases.columns, F.coalesce("terms", F.lit(0)).alias("terms"))


def top_children(children: DataFrame, parent: str, key: str, k: int = 5) -> DataFrame:
    """The k children of each parent with the largest keys."""
    newest = Window.partitionBy(parent).orderBy(F.desc(key))
    return children.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)


def shared_list(items: DataFrame, favourites: DataFrame, user_id: int, order: str, page: int, limit: int) -> DataFrame:
    """Shared items with favourite count and own-favourite flag; order latest, added or fav."""
    counts = favourites.groupBy("item_id").agg(F.count("*").alias("favs"))
    own = favourites.where(F.col("user_id") == user_id).select("item_id").distinct().withColumn("own", F.lit(1))
    out = items.join(counts, "item_id", "left").join(own, "item_id", "left")
    out = out.withColumn("favs", F.coalesce("favs", F.lit(0))).withColumn("own", F.coalesce("own", F.lit(0)))
    first = {"latest": F.desc("updated_at"), "added": F.desc("created_at"), "fav": F.desc("favs")}.get(order)
    return page_of(out, [*([first] if first is not None else []), F.desc("item_id")], page, limit)


def latest_per_key(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("turn", F.row_number().over(newest)).where("turn = 1").drop("turn")


def valid_code(codes: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """The newest code of each user that is at most ``minutes`` old, to the microsecond."""
    fresh = codes.where(F.timestamp_diff("MICROSECOND", F.col("ts"), stamp(now)).between(0, minutes * 60_000_000))
    return latest_per_key(fresh, "user_id", "ts", "event_id")


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``requests`` (owner, url, source_lang, languages) with ``duplicate``: whether a live job of the same owner, url and source
    language has one of their target languages (jobs: owner, url, source_lang, language). A request's languages meet the jobs as
    rows; nulls equal nothing."""
    keys = ["owner", "url", "source_lang"]
    known = live(jobs).select(*keys, "language").distinct()
    asked = requests.select(*keys, "languages").distinct()
    hit = asked.withColumn("language", F.explode("languages")).join(known, [*keys, "language"], "left_semi").select(*keys, "languages").distinct()
    return requests.join(hit.withColumn("duplicate", F.lit(True)), [*keys, "languages"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def effective_settings(settings: DataFrame, tenant_id: int) -> DataFrame:
    """Settings with the tenant's values over the global ones; blank values fall through.
    One pass over the rows: the cascade is an aggregate, not a join."""
    own = F.max(F.when(F.col("tenant_id") == tenant_id, F.nullif("value", F.lit(""))))
    common = F.max(F.when(F.col("tenant_id").isNull(), F.col("value")))
    return settings.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant_id)).groupBy("alias").agg(F.coalesce(own, common).alias("value"))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Favourites after toggles: an odd number of them sets one."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).cast("int").alias("favourite"))


def running_floor(changes: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    """Balance per key after its changes in order, never below zero at any step. The closed
    form is the total less the lowest prefix sum (if that is below zero): plain windows."""
    ordered = Window.partitionBy(key).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = changes.withColumn("total", F.sum(amount).over(upto))
    return summed.withColumn("balance", F.col("total") - F.least(F.min("total").over(upto), F.lit(0.0))).drop("total")


def job_listing(jobs: DataFrame) -> DataFrame:
    """Jobs with status labels."""
    return jobs.withColumn("status_label", labels.status_label(F.col("status")))
