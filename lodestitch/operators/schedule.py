"""When calls are made: least spacing, waits between attempts, siblings that stop.

Times are microseconds of a virtual clock, so a schedule is a table that can be planned, checked and
replayed. Spacing is a closed form: the k-th call of a key starts at the greatest of
``arrival_j + (k - j) * gap`` over the calls j up to it, which is a running maximum and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MOST_ATTEMPTS = 10
#: What a failing call says, and what follows.
#: busy: tried again after 2, 4, 6 ... seconds; refused: the result stays empty; denied: once more by the backup, then the job fails.
KINDS = ("busy", "refused", "denied")


def spaced_starts(calls: DataFrame, key: str, order: list[str], at: str = "at", seconds: float = 0.05) -> DataFrame:
    """``calls`` with ``start``: not before their arrival ``at`` (microseconds), and at least ``seconds`` after the call
    before them in ``order`` of their key. Null keys are a key of their own."""
    gap = round(seconds * SECOND)
    ordered = Window.partitionBy(key).orderBy(*order)
    place = F.row_number().over(ordered).cast("long")
    numbered = calls.withColumn("_place", place)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("start", F.max(F.col(at) - F.col("_place") * gap).over(upto) + F.col("_place") * gap).drop("_place")


def waits_before(attempt: Column) -> Column:
    """Microseconds waited in all before an attempt (from 0): 2, 4, 6 ... seconds make n (n + 1)."""
    return attempt * (attempt + 1) * SECOND


def attempts(calls: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """job, call, attempt (from 0), at, model and outcome of every attempt of ``calls`` (job, call, start, took, kind, failures).

    A call fails ``failures`` times with ``kind``, then works; each attempt takes ``took``. A busy call is tried ``most``
    times, after waits; a refused one stays empty at its first attempt; a denied one goes to the backup at once, and where that
    fails too, its job fails: attempts of its siblings that would begin later are not made. Outcomes: done,
    again, empty, kept (the text as it was), failed."""
    fails = F.greatest(F.coalesce("failures", F.lit(0)), F.lit(0)).cast("long")
    tries = F.when(fails == 0, 1).when(F.col("kind") == "busy", F.least(fails + 1, F.lit(most))).when(F.col("kind") == "denied", 2).otherwise(1)
    spread = calls.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("long"), tries.cast("long") - 1)))
    waited = F.when(F.col("kind") == "busy", waits_before(F.col("attempt"))).otherwise(F.lit(0))
    spread = spread.withColumn("at", F.col("start") + F.col("attempt") * F.col("took") + waited)
    failing = F.col("attempt") < fails
    outcome = (
        F.when(~failing, "done")
        .when(F.col("kind") == "busy", F.when(F.col("attempt") + 1 < most, "again").otherwise("kept"))
        .when(F.col("kind") == "denied", F.when(F.col("attempt") == 0, "again").otherwise("failed"))
        .otherwise("empty")
    )
    model = F.when((F.col("kind") == "denied") & (F.col("attempt") > 0), "backup").otherwise("primary")
    told = spread.select("job", "call", "attempt", "at", model.alias("model"), outcome.alias("outcome"), (F.col("at") + F.col("took")).alias("_ends"))
    ends = told.where("outcome = 'failed'").groupBy(F.col("job").alias("_job")).agg(F.min("_ends").alias("_stop"))
    kept = told.join(ends, F.col("job").eqNullSafe(F.col("_job")), "left").drop("_job")
    return kept.where(F.col("_stop").isNull() | (F.col("at") < F.col("_stop"))).drop("_ends", "_stop")


def job_outcomes(made: DataFrame) -> DataFrame:
    """job, calls, attempts, state: a job fails with a denied call; texts that stay as they were or empty do not stop it."""
    return made.groupBy("job").agg(
        F.count_distinct("call").alias("calls"), F.count("*").alias("attempts"), F.when(F.max((F.col("outcome") == "failed").cast("int")) == 1, "failed").otherwise("done").alias("state")
    )
