"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

Weights are given to the sources in code-point order, null last, in repetition. The sources
share ``budget`` times all words by weight; a target stops at ``cap`` times its source's
size, and the excess goes to the others by weight (the water level is found in one sorted
pass over the per-source table). Within a source, documents stand in a hashed order; the
source's weight over time is ``1 + a (1 - 2t)`` of its mean, which integrates to the demand
``(1 + a) t - a t^2``. Inverting that at a document's cumulative words gives the time, its
training position; documents are range-sorted by it. A document is taken once for each
pass in which its middle word lies within the target, so a source misses its target by at
most half a document.

A document's place in the hashed order has 60 bits and their first ones are its bucket, so the
order does not depend on the number of buckets. Cumulative sums are taken per (source, bucket) and the buckets' totals are summed on
their own, so that a source with a third of all rows is many small windows.

Defined results: null texts have size 0 and are taken 0 words; null is a source, the last;
repeated rows are separate documents (those of one id and text share a bucket); empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Most times that a source is taken.
CAP = 2.0
PLACE_BITS = 60
ROWS_PER_BUCKET = 4096
LEAST_BUCKET_BITS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key() -> Column:
    """A document's place in its source's shuffled order: 60 bits of a digest."""
    own = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    digest = F.md5(F.concat(own, F.lit(":"), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, cap: float = CAP, tilt: float = 0.5) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target, tilt.

    ``sizes`` has source and source_size, a row per source; only that table meets in one task."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    fill = ranked.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("full_at", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fill = fill.withColumn("level", level)
    fill = fill.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    sources = F.max("rank").over(everything)
    return fill.select(
        "source",
        "source_size",
        "rank",
        "weight",
        F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
        F.when(sources > 1, tilt * (1 - 2 * (F.col("rank") - 1) / (sources - 1))).otherwise(F.lit(0.0)).alias("tilt"),
    )


def _plan(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their cumulative words, the targets, and the most passes that a source gets."""
    narrow = shared.materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key().alias("place")), "sizes")
    bits, rows = LEAST_BUCKET_BITS, narrow.count()
    while ROWS_PER_BUCKET << bits < rows and bits < 24:
        bits += 1
    targets = shared.materialize(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")
    placed = (
        narrow.withColumnRenamed("source", "own")
        .join(shared.maybe_broadcast(targets, 100_000), F.col("own").eqNullSafe(F.col("source")))
        .select("doc_id", "size", "place", "rank", "source_size", "target", "tilt", F.shiftright("place", PLACE_BITS - bits).alias("bucket"))
    )
    starts = (
        placed.groupBy("rank", "bucket")
        .agg(F.sum("size").alias("inside"))
        .withColumn("start", F.sum("inside").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("inside"))
        .drop("inside")
    )
    inner = Window.partitionBy("rank", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["rank", "bucket"])
    return summed.withColumn("middle", F.col("start") + F.col("before") + F.col("size") / 2), targets, max(1, math.ceil(options.get("cap", CAP)))


def _taken_in(p: int) -> Column:
    fits = p * F.col("source_size") + F.col("middle") <= F.col("target")
    return fits if p == 0 else fits & (F.col("size") > 0)


def _position(p: int) -> Column:
    u = F.when(F.col("target") > 0, (p * F.col("source_size") + F.col("middle")) / F.col("target")).otherwise(F.lit(0.0))
    a = F.col("tilt")
    t = F.when(a == 0, u).otherwise(((1 + a) - F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * u, F.lit(0.0)))) / (2 * F.when(a != 0, a)))
    return F.when(_taken_in(p), t)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document, sorted by first training position (documents left out come last):
    doc_id, size, source_size, target, taken, position, second_position."""
    summed, _, most = _plan(docs, **options)
    passes = sum((_taken_in(p).cast("long") for p in range(1, most)), _taken_in(0).cast("long"))
    return summed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * passes).alias("taken"),
        F.round(_position(0), 12).alias("position"),
        F.round(_position(1), 12).alias("second_position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def draw_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole rows of ``docs``, one for each pass that takes them, sorted
    by the training position of that pass.

    Positions are found on narrow rows and joined by source and place. Rows that agree in both
    are copies of one document, and are dealt the copies' positions by their number."""
    summed, targets, most = _plan(docs, **options)
    key, turn, copies, position = (shared.fresh(docs, f"mix_{x}") for x in ("key", "turn", "copies", "position"))
    passes = F.filter(F.array(*map(_position, range(most))), lambda x: x.isNotNull())
    taken = summed.select("rank", "place", passes.alias("passes")).groupBy("rank", "place").agg(F.sort_array(F.collect_list("passes")).alias(copies))
    names = targets.select(F.col("rank").alias("r"), "source")
    taken = taken.join(shared.maybe_broadcast(names, 100_000), F.col("rank") == F.col("r")).select(F.struct("source", "place").alias(key), copies)
    taken = shared.materialize(taken.where(F.exists(copies, lambda x: F.size(x) > 0)), "positions")
    keyed = docs.withColumn(key, F.struct(F.col("source").alias("source"), order_key().alias("place"))).join(taken, key)
    # Texts meet by key once more only where there are such copies.
    repeated = taken.where(F.size(copies) > 1).limit(1).count() > 0
    dealt = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy("doc_id")) if repeated else F.lit(1))
    drawn = dealt.withColumn(position, F.explode(F.element_at(copies, F.col(turn))))
    return drawn.orderBy(position, "doc_id").select(*docs.columns)
