"""New versions of tables: gapless ids, copies with children, upserts, default rows, counts beside a result.

Tables are never changed in place; each operation is a DataFrame of the new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestitch.operators.jobs import check_page
from lodestitch.sources.shared import shared_path


def with_numbers(rows: DataFrame, order: list[str], name: str = "number", first: int = 0) -> DataFrame:
    """``rows`` with gapless numbers from ``first`` in the order of columns ``order`` (which should tell rows apart).

    A range sort deals the rows to parts, which are written with their part; a part's rows are numbered by themselves
    behind the offset of the parts before it. One row for each part meets in one place, never the rows."""
    spark, parts = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "numbered")
    rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(rows.withColumn("_part", F.lit(0)).schema).parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.join(F.broadcast(offsets), "_part")  # a row for each part
    return numbered.withColumn(name, F.col("_before") + place - 1 + F.lit(first)).drop("_part", "_before")


def copied(parents: DataFrame, children: DataFrame, wanted: Column, key: str = "id", link: str = "parent_id", fresh: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies of the parents that ``wanted`` picks, with their children: both get ids behind the greatest so far, in
    the order of the old ones, children are linked to the new parents, and ``fresh`` columns of the parents are
    set anew. ``copied_from`` keeps the old ids. A parent without children is copied alone."""
    top = parents.agg(F.coalesce(F.max(key), F.lit(0))).first()[0], children.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    picked = with_numbers(parents.where(wanted), [key], "_new", top[0] + 1)
    links = picked.select(F.col(key).alias("_old"), F.col("_new").alias("_parent"))
    own = children.join(links, F.col(link) == F.col("_old")).drop("_old")
    own = with_numbers(own, [key], "_new", top[1] + 1)
    new = picked.withColumn("copied_from", F.col(key)).withColumn(key, F.col("_new")).drop("_new").withColumns(fresh or {})
    return new, own.withColumn("copied_from", F.col(key)).withColumns({key: F.col("_new"), link: F.col("_parent")}).drop("_new", "_parent")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """The table after ``changes`` (its columns, a ``version`` and perhaps a flag ``deleted``): the latest version of
    each key, changes over what stood there; deleted keys go. Null keys are keys. A key's versions are compared as an
    aggregate, so a key with many changes is one row for each task."""
    columns = [c for c in current.columns if c not in keys]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    old = current.select(*keys, F.lit(None).cast(changes.schema[version].dataType).alias("_version"), F.lit(0).alias("_turn"), F.lit(False).alias("_gone"), *columns)
    new = changes.select(*keys, F.col(version).alias("_version"), F.lit(1).alias("_turn"), gone.alias("_gone"), *columns)
    order = F.struct("_turn", "_version")
    latest = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct("_gone", *columns), order).alias("_row"))
    return latest.where("NOT _row._gone").select(*keys, *[F.col("_row")[c].alias(c) for c in columns]).select(*current.columns)


def with_defaults(rows: DataFrame, owners: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """A row for every owner (columns ``keys``): its own, where it has one, else one of ``defaults``."""
    own = rows.withColumn("_own", F.lit(True))
    joined = owners.select(*keys).distinct().join(own, keys, "left")
    return joined.select(*keys, *[F.when(F.col("_own"), F.col(c)).otherwise(defaults.get(c, F.lit(None))).alias(c) for c in rows.columns if c not in keys])


def cleaned_ids(ids: Column) -> Column:
    """An array of ids as a comma list, blank and null ones left out; null for none."""
    kept = F.filter(ids, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.trim(x)), ","))


def page_with_total(df: DataFrame, order: list[Column], page: int, limit: int) -> tuple[list, int]:
    """The rows of a page (100 at most) and the number of all rows, from one job: the total is observed on the
    way to the top-k that makes the page."""
    page, limit = check_page(page, limit)
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).offset((page - 1) * limit).limit(limit).collect()
    return rows, seen.get["total"]


class LengthMismatch(Exception):
    """A batch came back with fewer or more rows than went out."""


def written_checked(sources: DataFrame, results: DataFrame, keys: list[str], path: str) -> dict:
    """``results`` of ``sources`` (same ``keys``), written to ``path`` if every source has exactly one; both are counted while
    they are written, not before. What does not fit stays under ``path``/_refused and raises."""
    told, seen = Observation(), Observation()
    asked = sources.select(*keys, F.lit(1).alias("_asked")).observe(told, F.count(F.lit(1)).alias("sources"))
    given = results.withColumn("_given", F.lit(1)).observe(seen, F.count(F.lit(1)).alias("results"))
    lone = Observation()
    joined = asked.join(given, keys, "full").observe(lone, F.count_if(F.col("_asked").isNull() | F.col("_given").isNull()).alias("alone"))
    joined.drop("_asked", "_given").write.mode("overwrite").parquet(f"{path}/_refused")
    counts = {**told.get, **seen.get, **lone.get}
    if counts["alone"] or counts["sources"] != counts["results"]:
        raise LengthMismatch(str(counts))
    spark = sources.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_refused")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows"))
    return counts
