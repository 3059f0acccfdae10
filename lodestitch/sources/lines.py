"""Text files by lines: numbered across their splits, worked on in chunks, written back byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.sources.shared import shared_path


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), text and last (whether no line end follows) of every line of UTF-8 files. Lines end with a
    line feed; a carriage return is part of its line, so nothing is lost.

    Files are split as Spark likes; a split's lines are numbered by themselves behind the counts of the splits before it in
    its file, so a file may be of any size."""
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    raw = read.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("turn"), F.col("value").alias("text"))
    table = shared_path(spark, "lines")
    raw.write.parquet(table)
    rows = spark.read.schema(raw.schema).parquet(table)
    # A split is read by one task from its first line to its last, so its lines have consecutive turns.
    blocks = rows.groupBy("path", "block", "size").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    file = Window.partitionBy("path").orderBy("block")
    before = F.coalesce(F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("path")
    offsets = blocks.select("path", "block", before.alias("before"), "first", F.sum("n").over(whole).alias("lines"), (F.sum("bytes").over(whole) > F.col("size")).alias("open"))
    # A row for each split, as a table of its own: where it is small it is broadcast, and the lines stay where they are.
    table = shared_path(spark, "line-offsets")
    offsets.write.parquet(table)
    offsets = spark.read.schema(offsets.schema).parquet(table)
    placed = rows.join(offsets, ["path", "block"]).withColumn("line", F.col("before") + F.col("turn") - F.col("first"))
    return placed.select("path", "line", "text", (F.col("open") & (F.col("line") == F.col("lines") - 1)).alias("last"))


def work_on_chunks(lines: DataFrame, work, out: str, size: int = 1000) -> DataFrame:
    """``lines`` with the texts that ``work`` (a DataFrame of path, line, text and chunk to path, line, text) gives, chunk by
    chunk of ``size`` lines. Finished chunks stand in the table ``out``; those that are there already are not worked on again,
    so a run that failed is taken up where it stopped. A line that ``work`` leaves out keeps its text."""
    spark = lines.sparkSession
    chunked = lines.withColumn("chunk", F.expr(f"line div {size}"))
    schema = chunked.select("path", "chunk", "line", "text").schema
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    done = spark.read.schema(schema).parquet(out) if there else None
    todo = chunked if done is None else chunked.join(done.select("path", "chunk").distinct(), ["path", "chunk"], "left_anti")
    worked = work(todo.select("path", "chunk", "line", "text")).select("path", "line", F.col("text").alias("_new"))
    todo.join(worked, ["path", "line"], "left").select("path", "chunk", "line", F.coalesce("_new", "text").alias("text")).write.mode("append").parquet(out)
    finished = spark.read.schema(schema).parquet(out).select("path", "line", "text")
    return lines.select("path", "line", "last").join(finished, ["path", "line"])


def replaced_lines(lines: DataFrame, patches: DataFrame, size: int = 1000) -> DataFrame:
    """``lines`` with the texts of ``patches`` (path, line, text) put in; both meet by chunks of ``size`` lines, and a patch
    behind the end of its file changes nothing."""
    chunk = F.expr(f"line div {size}").alias("chunk")
    new = patches.select("path", chunk, F.col("line").alias("p_line"), F.col("text").alias("p_text"))
    grouped = new.groupBy("path", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("p_line", "p_text"))).alias("p"))
    joined = lines.withColumn("chunk", chunk).join(grouped, ["path", "chunk"], "left")
    return joined.select("path", "line", F.coalesce(F.try_element_at("p", F.col("line")), F.col("text")).alias("text"), "last")


def write_files(lines: DataFrame, out: str, name) -> None:
    """The lines as files again, ``out``/file=<name of the path>. A file's lines are ranges of one sort, so a file
    of many lines is several parts whose names keep their order. Every line is as it was, carriage returns too; Spark's
    text writer ends each with a line feed, so a file that had none at its very end (column last) has one now."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.withColumn("file", name(F.col("path"))).repartitionByRange(parts, "file", "line").sortWithinPartitions("file", "line")
    ordered.select("file", F.col("text").alias("value")).write.partitionBy("file").text(out)
