"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact join.

A rule is ``host/path``; it fits its host and every subdomain, for URL paths that start
with its path, and the longest fitting rule wins. The canonical key of a rule is its host with
its path's directory; a URL has one for each host suffix and each directory above it, down to the greatest
depth that the list holds, so a very long URL costs no more than that. The Bloom filter of the listed keys, whose size
has a fixed upper bound, is probed on the page's own row, before any shuffle; pages without a
possible hit are done. The others are joined to the listed directories, which removes false
positives, and by the lengths that a directory lists to the exact rules. A saturated filter
costs time, never a wrong verdict.

Defined results: null URLs and URLs without ``://`` have empty host and path and get the
default verdict; an empty rule list gives every row the default; repeated rows are judged
alike; repeated rules are merged (``block`` wins over ``allow``); only the key and URL columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WORDS_PER_BLOCK = 8
BITS_PER_RULE = 16
#: Upper bound of the broadcast filter: 2**17 blocks of 64 bytes are 8 MiB.
MAX_BLOCKS = 1 << 17


def _words(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its 8 word positions and the one bit set in each of them."""
    h = h.astype(np.uint64)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    low = h & np.uint64((1 << 40) - 1)
    lane = np.arange(WORDS_PER_BLOCK, dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15) * (lane * np.uint64(2) + np.uint64(1))
    with np.errstate(over="ignore"):
        bit = ((low[:, None] + np.uint64(1)) * odd[None, :]) >> np.uint64(58)
    return block[:, None] * np.uint64(WORDS_PER_BLOCK) + lane[None, :], np.uint64(1) << bit


def build_filter(keys: DataFrame, column: str, n_keys: int, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter's words. Tasks make (word, bits) rows, ``bit_or`` merges them before and
    after the shuffle, and at most ``8 * max_blocks`` words reach the driver."""
    blocks = 1
    while blocks < max_blocks and blocks * 512 < n_keys * BITS_PER_RULE:
        blocks *= 2

    def rows(batches):
        for pdf in batches:
            at, bits = _words(pdf["h"].to_numpy().view(np.uint64), blocks)
            yield pd.DataFrame({"word": at.ravel().astype(np.int64), "bits": bits.ravel().view(np.int64)})

    merged = (
        keys.select(F.xxhash64(column).alias("h"))
        .mapInPandas(rows, "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    words = np.zeros(blocks * WORDS_PER_BLOCK, np.uint64)
    words[merged["word"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _possible(words):
    """Batches with, in place of the hashes, the places (from 0) of those that the filter lets through."""

    def probe(batches):
        for batch in batches:
            table, hashes = words.value, batch.column("hashes")
            at, bits = _words(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), len(table) // WORDS_PER_BLOCK)
            through = ((table[at.astype(np.int64)] & bits) == bits).all(axis=1)
            ends = np.r_[0, np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False))]
            passed = np.r_[0, np.cumsum(through)][ends]
            place = np.arange(len(through)) - np.repeat(ends[:-1], np.diff(ends))
            possible = pa.ListArray.from_arrays(pa.array(passed, pa.int32()), pa.array(place[through], pa.int32()))
            columns = [possible if n == "hashes" else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["possible" if n == "hashes" else n for n in batch.schema.names])

    return probe


def _directory(path: Column) -> Column:
    """A path up to its last separator."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _directories(host: Column, path: Column, labels: int, separators: int) -> Column:
    """Canonical keys of a URL: each host suffix of at most ``labels`` labels with each of the path's
    directories of at most ``separators`` separators, and with none. Deeper ones than the list holds cannot be
    listed, so a very long URL costs no more than its listed depth."""
    parts = F.split(host, r"\.")
    own = F.least(F.size(parts), F.lit(labels))
    hosts = lambda p: F.transform(F.sequence(F.lit(1), own), lambda i: F.array_join(F.slice(p, -i, i), "."))
    # The last piece is what stands behind the deepest directory that counts.
    paths = lambda c: F.transform(c, lambda _, i: F.concat(F.array_join(F.slice(c, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    cuts = F.split(path, "/", separators + 1)
    each = lambda hs, ps: F.flatten(F.transform(hs, lambda h: F.transform(ps, lambda p: F.concat(h, p))))
    return shared.let(hosts(parts), lambda hs: shared.let(shared.let(cuts, paths), lambda ps: each(hs, ps)))


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``pages`` with the verdict of ``rules`` (columns rule, verdict) on each URL.

    Returns key, host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    rule_host, rule_path = F.regexp_extract("rule", r"(?s)^([^/]*)", 1), F.regexp_extract("rule", r"(?s)^[^/]*(.*)", 1)
    listed = shared.materialize(
        rules.where(F.col("rule").isNotNull())
        .select(F.concat(shared.ascii_lower(rule_host), rule_path).alias("rule"), "verdict")
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("directory", F.concat(rule_host, _directory(rule_path))),
        "rules",
    )
    directories = shared.materialize(
        listed.groupBy("directory").agg(F.collect_set(F.length("rule") - F.length("directory")).alias("tails")), "directories"
    )
    labels, separators = directories.agg(
        F.max(F.size(F.split(F.regexp_extract("directory", r"(?s)^([^/]*)", 1), r"\."))), F.max(F.length("directory") - F.length(F.replace("directory", F.lit("/"))))
    ).first()
    keys = lambda: _directories(F.col("host"), F.col("path"), labels or 1, separators or 0)
    words = spark.sparkContext.broadcast(build_filter(directories, "directory", directories.count(), max_blocks))
    asked = pages.select(F.col(key).alias(key), shared.host_of(F.col(url)).alias("host"), shared.path_of(F.col(url)).alias("path"))
    hashes = F.transform(keys(), lambda k: F.xxhash64(k))
    # The filter is probed on the page's own row; only rows that may be hit are shuffled.
    hashed = asked.withColumn("hashes", hashes)
    schema = T.StructType([*asked.schema.fields, T.StructField("possible", T.ArrayType(T.IntegerType()))])
    probed = shared.materialize(hashed.mapInArrow(_possible(words), schema).withColumn("row", F.monotonically_increasing_id()), "probed")
    missed = probed.where(F.size("possible") == 0).select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hit = (
        probed.where(F.size("possible") > 0)
        .select(key, "host", "path", "row", F.explode(shared.let(keys(), lambda ks: F.transform("possible", lambda i: F.element_at(ks, i + 1)))).alias("directory"))
    )
    rest = F.regexp_extract("directory", r"(?s)^[^/]*(.*)", 1)
    sized = hit.join(shared.maybe_broadcast(directories), "directory", "left").withColumn("rest", F.substring(F.col("path"), F.length(rest) + 1, F.length("path")))
    keyed = sized.select(
        key, "host", "path", "row",
        F.explode_outer(F.transform(F.filter("tails", lambda n: n <= F.length("rest")), lambda n: F.concat("directory", F.substring(F.col("rest"), F.lit(1), n)))).alias("rule"),
    )
    best = (
        keyed.join(shared.maybe_broadcast(listed.select("rule", "verdict")), "rule", "left")
        .groupBy("row")
        .agg(
            F.first(F.struct(F.col(key).alias("key"), "host", "path")).alias("page"),
            F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"),
        )
    )
    judged = best.select(
        F.col("page.key").alias(key), F.col("page.host").alias("host"), F.col("page.path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return missed.unionByName(judged)
