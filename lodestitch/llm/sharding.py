"""Sharding by a keyed permutation: a Feistel network with cycle walking over row numbers.

Rows are numbered by (doc_id, text hash) with one narrow range sort; a row's number goes
through the permutation of ``[0, n)`` and gives shard and slot by division, so both can be
computed (and inverted) from the number alone. Only narrow rows are shuffled, texts never.
Law ``rows``: shard sizes differ by at most one, slots run from 0 without gaps.

Defined results: a null text has size 1 and CRC 0 (as the empty text); null ids are
numbered first; repeated rows each get a slot of their own; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

ROUNDS = 6
SEED = 20240229


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as the round function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round_key(seed: int, r: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF


def _once(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_mix(left, _round_key(seed, r)) & mask), left
        else:
            left, right = right, left ^ (_mix(right, _round_key(seed, r)) & mask)
    return (left << np.uint64(bits)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Images of row numbers under the permutation of ``[0, n)`` (``back``: their origins).

    Values that leave the range walk on along their cycle until they return to it."""
    out = np.array(rows, dtype=np.uint64)
    todo = np.arange(len(out))
    bits = _half_bits(n)
    while len(todo):
        out[todo] = _once(out[todo], bits, seed, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(narrow: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``narrow`` with a gapless ``row_no`` by ``order``, and the row count.

    The sorted rows are written once, as range boundaries are sampled anew on every run."""
    at = shared.materialize(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("mid", 33)
    counts = sorted((r["part"], r["count"]) for r in at.groupBy(part.alias("part")).count().collect())  # one per partition
    starts, n = [], 0
    for p, c in counts:
        starts.append((p, n))
        n += c
    table = at.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = (
        at.withColumn("part", part)
        .join(F.broadcast(table), "part")
        .withColumn("row_no", F.col("start") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("part", "start", "mid")
    )
    return numbered, n


def shard_documents(docs: DataFrame, *, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no for every document."""
    if shards < 1:
        raise ValueError("shards must be positive")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    numbered, n = number_rows(narrow, ["doc_id", "text_hash", "text_crc32", "size"])

    @F.pandas_udf(T.LongType())
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(np.int64), n, seed))

    return numbered.withColumn("place", place("row_no")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot") if shards & (shards - 1) else F.shiftright("place", shards.bit_length() - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
