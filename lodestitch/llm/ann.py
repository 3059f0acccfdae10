"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order; that representation is
computed once per distinct vector and written as a table, the index. The index is cut into
segments, and in a segment every vector is posted in the inverted file of each pivot of its
prefix, with its place there. A block of queries meets a segment once: only the posting lists
of a query's own pivots are read, they give the footrule distance of the permutations, the
nearest by that distance are reranked by exact Euclidean distance in double precision, and
the best of each segment are merged.

All sizes follow the square root of the number n of distinct vectors, without a switch: there
are ``pivots * sqrt(n)`` pivots (``MOST_PIVOTS`` at most, which bounds the broadcast), so a
posting list holds ``prefix / pivots * sqrt(n)`` of n vectors; ``candidates * sqrt(n)`` vectors
are reranked for a query; and a segment holds ``SEGMENT * sqrt(n)`` vectors. So a query's work
and its copies grow with the root of the table, not with the table. The index is copied once for each block of
``BLOCK_ROWS`` queries, which is as many as a task can hold beside a segment.

Equal vectors are one class in the index, which carries the rows of its k + 1 smallest distinct
ids, each at most k times. A query leaves out its own id, however often that stands, so k
other rows remain wherever there are as many; cuts are made by distinct ids throughout.

Defined results: vectors that are null, empty or zero, hold null or non-finite components,
or have another length than most, take no part; rows with a null id neither; repeated
(id, vector) rows count once each; ties in footrule distance and in distance go to the
smaller id, and rows are ordered by id before any arithmetic, so reruns agree whatever the
order of arrival; an empty table or one vector gives no rows. Only the id and vector columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Multiples of the root of the number of distinct vectors.
PIVOTS = 6.0
CANDIDATES = 16.0
SEGMENT = 36.0
#: Pivots of a vector that are kept, in order.
PREFIX = 64
MOST_PIVOTS = 1 << 16
BLOCK_ROWS = 1 << 17
SEED = 7


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _class_key() -> Column:
    return F.struct(F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    near = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1) if prefix < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int32)


def _inverted(prefixes: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted files of a segment: where each pivot's list starts, members, their places."""
    flat = prefixes.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    member, place = np.divmod(order, prefixes.shape[1])
    return starts, member, place


def _closeness(query: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How far each of n members stays below the largest footrule distance to a query, summed
    over the query's posting lists: a pivot in both prefixes lowers it by twice what is added."""
    starts, member, place = files
    out = np.zeros(n, np.int64)
    for at, pivot in enumerate(query):
        part = slice(starts[pivot], starts[pivot + 1])
        out[member[part]] += len(query) - np.maximum(place[part], at)
    return out


def search(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = 10,
    pivots: float = PIVOTS,
    prefix: int = PREFIX,
    candidates: float = CANDIDATES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & _usable(F.col("vector"))
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == sizes[0]["n"]).withColumn("class", _class_key())
    first = Window.partitionBy("class").orderBy("id")
    classes = shared.materialize(
        rows.groupBy("class", "id")
        .agg(F.count("*").alias("times"), F.first("vector").alias("vector"))
        .withColumn("turn", F.row_number().over(first))
        .where(F.col("turn") <= k + 1)
        .withColumn("copies", F.array_repeat("id", F.least("times", F.lit(k)).cast("int")))
        .groupBy("class")
        .agg(F.array_sort(F.flatten(F.collect_list("copies"))).alias("ids"), F.first("vector").alias("vector")),
        "classes",
    )
    asked = rows.where(F.col("id") % every == 0)
    asked_classes = shared.materialize(asked.groupBy("class").agg(F.first("vector").alias("vector")), "asked")
    n_classes, n_asked = classes.count(), asked_classes.count()
    root = max(n_classes, 1) ** 0.5
    n_pivots = max(2, min(MOST_PIVOTS, round(pivots * root)))
    drawn = classes.orderBy(F.xxhash64(F.lit(SEED), "class.k1", "class.k2"), "class").limit(n_pivots).select("vector").collect()
    centre = spark.sparkContext.broadcast(np.array([r["vector"] for r in drawn], np.float64))
    prefix, rerank = min(prefix, max(1, len(drawn) // 2)), candidates / root
    segments, blocks = max(1, round(n_classes / (SEGMENT * root))), max(1, -(-n_asked // BLOCK_ROWS))

    def represent(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 21) // len(centre.value))):
                part = batch.slice(at, max(1, (1 << 21) // len(centre.value)))
                near = _prefixes(_matrix(part.column("vector")), centre.value, prefix)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), prefix).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "prefix"])

    def indexed(df: DataFrame, label: str) -> DataFrame:
        return shared.materialize(df.mapInArrow(represent, T.StructType([*df.schema.fields, T.StructField("prefix", T.ArrayType(T.IntegerType()))])), label)

    def dealt(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        """Rows in part ``own`` of ``n``, once for each of the ``others`` parts that they meet."""
        hashed = F.pmod(F.xxhash64(F.lit(SEED), "class.k1", "class.k2"), F.lit(n).cast("bigint"))
        return df.withColumn(own, hashed).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))

    index = dealt(indexed(classes, "index"), "segment", segments, "block", blocks).select("segment", "block", "class", "ids", "vector", "prefix")
    queries = dealt(indexed(asked_classes, "queries"), "block", blocks, "segment", segments).select("segment", "block", "class", "vector", "prefix")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.append_column("least", pc.list_element(left["ids"], 0)).sort_by("least")
            right = right.append_column("k1", pc.struct_field(right["class"], "k1")).sort_by("k1")
            v, q = _matrix(left["vector"]), _matrix(right["vector"])
            asks = right["prefix"].combine_chunks().flatten().to_numpy().reshape(len(q), -1)
            n, ids, names = len(v), left["ids"].combine_chunks(), right["class"].combine_chunks()
            files = _inverted(left["prefix"].combine_chunks().flatten().to_numpy().reshape(n, -1), len(centre.value))
            most = min(n, max(k + 1, int(np.ceil(rerank * n))))
            least = left["least"].to_numpy()
            smaller_first = np.arange(n - 1, -1, -1)
            for i in range(len(q)):
                near = _closeness(asks[i], files, n) * n + smaller_first
                c = np.argpartition(-near, most - 1)[:most]
                d = np.sqrt(((v[c] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((c, d))
                fresh = np.sort(np.unique(least[c[order]], return_index=True)[1])[: k + 1]
                edge = d[order[fresh[-1] if len(fresh) > k else -1]]  # there are k + 1 ids up to here
                keep = c[d <= edge]  # ties at the edge stay, the merge decides them by id
                out["query"].append(pa.array(np.full(len(keep), i)))
                out["ids"].append(pa.array(keep))
                out["score"].append(pa.array(d[d <= edge]))
            take = {x: pa.chunked_array(y).combine_chunks() for x, y in out.items()}
            return pa.table({"class": names.take(take["query"]), "ids": ids.take(take["ids"]), "score": take["score"]})
        return pa.table({"class": right["class"].slice(0, 0), "ids": left["ids"].slice(0, 0), "score": pa.array([], pa.float64())})

    class_type = classes.schema["class"].dataType.simpleString()
    met = (
        index.groupBy("segment", "block")
        .cogroup(queries.groupBy("segment", "block"))
        .applyInArrow(meet, f"class {class_type}, ids array<bigint>, score double")
    )
    same = Window.partitionBy("class", "id")
    ranked = Window.partitionBy("class").orderBy("nearest", "id")
    best = met.select("class", F.explode("ids").alias("id"), "score").withColumn("turn", F.row_number().over(same.orderBy("score"))).where(F.col("turn") <= k)
    best = best.withColumn("nearest", F.min("score").over(same)).withColumn("turn", F.dense_rank().over(ranked)).where(F.col("turn") <= k + 1)
    final = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), "class", F.monotonically_increasing_id().alias("query_row"))
        .join(best.select("class", F.col("id").alias("vec_id"), "score"), "class")
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
