"""Merkle manifest of a document table by time-forward processing.

Nodes are labelled (tree, level, index); a child's digest is a message to its parent, and messages
are taken from a priority queue in label order, so each node finds its whole inbox at the head of
the queue when its turn comes. The queue is external: its front is a heap that never holds more
than one chunk (``FAN ** LEVELS`` nodes and their ancestors), and messages to nodes of a later
chunk or sweep go to a written table that Spark sorts by the receiver's label. A sweep climbs
``LEVELS`` levels, so every sweep has a 256th of the nodes of the one before, and any number of
tasks share it. The reversed sweeps walk the same labels backwards: a node hands every child the
proof suffix that it got itself, with the child's siblings in front, until the leaves have theirs.

Leaves are placed in their tree by a range sort and running offsets; texts never leave the task that
reads them. The subroots of all sources form a tree of their own.

Defined results: null fields are ``-`` in a leaf; a null source is a source of its own and comes first;
null ids stand first in their source and are never tampered with; rows that share an id stand
in the order of their leaves, and equal rows are equal leaves; an empty table gives no rows; the
documents' other columns are not read. A run of one node has no siblings but is hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FAN = 16
LEVELS = 2
#: Every so manieth id (by its check sum) is tampered with.
TAMPERED = 5

#: (digests left of a node in its run, digests right of it): one step of a proof.
Step = tuple[str, str]


def _hash(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """Digest of a document row with that text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """tree (source, null as the empty text and others behind a full stop, so that order holds), doc_id, digest
    and, for tampered rows, seen."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit("")).alias("tree"),
        "doc_id",
        leaf_digest(F.col("text")).alias("digest"),
        F.when(hit, leaf_digest(shared.ascii_lower(F.col("text")))).alias("seen"),
        F.monotonically_increasing_id().alias("copy"),
    )


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and nth, the running number of a row in its tree, to rows sorted by tree."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("tree"))
        nth, start = np.arange(batch.num_rows, dtype=np.int64), 0
        for tree, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            seen = seen if tree == last else 0
            nth[start:end] += seen - start
            last, seen, start = tree, seen + end - start, end
        columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "nth"])


def _placed(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """``rows`` with pos, their gapless place in the tree by ``order``, and n, the tree's number of rows;
    and the largest n. A range sort spreads even one tree over all tasks."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    counted = shared.materialize(ordered.mapInArrow(_count_runs, schema), "merkle-order")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counted.groupBy("tree", "part").agg(F.count("*").alias("in_part"))
    offsets = counts.select("tree", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"), F.sum("in_part").over(tree).alias("n"))
    offsets = shared.materialize(offsets, "merkle-offsets")
    most = offsets.agg(F.max("n")).first()[0] or 0
    placed = counted.join(shared.maybe_broadcast(offsets), ["tree", "part"]).withColumn("pos", F.col("before") + F.col("nth"))
    return placed.drop("part", "nth", "before", "copy"), most


def _height(n: int) -> int:
    """Levels that a sweep climbs in a tree with ``n`` nodes left."""
    height = 0
    while n > 1 and height < LEVELS:
        n, height = -(-n // FAN), height + 1
    return height


def _forward(nodes: list[tuple[int, str]], height: int) -> list[tuple[tuple[int, int], list[tuple[int, str]]]]:
    """(label, inbox) of a chunk's inner nodes in label order; the last one is the chunk's root."""
    queue = [(1, pos // FAN, pos, digest) for pos, digest in nodes]
    heapify(queue)
    done = []
    while queue:
        label, inbox = queue[0][:2], []
        while queue and queue[0][:2] == label:
            inbox.append(heappop(queue)[2:])
        done.append((label, inbox))
        if label[0] < height:
            level, index = label
            heappush(queue, (level + 1, index // FAN, index, _hash("".join(d for _, d in inbox))))
    return done


def _reversed(done: list, suffix: list[Step]) -> dict[int, list[Step]]:
    """Each of the chunk's nodes by place with its proof suffix, given that of the chunk's root."""
    due = {done[-1][0]: suffix}
    leaves = {}
    for (level, index), inbox in reversed(done):
        own, digests = due.pop((level, index)), [d for _, d in inbox]
        for i, (child, _) in enumerate(inbox):
            steps = [("".join(digests[:i]), "".join(digests[i + 1 :])), *own]
            if level == 1:
                leaves[child] = steps
            else:
                due[(level - 1, child)] = steps
    return leaves


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one chunk after another; the first three columns are tree, chunk and pos."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, group in groupby(rows, key=lambda r: r[:2]):
        yield list(group)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _by_chunk(rows: DataFrame) -> DataFrame:
    """Rows of a chunk together and in label order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "chunk").sortWithinPartitions("tree", "chunk", "pos")



def _chunk() -> Column:
    return F.expr(f"pos div {FAN**LEVELS}").alias("chunk")


def _climb(nodes: DataFrame) -> DataFrame:
    """The next sweep's nodes (tree, pos, n, digest): the roots of the chunks of this one's."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> Iterator[tuple]:
            for chunk in _chunks(batches):
                tree, index, _, n, digest = chunk[0]
                if n > 1:
                    done = _forward([(r[2], r[4]) for r in chunk], _height(n))
                    digest = _hash("".join(d for _, d in done[-1][1]))
                yield tree, index, -(-n // FAN**LEVELS), digest

        yield from _batched(roots(), schema)

    rows = _by_chunk(nodes.select("tree", _chunk(), "pos", "n", "digest"))
    return rows.mapInArrow(sweep, "tree string, pos long, n long, digest string")


_STEPS = "array<struct<left:string,right:string>>"


def _descend(nodes: DataFrame, messages: DataFrame, emit, out: str, out_arrow: pa.Schema) -> DataFrame:
    """Hands the suffixes of chunk roots (tree, pos, subroot, suffix) on to the chunks' nodes
    (tree, pos, n, digest and the columns that ``emit`` wants behind them)."""
    more = [c for c in nodes.columns if c not in ("tree", "pos", "n", "digest")]
    blank = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more]
    told = messages.select(
        "tree", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.col("subroot").alias("digest"), "suffix", *blank
    )
    asked = nodes.select("tree", _chunk(), "pos", "n", "digest", F.lit(None).cast(_STEPS).alias("suffix"), *more)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (_, _, _, _, subroot, told, *_), *chunk in _chunks(batches):
                suffix = [(s["left"], s["right"]) for s in told]
                n = chunk[0][3]
                steps = _reversed(_forward([(r[2], r[4]) for r in chunk], _height(n)), suffix) if n > 1 else {chunk[0][2]: suffix}
                for tree, _, pos, _, digest, _, *rest in chunk:
                    yield emit(tree, pos, digest, subroot, steps[pos], rest)

        yield from _batched(rows(), out_arrow)

    return _by_chunk(told.unionByName(asked)).mapInArrow(sweep, out)


_MESSAGE = f"tree string, pos long, subroot string, suffix {_STEPS}"
_MESSAGE_ARROW = pa.schema(
    [("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("suffix", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]
)


def _pass_on(tree, pos, digest, subroot, steps, rest):
    return tree, pos, subroot, [{"left": a, "right": b} for a, b in steps]


def _climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every sweep, down to one per tree."""
    stages = [nodes]
    while most > 1:
        stages.append(shared.materialize(_climb(stages[-1]), "merkle-nodes"))
        most = -(-most // FAN**LEVELS)
    return stages


def _handed_down(stages: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Messages to the chunks of the lowest sweep, from those to the trees' roots."""
    for nodes in reversed(stages[1:-1]):
        messages = shared.materialize(_descend(nodes, messages, _pass_on, _MESSAGE, _MESSAGE_ARROW), "merkle-suffixes")
    return messages


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    id_type = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])
    out = out.add("verified", T.BooleanType())
    leaves, most = _placed(_leaves(docs), ["doc_id", "digest", "copy"], "leaves")
    if not most:
        return docs.sparkSession.createDataFrame([], out)
    stages = _climbed(leaves, most)
    tops = stages[-1] if len(stages) > 1 else shared.materialize(leaves.select("tree", "pos", "n", "digest"), "merkle-nodes")

    # The sources' subroots are the leaves of a tree of their own, in the order of their names.
    sources, count = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "sources")
    over = _climbed(sources, count)
    root = over[-1].first()["digest"]
    above = _empty_suffix(over[-1])
    if len(over) > 1:
        named = sources.select("tree", "pos", "n", "digest", "name")
        emit = lambda tree, pos, digest, subroot, steps, rest: (rest[0], 0, digest, [{"left": a, "right": b} for a, b in steps])
        messages = _descend(named, _handed_down(over, above), emit, _MESSAGE, _MESSAGE_ARROW)
    else:
        messages = sources.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), F.array().cast(_STEPS).alias("suffix"))
    messages = _handed_down(stages, shared.materialize(messages, "merkle-suffixes"))

    def last(tree, pos, digest, subroot, steps, rest):
        doc_id, seen = rest
        folded = seen or digest
        for left, right in steps:
            folded = _hash(left + folded + right)
        return doc_id, digest, subroot, root, _hash("".join(a + b for a, b in steps)), folded, folded == root

    nodes = leaves.select("tree", "pos", "n", "digest", "doc_id", "seen")
    arrow = pa.schema([(f.name, _ARROW.get(f.dataType, pa.string())) for f in out.fields])
    return _descend(nodes, messages, last, out, arrow)


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.ShortType(): pa.int16(), T.BooleanType(): pa.bool_()}


def _empty_suffix(top: DataFrame) -> DataFrame:
    return top.select("tree", "pos", F.col("digest").alias("subroot"), F.array().cast(_STEPS).alias("suffix"))
