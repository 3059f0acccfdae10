"""SimHash near-duplicates by ball hashing.

Fingerprints come from whole texts, one Arrow batch at a time, in slices of bounded length.
Links meet in the middle: a fingerprint emits every variant within half the radius, on one
side the ball of the smaller half and on the other that of the larger, all are shuffled on the
variant, and what collides is verified on all 64 bits inside the join and then deduplicated.
With ``parts=1`` the balls are around whole fingerprints: 65 and 2,081 variants at radius 3.
With ``parts=2`` (the default, see the README for figures of both) they are around 32-bit
halves: of two fingerprints within ``r`` bits one half differs in at most ``r // 2``, so at
radius 3 the balls have 1 and 33 variants. Both give the same links. Copies have
one fingerprint and so one node; only true links between different fingerprints leave the
join. Components come from alternating large-star and small-star rounds over the links,
each round a written table.

Defined results: texts without words (null, empty, white space) have fingerprint zero and
are linked like any other; repeated rows share their component; a component is named by its
smallest non-null doc_id; an empty table gives no rows; other columns are not read (or, in
``keep_one``, carried along untouched).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Parts of a fingerprint around which balls are emitted.
PARTS = 2
#: Shingles hashed at a time; bounds memory on very long texts.
SLICE = 1 << 16
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash (unsigned) of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    total, ones = len(words) - size + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        rows = min(SLICE, total - at)
        grams = zip(*(words[at + k : at + k + rows] for k in range(size)))
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, rows)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long)."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint")


def _ball(fp: Column, part: int, width: int, radius: int) -> Column:
    """Keys of all variants of a part of ``width`` bits within ``radius`` bits. Parts of less than
    64 bits have their number in the key."""
    masks = [reduce(lambda m, b: m | 1 << b, bits, 0) for r in range(radius + 1) for bits in combinations(range(width), r)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks])
    own = fp if width == 64 else F.shiftrightunsigned(fp, width * part).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(part << width))
    return F.transform(signed, lambda m: m.bitwiseXOR(own))


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    if parts not in (1, 2, 4):
        raise ValueError("parts must be 1, 2 or 4")
    width, inner = 64 // parts, radius // parts
    # The written table may be a few files, and a row becomes many: a number of tasks that does not go by the rows' size now.
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = lambda r: F.explode(F.concat(*[_ball(F.col("fp"), p, width, r) for p in range(parts)])).alias("key")
    posted = spread.select(F.col("fp").alias("a"), balls(inner // 2))
    variants = spread.select(F.col("fp").alias("b"), balls(inner - inner // 2))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # Exploded rows are many times what the planner takes them for: never broadcast them.
    hits = posted.hint("merge").join(variants, (posted["key"] == variants["key"]) & (F.col("a") != F.col("b")) & close)
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours (its larger ones, or itself and its smaller ones) are
    tied to the smallest node around it. The minimum is aggregated before it is shuffled."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        tied = sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        tied = sides.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return tied.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node with a link."""
    now, seen = shared.materialize(edges, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = shared.materialize(_star(_star(now, True), False), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def groups(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """fp, component_id and members (rows of that fingerprint) for every distinct fingerprint."""
    nodes = shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "prints")
    tied = shared.materialize(components(links(nodes, radius, parts)), "components")
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id", "members")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row."""
    prints = shared.materialize(fingerprints(docs, shingle), "fingerprints")
    return prints.join(groups(prints, radius, parts), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Where ids are unique, the ids to go are found on narrow rows and taken out by an anti
    join, so texts stay where they are unless those ids are too many to broadcast."""
    prints = shared.materialize(fingerprints(docs, shingle), "fingerprints")
    labels = shared.materialize(groups(prints, radius), "groups")
    rows, ids = prints.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        gone = prints.join(labels, "fp").where("doc_id != component_id").select("doc_id")
        return docs.join(shared.maybe_broadcast(shared.materialize(gone, "copies")), "doc_id", "left_anti").select(*docs.columns)
    # Null or repeated ids: decide by row, with the fingerprint beside the text.
    fp, component, turn = (shared.fresh(docs, f"near_{x}") for x in ("fp", "component", "turn"))

    @F.pandas_udf("bigint")
    def printed(texts):
        return texts.map(lambda t: int(np.uint64(fingerprint(t, shingle)).astype(np.int64)))

    named = labels.select(F.col("fp").alias(fp), F.struct("component_id").alias(component), F.xxhash64("component_id").alias(turn))
    root = Window.partitionBy(component).orderBy(F.col("doc_id").asc_nulls_last(), F.col(fp))
    return (
        docs.withColumn(fp, printed("text")).join(named.drop(turn), fp).withColumn(turn, F.row_number().over(root)).where(F.col(turn) == 1).select(*docs.columns)
    )
