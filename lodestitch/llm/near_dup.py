"""Near-duplicates by the Jaccard similarity of word shingles, for the corpus pipeline.

Two texts are linked where their sets of 5-word shingles have a similarity of at least 0.8;
of each component of links one row stays. SimHash is no candidate filter for this: at 0.8 two
64-bit fingerprints differ in about ten bits, and balls of that radius cannot be posted. So
the balls of ``simhash.links`` around the sets' fingerprints bring the first candidates, those within
3 bits, and what lies beyond their reach comes from min-hashes, 32 bands of 6: a pair at 0.8 is missed by all
bands with a chance of 6e-5, one at 0.9 with 1e-10. Every candidate is verified on the whole sets.

Equal sets are one node. A bucket of a band is linked as a star around one of its nodes first;
after that only pairs that are still in different components can change the result. Those are
joined within their bucket under two bounds on sketches of the sets, and what passes is
verified; so a large group of copies, or of texts that are somewhat alike, costs a star and
not its square, and no bucket is capped. The bounds: the parities of the shingles' hashes in
512 places differ in at most as many places as the sets differ in shingles, so no similar pair
is lost by that one; and one bit of each of the 192 min-hashes differs with a chance of at
most 0.1, so more than 40 differences are left to chances below 2e-6.

Defined results: words as in ``simhash``; a text of 1 to 4 words is one shingle; texts without
words (null, empty, white space) have the empty set and are one component; repeated rows are
one node; an empty table gives no rows; only doc_id and text are read, other columns are
carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, simhash
from .simhash import _FOLD, SEED, components

SHINGLE = 5
#: Least similarity, as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 32, 6
#: Places of the parity sketch, and most differences of min-hash bits of a similar pair.
PLACES, BIT_GAPS = 512, 40
#: Shingles min-hashed at a time; bounds memory on very long texts.
SLICE = 1 << 12
#: Rows of a record batch that leave a map task together.
OUT_ROWS = 512
_RNG = np.random.default_rng(SEED)
_MULTIPLY, _FOLD_BAND = (_RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * BAND_ROWS, BANDS * BAND_ROWS))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    grams = zip(*(words[k : len(words) - size + 1 + k] for k in range(size)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - size + 1))


def node_of(found: np.ndarray) -> int:
    """A set's 64-bit name, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def print_of(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles' hashes, as a signed long; zero for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), SLICE):
        ones += np.unpackbits(found[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(np.int64)[0])


def _parity(found: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((found & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES).astype(np.uint8) & 1).view(np.int64)


def bands(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each band (none for the empty set), and the sketch: parities, min-hash bits."""
    parity = _parity(found)
    if not len(found):
        return np.zeros(0, np.int64), np.r_[parity, np.zeros(BANDS * BAND_ROWS // 64, np.int64)]
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), SLICE):
            np.minimum(least, (_MULTIPLY[:, None] * found[None, at : at + SLICE]).min(axis=1), out=least)
        # sums of products with each place's own factor, so bands have keys of their own
        keys = (least * _FOLD_BAND).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)
    bits = np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return keys, np.r_[parity, bits]


def prefix(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place of bands, the least hashes of a set: so many that similar sets are sure to share one. No
    bits of min-hashes."""
    part, whole = SIMILAR
    return found[: len(found) - -(-part * len(found) // whole) + 1].view(np.int64), np.r_[_parity(found), np.zeros(BANDS * BAND_ROWS // 64, np.int64)]


def _sets(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, fp (the set's name), n, print (its SimHash), bands, sketch and shingles of every row."""
    keyed = prefix if exact else bands

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                found = [shingles(t.as_py()) for t in part.column("text")]
                keys, sketches = zip(*map(keyed, found))
                lists = lambda arrays: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(map(node_of, found), pa.int64()), pa.array(map(len, found), pa.int64()),
                        pa.array(map(print_of, found), pa.int64()), lists(keys), lists(sketches), lists([s.view(np.int64) for s in found]),
                    ],
                    names=["doc_id", "fp", "n", "print", "bands", "sketch", "shingles"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint, n bigint, print bigint, bands array<bigint>, sketch array<bigint>, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    part, whole = SIMILAR
    pairs = shared.materialize(pairs, "candidates")
    asked = shared.materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "asked")
    found = sets.select("fp", "shingles").join(shared.maybe_broadcast(asked), "fp", "left_semi")
    found = shared.materialize(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "asked-sets")
    left, right = (found.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    either = F.size("a_set") + F.size("b_set") - both
    similar = shared.materialize(pairs.join(left, "a").join(right, "b").where(whole * both >= part * either).select("a", "b"), "similar")
    shared.discard(pairs, asked, found)
    return similar


def _pairs(hits: DataFrame) -> DataFrame:
    """Distinct a < b of columns a, b whose sizes allow the similarity."""
    part, whole = SIMILAR
    fits = whole * F.least("a_n", "b_n") >= part * F.greatest("a_n", "b_n")
    return hits.where((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sketches_allow() -> Column:
    """Whether sketches a_0.., b_0.. leave room for the similarity: of s shingles in both sets
    together, with repeats, at most (1 - similarity) / (1 + similarity) stand in one alone."""
    part, whole = SIMILAR
    gaps = [F.bit_count(F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}"))) for i in range((PLACES + BANDS * BAND_ROWS) // 64)]
    apart, bits = sum(gaps[1 : PLACES // 64], gaps[0]), sum(gaps[PLACES // 64 + 1 :], gaps[PLACES // 64])
    return ((whole + part) * apart <= (whole - part) * (F.col("a_n") + F.col("b_n"))) & (bits <= BIT_GAPS)


def ball_pairs(sets: DataFrame) -> DataFrame:
    """Candidates (a < b) of nodes by ball hashing: nodes of equal fingerprints, each with the first of them, and the
    first nodes of fingerprints that ``simhash.links`` finds within 3 bits."""
    nodes = shared.materialize(sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("print").alias("print")), "prints")
    heads = shared.materialize(nodes.groupBy("print").agg(F.min(F.struct("fp", "n")).alias("head")).select("print", F.col("head.fp").alias("a"), F.col("head.n").alias("a_n")), "print-heads")
    equal = nodes.join(heads, "print").select("a", "a_n", F.col("fp").alias("b"), F.col("n").alias("b_n"))
    close = shared.materialize(simhash.links(heads.select(F.col("print").alias("fp"))).withColumnsRenamed({"a": "left", "b": "right"}), "ball-links")
    other = heads.select(F.col("print").alias("right"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    near = close.join(heads.withColumnRenamed("print", "left"), "left").join(other, "right").select("a", "a_n", "b", "b_n")
    pairs = shared.materialize(_pairs(equal.unionByName(near)), "ball-pairs")
    shared.discard(nodes, heads, close)
    return pairs


def links(sets: DataFrame) -> DataFrame:
    """Similar pairs (a < b) of nodes that have the components of all similar pairs of ``sets``
    (written: fp, n, print, bands, sketch, shingles) within a ball, or that share a band."""
    nodes = sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    posts = shared.materialize(nodes.select("fp", "n", F.explode("bands").alias("key")), "bands")
    # Another node leads in each band, so that one odd copy is not the centre of all stars.
    turn = F.xxhash64("key", "fp")
    heads = posts.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "fp", "n")).alias("head"), F.count("*").alias("rows")).where("rows > 1")
    shared_keys = shared.materialize(heads.select("key", F.col("head.fp").alias("a"), F.col("head.n").alias("a_n")), "band-heads")
    close = shared.materialize(posts.join(shared_keys, "key").select("key", "a", "a_n", F.col("fp").alias("b"), F.col("n").alias("b_n")), "band-members")
    balls = ball_pairs(sets)
    first = shared.materialize(_pairs(close).union(balls).distinct(), "first-pairs")
    stars = _verified(first, sets)
    rooted = components(stars)
    members = close.select("key", F.col("b").alias("fp"), F.col("b_n").alias("n")).join(rooted.withColumnRenamed("node", "fp"), "fp", "left")
    members = members.withColumn("root", F.coalesce("root", "fp"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    still = shared.materialize(members.join(open_keys, "key", "left_semi"), "open-bands")
    named = still.select("fp").distinct().join(sets.select("fp", "sketch"), "fp").dropDuplicates(["fp"])
    drawn = shared.materialize(still.join(named, "fp"), "open-sketches")
    left, right = (
        drawn.select(
            "key", F.col("fp").alias(c), F.col("n").alias(f"{c}_n"), F.col("root").alias(f"{c}_root"),
            *[F.col("sketch")[i].alias(f"{c}_{i}") for i in range((PLACES + BANDS * BAND_ROWS) // 64)],
        )
        for c in ("a", "b")
    )
    apart = _pairs(left.join(right, "key").where(F.expr("a < b and a_root != b_root") & _sketches_allow()))
    # What a ball or a star has asked already is not asked again.
    rest = _verified(apart.join(first, ["a", "b"], "left_anti"), sets)
    shared.discard(posts, shared_keys, close, still, drawn, balls, first)
    return stars.union(rest)


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id. ``exact`` loses no link: a text
    is posted under a fifth of its shingles, not under 32 bands, which costs the more the longer texts are.

    Where ids are unique, the ids to go are found on narrow rows and taken out by an anti
    join, so texts stay where they are unless those ids are too many to broadcast."""
    sets = shared.materialize(_sets(docs, exact), "sets")
    nodes = sets.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tied = shared.materialize(components(links(sets)), "components")
    rooted = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labels = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
    labels = shared.materialize(labels.select("fp", "root", "component_id"), "groups")
    rows, ids = sets.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        gone = sets.select("doc_id", "fp").join(labels, "fp").where("doc_id != component_id").select("doc_id")
        gone = shared.materialize(gone, "copies")
        shared.discard(sets)
        return docs.join(shared.maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    shared.discard(sets)
    # Null or repeated ids: decide by row, with the set's name beside the text.
    fp, root, turn = (shared.fresh(docs, f"near_{x}") for x in ("fp", "root", "turn"))

    @F.pandas_udf("bigint")
    def named(texts):
        return texts.map(lambda t: node_of(shingles(t)))

    first = Window.partitionBy(root).orderBy(F.col("doc_id").asc_nulls_last(), F.col(fp))
    tagged = docs.withColumn(fp, named("text")).join(labels.select(F.col("fp").alias(fp), F.col("root").alias(root)), fp)
    return tagged.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).select(*docs.columns)
