"""Benchmark decontamination by winnowing (DataFrame functions only).

The hashes of a text's ``GRAM``-word grams are winnowed: the least of every ``KEEP``
consecutive ones is a fingerprint. A shared span of ``SPAN = GRAM + KEEP - 1`` words holds
one whole window of hashes, so both texts keep the same fingerprint there: no shared window
of 13 words is missed. Items of fewer words are fingerprinted by one gram of their own
length, and documents are hashed at the few lengths that occur.

Documents meet the benchmark on fingerprints only. Documents that collide are read again and
their hits are extended to every window: windows of 13 words (or of a shorter item's length)
are joined to the items' distinct windows, both under two independent 64-bit hashes. A
document's position is in one row for each length and meets one row at most, so repeated
text, however long, costs rows in proportion to its words, and a passage that many documents
share is many rows of a join, not one task.

Defined results: a null or wordless document has no words, no hits and is clean; a null
or wordless item hits nothing; an item with a null id hits but is not listed; items that
share an id count once; repeated documents are judged alike, rows that share an id but not
a text each by their own text; an empty benchmark leaves every document clean; other columns
are not read (or, in ``drop_contaminated``, carried along untouched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPAN = 13
GRAM = 8
KEEP = SPAN - GRAM + 1
#: Anything but ASCII letters, digits and non-ASCII characters separates words.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(shared.ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _upto(first: Column | int, last: Column) -> Column:
    """first..last, empty where last < first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _zipped(left: Column, right: Column, n: Column, f) -> Column:
    """f over the first n elements of two arrays; empty where n < 1."""
    return F.when(n > 0, F.zip_with(F.slice(left, 1, n), right, f)).otherwise(F.array().cast("array<bigint>"))


def _doubled(values: Column, step: int, f) -> Column:
    """f of each element and the one ``step`` further on."""
    n = F.size(values) - step
    return _zipped(values, F.slice(values, step + 1, F.greatest(n, F.lit(0))), n, f)


def _eight_gram_hashes(words: Column) -> Column:
    """Hashes of all 8-word grams, doubled from words over pairs and fours: three passes of two
    hashed numbers each, where hashing every gram anew would read each word eight times."""
    both = lambda a, b: F.xxhash64(a, b)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h1: _let(_doubled(h1, 1, both), lambda h2: _let(_doubled(h2, 2, both), lambda h4: _doubled(h4, 4, both))))


def _gram_hashes(words: Column, gram: Column | int) -> Column:
    """Hashes of all grams of that many words; the length is part of the hash."""
    if isinstance(gram, int) and gram == GRAM:
        return _eight_gram_hashes(words)
    gram = F.lit(gram) if isinstance(gram, int) else gram
    sliced = F.transform(_upto(1, F.size(words) - gram + 1), lambda i: F.xxhash64(gram, F.slice(words, i, gram)))
    return F.when(gram == GRAM, _eight_gram_hashes(words)).otherwise(sliced)


def _least_per_window(hashes: Column) -> Column:
    """The least of every 6 consecutive hashes, from the least of pairs and fours."""
    low = lambda a, b: F.least(a, b)
    n = F.size(hashes) - KEEP + 1
    return _let(
        _doubled(hashes, 1, low),
        lambda m2: _let(_doubled(m2, 2, low), lambda m4: _zipped(m4, F.slice(m2, 5, F.greatest(n, F.lit(0))), n, low)),
    )


def _row_key() -> list[Column]:
    """Rows with equal id and text are one document here."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def _windows(words: Column, span: Column) -> Column:
    """For each window of ``span`` words its two hashes; those of 13 words are put together from
    the 8-grams at both ends, which overlap by three words."""
    grams = _gram_hashes(words, GRAM)
    long = lambda seed: _doubled_at(grams, SPAN - GRAM, lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), F.xxhash64(F.lit(seed), b, a).alias("g")))
    sliced = F.transform(
        _upto(1, F.size(words) - span + 1),
        lambda i: F.struct(F.xxhash64(span, F.slice(words, i, span)).alias("h"), F.xxhash64(F.lit(2), F.slice(words, i, span)).alias("g")),
    )
    return F.when(span == SPAN, long(2)).otherwise(sliced)


def _doubled_at(values: Column, step: int, f) -> Column:
    """As ``_doubled``, for structs of hashes."""
    return _let(
        values,
        lambda v: F.when(
            F.size(v) > step, F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - step, F.lit(0))), F.slice(v, step + 1, F.greatest(F.size(v) - step, F.lit(0))), f)
        ).otherwise(F.array().cast("array<struct<h:bigint,g:bigint>>")),
    )


def item_prints(items: DataFrame) -> DataFrame:
    """One row per distinct fingerprint of the items: h, and span, the length of their windows."""
    long = items.where(F.size("item_words") >= SPAN).select(F.lit(SPAN).alias("span"), _least_per_window(_gram_hashes(F.col("item_words"), GRAM)).alias("kept"))
    short = items.where(F.size("item_words").between(1, SPAN - 1)).select(F.size("item_words").alias("span"), _gram_hashes(F.col("item_words"), F.size("item_words")).alias("kept"))
    return long.unionByName(short).select("span", F.explode("kept").alias("h")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_hit, n_items and items_sha256 of documents with a hit."""
    items = shared.materialize(
        benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct(),
        "items",
    )
    prints = shared.materialize(item_prints(items), "item-prints")
    short = sorted(r["span"] for r in prints.where(F.col("span") != SPAN).select("span").distinct().collect())  # lengths below 13
    keyed = docs.select(*_row_key(), words_of(F.col("text")).alias("words"))
    kept = _least_per_window(F.col("hashes"))
    for gram in short:
        kept = F.concat(kept, _gram_hashes(F.col("words"), gram))
    posted = keyed.withColumn("hashes", _gram_hashes(F.col("words"), GRAM)).select("doc_id", "text_key", F.explode(F.array_distinct(kept)).alias("h"))
    met = posted.join(shared.maybe_broadcast(prints), "h").groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    met = shared.materialize(met.withColumnsRenamed({"doc_id": "hit_doc", "text_key": "hit_key"}), "collisions")
    same_row = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & F.col("text_key").eqNullSafe(F.col("hit_key"))
    texts = docs.select(*_row_key(), "text").join(shared.maybe_broadcast(met), same_row).dropDuplicates(["doc_id", "text_key"])
    texts = texts.select("doc_id", "text_key", words_of(F.col("text")).alias("words"), F.explode("spans").alias("span"))
    laid = texts.select("doc_id", "text_key", "span", F.posexplode(_windows(F.col("words"), F.col("span"))).alias("at", "w"))
    laid = laid.select("doc_id", "text_key", "span", "at", "w.h", "w.g")
    windows = items.withColumn("span", F.least(F.size("item_words"), F.lit(SPAN))).select("item", "span", F.explode(_windows(F.col("item_words"), F.col("span"))).alias("w"))
    windows = shared.materialize(windows.select("item", "span", "w.h", "w.g").distinct(), "item-windows")
    distinct = shared.materialize(windows.select("span", "h", "g").distinct(), "windows")
    found = shared.materialize(laid.join(shared.maybe_broadcast(distinct), ["span", "h", "g"], "left_semi"), "found")
    per_row = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("span")).alias("e")))).alias("spans"))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["e"]).alias("upto"),
            (acc["n"] + F.greatest(x["e"] - F.greatest(acc["upto"], x["s"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    named = (
        found.select("doc_id", "text_key", "span", "h", "g")
        .distinct()
        .join(shared.maybe_broadcast(windows), ["span", "h", "g"])
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"), F.size("items").cast("long").alias("n_items"), _sha_of("items").alias("items_sha256"))
    )
    return per_row.select("doc_id", "text_key", merged.alias("n_hit")).join(named, same_row, "left").drop("hit_doc", "hit_key")


def _sha_of(listed) -> Column:
    return F.sha2(F.array_join(listed, ","), 256)


def judge(docs: DataFrame, benchmark: DataFrame, *, least_share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    Contaminated: some word is hit and ``least_share * n_hit >= n_words``."""
    found = shared.materialize(hits(docs, benchmark), "hits").withColumnRenamed("doc_id", "hit_doc").withColumnRenamed("text_key", "hit_key")
    base = docs.select(*_row_key(), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    same_row = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & F.col("text_key").eqNullSafe(F.col("hit_key"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(shared.maybe_broadcast(found, 100_000), same_row, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least_share: int = 20) -> DataFrame:
    """``docs`` without its contaminated rows."""
    found = shared.materialize(hits(docs, benchmark).select("doc_id", "text_key", "n_hit"), "hits")
    doc, key, n = (shared.fresh(docs, f"hit_{x}") for x in ("doc", "key", "n"))
    found = shared.maybe_broadcast(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("n_hit").alias(n)))
    same_row = docs["doc_id"].eqNullSafe(found[doc]) & F.xxhash64(docs["text"]).eqNullSafe(found[key])
    bad = least_share * found[n] >= F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0))
    return docs.join(found, same_row & bad, "left_anti").select(*docs.columns)
