"""Stupid-backoff scores of word bigrams, computed relationally.

``S(w2 | w1) = c(w1 w2) / c(w1)`` where the bigram occurs, else ``0.4 c(w2) / N``; the first
word of a text scores ``c(w) / N``. Counts come from all documents (or from ``train``); a
document scored against its own corpus is left out of its counts, so that its own bigrams do
not vouch for themselves. A word seen nowhere else counts one half.

Exploded bigrams, one row per (document, bigram), are partitioned by their words' hashes;
there the count table is a window sum, so counts and occurrences meet in one shuffle. What
the backoff then asks of the unigram table is pre-aggregated per (document, word) and joined
by word, and per-document sums follow.

Frequent bigrams and words would fill single partitions. A sample of documents names up to
``HEAD_BIGRAMS`` and ``HEAD_WORDS`` of them; this decides the route only: their counts are exact,
taken over all documents with map-side sums, broadcast (a fixed number of rows at most), and
applied in the map tasks.

``score_ngrams`` is the plain form for any order: count tables of all n-grams, partitioned by hash,
are joined to the exploded n-grams of the documents, and each document's finds meet its text
again and are summed. It moves every n-gram twice, the bigram form above moves a bigram once.

Words are runs outside ASCII white space, A-Z lower-cased. Ids are whole numbers. Defined results: a text without
words (null, empty) has 0 words and null scores; repeated rows are scored each on its own;
an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BACKOFF = 0.4
#: Most words and bigrams in the head: at most 4 and 16 MB are broadcast.
HEAD_WORDS = 1 << 18
HEAD_BIGRAMS = 1 << 20
#: Documents whose n-grams name the frequent ones.
HEAD_SAMPLE = 20_000
UNSEEN = 0.5
#: Words that a map task works on at a time (a longer text is taken whole).
FLUSH = 1 << 19
WORD, PAIR, HEAD_WORD = 0, 1, 2
BIGRAM, DEMAND, DOCUMENT = 0, 1, 2
#: Parts of scores (columns part, key, whose, v, n, d, t): a partition's sum for a document (key), a
#: document's demand on a word (key), a document (key) with its doc_id and number of words.
OF_SUM, OF_WORD, OF_DOCUMENT = 0, 1, 2
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash; emptied between flushes once it is large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of a pair of hashes."""
    with np.errstate(over="ignore"):
        x = a * _ODD + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _flushes(batches, columns: list[str]):
    """(rows' other columns, words per row, all word hashes) for some rows at a time."""
    cache, rows, lengths, parts, words_held = _Hashes(), {c: [] for c in columns}, [], [], 0
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in columns]
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
            parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
            lengths.append(len(words))
            for c, values in zip(columns, others):
                rows[c].append(values[i])
            words_held += len(words)
            if words_held >= FLUSH:
                yield rows, np.array(lengths), np.concatenate(parts)
                rows, lengths, parts, words_held = {c: [] for c in columns}, [], [], 0
                if len(cache) > 1 << 20:
                    cache.clear()
    if lengths:
        yield rows, np.array(lengths), np.concatenate(parts)


def _pairs(lengths: np.ndarray, hashes: np.ndarray):
    """Row of each word, and the positions of second words of bigrams."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    return row, second


def _batch(names, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _count_rows(heads):
    """kind, key, n: words outside the head by hash, bigrams and words of the head by their place
    in it. Without ``heads`` all words and bigrams by hash, to choose the heads from."""

    def run(batches):
        for _, lengths, hashes in _flushes(batches, []):
            _, second = _pairs(lengths, hashes)
            word, n_word = np.unique(hashes, return_counts=True)
            pair, n_pair = np.unique(_mix(hashes[second - 1], hashes[second]), return_counts=True)
            kind = np.full(len(word), WORD, np.int32)
            if heads is not None:
                words, bigrams = heads.value
                at = _find(words, word)
                kind[at >= 0] = HEAD_WORD
                word = np.where(at >= 0, at, word.view(np.int64))
                pair = _find(bigrams, pair)
                pair, n_pair = pair[pair >= 0], n_pair[pair >= 0]
            kind = np.r_[kind, np.full(len(pair), PAIR, np.int32)]
            yield _batch(["kind", "key", "n"], [kind, np.r_[word.view(np.int64), pair.view(np.int64)], np.r_[n_word, n_pair].astype(np.int64)])

    return run


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1 (fastest for sorted keys)."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _most_frequent(counts: DataFrame, kind: int, head: int) -> np.ndarray:
    """Sorted keys of the counts above a threshold that at most ``head`` keys pass; no sort."""
    at_least, room = None, head
    for n, keys in counts.where(F.col("kind") == kind).groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).collect():
        if keys > room:
            break
        at_least, room = n, room - keys
    if at_least is None:
        return np.zeros(0, np.uint64)
    keys = counts.where((F.col("kind") == kind) & (F.col("n") >= at_least)).select("key").toArrow()["key"]
    return np.sort(keys.to_numpy().view(np.uint64))


def _exact(counts: DataFrame, kind: int, head: np.ndarray) -> np.ndarray:
    """The counts of a head's words or bigrams, in its order."""
    out = np.zeros(len(head), np.int64)
    if len(head):
        got = counts.where(F.col("kind") == kind).select("key", "n").toArrow()
        out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


#: A bigram row. Words of the head are coded by their place from 1, others by their hash with
#: the top bit set. Two head words share ``k1`` (its upper 40 bits) and leave ``k2`` 0; else each
#: has its own. ``small`` packs the bigram's and both words' own counts. The bytes that vary
#: between neighbouring rows stand side by side, so the shuffle compresses well.
ROWS = "uid long, k2 long, k1 long, small long, v double, kind int"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_CODE_BITS, _SHIFT = 20, 24
#: Bits of a count in ``small``: a byte where all three fit, else 20 bits and the mark. Where
#: these are too few, ``small`` is negative, has 31 bits for each word's count (a text has fewer
#: words) and a bigram's own count stands in ``v``, so that no count is cut.
_FIELD, _MARK = 20, 1 << 62
_HUGE_FIELD, _HUGE = 31, -(1 << 63)
_TOP = np.uint64(1 << 63)


def _pack(n: np.ndarray, t1: np.ndarray, t2: np.ndarray, field: int) -> np.ndarray:
    n, t1, t2 = (x.astype(np.int64) for x in (n, t1, t2))
    most = np.maximum(np.maximum(n, t1), t2)
    wide = _MARK | n | t1 << field | t2 << 2 * field
    huge = _HUGE | t1 | t2 << _HUGE_FIELD
    return np.where(most < 256, n | t1 << 8 | t2 << 16, np.where(most < 1 << field, wide, huge))


def _field(i: int):
    """Count ``i`` of a row: the bigram's (of bigram rows only), or a word's."""
    small, mask = F.col("small"), lambda bits: F.lit((1 << bits) - 1)
    wide = F.shiftright(small, i * _FIELD).bitwiseAND(mask(_FIELD))
    huge = F.col("v").cast("long") if i == 0 else F.shiftright(small, (i - 1) * _HUGE_FIELD).bitwiseAND(mask(_HUGE_FIELD))
    return F.when(small < 0, huge).when(small < _MARK, F.shiftright(small, 8 * i).bitwiseAND(F.lit(255))).otherwise(wide)


def _score_rows(heads, total: int, own: bool):
    """Rows for the shuffle: bigrams outside the head, demands on words outside the head (k1:
    the document, k2: the word; their own count may be negative and is ``v``), and one row
    per document (k2: its id, small: its words, v: all that the head tables settle)."""

    field = _FIELD

    def run(batches):
        words, word_n, bigrams, bigram_n = heads.value
        for rows, lengths, hashes in _flushes(batches, ["uid", "doc_id"]):
            uid = np.array(rows["uid"], np.int64)
            row, second = _pairs(lengths, hashes)
            rest = np.log(np.maximum(total - lengths * int(own), 1))
            value = np.zeros(len(lengths))
            # code and count of each word, and its times in its document
            distinct, at = np.unique(hashes, return_inverse=True)
            known = _find(words, distinct)
            code = np.where(known >= 0, known + 1, (distinct | _TOP).view(np.int64))[at]
            held = np.where(known >= 0, word_n[known] if len(words) else 0, -1)[at]
            _, place, times = np.unique(at * np.int64(len(lengths)) + row, return_inverse=True, return_counts=True)
            times = times[place]
            # distinct bigrams of each document: sorted by key, documents stay in order
            key = _mix(hashes[second - 1], hashes[second])
            order = np.argsort(key, kind="stable")
            key, pos = key[order], second[order]
            fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[pos[1:]] != row[pos[:-1]])]) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.r_[fresh, len(key)])
            key, pos = key[fresh], pos[fresh]
            head = _find(bigrams, key)
            tail = np.flatnonzero(head < 0)
            tail = tail[np.argsort(row[pos[tail]], kind="stable")]  # a document's rows stay together
            p = pos[tail]
            c1, c2 = code[p - 1], code[p]
            both = (c1 > 0) & (c2 > 0)
            small = _pack(n[tail], times[p - 1], times[p], field)
            yield _batch(
                _NAMES,
                [
                    uid[row[p]], np.where(both, 0, c2), np.where(both, (c1 << _CODE_BITS | c2) << _SHIFT, c1),
                    small, np.where(small < 0, n[tail], 0).astype(np.float64), np.full(len(p), BIGRAM, np.int32),
                ],
            )
            # bigrams of the head are settled here, down to a demand on one word each
            p, n, head = pos[head >= 0], n[head >= 0], head[head >= 0]
            seen = (bigram_n[head] if len(bigrams) else head) - (n if own else 0)
            found = seen > 0
            np.add.at(value, row[p], n * np.where(found, np.log(np.maximum(seen, 1)), np.log(BACKOFF) - rest[row[p]]))
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            np.add.at(value, row[starts], -rest[row[starts]])
            w = np.r_[np.where(found, p - 1, p), starts]
            sign = np.r_[np.where(found, -n, n), np.ones(len(starts), np.int64)]
            k = held[w] >= 0
            left = np.maximum(held[w[k]] - (times[w[k]] if own else 0), UNSEEN)
            np.add.at(value, row[w[k]], sign[k] * np.log(left))
            w, sign = w[~k], sign[~k]
            one = np.ones(len(w), np.int64)
            yield _batch(
                _NAMES,
                [uid[row[w]], code[w], uid[row[w]], _pack(one, one, times[w], field), sign.astype(np.float64), np.full(len(w), DEMAND, np.int32)],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid), pa.array(rows["doc_id"], pa.int64()), pa.array(uid), pa.array(lengths.astype(np.int64)),
                    pa.array(value), pa.array(np.full(len(lengths), DOCUMENT, np.int32)),
                ],
                names=_NAMES,
            )

    return run


#: Logarithms are summed as whole billionths: sums do not depend on the order of tasks.
NANO = 1e9


def _nano(x):
    return F.round(x * NANO).cast("long")


def score_documents(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S) and mean_log_score for every row of ``docs``."""
    spark = docs.sparkSession
    corpus = (docs if train is None else train).select("text")
    own = train is None
    texts = corpus.count()
    sample = corpus if texts <= HEAD_SAMPLE else corpus.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 20)) < int((1 << 20) * HEAD_SAMPLE / texts))
    sampled = sample.mapInArrow(_count_rows(None), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    sampled = shared.materialize(sampled.where("n > 1"), "sampled")
    words, bigrams = _most_frequent(sampled, WORD, HEAD_WORDS), _most_frequent(sampled, PAIR, HEAD_BIGRAMS)
    shared.discard(sampled)
    named = spark.sparkContext.broadcast((words, bigrams))
    counts = corpus.mapInArrow(_count_rows(named), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = shared.materialize(counts, "counts")
    total = counts.where(F.col("kind") != PAIR).agg(F.sum("n")).first()[0] or 0
    tables = (words, _exact(counts, HEAD_WORD, words), bigrams, _exact(counts, PAIR, bigrams))
    heads = spark.sparkContext.broadcast(tables)

    head_words = F.broadcast(counts.where(F.col("kind") == HEAD_WORD).select((F.col("key") + 1).alias("hw"), F.col("n").alias("hc")))

    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    rows = keyed.mapInArrow(_score_rows(heads, total, own), ROWS)
    counted = F.when(F.col("kind") == BIGRAM, _field(0))
    if not own:
        trained = train.select(F.lit(-1).cast("long").alias("uid"), F.lit(None).cast("long").alias("doc_id"), "text")
        rows = rows.unionByName(trained.mapInArrow(_score_rows(heads, total, own), ROWS).where(F.col("kind") == BIGRAM))
        counted = F.when(F.col("uid") == -1, _field(0))
    rows = rows.withColumn("c", F.sum(counted).over(Window.partitionBy("k1", "k2"))).where("uid != -1")
    is_bigram, found, n = F.col("kind") == BIGRAM, F.col("found"), F.col("n")
    paired = is_bigram & (F.col("k2") == 0)
    step = rows.withColumn("n", F.when(is_bigram, _field(0)))
    step = step.withColumn("seen", F.coalesce("c", F.lit(0)) - (n if own else F.lit(0))).withColumn("found", is_bigram & (F.col("seen") > 0))
    # Backed-off bigrams still lack the 1 / N of their document; that is added by their number at the end.
    code = F.when(found, F.when(paired, F.shiftright("k1", _CODE_BITS + _SHIFT)).otherwise(F.col("k1"))).otherwise(
        F.when(paired, F.shiftright("k1", _SHIFT).bitwiseAND(F.lit((1 << _CODE_BITS) - 1))).otherwise(F.col("k2"))
    )
    step = step.select(
        "uid",
        "kind",
        F.when(F.col("kind") == DOCUMENT, F.col("k2")).alias("doc_id"),
        F.when(F.col("kind") == DOCUMENT, F.col("small")).alias("n_words"),
        F.when(found, n * F.log(F.greatest("seen", F.lit(1))))
        .when(is_bigram, n * float(np.log(BACKOFF)))
        .when(F.col("kind") == DOCUMENT, F.col("v"))
        .otherwise(F.lit(0.0))
        .alias("v"),
        F.when(is_bigram & ~found, n).otherwise(F.lit(0)).alias("backed"),
        F.when(F.col("kind") != DOCUMENT, code).alias("word"),
        F.when(found, -n).when(is_bigram, n).when(F.col("kind") == DEMAND, F.col("v").cast("long")).alias("d"),
        F.when(found, _field(1)).otherwise(_field(2)).alias("t"),
    )
    step = step.join(head_words, F.col("word") == F.col("hw"), "left")
    log_count = lambda c: F.log(F.greatest(c - (F.col("t") if own else F.lit(0)), F.lit(UNSEEN)))
    value = F.col("v") + F.when(F.col("hc").isNotNull(), F.col("d") * log_count(F.col("hc"))).otherwise(F.lit(0.0))
    # What a partition has settled of a document is one row of it; words outside the head are asked
    # for once per document, and what their bigrams have settled goes along.
    document, open_word = F.col("kind") == DOCUMENT, F.col("word").isNotNull() & F.col("hc").isNull()
    parts = step.select(
        F.when(document, OF_DOCUMENT).when(open_word, OF_WORD).otherwise(OF_SUM).alias("part"),
        F.when(open_word, F.col("word")).otherwise(F.col("uid")).alias("key"),
        F.when(document, F.col("doc_id")).when(open_word, F.col("uid")).alias("whose"),
        _nano(value).alias("v"),
        F.when(document, F.col("n_words")).otherwise(F.col("backed")).alias("n"),
        F.when(open_word, F.col("d")).alias("d"),
        F.when(open_word, F.col("t")).alias("t"),
    )
    parts = parts.groupBy("part", "key", "whose").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("t").alias("t"))
    top = F.lit(-(1 << 63)).cast("long")
    unigrams = counts.where(F.col("kind") == WORD).groupBy(F.col("key").bitwiseOR(top).alias("uk")).agg(F.sum("n").alias("uc"))
    asks = F.col("part") == OF_WORD
    joined = parts.join(unigrams, (F.col("key") == F.col("uk")) & asks, "left")
    late = F.when(asks, _nano(F.col("d") * log_count(F.coalesce("uc", F.lit(0))))).otherwise(F.lit(0))
    of_document = F.col("part") == OF_DOCUMENT
    summed = joined.groupBy(F.when(asks, F.col("whose")).otherwise(F.col("key")).alias("uid")).agg(
        F.max(F.when(of_document, F.col("whose"))).alias("doc_id"),
        F.max(F.when(of_document, F.col("n"))).cast("long").alias("n_words"),
        F.sum(F.col("v") + late).alias("v"),
        F.sum(F.when(of_document, F.lit(0)).otherwise(F.col("n"))).alias("backed"),
    )
    rest = F.log(F.greatest(F.lit(total) - (F.col("n_words") if own else F.lit(0)), F.lit(1)))
    score = F.when(F.col("n_words") > 0, F.col("v") / NANO - F.col("backed") * rest)
    return summed.select("doc_id", "n_words", score.alias("log_score"), (score / F.nullif("n_words", F.lit(0))).alias("mean_log_score"))


def _gram_keys(words: list[bytes], order: int) -> list[list[int]]:
    """For n from 1 to ``order`` the signed 64-bit hashes of all n-grams, by first word."""
    digest = lambda n, i: xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), n)
    return [[h - (1 << 64) if h >> 63 else h for h in (digest(n, i) for i in range(len(words) - n + 1))] for n in range(1, order + 1)]


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _exploded(order: int):
    """uid, key, n: the distinct n-grams of each text with their numbers."""

    def run(batches):
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text")):
                found = Counter(k for keys in _gram_keys(_words_of(text.as_py()), order) for k in keys)
                if found:
                    yield _batch(["uid", "key", "n"], [np.full(len(found), uid, np.int64), np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))])

    return run


def _backed_off(order: int, total: int, own: bool):
    """doc_id, n_words, log_score of texts with the counts (keys, left) of their n-grams elsewhere."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, keys, left in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "keys", "left"))):
                words, held, score = _words_of(text), dict(zip(keys or [], left or [])), 0.0
                rest = max(total - (len(words) if own else 0), 1)
                grams = _gram_keys(words, order)
                for i in range(len(words)):
                    most = min(order, i + 1)
                    for n in range(most, 0, -1):
                        seen = held.get(grams[n - 1][i - n + 1], 0)
                        if n == 1 or seen > 0:
                            before = rest if n == 1 else max(held.get(grams[n - 2][i - n + 1], 0), UNSEEN)
                            score += (most - n) * np.log(BACKOFF) + np.log(max(seen, UNSEEN) / before)
                            break
                out.append((doc_id, len(words), float(score) if words else None))
            ids, sizes, scores = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "log_score"])

    return run


def score_ngrams(docs: DataFrame, train: DataFrame | None = None, order: int = 3) -> DataFrame:
    """As ``score_documents``, with n-grams up to ``order``."""
    if order < 1:
        raise ValueError("order must be positive")
    own = train is None
    keyed = shared.materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts")
    explode = lambda df: df.mapInArrow(_exploded(order), "uid long, key long, n long")
    corpus = keyed if own else train.select(F.lit(-1).cast("long").alias("uid"), "text")
    total = corpus.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0] or 0
    counts = shared.materialize(explode(corpus.select("uid", "text")).groupBy("key").agg(F.sum("n").alias("c")), "ngram-counts")
    left = F.col("c") - (F.col("n") if own else F.lit(0))
    finds = explode(keyed.select("uid", "text")).join(counts, "key").select("uid", "key", left.alias("left")).where("left > 0")
    per_text = finds.groupBy("uid").agg(F.collect_list(F.struct("key", "left")).alias("f")).select("uid", F.col("f.key").alias("keys"), F.col("f.left").alias("left"))
    scored = keyed.join(per_text, "uid", "left").select("doc_id", "text", "keys", "left")
    out = scored.mapInArrow(_backed_off(order, total, own), "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))
