"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of three kinds: a text's words (A-Z lower-cased, hashed to ``WORD_BUCKETS``), its
byte-class bigrams (letters by case, digits, blanks, line ends, non-ASCII, each punctuation
mark), and bucketed shape terms (length, share of words that repeat the word before, share of
distinct words). Counts are damped by logarithms and inverse document frequency; each kind is
scaled to the same length and weighted by ``KINDS``, so that none outweighs the others by mere
numbers. Latent axes are the leading right singular vectors of a labelled sample's term matrix.
The sample's vectors and labels are broadcast; every document's whole text is projected
and its exact cosine with each labelled vector is computed in blocks; the nearest vote with
their label, weighted by a power of the similarity. All that are as near as the last of the
nearest vote too, so ties need no order.

``FIT_ROWS`` bounds the labelled sample (and with it all that reaches the driver or is
broadcast: 2,048 rows of 2,600 half-precision numbers, and vectors of 64 numbers). It is drawn by hash of the id from labels whose
``crc32(doc_id) mod 4`` is not 2, copies of a text counting once. Labels are joined to
documents for the fit alone; a score depends on the text only.

Defined results: null and empty texts are scored by their shape terms; without labels, or
without a similar neighbour, the score is the mean label (0.5 without labels); several
labels of a document are averaged, null labels ignored; a null id is not held out; repeated
rows score alike; other columns are not read (or, in ``keep_good``, carried along untouched).
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

FIT_ROWS = 2048
AXES = 64
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.7
SEED = 11
#: Bytes of a text that are turned into terms at a time.
SLICE = 1 << 20

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_N_CLASSES = 7 + len(_PUNCTUATION)
_PAIRS = _N_CLASSES**2
WORD_BUCKETS = 1024
_BUCKETS = 12
N_TERMS = _PAIRS + WORD_BUCKETS + 3 * _BUCKETS
#: Where each kind of terms stands, and its weight: class bigrams, words, shape.
KINDS = ((0, _PAIRS, 1.0), (_PAIRS, _PAIRS + WORD_BUCKETS, 0.3), (_PAIRS + WORD_BUCKETS, N_TERMS, 0.5))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.int32)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    kind[ord(" ")], kind[ord("\n")], kind[128:] = 4, 5, 6
    kind[_PUNCTUATION] = 7 + np.arange(len(_PUNCTUATION))
    return kind


_KIND = _byte_classes()


def terms(text: str | None) -> np.ndarray:
    """Term counts of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_TERMS, np.float32)
    for at in range(0, len(raw) - 1, SLICE):
        kind = _KIND[np.frombuffer(raw, np.uint8, count=min(SLICE + 1, len(raw) - at), offset=at)]
        out[:_PAIRS] += np.bincount(kind[:-1] * _N_CLASSES + kind[1:], minlength=_PAIRS)
    words = raw.translate(_FOLD).split()
    n, counted = len(words), Counter(words)
    buckets = np.fromiter((xxhash.xxh32_intdigest(w, SEED) for w in counted), np.int64, len(counted)) % WORD_BUCKETS
    out[_PAIRS : _PAIRS + WORD_BUCKETS] = np.bincount(buckets, weights=list(counted.values()), minlength=WORD_BUCKETS)
    again = sum(map(operator.eq, words, words[1:])) / max(n - 1, 1)
    spread = len(counted) / max(n, 1) ** 0.75
    for i, bucket in enumerate((np.log2(n + 1), 0 if again < 0.02 else 1 + 10 * again, 6 * spread)):
        out[_PAIRS + WORD_BUCKETS + i * _BUCKETS + min(int(bucket), _BUCKETS - 1)] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _leading_axes(rows: np.ndarray, axes: int, turns: int = 12) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration: no square matrix is formed."""
    width = min(axes + 16, *rows.shape)
    basis = np.random.default_rng(SEED).standard_normal((rows.shape[1], width), dtype=np.float32)
    for _ in range(turns if width else 0):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, values, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turned.T)[:, :axes][:, values[:axes] > 1e-3])


class Model:
    """Axes, labelled vectors and labels; small by construction."""

    def __init__(self, logs: np.ndarray, labels: np.ndarray, axes: int, neighbours: int, power: int):
        """``logs``: log1p of the term counts of the labelled rows."""
        self.labels, self.neighbours, self.power = labels.astype(np.float64), min(neighbours, len(labels)), power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = (np.log((1 + len(labels)) / (1 + (logs > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = self._weighted(logs.astype(np.float32))
        self.axes = _leading_axes(weighted, axes)
        self.vectors = _unit(weighted @ self.axes)

    def _weighted(self, logs: np.ndarray) -> np.ndarray:
        """The rows' weighted terms, in place: the sample is the largest thing that a driver holds here."""
        logs *= self.idf
        for first, end, weight in KINDS:
            logs[:, first:end] *= weight / np.maximum(np.linalg.norm(logs[:, first:end], axis=1, keepdims=True), 1e-9)
        return logs

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self._weighted(np.log1p(counts, dtype=np.float32)) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.neighbours:
            return np.full(len(counts), self.prior)
        near = (self.project(counts) @ self.vectors.T).astype(np.float64)
        last = np.partition(near, -self.neighbours, axis=1)[:, -self.neighbours]
        weight = np.where(near >= last[:, None], np.maximum(near, 0), 0) ** self.power
        total = weight.sum(axis=1)
        voted = weight @ self.labels / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 1e-12, voted, self.prior), 0, 1)


def held_out() -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, axes: int = AXES, neighbours: int = NEIGHBOURS, power: int = POWER) -> Model:
    """A model of at most ``rows`` labelled documents."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
        .limit(2 * rows)  # copies of a text fall away below
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(shared.materialize(chosen, "labels")), "doc_id")
    keyed = texts.select("doc_id", "label", F.xxhash64("text").alias("text_key"), "text")

    def count(batches):
        """Texts become term counts of one size where they are read, and do not travel."""
        for batch in batches:
            logs = [np.log1p(terms(t.as_py())).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs, pa.binary())], names=["doc_id", "label", "text_key", "logs"])

    counted = keyed.mapInArrow(count, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, label double, text_key long, logs binary")
    once = counted.groupBy("text_key").agg(F.min(F.struct("doc_id", "logs")).alias("one"), F.avg("label").alias("label"))
    key = F.xxhash64(F.lit(SEED), "one.doc_id").alias("key")
    table = once.select(key, "text_key", "label", "one.logs").orderBy("key", "text_key").limit(rows).select("key", "label", "logs").toArrow()
    order = np.argsort(table["key"].to_numpy(), kind="stable")
    logs = np.stack([np.frombuffer(table["logs"][int(i)].as_buffer(), np.float16) for i in order]) if len(order) else np.zeros((0, N_TERMS), np.float16)
    return Model(logs, table["label"].to_numpy()[order], axes, neighbours, power)


def _scorer(docs: DataFrame, model: Model):
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(texts), 256):
            out.append(shipped.value.score(np.stack([terms(t) for t in texts.iloc[at : at + 256]])))
        return pd.Series(np.concatenate(out))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    score = _scorer(docs, fit(docs, labels, **options))
    return docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    score = _scorer(docs, fit(docs, labels, **options))
    return docs.where(score("text") >= threshold)
