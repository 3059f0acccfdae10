"""Source divergence audit: how far apart the term distributions of a language's sources are.

Each kept term of a language is a transaction: its nonzero counts in source order. Counts are
gathered per map task first (one row for each task, source and term, however frequent the term), then summed.
The transactions, equal ones merged to a multiplicity, are spread by ranges of their paths and inserted into
frequent-pattern trees: terms that begin with the same counts share nodes, and sorted paths build a tree in one
pass with the open path alone in memory. A node is settled once, with its whole multiplicity: for
every ancestor, the correction of that pair of counts. A range border cuts a node into two, whose
multiplicities add up, so any number of tasks gives the same sums.

With p0 a source's smoothed share of an absent term, the distance of sources a and b is

    V |p0a - p0b|
    + the sum over the terms of a of |pa - p0b| - |p0a - p0b|, likewise over those of b
    + the sum over the terms of both of |pa - pb| - |pa - p0b| - |p0a - pb| + |p0a - p0b|

The second line needs counts of equal counts only (the trees' header tables), the third is what
the trees settle. All of it is integer arithmetic.

Defined results: null text, lang and source are ''. A group without terms has the shares of
an absent term; where a language keeps no term, distances are 0 and there are no term rows; a language with one
source has no pairs; repeated rows count as often as they stand; an empty table gives no rows; other
columns are not read. The result holds all pairs of a language's sources; a transaction is as long
as a language has sources, and no more than a task's open path is held.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: A term stays if it is in so many documents of its language.
LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50

#: Letters in lower case and all bytes of other characters stay; everything else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms that a map task holds before it hands its counts on.
_HELD = 1_000_000


def _map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: the counts of a map task; term is null in a row that only says
    that the group occurs."""
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for (lang, source), terms in counts.items():
            within, keys = docs[lang, source], list(terms)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                numbers = [pa.array(list(map(c.__getitem__, part)), pa.int64()) for c in (terms, within)]
                columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), *numbers]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, source, None, 0, 0), [pa.string()] * 3 + [pa.int64()] * 2)], names=names)
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            words, group = (text or b"").translate(_TABLE).split(), (lang or "", source or "")
            known, distinct = counts[group], set(words)
            before = len(known)
            known.update(words)
            docs[group].update(distinct)
            held += len(known) - before
            if held > _HELD:
                yield from flush()
                held = 0
    yield from flush()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of a term in a group and documents that have it; a row
    with a null term for every group."""
    read = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    partial = read.mapInArrow(_map_counts, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, n: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 5) / (n + 5 * terms)), in decimals wide enough to be exact."""
    wide = lambda x, digits: f"CAST({x} AS DECIMAL({digits}, 0))"
    return F.expr(f"1 + {wide(UNIT, 10)} * {wide(f'({count}) + {SMOOTHING}', 19)} div {wide(f'({n}) + {SMOOTHING} * ({terms})', 19)}")


class _Tree:
    """The open path of a frequent-pattern tree over sorted transactions, and the corrections so far."""

    def __init__(self) -> None:
        self.lang: str | None = None
        self.keys: list[tuple[str, int]] = []
        self.weights: list[int] = []
        self.shares = np.empty((64, 2), np.int64)  # of the open path: p and p0
        self.places = np.empty(64, np.int64)  # of its sources among the language's
        self.sources: dict[str, int] = {}
        self.sums: dict[int, np.ndarray] = {}  # by source: its corrections with those before it

    def insert(self, lang: str, path: list[tuple[str, int, int, int]], times: int) -> None:
        """Adds a transaction; the language may only change after ``close(0)`` and ``taken``."""
        common = 0
        while common < min(len(path), len(self.keys)) and path[common][:2] == self.keys[common]:
            common += 1
        self.close(common)
        self.lang = lang
        if len(path) > len(self.places):
            more = 2 * len(path) - len(self.places)
            self.shares, self.places = np.concatenate([self.shares, np.empty((more, 2), np.int64)]), np.concatenate([self.places, np.empty(more, np.int64)])
        for source, n, p, p0 in path[common:]:
            at = len(self.keys)
            self.shares[at], self.places[at] = (p, p0), self.sources.setdefault(source, len(self.sources))
            self.keys.append((source, n))
            self.weights.append(0)
        self.weights[-1] += times

    def close(self, depth: int) -> None:
        """Settles the nodes below ``depth``: once each, against every ancestor."""
        while len(self.keys) > depth:
            end = len(self.keys)
            start = max(depth, end - 256)  # nodes that are settled together
            p, p0 = self.shares[:end, 0], self.shares[:end, 1]
            own, own0 = p[start:, None], p0[start:, None]
            changes = np.abs(p - own) - np.abs(p - own0) - np.abs(p0 - own) + np.abs(p0 - own0)
            for at in range(end - 1, start - 1, -1):
                self.keys.pop()
                weight = self.weights.pop()
                if at:
                    self.weights[-1] += weight
                    row = self.sums.get(int(self.places[at]))
                    if row is None or len(row) < len(self.sources):
                        grown = np.zeros(max(16, 2 * len(self.sources)), np.int64)
                        grown[: 0 if row is None else len(row)] = 0 if row is None else row
                        row = self.sums[int(self.places[at])] = grown
                    row[self.places[:at]] += changes[at - start, :at] * weight

    def cells(self) -> int:
        return sum(map(len, self.sums.values()))

    def taken(self) -> Iterator[tuple[str, str, str, int]]:
        """lang, a, b, value: the corrections so far, which are forgotten."""
        names = list(self.sources)
        for b, row in self.sums.items():
            for a in np.nonzero(row)[0].tolist():
                yield self.lang, names[a], names[b], int(row[a])
        self.sums.clear()


#: Pairs of sources that a task sums before it hands them on.
_PAIRS_HELD = 4_000_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: summed corrections of a range of sorted transactions."""
    tree = _Tree()

    def handed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        while part := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["lang", "a", "b", "value"])

    for batch in batches:
        for lang, path, times in zip(*(c.to_pylist() for c in batch.columns)):
            if lang != tree.lang:
                tree.close(0)
                yield from handed(tree.taken())
                tree = _Tree()
            tree.insert(lang, [(x["source"], x["n"], x["p"], x["p0"]) for x in path], times)
        if tree.cells() > _PAIRS_HELD:
            yield from handed(tree.taken())
    tree.close(0)
    yield from handed(tree.taken())


def corrections(kept: DataFrame) -> DataFrame:
    """lang, a, b (a before b), value: the sum over the terms that both sources have. ``kept`` has
    lang, term, source, n, p and p0."""
    item = F.struct("source", "n", "p", "p0")
    paths = kept.groupBy("lang", "term").agg(F.array_sort(F.collect_list(item)).alias("path")).where(F.size("path") > 1)
    merged = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = merged.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path")
    settled = ranged.mapInArrow(_settle, "lang string, a string, b string, value long")
    return settled.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most) if most else ranked


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each source by distance (part
    ``pair``), and the terms that it has more of than its language (part ``term``), the first ``top``."""
    counts = shared.materialize(count_terms(docs), "divergence-counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term")
    items = by_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items")).where(F.col("docs") >= least_docs)
    items = shared.materialize(items.select("lang", "term", "total", F.explode("items").alias("x")).select("lang", "term", "total", "x.source", "x.n"), "divergence-terms")

    langs = items.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    langs = counts.select("lang").distinct().join(langs, "lang", "left")
    sums = items.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("group_n", "terms", "lang_n")}
    groups = groups.withColumns(zero).withColumn("p0", F.when(F.col("terms") > 0, _share("0", "group_n", "terms")).otherwise(F.lit(0).cast("long")))
    groups = shared.materialize(groups, "divergence-groups")
    few = shared.maybe_broadcast(groups)

    kept = items.join(few, ["lang", "source"])
    kept = kept.select("lang", "term", "source", "n", _share("n", "group_n", "terms").alias("p"), _share("total", "lang_n", "terms").alias("q"), "p0")
    kept = shared.materialize(kept, "divergence-shares")

    # The header tables: terms of a source by their count, against every other source.
    same = kept.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    met = same.join(shared.maybe_broadcast(other), "lang").where("source != b")
    change = F.col("times") * (F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("p0") - F.col("b0")))
    single = met.select("lang", F.col("source").alias("a"), "b", change.alias("value"))
    base = groups.select("lang", F.col("source").alias("a"), "p0", "terms").join(shared.maybe_broadcast(other), "lang").where("a != b")
    base = base.select("lang", "a", "b", (F.col("terms") * F.abs(F.col("p0") - F.col("b0"))).alias("value"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    both = shared.materialize(corrections(kept), "divergence-corrections")
    single = single.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    whole = base.unionByName(single).unionByName(turned(single)).unionByName(both).unionByName(turned(both))
    pairs = whole.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = _ranked(pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value"))

    over = kept.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(_ranked(over, top)).select("lang", "source", "part", "item", "value", "rank")
