"""The pipeline's near-dedup against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lodestitch.llm import near_dup


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def texts():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \t", "one", "One", "two words", "a b c d e", "a b c d e f"]
    passage = words(60)
    for n in (100, 200, 500):
        for changed in (1, 2, 4, 10, 20):
            base = words(n)
            for _ in range(4):
                copy = list(base)
                for at in rng.sample(range(n), changed * n // 200 or 1):
                    copy[at] = f"new{rng.randrange(10**6)}"
                out.append(" ".join(copy))
    out += [" ".join(words(150) + passage) for _ in range(40)]  # one passage in unlike texts
    base = words(120)
    for _ in range(120):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out + out[8:12]


def test_stage_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == sorted(set(plain_roots(rows)))


def test_exact_equals_brute_force(spark):
    """Also where the bands and the bits of min-hashes could miss a pair: at the threshold itself."""
    rng = random.Random(12)
    rows = texts()
    for _ in range(60):
        base = [f"t{rng.randrange(10**6)}" for _ in range(49)]  # 45 shingles; 40 shared of 50 are 0.8
        rows += [" ".join(base), " ".join([*base[:44], *(f"u{rng.randrange(10**6)}" for _ in range(5))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(r.doc_id for r in near_dup.keep_one(docs, exact=True).collect())
    assert got == sorted(set(plain_roots(rows)))


def test_similar_sets_share_a_prefix():
    rng = random.Random(13)
    for n in range(1, 60):
        found = np.array(sorted(rng.sample(range(10**9), n)), np.uint64)
        for gone in range(n - -(-4 * n // 5) + 1):
            rest = np.delete(found, rng.sample(range(n), gone))
            assert set(near_dup.prefix(found)[0]) & set(near_dup.prefix(rest)[0])


def test_stage_with_null_and_repeated_ids(spark):
    rows = texts()[:60]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(rows))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, rows)], "doc_id long, text string, near_fp string")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    roots = plain_roots(rows)
    where = {t: r for t, r in zip(rows, roots)}
    got = [where[r.text] for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(set(got)) == len(set(roots))
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_balls_bring_candidates(spark):
    """Ball hashing is a step of its own: sets within 3 bits of their SimHash are asked by it, bands or not."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(9000)}" for _ in range(600)]
    rows = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base[1:]), " ".join(f"v{rng.randrange(9000)}" for _ in range(300)), None, "one"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = near_dup.shared.materialize(near_dup._sets(docs), "test-sets")
    nodes = {r.fp: near_dup.shingles(rows[r.doc_id]) for r in sets.select("fp", "doc_id").collect()}
    prints = {fp: near_dup.print_of(s) for fp, s in nodes.items()}
    size = lambda a, b: 5 * min(len(nodes[a]), len(nodes[b])) >= 4 * max(len(nodes[a]), len(nodes[b]))
    want = {(a, b) for a in nodes for b in nodes if a < b and bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 3 and size(a, b)}
    got = {tuple(r) for r in near_dup.ball_pairs(sets).collect()}

    def tied(pairs):
        of = {x: {x} for x in nodes}
        for a, b in pairs:
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
        return {frozenset(x) for x in of.values()}

    # Of equal fingerprints the first node alone meets others.
    assert len(want) >= 3 and got <= want and tied(got) == tied(want)
