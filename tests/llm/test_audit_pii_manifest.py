"""Divergence audit, personal data and Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestitch.llm import divergence, merkle, pii, pii_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ["tree", "digest", "pos", "n", "part", "nth", "seen", "copy", "chunk", "suffix", "term", "value", "item", "rank", "p", "q", "h", "window", "spans"]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "délta", "É", "zeta", "eta9x", "λ", "the", "THE"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), ["en", "de", "fr"][i % 3], f"s{i % 4}", i % 50) for i in range(700)]
    out += [(1000 + i, "the beta", "en", "s0", None) for i in range(20)]
    out += [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, "only one", "xx", "lone", 8), (2003, "the " * 30_000, "en", "s1", 120_000), (None, "No Id", "en", "s1", 5), (None, None, "de", "s2", None)]
    return out + [out[5], out[5], out[9], (9, "another text under this id", "de", "s1", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 13 -----------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(shown))


def climb(digests):
    """The levels of a tree, and for each leaf its siblings level by level as (left, right)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            steps[i].append((run[: place % 16], run[place % 16 + 1 :]))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], steps


def plain_manifest(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, text, lang, source, n_chars)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        seen = plain_leaf(doc_id, text if text is None else text.translate(FOLD), lang, source, n_chars) if hit else leaf
        by[source].append((doc_id, leaf, seen))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = climb([leaf for _, leaf, _ in by[name]])
    root, above = climb([trees[n][0] for n in names])
    out = []
    for i, name in enumerate(names):
        for (doc_id, leaf, seen), steps in zip(by[name], trees[name][1]):
            steps, folded = steps + above[i], seen
            for left, right in steps:
                folded = sha("".join([*left, folded, *right]))
            out.append((doc_id, leaf, trees[name][0], root, sha("".join(d for a, b in steps for d in [*a, *b])), folded, folded == root))
    return sorted(out, key=key)


def test_manifest(spark, docs, rows, empty):
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=key)
    assert got == plain_manifest(rows)
    assert any(r[6] for r in got) and not all(r[6] for r in got)
    assert merkle.manifest(empty).collect() == []


@pytest.mark.parametrize("few", [[(1, "a B", None, None, 3)], [(5, "UP", "en", "a", 2), (7, "Up", "en", "b", 2)], [(i, "T", "en", f"src{i:03}", 1) for i in range(300)]])
def test_small_manifests(spark, few):
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(few, DOCS)).collect()), key=key) == plain_manifest(few)


def test_queue_front_is_bounded():
    done = merkle._forward([(i, f"{i:064x}") for i in range(256)], 2)
    assert [label for label, _ in done] == [(1, i) for i in range(16)] + [(2, 0)]
    assert len(merkle._reversed(done, [])) == 256


# ---- 11 -----------------------------------------------------------------------------


def plain_audit(rows, least, top):
    terms, seen, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        for w in words:
            terms[lang, source, w] += 1
        for w in set(words):
            seen[lang][w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in seen[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        sums = {s: sum(terms[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): share(terms[lang, s, w], sums[s]) for s in sources for w in kept}
        q = {w: share(sum(terms[lang, s, w] for s in sources), sum(sums.values())) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s, w] - p[o, w]) for w in kept)) for o in sources if o != s]
            over = [(w, p[s, w] - q[w]) for w in kept if terms[lang, s, w] and p[s, w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 4), (30, 50), (10**6, 5)])
def test_audit(spark, docs, rows, least, top):
    assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == plain_audit(rows, least, top)


def test_audit_of_nothing(spark, empty):
    assert divergence.audit(empty).collect() == []


def test_tree_settles_each_node_once():
    paths = [([("a", 1, 10, 3), ("b", 2, 20, 4)], 5), ([("a", 1, 10, 3), ("b", 2, 20, 4), ("c", 1, 7, 2)], 1), ([("a", 1, 10, 3), ("c", 1, 7, 2)], 2), ([("b", 2, 20, 4), ("c", 9, 40, 2)], 3)]
    tree, want = divergence._Tree(), Counter()
    for path, times in paths:
        tree.insert("en", path, times)
        for i, (a, _, pa_, a0) in enumerate(path):
            for b, _, pb, b0 in path[i + 1 :]:
                want["en", a, b] += times * (abs(pa_ - pb) - abs(pa_ - b0) - abs(a0 - pb) + abs(a0 - b0))
    tree.close(0)
    assert {(lang, a, b): v for lang, a, b, v in tree.taken()} == {k: v for k, v in want.items() if v}
    assert list(tree.taken()) == []


def test_audit_flushes(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 5)
    batches = [pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), pa.array(["s", "t", "s"]), pa.array([b"One two THREE four five six", b"two two", None], pa.binary())], names=["lang", "source", "text"])]
    n, df = Counter(), Counter()
    for b in divergence._map_counts(iter(batches)):
        for r in b.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            df[r["lang"], r["source"], r["term"]] += r["docs"]
    assert n["en", "t", "two"] == 2 and df["en", "t", "two"] == 1 and n["en", "s", "three"] == 1 and ("de", "s", None) in n


# ---- 12 -----------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_base(text):
    checks = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and plain_luhn(re.sub(r"\D", "", s)), lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if checks[k](m[0]))


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_rules_equal_the_expressions():
    rng = random.Random(1)
    for alphabet in ("a1@.", "1.2 ", "0123456789 -", "+1(2) .-3", "aZ0@._%+-é 12"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert sorted((s, k, e) for k, s, e in pii.matches(text)) == sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text)), text
            assert pii.base_spans(text) == plain_base(text), text
    for _ in range(300):
        text = " ".join(pii.planted(rng.randrange(4), rng) for _ in range(3))
        assert pii.base_spans(text) == plain_base(text)


def test_rules_are_linear():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1(" * 100_000, "9 " * 150_000, "a" * 200_000 + "@b.c"):
        pii.base_spans(text)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(2)
    return [" ".join(pii._word(rng) for _ in range(12))[:64] for _ in range(200)]


@pytest.fixture(scope="module")
def tagger(spark, prose):
    return pii.fit(spark.createDataFrame([(i, " ".join(prose[i % 50 : i % 50 + 5])) for i in range(80)], "doc_id long, text string"))


def spans_of(tagger, texts):
    finder = pii._finder(tagger, pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    return [[tuple(int(v) if v.isdigit() else v for v in x.split(":")) for x in r["spans"].split(",") if x] for b in finder(iter([batch])) for r in b.to_pylist()]


def test_gradients_are_those_of_the_likelihood():
    """A small step down each weight's gradient changes the loss as the gradient says (weights whose gates are open)."""
    rng = np.random.default_rng(0)
    windows, tags = rng.integers(1, 6, (9, 5)), np.zeros((9, 5), np.intp)
    tags[3], tags[4] = 3, 4
    model = pii_model.train(rng.integers(1, 6, (4, 9)), np.zeros((4, 9), np.intp), 1)
    _, grads = pii_model._gradients(model, windows, tags)
    for name, grad in zip(("out", "bias"), grads[2:4]):
        weight = getattr(model, name)
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, losses = weight[at], []
        for step in (1e-2, -1e-2):
            weight[at] = kept + step
            losses.append(pii_model._gradients(model, windows, tags)[0])
        weight[at] = kept
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grad[at], rel=0.05)


def test_bound_loses_no_path(tagger, prose):
    """Windows that are not searched have "outside" throughout as their best path."""
    rng = random.Random(4)
    texts = [(prose[i] + " " + (pii.planted(i % 4, rng) if i % 3 else pii._decoy(rng)) + " " + prose[-i])[:96] for i in range(120)]
    windows = np.zeros((96, 128), np.int8)
    for i, t in enumerate(texts):
        windows[: len(t), i] = pii_model.codes(t)
    scores = tagger.emissions(windows)
    assert set(np.nonzero((tagger._best(scores) > 0).any(axis=1))[0].tolist()) <= set(np.nonzero(tagger._may_hold(scores))[0].tolist())


def test_tagger_finds_what_the_rules_drop(tagger, prose):
    rng = random.Random(8)
    texts, want = [], []
    for i in range(200):
        a, b = (pii.planted(2, rng), pii.planted(2, rng)) if i % 2 else (f"+1 ({pii._digits(rng, 3)}) 555-{pii._digits(rng, 4)}", pii.planted(1, rng))
        text = prose[i % 50] + " " + a + " "
        want.append({(s, e) for s, e in ((len(prose[i % 50]) + 1, len(text) - 1), (len(text), len(text) + len(b)))})
        texts.append(text + b + " " + prose[-1 - i % 50])
    got = spans_of(tagger, texts)
    found = sum(len(w & {(s, e) for _, s, e in g}) for w, g in zip(want, got))
    rules = sum(len(w & {(s, e) for s, _, e in pii.base_spans(t)}) for w, t in zip(want, texts))
    assert rules <= 200 and found >= 360
    assert all(set(pii.base_spans(t)) <= {(s, pii.KINDS.index(k), e) for k, s, e in g} for t, g in zip(texts, got))


def test_clean_texts_stay_clean(tagger, prose):
    rng = random.Random(9)
    clean = [" ".join([*prose[i : i + 4], pii._word(rng), f"{rng.randint(1990, 2030)}-01-02", "12:30:45", "1,234.50", "v1.2.3", prose[i]]) for i in range(100)]
    assert sum(map(len, spans_of(tagger, clean))) <= 2


def test_whole_texts_wherever_windows_end(tagger, prose):
    """A find is the same at every place of a long text, and whatever stands in the batch."""
    rng = random.Random(10)
    card = "4111 1111 1111 1111 5500 0000 0000 0004"
    long = "".join(prose[rng.randrange(200)] + " " for _ in range(400))
    for at in [*range(380, 520, 7), 5000, 20_000]:
        cut = long.index(" ", at) + 1
        text = long[:cut] + card + " " + long[cut:]
        (got,) = spans_of(tagger, [text])
        assert {(s - cut, e - cut) for _, s, e in got} == {(0, 19), (20, 39)}, at
    texts = [long, "", long[:100] + card, "a@b.cc", None, long[300:]]
    assert spans_of(tagger, texts) == [s for t in texts for s in spans_of(tagger, [t])]


def test_pii_table(spark, tagger, docs, empty):
    out = pii.find_personal_data(docs, tagger)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert out.count() == docs.count()
    for r in out.where("spans = ''").limit(3).collect():
        assert r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["n_card"] == 0
    assert pii.find_personal_data(empty).collect() == []
    mixed = spark.createDataFrame([(1, "x@y.zz, 10.0.0.1, 4111111111111111, +1 (509) 555-6973"), (1, None)], "doc_id long, text string")
    first, second = sorted(pii.find_personal_data(mixed, tagger).collect(), key=lambda r: -len(r["spans"]))
    text = "email:0:6,ip:8:16,card:18:34"
    assert (first["n_email"], first["n_ip"], first["n_card"], first["n_phone"]) == (1, 1, 1, 1)
    assert first["spans"].startswith(text) and first["base_sha256"] == hashlib.sha256((text + ",phone:36:53").encode()).hexdigest()
    assert second["spans"] == "" and second["n_email"] == 0
