"""Corpus operators against brute force, on tables with nulls, repeats, ties and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestitch.llm import ann, decontam, line_dedup, lm_score, mixing, quality, sharding, simhash, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "délta", "É", "e-psilon", "zeta.", "eta", "theta", "iota!", "k1", "λ"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " more", None, "", " \t\n", "one", "two words", "x " * 30_000]
    for _ in range(6):  # near copies of a long text
        words = (" ".join(texts[:8])).split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    out = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"src{i % 4}", None) for i, t in enumerate(texts)]
    return out + [out[2], (None, "a null id", None, "src1", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["fp", "size", "shard", "words", "h", "target", "rank", "near_fp", "mix_key", "hit_doc"]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((x is None, x) for x in r)


# ---- 1 ------------------------------------------------------------------------------


def plain_print(text):
    words = SPACE.findall((text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, rows):
    prints = [plain_print(r[1]) for r in rows]
    root = plain_groups(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    want = sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=key)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == want


@pytest.mark.parametrize("parts,radius", [(1, 3), (2, 3), (4, 3), (2, 5), (4, 6), (1, 2)])
def test_links_at_every_distance(spark, parts, radius):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for p in base:
        for d in range(1, 8):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, parts).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= radius}
    assert got == want


def test_fingerprint_of_a_text_longer_than_a_slice():
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(simhash.SLICE + 5_000))
    assert simhash.fingerprint(text) == plain_print(text)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (100, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}


def test_keep_one(spark, docs, rows, empty):
    root = plain_groups([plain_print(r[1]) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [root[plain_print(r.text)] for r in kept.collect()]
    assert len(got) == len(set(got)) == len(set(root.values()))
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(r.doc_id for r in simhash.keep_one(unique).collect())
    assert got == sorted({r.component_id for r in simhash.near_duplicates(unique).collect()})
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


# ---- 2 ------------------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[50:70] = vectors[0]
    table = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    table += [(400, None, 0), (500, [0.0] * 8, 0), (600, [float("nan")] * 8, 0), (700, [None] * 8, 0), (800, [1.0], 0), (None, [1.0] * 8, 0), (900, [], 0)]
    got = ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>, rank int")).collect()
    for q in (0, 100, 200):
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[1] for r in mine] == [i for _, i in want]
        assert np.allclose([r[2] for r in mine], [x for x, _ in want])
    assert {r.query_id for r in got} == {0, 100, 200}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_search_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(table)
    t = table.toPandas()
    x, ids = np.stack(t["embedding"].to_numpy()).astype(float), t["vec_id"].to_numpy()
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    right = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        right, total = right + len(found[q] & set(want)), total + 10
    assert right / total >= 0.9


# ---- 3 ------------------------------------------------------------------------------


def plain_scores(texts, train=None):
    split = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    words = [split(t) for t in texts]
    corpus = words if train is None else [split(t) for t in train]
    c1, c2 = Counter(w for ws in corpus for w in ws), Counter(b for ws in corpus for b in zip(ws, ws[1:]))
    total = sum(c1.values())
    for ws in words:
        o1, o2 = (Counter(ws), Counter(zip(ws, ws[1:]))) if train is None else (Counter(), Counter())
        n, s = max(total - (len(ws) if train is None else 0), 1), 0.0
        for i, w in enumerate(ws):
            u = max(c1[w] - o1[w], 0.5) / n
            b = (ws[i - 1], w)
            if i == 0:
                s += math.log(u)
            elif c2[b] - o2[b] > 0:
                s += math.log((c2[b] - o2[b]) / max(c1[b[0]] - o1[b[0]], 0.5))
            else:
                s += math.log(0.4 * u)
        yield len(ws), s if ws else None


@pytest.mark.parametrize("head", [0, 5, 1000])
@pytest.mark.parametrize("other", [False, True])
def test_lm_scores(spark, docs, rows, head, other, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD_WORDS", head)
    monkeypatch.setattr(lm_score, "HEAD_BIGRAMS", head)
    train = ["alpha beta gamma alpha beta", "theta eta theta eta", None, "x x x"] if other else None
    table = None if train is None else spark.createDataFrame([(t,) for t in train], "text string")
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score_documents(docs, table).collect()), key=key)
    want = sorted(((r[0], n, s) for r, (n, s) in zip(rows, plain_scores([r[1] for r in rows], train))), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2] == w[2] or abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2]))


def plain_ngram_scores(texts, train, order):
    split = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    corpus = [split(t) for t in (texts if train is None else train)]
    counts, total = sum((grams(ws) for ws in corpus), Counter()), sum(map(len, corpus))
    for ws in map(split, texts):
        own = grams(ws) if train is None else Counter()
        c = lambda g: counts[g] - own[g]
        s = 0.0
        for i in range(len(ws)):
            n = most = min(order, i + 1)
            while n > 1 and c(tuple(ws[i - n + 1 : i + 1])) <= 0:
                n -= 1
            below = max(total - (len(ws) if train is None else 0), 1) if n == 1 else max(c(tuple(ws[i - n + 1 : i])), 0.5)
            s += (most - n) * math.log(0.4) + math.log(max(c(tuple(ws[i - n + 1 : i + 1])), 0.5) / below)
        yield len(ws), s if ws else None


@pytest.mark.parametrize("order", [1, 2, 3, 5])
@pytest.mark.parametrize("train", [None, ["alpha beta gamma alpha beta", None, "x x x"]])
def test_lm_any_order(spark, docs, rows, order, train):
    table = None if train is None else spark.createDataFrame([(t,) for t in train], "text string")
    few, given = rows, docs
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score_ngrams(given, table, order).collect()), key=key)
    want = sorted(((r[0], n, s) for r, (n, s) in zip(few, plain_ngram_scores([r[1] for r in few], train, order))), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == w[2] or abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2])) for g, w in zip(got, want))
    if order == 2:
        fast = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score_documents(given, table).collect()), key=key)
        assert all(g[2] == f[2] or abs(g[2] - f[2]) < 1e-6 * max(1, abs(f[2])) for g, f in zip(got, fast))


def test_lm_flushes_keep_words_apart(monkeypatch):
    monkeypatch.setattr(lm_score, "FLUSH", 5)
    texts = ["a b c", None, "d", "e f g h i j k", "", "l m"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], names=["text", "uid"])
    uid, words, hashes = [], [], []
    for rows_, lengths, found in lm_score._flushes([batch], ["uid"]):
        uid += rows_["uid"]
        words += list(lengths)
        hashes += list(found)
    assert uid == list(range(6)) and words == [3, 0, 1, 7, 0, 2] and hashes == [xxhash.xxh64_intdigest(c.encode(), 42) for c in "abcdefghijklm"]


def test_lm_empty(empty):
    assert lm_score.score_documents(empty).count() == lm_score.score_ngrams(empty).count() == 0


# ---- 4 ------------------------------------------------------------------------------


@pytest.mark.parametrize("most_tasks", [20_000, 3])
def test_warc_round_trip(spark, tmp_path, monkeypatch, most_tasks):
    monkeypatch.setattr(warc, "MOST_TASKS", most_tasks)  # with 3, a task writes several archives
    long, crlf = "é" * 700, "a\r\n\r\nWARC/1.1\r\n" * 120
    pages = [(1, "http://a/", long), (5, "http://b/\r\nX: y", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", "")]
    pages += [(8, "u", crlf), (9, "u", "z" * 5000), (9, "u", "z" * 5000), (None, "u", long), (10, "u", "\x1f\x8b binary"), (11, "http://a/\tb", "x")]
    pages += [(12, "u", "".join(map(str, range(40_000)))), (13, "u", "q" * 16 * 999), (14, "u", "q" * (16 * 999 + 1))]  # over several archives
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/warc"
    out = warc.archive_round_trip(df, path, segment_bytes=999, archive_bytes=4000)
    table = out.collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table), key=key)
    assert len(list((tmp_path / "warc").glob("part-*"))) > 6
    assert {r.url for r in table if r.page_id == 5} == {"http://b/%0D%0AX: y"} and {r.url for r in table if r.page_id == 11} == {"http://a/%09b"}
    keeper = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            keeper[b] = max(keeper.get(b, i), i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        k = keeper.get(b, i)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if i == k else "revisit", None if i == k else k))
    assert got == sorted(want, key=key)
    chunks = warc.read_chunks(spark, path, chunk_bytes=100).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.data)
        assert len(r.data) <= 100
        if r.sha1_so_far is None:  # began in another archive
            assert r.segmented and r.chunk_no >= (warc.RUN if most_tasks > 3 else 1) * warc.SEGMENT_CHUNKS  # an archive that is full cuts a run
        else:
            assert hashlib.sha1(whole[r.record_id]).hexdigest() == r.sha1_so_far
    said = [(h or "").encode() for (i, _, h), w in zip(pages, want) if w[3] == "response"] + [b""] * sum(w[3] == "revisit" for w in want)
    assert sorted(whole.values()) == sorted(said)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(empty).count() == 0


def test_warc_reader_finds_damage(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.read_records(record[:-6]))
    for text in (record, record.replace(b"sha1:00", b"sha1:da23614e02469a0d7c7bd1bdab5c9c474b1904dc")):
        folder = tmp_path / str(len(text))
        folder.mkdir()
        (folder / "part-0").write_bytes(text)
        if text == record:
            with pytest.raises(Exception, match="digest differs"):
                warc.read_whole(spark, f"file://{folder}").collect()
        else:
            assert [(r.bytes, r.record_id) for r in warc.read_whole(spark, f"file://{folder}").collect()] == [(2, "x")]
    first = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Segment-Number: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "part-1").write_bytes(first)  # its other segments are lost
    with pytest.raises(Exception, match="cut off"):
        warc.read_whole(spark, f"file://{tmp_path}").collect()


# ---- 5 ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(texts, items):
    words = lambda t: WORD.findall((t or "").translate(FOLD))
    windows = {}  # span -> window -> items
    for i, item in items:
        iw = words(item)
        span = min(13, len(iw))
        for j in range(len(iw) - span + 1 if iw else 0):
            windows.setdefault(span, {}).setdefault(tuple(iw[j : j + span]), set()).update({str(i)} if i is not None else set())
    for t in texts:
        ws, hit, found = words(t), set(), set()
        for span, known in windows.items():
            for k in range(len(ws) - span + 1):
                if tuple(ws[k : k + span]) in known:
                    hit |= set(range(k, k + span))
                    found |= known[tuple(ws[k : k + span])]
        yield len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    texts = [r[1] for r in rows if r[1] and 20 < len(r[1]) < 5000]
    pick = lambda n: " ".join(rng.choice(texts).split()[:n])
    items = [(i, pick(n)) for i, n in enumerate([13, 14, 20, 40, 12, 8, 5, 1, 30, 13])]
    items += [(20, None), (21, "..."), (3, "two words"), (None, "one"), (22, "x " * 13), (25, "x " * 1_000), (23, "a1 b2"), (24, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((tuple(r) for r in decontam.judge(docs, bench).collect()), key=key)
    want = sorted(((r[0], *x) for r, x in zip(rows, plain_hits([r[1] for r in rows], items))), key=key)
    assert got == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for r, x in zip(rows, plain_hits([r[1] for r in rows], items)) if not x[4])
    assert decontam.judge(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.judge(docs, bench.limit(0)).collect())


# ---- 6 ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    image = sharding.permute(np.arange(n), n)
    assert sorted(image) == list(range(n))
    assert (sharding.permute(image, n, back=True) == np.arange(n)).all()


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs).collect()
    again = sharding.shard_documents(docs.repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.shard, r.slot) if r.doc_id is not None else (True, -1, r.shard, r.slot) for r in out) == sorted(
        (r.doc_id is None, r.doc_id, r.shard, r.slot) if r.doc_id is not None else (True, -1, r.shard, r.slot) for r in again
    )
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert sharding.shard_documents(empty).count() == 0


# ---- 7 ------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = scored[scored["quality"] == 1], scored[scored["quality"] == 0]
    assert good["predicted"].mean() > 0.95 and bad["predicted"].mean() < 0.4
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in scored["doc_id"])


def test_quality_vote_equals_plain_vote():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words[: 5 + i % 30], k=rng.randrange(1, 40))) for i in range(60)] + ["", None, "! ! !", "word1"]
    counts = np.stack([quality.terms(t) for t in [*texts, texts[3], texts[3]]])  # ties among the labelled
    labels = np.array([rng.random() < 0.5 for _ in range(len(counts))], float)
    model = quality.Model(np.log1p(counts[:40]), labels[:40], 8, 5, 8)
    vectors, asked = model.vectors.astype(float), model.project(counts).astype(float)
    for got, x in zip(model.score(counts), asked):
        near = [float(np.dot(x, v)) for v in vectors]
        last = sorted(near, reverse=True)[4]
        votes = [(max(n, 0) ** 8, y) for n, y in zip(near, labels) if n >= last - 1e-6]
        assert abs(got - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3


def test_quality_terms_of_a_sliced_text(monkeypatch):
    text = "Some Words, é and 12 more!\n" * 50
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "SLICE", 7)
    assert (quality.terms(text) == whole).all() and whole[: quality._PAIRS].sum() == len(text.encode()) - 1
    assert whole[quality._PAIRS : quality._PAIRS + quality.WORD_BUCKETS].sum() == len(text.split())


def test_quality_odd_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 0), (3, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


# ---- 8 ------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("bare.io", "block")]
    urls = [
        None, "", "no scheme/com/en/", "http://com/en/", "http://A.Example.COM/en/77?x#y", "http://example.com/en/8", "https://xexample.com/en/7", "ftp://example.net/de/80",
        "http://m.example.net/de/9", "http://org/es", "http://x.org/es/", "http://x.org?/es/", "http://net#/de/", "a://b://com/en/", "http://bare.io", "http://sub.bare.io/any",
    ]
    pages = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[3])]

    def plain(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fits = []
        for r, v in rules:
            h, _, p = r.partition("/")
            p = "/" + p if "/" in r else ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(r), r, v))
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("clash"))
    table = spark.createDataFrame([*rules, (None, "block")], "rule string, verdict string")
    want = sorted(((i, *plain(u)) for i, u in pages), key=key)
    for blocks in (1, 64):  # a saturated filter too
        got = sorted((tuple(r) for r in url_filter.judge_urls(df, table, max_blocks=blocks).collect()), key=key)
        assert got == want
    assert url_filter.judge_urls(df, table.limit(0)).where("verdict = 'block'").count() == 0


# ---- 9 ------------------------------------------------------------------------------


def test_url_empty_and_long(spark):
    """An empty table of pages, and URLs of 20 KB in seconds: rules deeper and shallower than them."""
    rules = spark.createDataFrame([("a.org/x/", "block"), ("a.org/x/x/y", "allow"), ("org/", "block"), ("b.a.org/" + "x/" * 12, "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([(i, "http://" + "s." * 30 + "b.a.org/" + "x/" * n) for i, n in enumerate((10_000, 12, 11, 2, 0))], "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert time.time() - began < 30
    assert got == {0: ("b.a.org/" + "x/" * 12, "allow"), 1: ("b.a.org/" + "x/" * 12, "allow"), 2: ("a.org/x/", "block"), 3: ("a.org/x/", "block"), 4: ("org/", "block")}
    empty = url_filter.judge_urls(pages.limit(0), rules)
    assert empty.columns == ["page_id", "host", "path", "rule", "verdict"] and empty.collect() == []


def test_line_dedup(spark):
    page = lambda body: f"<html><body><nav>Home</nav><p>{body}</p><div>Foot <b>er</b></div><script>var a = '<p>';</script></body></html>"
    pages = [(i, "http://Big.org/x", page(f"text {i}<br>shared {i % 2}")) for i in range(10)]
    pages += [(20 + i, "http://small.org/", page("same")) for i in range(3)] + [(30, None, None), (31, "http://big.org", ""), (None, "http://big.org", page("z"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit(0))
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[3].text == "text 3" and got[3].n_lines == 4 and got[3].n_dropped == 3 and got[3].host == "big.org"
    assert got[20].text == "" and got[20].n_dropped == 3 and got[30].text == ""  # a host of three pages is a host
    assert got[31].n_lines == 0 and got[31].text == "" and got[None].text == "z" and got[None].n_dropped == 2
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def plain_lines(html):
    space = "[ \\t\\n\\x0B\\f\\r]"
    out = re.sub(rf"(?is)<script\b.*?</script{space}*>|<style\b.*?</style{space}*>|<!--.*?-->", " ", html or "")
    cut = "|".join(line_dedup.BLOCKS)
    out = re.sub(r"[ \t]+", " ", re.sub(r"<[^>\n]*>", " ", re.sub(rf"(?i)</?(?:{cut})\b[^>]*>|[\r\n]+", "\n", out)))
    return [x.strip(" ") for x in out.split("\n") if x.strip(" ")]


def test_line_dedup_ratio_alone(spark):
    pages = [(i, "http://three.org/", f"<p>only {i}</p>") for i in range(3)] + [(9, "http://one.org/", "<p>a</p><p>b</p>")]
    got = {r.page_id: (r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: (1, ""), 1: (1, ""), 2: (1, ""), 9: (2, "")}


def test_line_dedup_long_pages(spark):
    """Two pages of 20,000 shared lines, and one long line."""
    body = "".join(f"<p>line {i}</p>" for i in range(20_000))
    pages = [(1, "http://a.org/", body), (2, "http://a.org/", body + "<p>own</p>"), *[(3 + i, "http://a.org/", f"<p>{'x' * 300_000}{i}</p>") for i in range(2)]]
    began = time.time()
    got = {r.page_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string"), ratio=0.4).collect()}
    assert got[1] == "" and got[2] == "own" and len(got[3]) == 300_001 and time.time() - began < 30


@pytest.mark.parametrize("ratio,support", [(0.3, 2), (0.1, 2), (0.1, 1), (0.5, 3)])
def test_line_dedup_equals_brute_force(spark, ratio, support):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(30)]
    pages = []
    for i in range(150):
        host = rng.choice(["a.org", "A.org", "b.net", f"h{i % 20}.com", ""])
        tag = rng.choice(["p", "div", "li"])
        html = "".join(f"<{tag}>{x}</{tag}>" for x in rng.choices(lines, k=rng.randrange(12)))
        pages.append((i, rng.choice([f"http://{host}/x", None]) if host else "none", rng.choice([html, html, None, "<script>x</script><p>only</p>"])))
    pages += [pages[3], pages[3], (None, "http://a.org", "<p>line 1</p>")]
    host = lambda u: (re.match(r"(?s)^.*?://([^/?#]*)", u or "") or ["", ""])[1].translate(FOLD)
    n_pages = Counter(host(u) for _, u, _ in pages)
    held = Counter((host(u), x) for _, u, h in pages for x in set(plain_lines(h)))
    want = []
    for i, u, h in pages:
        found = plain_lines(h)
        kept = [x for x in found if not (held[host(u), x] >= support and held[host(u), x] > ratio * n_pages[host(u)])]
        want.append((i, host(u), len(found), len(found) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [tuple(r) for r in line_dedup.drop_boilerplate(df, ratio=ratio, support=support).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


# ---- 10 -----------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, docs, rows, empty):
    words = lambda t: len(SPACE.findall(t or ""))
    sizes, longest = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
        longest[r[3]] = max(longest[r[3]], words(r[1]))
    target = plain_targets(sizes)
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    by_source = {sizes[s]: s for s in sizes}
    taken = Counter()
    for r in out:
        s = by_source[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
        assert r.position is None or 0 <= r.position <= 1
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places)
    again = {(r.doc_id, r.size, r.position) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.position) for r in out}
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns
    copies = Counter((r.doc_id, r.text) for r in drawn.collect())
    by_row = Counter()
    for r in out:
        by_row[(r.doc_id, r.size)] += r.taken
    sized = Counter()
    for (i, t), n in copies.items():
        sized[(i, words(t))] += n * words(t)
    assert {k: v for k, v in sized.items() if v} == {k: v for k, v in by_row.items() if v}
    assert mixing.mix_sources(empty).count() == mixing.draw_mix(empty).count() == 0
