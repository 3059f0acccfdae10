"""Results that earlier cuts lost: long counts, training order, repeated query rows, small hosts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lodestitch.llm import ann, lm_score, mixing
from lodestitch.llm import queries as registered

from .test_operators import SPACE, docs, key, plain_scores, rows  # noqa: F401


@pytest.mark.parametrize("other", [False, True])
def test_lm_counts_beyond_the_field(spark, docs, rows, other, monkeypatch):  # noqa: F811
    for name, value in (("_FIELD", 9), ("HEAD_WORDS", 0), ("HEAD_BIGRAMS", 0)):
        monkeypatch.setattr(lm_score, name, value)
    monkeypatch.setattr(lm_score, "_MOST", (1 << 9) - 1, raising=False)
    train = ["alpha beta gamma", "x " * 900, "x x x"] if other else None
    table = None if train is None else spark.createDataFrame([(t,) for t in train], "text string")
    more = docs.unionByName(spark.createDataFrame([(999, "x " * 700)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_score.score_documents(more, table).collect()), key=key)
    texts = [*((r[0], r[1]) for r in rows), (999, "x " * 700)]
    want = sorted(((i, n, s) for (i, _), (n, s) in zip(texts, plain_scores([t for _, t in texts], train))), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2] == w[2] or abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2]))


def test_lm_packed_counts(spark):
    counts = [(1, 2, 3), (255, 256, 300), (1, 1 << 19, 1 << 20), (1_048_576, 1_500_000, 1_048_577), ((1 << 30) - 1, 1 << 30, 1 << 30)]
    n, t1, t2 = (np.array(x) for x in zip(*counts))
    small = lm_score._pack(n, t1, t2, lm_score._FIELD)
    held = [(int(s), float(x) if s < 0 else 0.0) for s, x in zip(small, n)]
    got = spark.createDataFrame(held, "small long, v double").select(*[lm_score._field(i).alias(f"f{i}") for i in range(3)]).collect()
    assert [tuple(r) for r in got] == counts


@pytest.mark.parametrize("unique", [False, True])
def test_draw_mix_order(docs, unique):  # noqa: F811
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if unique else docs
    passes = []
    for r in mixing.mix_sources(docs).collect():
        passes += [(p, r.doc_id, r.size) for p in (r.position, r.second_position) if p is not None]
    want = [x[1:] for x in sorted(passes, key=key)]
    drawn = [(r.doc_id, len(SPACE.findall(r.text or ""))) for r in mixing.draw_mix(docs.repartition(3)).collect()]
    at = sorted(x[0] for x in passes)
    assert Counter(drawn) == Counter(want)
    ties = {i for i in range(len(at)) if at.count(at[i]) > 1}
    assert [x for i, x in enumerate(drawn) if i not in ties] == [x for i, x in enumerate(want) if i not in ties]


@pytest.mark.parametrize("times", [2, 12])
@pytest.mark.parametrize("apart", [0.0, 1e-3])
def test_search_with_repeated_query_rows(spark, times, apart):
    vectors = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table += [(0, (vectors[0] + np.float32(apart * m)).tolist()) for m in range(1, times)] + [table[7]] * 3
    got = ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect()
    arrays = [(i, np.array(v, np.float32).astype(float)) for i, v in table]
    want = []
    for q, x in arrays:
        if q % 100 == 0:
            near = sorted((np.sqrt(((x - v) ** 2).sum()), i) for i, v in arrays if i != q)[:10]
            want += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def test_registered_line_dedup_covers_small_hosts(spark, tmp_path):
    page = lambda body: f"<nav>Home</nav><p>{body}</p>"
    pages = [(10 * n + i, f"http://h{n}.org/", page(f"own {i}")) for n in (1, 2, 3, 4) for i in range(n)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in registered.op9_line_dedup(spark, str(tmp_path)).collect()}
    # the ratio of 0.3 alone decides: one page of three is above it, one of four is not
    assert got == {10 * n + i: f"own {i}" if n == 4 else "" for n in (1, 2, 3, 4) for i in range(n)}
