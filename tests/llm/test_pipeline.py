"""The pipeline on a small table: every stage's decision takes effect on what it got."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lodestitch.llm import decontam, mixing, quality, shared

from .test_near_dup import plain_roots


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen[name] = docs
        docs = shared.materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == documents.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good = {r.doc_id for r in quality.score_documents(seen["quality"], labels).where("predicted = 1").collect()}
    assert set(ids(seen["near_dedup"])) == good
    # The stage's rule is 5-word shingles at a similarity of 0.8 or more, by brute force.
    given = sorted((r.doc_id, r.text) for r in seen["near_dedup"].collect())
    assert ids(seen["decontaminate"]) == Counter({given[root][0] for root in plain_roots([t for _, t in given])})
    clean = {r.doc_id for r in decontam.judge(seen["decontaminate"], bench).where("not contaminated").collect()}
    assert set(ids(seen["mix"])) == clean
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix_sources(seen["mix"]).collect()}
    assert ids(docs) == Counter({i: n for i, n in taken.items() if n})
    final = corpus_pipeline.run(spark, sf)
    assert ids(final) == ids(docs)
    sizes = Counter(r.shard for r in final.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def _tables(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14", 0), (None, None, 1), (2, "", 2)], "item_id long, text string, h int").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_tables(spark, tmp_path):
    """Nulls, repeats, clashing columns: every stage keeps the columns, and what it must."""
    text = lambda i: " ".join(f"w{(i * 37 + k * k) % 91}" for k in range(40 + i))
    rows = [(i, text(i), "en", None if i % 4 == 0 else f"s{i % 3}", None) for i in range(30)]
    rows += [rows[3], rows[3], (None, text(50), None, None, None), (None, None, None, "s1", None), (31, "", "en", "s1", 0), (32, text(3) + " more", "en", "s1", 0)]
    rows += [(33, " ".join(f"w{k}" for k in range(1, 15)), "en", "s2", 0)]
    clash = ["fp", "size", "near_fp", "near_turn", "mix_key", "mix_turn", "hit_doc", "text_key", "component_id", "rank"]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents = documents.select("*", *[F.lit("x").alias(c) for c in clash])
    _tables(spark, tmp_path, documents)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen[name] = docs
        docs = shared.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == documents.columns
    left = {r.doc_id for r in seen["mix"].collect()}
    given = [(r.doc_id, r.text) for r in seen["near_dedup"].collect()]
    assert len(given) == len(rows)  # all labels say good
    assert seen["decontaminate"].count() == len(set(plain_roots([t for _, t in given])))
    assert 3 in left and 32 not in left and 33 not in left  # a copy and a contaminated text are gone
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert final.count() == docs.count() and {r.doc_id for r in final.collect()} <= left


def test_empty_table(spark, tmp_path):
    _tables(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))
    assert corpus_pipeline.run(spark, str(tmp_path), alone=True).count() == 0
