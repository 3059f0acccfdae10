"""Similarity joins and the automaton against plain loops over all words and terms."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestitch.operators import glossary as G
from lodestitch.plans import registry
from tests.compare import differences
from tests.test_operators import plain_word_score

BASE = "base string, term_id long, source string, target string"


def terms_of(spark, sources):
    return G.merge_bases(spark.createDataFrame([("b", i, s, f"t{i}") for i, s in enumerate(sources)], BASE))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize(("fuzzy", "masks"), [(True, 4), (False, 4), (True, 0)])
def test_similar_terms_are_those_of_a_product(spark, monkeypatch, seed, fuzzy, masks):
    """With masks of bits, and with arrays as for large alphabets."""
    monkeypatch.setattr(G, "MOST_MASKS", masks)
    rng = random.Random(seed)
    letters = ["abc", "abcdefgh", "aä工é b-"][seed - 1]
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    words = sorted({w for w in (word(12) for _ in range(150)) if " " not in w})
    sources = sorted({s for s in (word(16) for _ in range(120)) if s.strip()}) + ["Abc", "ABCDEFGH"]
    terms = terms_of(spark, sources).select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    got = {(r.word, r.source): r.score for r in G.similar_terms(spark.createDataFrame([(w,) for w in words], "word string"), terms, fuzzy).collect()}
    want = {}
    for w in words:
        for s in sources:
            share = len(set(w) & set(s.lower())) / max(len(set(w)), len(set(s.lower())))
            score = plain_word_score(w, s)
            if score and (fuzzy or w in s.lower() or s.lower() in w or share > 0.5):
                want[w, s] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_words_of_one_character_set_are_compared_once(spark, monkeypatch):
    """40 anagrams ask once; the best terms of each word are those of all its terms, ties and contained terms included."""
    rng, asked, join = random.Random(5), [], G.overlap_join
    monkeypatch.setattr(G, "overlap_join", lambda left, *rest: (asked.append(left.count()), join(left, *rest))[1])
    words = sorted({"".join(rng.sample("abcdefg", 7)) for _ in range(40)})
    sources = sorted({"".join(rng.sample("abcdefghij", rng.randint(2, 9))) for _ in range(80)}) + [w[:6] for w in words[:4]] + [words[0] + "x"]
    terms = terms_of(spark, sources).select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    found = G._best_of_word(spark.createDataFrame([(w,) for w in words], "word string"), terms, fuzzy=False).collect()
    assert asked == [1]
    score = lambda w, s: next((x for x, hit in ((100.0, w == s), (90.0, s.find(w) >= 0), (85.0, w.find(s) >= 0)) if hit), 70.0 * len(set(w) & set(s)) / max(len(set(w)), len(set(s))))
    places = {s: i for i, s in reversed(list(enumerate(sources)))}
    for w in words:
        want = sorted((-x, i, s) for s, i in places.items() if (x := score(w, s)) > 35.0)[:5]
        got = sorted((r.in_word, r.source, r.score) for r in found if r.word == w)
        assert [(s, round(-x, 6)) for x, _, s in want] == [(s, round(x, 6)) for _, s, x in got]


def test_best_terms_by_sequence_are_those_of_a_product(spark):
    """Words of many repeats: sequences score where few characters are common; some words have five better terms, some have not."""
    rng = random.Random(9)
    spell = lambda rare: "".join(rng.choice("aaaa" + rare) for _ in range(rng.randint(4, 12)))
    words, sources = (sorted({spell(rare) for rare in both for _ in range(30)}) for both in (("bcd", "efgh", "xyz"), ("bce", "fghi", "uvw")))
    terms = terms_of(spark, sources).select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    found = G._best_of_word(spark.createDataFrame([(w,) for w in words], "word string"), terms, fuzzy=True).collect()
    top = {w: sorted((-plain_word_score(w, s), at, s) for at, s in enumerate(sources) if plain_word_score(w, s) > 0)[:5] for w in words}
    want = {(w, i, s, round(-score, 6)) for w in words for i, (score, _, s) in enumerate(top[w], 1)}
    assert {(r.word, r.in_word, r.source, round(r.score, 6)) for r in found} == want
    by_sequence = lambda w, s: len(set(w) & set(s)) / max(len(set(w)), len(set(s))) <= 0.5 and w not in s and s not in w
    assert 10 < sum(by_sequence(w, s) for w, _, s, _ in want) < len(want) - 10


def test_no_nested_loops(spark):
    words = spark.createDataFrame([(1, 0, "some words here")], "doc_id int, seg_idx int, text string")
    plan = G.relevant_terms(words, terms_of(spark, ["word", "here"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and not [x for x in plan.split("\n") if "Join Inner" in x and "=" not in x]


def test_empty_base_and_texts(spark):
    segments = spark.createDataFrame([(1, 0, ""), (1, 1, None), (1, 2, "abc")], "doc_id int, seg_idx int, text string")
    none = terms_of(spark, ["x"]).limit(0)
    for found in (G.relevant_terms(segments, none), G.relevant_terms(segments, none, small=0), G.text_scores(segments, none), G.contained_terms(segments, none)):
        assert found.collect() == []
    assert [(r.seg_idx, r.source) for r in G.text_scores(segments, terms_of(spark, ["ABC", ""])).collect()] == [(2, "ABC")]


@pytest.mark.parametrize("most_bytes", [1 << 20, 200])
def test_contained_terms(spark, most_bytes):
    rng = random.Random(7)
    sources = sorted({"".join(rng.choice("abAB ") for _ in range(rng.randint(1, 6))) for _ in range(80)}) + ["long term of more than five words indeed", "İx"]
    texts = ["".join(rng.choice("abAB ") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x" * 50_000 + " a LONG term of more than five words indeed", "İX ab", None, ""]
    segments = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "doc_id long, seg_idx int, text string")
    got = {(r.doc_id, r.source): r.score for r in G.contained_terms(segments, terms_of(spark, sources), most_bytes).collect()}
    want = {(i, s): 100.0 if s in t else 95.0 for i, t in enumerate(texts) if t for s in sources if s.lower() in t.lower()}
    assert got == want


def test_text_scores_take_the_share_of_words(spark):
    segments = spark.createDataFrame([(1, 0, "The red  LAMP of oak"), (1, 1, "nothing here")], "doc_id int, seg_idx int, text string")
    got = [(r.source, round(r.score, 6)) for r in G.text_scores(segments, terms_of(spark, ["red lamp", "lamp", "oak lamp shade", "LAMP", "lamps"])).orderBy("rank").collect()]
    assert got == [("LAMP", 100.0), ("lamp", 95.0), ("red lamp", 70.0), ("oak lamp shade", round(140 / 3, 6))]


def test_large_base_without_python_or_driver(spark):
    """Exact finds of words and phrases are joins: no task's Python and no driver holds the base."""
    sources = ["alpha", "Alpha", "ALPHA beta", "beta gamma", "a b c d e", "a b c d e f", "gamma  delta", "", "beta"]
    base = spark.createDataFrame([("b", i, s, f"T{i}") for i, s in enumerate(sources)], "base string, term_id long, source string, target string")
    texts = {(1, 0): "alpha BETA, gamma; a-b c d E f", (1, 1): "ALPHA beta" + " x" * 120, (2, 0): "", (2, 1): "Alpha Alpha alpha"}
    segments = spark.createDataFrame([(*k, t) for k, t in texts.items()], "doc_id int, seg_idx int, text string")
    terms = G.merge_bases(base).select(F.struct("base_place", "term_id", "source").alias("place"), "source", "target")
    want = set()
    for k, text in texts.items():
        words = re.findall(r"\w+", text)
        for s in sources:
            for n in range(1, 6 if len(text) < 200 else 2):
                found = [(0 if p == s else 1, i) for i in range(len(words) - n + 1) if (p := " ".join(words[i : i + n])).lower() == s.lower()]
                if found:
                    worse, i = min(found)
                    want.add((*k, s, worse + 2 * (n > 1), n, i + (n > 1), 95.0 if worse else 100.0))
    exact = G._exact(segments, terms)
    assert {(r.doc_id, r.seg_idx, r.source, r.o.stage, r.o["at"].n, r.o["at"].i, r.score) for r in exact.collect()} == want
    found = G.relevant_terms(segments, G.merge_bases(base), fuzzy=False, small=0)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def spelt(n: int) -> list[str]:
    """n different names of the letters a to f."""
    rng = random.Random(11)
    return sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 9))) for _ in range(4 * n)})[:n]


@pytest.mark.parametrize("fuzzy", [True, False])
def test_one_more_term_changes_no_other(spark, fuzzy):
    """A base of 1,000 terms and one of 1,001, the last of which no text comes near."""
    names = spelt(1000)
    segments = spark.createDataFrame([(1, 0, "bade cabbed fade Abced"), (1, 1, names[3].upper()), (2, 0, "dea " + names[500][:-1])], "doc_id int, seg_idx int, text string")
    found = [sorted(map(tuple, G.relevant_terms(segments, terms_of(spark, x), fuzzy=fuzzy).collect())) for x in (names, [*names, "工具"])]
    assert found[0] == found[1] and {r[1] for r in found[0]} == {0, 1} and any(r[5] < 85.0 for r in found[0])


@pytest.mark.parametrize("name", ["glossary_budget", "glossary_topk_native", "glossary_batch", "term_lists"])
def test_large_bases_match_sql(spark, tmp_path, name):
    """A base of 1,200 names; the tables of the test data have 64 at most."""
    rng, names = random.Random(12), spelt(1200)
    parts = [(i, n.title() if i % 3 == 0 else n, f"Brand#{i % 7}", rng.choice(["SMALL", "PROMO"])) for i, n in enumerate([*names, *names[:200]])]
    word = lambda: rng.choice([rng.choice(names), "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))])
    turns = [(c, t, "user", " ".join(word() for _ in range(rng.randint(0, 12)))) for c in range(12) for t in range(3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert not differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path), con)
