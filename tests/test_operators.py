"""Jobs, queues, glossary, translation and layout on small tables."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestitch.operators import glossary as G
from lodestitch.operators import jobs as J
from lodestitch.operators import layout as L
from lodestitch.operators import queueing as Q
from lodestitch.operators import translation as R


def test_guards():
    assert J.check_page(1, 100) == (1, 100) and J.check_ids(["1", 2]) == [1, 2] and J.check_status("changing") == "changing"
    J.check_range("2024-01-01", "2024-01-02")
    for f in (lambda: J.check_page(0, 10), lambda: J.check_page(1, 101), lambda: J.check_ids([]), lambda: J.check_ids(range(101)), lambda: J.check_range("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        J.check_status("queued")


def test_status_and_trend(spark):
    rows = [(1, "done", "N", "2024-01-09 10:00:00"), (2, "changing", "N", "2024-01-09 11:00:00"), (3, "odd", "N", "2024-01-10 01:00:00"), (4, "failed", "Y", "2024-01-09 01:00:00")]
    jobs = spark.createDataFrame(rows, "id long, status string, deleted_flag string, at string").withColumn("created_at", F.to_timestamp_ntz("at"))
    assert {r.status: r.n for r in J.status_distribution(jobs).collect()} == {"done": 1, "process": 0, "failed": 0, "queued": 0, "none": 0}
    trend = [(str(r.day), r.n) for r in J.daily_trend(jobs, "2024-01-10 12:00:00", 2).orderBy("day").collect()]
    assert trend == [("2024-01-08", 0), ("2024-01-09", 2)]
    assert J.daily_trend(jobs, "2024-01-10 12:00:00", 2, True).where("n = 1").count() == 1
    assert J.job_statistics(jobs).first().failed == 1
    assert J.dashboard_stats(jobs.limit(0).withColumn("customer_id", F.lit(1)), spark.createDataFrame([], "storage double"), "2024-01-10 12:00:00", 0.0).first().success_rate == 0.0


def test_filters(spark):
    df = spark.createDataFrame([("a%b", 1), ("AXB", 2), (None, 3)], "t string, i int")
    assert [r.i for r in J.matching(df, ["t"], "x").collect()] == [2] and J.matching(df, ["t"], None).count() == 3
    assert J.without(df, "t", [""]).count() == 3 and [r.i for r in J.without(df, "t", ["AXB"]).collect()] == [1]


def test_balance_never_below_zero(spark):
    steps = [(1, i, float(x)) for i, x in enumerate([5, -9, 3, -1, -7, 2])]
    got = [r.balance for r in J.running_floor(spark.createDataFrame(steps, "k int, i int, d double"), "k", ["i"], "d").orderBy("i").collect()]
    want, b = [], 0.0
    for _, _, d in steps:
        b = max(0.0, b + d)
        want.append(b)
    assert got == want


def test_pdf_admission(spark):
    queue = lambda pages: spark.createDataFrame([(i, i, p) for i, p in enumerate(pages)], "id int, created_at int, pages int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(Q.admit_pdfs(queue([30, 30, 30, 1]))) == [0, 1]
    assert ids(Q.admit_pdfs(queue([30, 1, 1, 1, 1]))) == [0, 1, 2, 3]
    assert ids(Q.admit_pdfs(queue([1, 1]), large_running=2, small_running=2)) == []
    assert ids(Q.admit_pdfs(queue([30, 1]), large_running=2)) == []


def test_states(spark):
    df = spark.createDataFrame([("SUCCEEDED", "E1", "bad"), ("FAILED", None, "bad"), ("RUNNING", "E1", None), ("UNKNOWN", "", "")], "s string, c string, m string")
    got = df.select(Q.image_state(F.col("s"), F.lit("now")).alias("s"), Q.image_error(F.col("c"), F.col("m")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("completed", "E1: bad"), ("failed", "bad"), ("now", "E1"), ("failed", None)]


def test_merge_first_wins(spark):
    terms = spark.createDataFrame([("b", 1, "x", "1"), ("a", 3, "x", "2"), ("a", 2, "x", "3"), ("b", 4, "y", " "), ("a", 9, " z ", "4")], "base string, term_id long, source string, target string")
    pick = lambda **o: {r.source: r.target for r in G.merge_bases(terms, **o).collect()}
    assert pick()["x"] == "3" and pick(newest_first=True)["x"] == "2" and pick(bases=["b", "a"])["x"] == "1"
    assert pick(trim=True) == {"x": "3", "z": "4"}


def plain_word_score(w, t):
    t = t.lower()
    if w == t:
        return 100.0
    if w in t:
        return 90.0
    if t in w:
        return 85.0
    share = len(set(w) & set(t)) / max(len(set(w)), len(set(t)))
    if share > 0.5:
        return share * 70.0
    r = SequenceMatcher(None, w, t).ratio()
    return r * 60.0 if r > 0.6 else 0.0


def test_small_base_scores(spark):
    import re

    terms = ["Engine oil", "pump", "Gear box", "valve", "Hydraulic pump", "oil", "wrench", "boxer", "lever", "xz"]
    base = spark.createDataFrame([("b", i, t, t.upper()) for i, t in enumerate(terms)], "base string, term_id long, source string, target string")
    texts = ["Check the oil pump and gearbox", "levers wench Valve", "", "a b", "pump pump OIL hydraulics"]
    segments = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, seg_idx int, text string")
    got = {}
    for r in G.relevant_terms(segments, G.merge_bases(base)).orderBy("rank").collect():
        got.setdefault(r.seg_idx, []).append((r.source, round(r.score, 6)))
    want = {}
    for i, text in enumerate(texts):
        best: dict = {}
        for w in [w for w in re.findall(r"\b\w+\b", text.lower()) if len(w) >= 2]:
            scored = sorted(((s, -p) for p, t in enumerate(terms) if (s := plain_word_score(w, t)) > 0), reverse=True)[:5]
            for s, p in scored:
                best[terms[-p]] = max(best.get(terms[-p], 0), s)
        if best:
            want[i] = [(t, round(s, 6)) for t, s in sorted(best.items(), key=lambda x: -x[1])][:10]
    assert got == want


def test_budget_stops_at_first_overflow(spark):
    rows = [(1, 0, i, "s" * n, "t", 1.0) for i, n in enumerate([400, 500, 200, 10], 1)]
    ranked = spark.createDataFrame(rows, "doc_id int, seg_idx int, rank int, source string, target string, score double")
    assert sorted(r.rank for r in G.within_budget(ranked).collect()) == [1, 2]
    lists = G.term_list(G.within_budget(ranked)).first().terms
    assert lists == "s" * 400 + ": t\n" + "s" * 500 + ": t"
    df = spark.createDataFrame([("a: b\nno\nc: d: e", "x: y; z; p:q", " 1, x,22,")], "l string, c string, i string")
    got = df.select(G.parse_term_list(F.col("l")).alias("l"), G.parse_content(F.col("c")).alias("c"), G.parse_ids(F.col("i")).alias("i")).first()
    assert [tuple(x) for x in got.l] == [("a", "b"), ("c", "d: e")] and [tuple(x) for x in got.c] == [("x", "y"), ("p", "q")] and got.i == [1, 22]


def test_large_base_prefers_exact(spark):
    base = spark.createDataFrame([("b", i, t, "T") for i, t in enumerate(["oil pump", "Oil", "pump", "pumpkin"])], "base string, term_id long, source string, target string")
    segments = spark.createDataFrame([(1, 0, "the Oil pump")], "doc_id int, seg_idx int, text string")
    got = [(r.source, r.score) for r in G.relevant_terms(segments, G.merge_bases(base), small=1).orderBy("rank").collect()]
    assert got == [("Oil", 100.0), ("pump", 100.0), ("oil pump", 95.0)]


def _busy(row):
    raise ConnectionError("busy")


def _reject(row):
    raise R.Rejected("no")


def test_translation(spark):
    segments = spark.createDataFrame([(1, 0, "one two"), (1, 1, "..."), (1, 2, "one two"), (2, 0, "cat dog")], "doc_id int, seg_idx int, text string")
    run = lambda chain, **o: {(r.doc_id, r.seg_idx): (r.translated, r.status, r.attempts) for r in R.translate_segments(segments, chain, **o).collect()}
    got = run([R.reverse_words])
    assert got[1, 0] == got[1, 2] == ("two one", "done", 1) and got[1, 1] == ("...", "skipped", None)
    assert run([_busy, R.reverse_words], retries=2)[2, 0] == ("dog cat", "done", 3)
    assert run([_busy], retries=2)[2, 0] == ("cat dog", "kept", 2)
    assert run([_reject, R.identity])[2, 0] == ("", "rejected", 1)
    assert run([lambda r: "Sorry, I cannot", R.identity], retries=1)[2, 0] == ("cat dog", "done", 2)
    assert run([lambda r: "<think>\nx</think>yes"])[2, 0] == ("yes", "done", 1)
    terms = spark.createDataFrame([(2, 0, "cat: Katze\ncat dog: Tier")], "doc_id int, seg_idx int, terms string")
    assert run([R.glossary_substitute], terms=terms)[2, 0] == ("Tier", "done", 1)


def test_layout(spark):
    df = spark.createDataFrame([(["ab", "cd", ""], "wxyz"), (["a", "bc"], "one two three"), (["a"], "x"), (["abc", "de", "f"], "q")], "r array<string>, t string")
    words = [x.v for x in df.select(L.distribute_words(F.col("r"), F.col("t")).alias("v")).collect()]
    assert words == [["wx", "yz", ""], ["one", "two three"], ["x"], ["", "", "q"]]
    assert [x.v for x in df.select(L.distribute_words(F.col("r"), F.col("t"), parity=True).alias("v")).collect()][1] == ["one", "two"]
    even = [x.v for x in df.select(L.distribute_even_tail(F.transform("r", lambda x: F.length(x)), F.col("t")).alias("v")).collect()]
    assert even == [["wx", "yz", ""], ["one ", "two three"], ["x"], ["q", "", ""]]
    box = spark.range(1).select(L.image_box("fit", F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(200.0)).alias("b")).first().b
    assert tuple(box) == (0.0, 50.0, 200.0, 150.0)
    runs = [(1, 0, "a", "h", False), (1, 1, "b", "h", False), (1, 2, "", "h", False), (1, 3, "c", "h", False), (1, 4, "d", "h", True), (1, 5, "e", "g", False)]
    merged = L.merge_groups(spark.createDataFrame(runs, "para_id int, run_idx int, text string, hash string, bounded boolean"))
    assert sorted((r.first_run, r.text) for r in merged.collect()) == [(0, "ab"), (2, ""), (3, "c"), (4, "d"), (5, "e")]


def test_valid_code_is_exact_to_the_microsecond(spark):
    """Neither half a second to come nor half a second too old counts."""
    rows = [(1, 1, "2024-01-30 00:00:00.5"), (2, 2, "2024-01-28 23:59:59.5"), (3, 3, "2024-01-29 00:00:00"), (4, 4, "2024-01-30 00:00:00"), (1, 5, "2024-01-29 12:00:00")]
    codes = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["event_id"] for r in J.valid_code(codes, "2024-01-30 00:00:00", 1440).collect()) == [3, 4, 5]
