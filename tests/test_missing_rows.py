"""Sign lists, hints, icons, line packing, joins by place, layout additions, against plain versions."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import labels
from lodestitch.functions import text as X
from lodestitch.operators import glossary as G
from lodestitch.operators import layout as L
from lodestitch.operators import queueing as Q
from lodestitch.sources import files


def values(spark, f, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_signs(spark):
    """Which signs are symbols, by hand: the first row are, the second are not."""
    symbols, others = ["★", "∞∑", "∂∆∇", "⊕", "∟", "⋿", "πΠ"], ["∈∅∃", "∀", "−", "∗", "★a", "∎"]
    assert values(spark, X.is_symbols_only, symbols + others) == [True] * len(symbols) + [False] * len(others)
    assert values(spark, X.pdf_should_translate, ["∈∅∃", "∞∑∞", "∐∐∐", "a", "漢", "12", "ab", "V°", "h"]) == [True, False, True, False, True, True, False, False, True]
    assert values(spark, X.is_abnormal, ["'''", '""', "，。", "“”", "abcabcabcabc", "♂♂ab", "fine", "", None]) == [False, True, True, False, True, True, False, True, True]


def test_hints(spark):
    texts = [
        "Domain Hint: Hello\n\n  world  ",
        "The text originates from the domains of x\ny document fields. Fine",
        "keep ♦ heavy machinery and CONSTRUCTION EQUIPMENT end",
        "政府の公文書です",
        "",
        "a\n \n\nb　",
    ]
    assert values(spark, X.remove_hints, texts) == ["Hello\nworld", "Fine", "keep   end", "です", "", "a\nb"]
    assert len(X.HINTS) == 22


def test_icons(spark):
    icon, other = "", ""
    pairs = [("1. A", "B"), (f"{icon} A", " B"), (f"{icon}{other}A", f"B{other}"), ("x" * 25 + icon, "B"), (f"a{icon}", f"a{icon}b"), (icon, ""), ("12", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, t string")
    got = [r.v for r in df.select("i", X.restore_numbering(F.col("s"), F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == ["1. B", f"{icon}B", f"{icon}B{other}", "B", f"a{icon}b", "", "12x"]


def plain_packed(pieces, limit):
    out, part, size = [], [], 0
    for p in pieces:
        if size + len(p) <= limit:
            part, size = part + [p], size + len(p)
        elif part:
            out.append(" ".join(part))
            part, size = [p], len(p)
        else:
            out.append(p)
    return out + ([" ".join(part)] if part else [])


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randrange(1, 30) + rng.choice([".", "!", "", "。"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["x" * 300, "a. " * 5_000]
    pattern = re.compile("(?<=[.!?。！？;；:：…—]) +|(?<=[。！？；：…—])\\s*")
    assert values(spark, lambda c: X.pack_sentences(c, 100), texts) == [plain_packed(pattern.split(t), 100) for t in texts]


def test_line_packing(spark):
    def plain(text, limit):
        out, open_ = [], ""
        for line in text.split("\n"):
            if not (re.search("[a-z]", line) or line.strip() == ""):
                continue
            if len(line) > limit:
                out += [(open_, False)] if open_ else []
                open_ = ""
                out += [(p, True) for p in plain_packed(re.split("(?<=[.]) +", line), limit)]
                continue
            if len(open_) + len(line) > limit:
                out += [(open_, False)] if open_ else []
                open_ = ""
            open_ += line + "\n"
        out += [(open_, False)] if open_ else []
        return [(t if re.search("[a-z]", t) else "", s) for t, s in out]

    rng = random.Random(3)
    lines = ["", "abc", "...", "12", "x y z", "long. " * 12, "q" * 70, "word " * 6]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 15))) for _ in range(40)]
    got = [[(p.text, p.sub) for p in v] for v in values(spark, lambda c: X.pack_lines(c, 60), texts)]
    assert got == [plain(t, 60) for t in texts]


def test_text_term_score(spark):
    pairs = [("a red lamp", "red"), ("a RED lamp", "red"), ("lamp of oak", "oak lamp shade"), ("colour", "color"), ("xyz", "abc"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.v for r in df.select("i", G.text_term_score(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got[:2] == [100.0, 95.0] and abs(got[2] - 2 / 3 * 70) < 1e-9 and abs(got[3] - 50 * SequenceMatcher(None, "colour", "color").ratio()) < 1e-9
    assert got[4:] == [0.0, 0.0, 0.0]


def test_phrases_beyond_a_hundred_thousand_words(spark):
    text = "x " * 100_001 + "red lamp"
    segments = spark.createDataFrame([(1, 0, text), (2, 0, "a Red lamp")], "doc_id int, seg_idx int, text string")
    terms = spark.createDataFrame([("b", 1, "lamp", "L"), ("b", 2, "red lamp", "RL"), ("b", 3, "x", "X")], "base string, term_id int, source string, target string")
    got = sorted((r.doc_id, r["rank"], r.source, r.score) for r in G.relevant_terms(segments, G.merge_bases(terms), fuzzy=False, small=0).collect())
    assert got[:3] == [(1, 1, "x", 100.0), (1, 2, "lamp", 100.0), (1, 3, "red lamp", 90.0)] and (2, 2, "red lamp", 95.0) in got


def test_cells_by_place(spark):
    cells = [(1, 0, 0, 0, "a"), (1, 0, 0, 1, "12"), (1, 0, 1, 0, "b"), (1, 1, 0, 0, "a"), (2, 0, 0, 0, "1")]
    df = spark.createDataFrame(cells, "doc_id int, sheet int, row int, col int, cell string")
    items = [(1, 0, "A"), (1, 1, "B"), (1, 2, "A2")]
    fill = lambda rows: files.fill_cells(df, spark.createDataFrame(rows, "doc_id int, nth int, text string"), X.needs_translation(F.col("cell")))
    assert sorted(tuple(r) for r in fill(items).collect()) == sorted([(1, 0, 0, 0, "A"), (1, 0, 0, 1, "12"), (1, 0, 1, 0, "B"), (1, 1, 0, 0, "A2"), (2, 0, 0, 0, "1")])
    for odd in (items[:2], items + [(1, 3, "more")], items + [(3, 0, "x")]):
        with pytest.raises(Exception, match="differ in number"):
            fill(odd).collect()


def test_chunks_and_units(spark):
    chunks = spark.createDataFrame([(1, "chunk_0002", "b"), (1, "chunk_0001", "a"), (2, "x", "c")], "doc_id int, name string, text string")
    assert {r.doc_id: r.text for r in files.merge_chunks(chunks).collect()} == {1: "ab", 2: "c"}
    units = spark.createDataFrame([("p", "1", "one"), ("p", "2", "two")], "path string, unit_id string, source string")
    done = spark.createDataFrame([("p", "2", "deux"), ("q", "1", "no")], "path string, unit_id string, target string")
    assert {r.unit_id: r.target for r in files.join_units(units, done).collect()} == {"1": "one", "2": "deux"}


def test_status_and_spacing(spark):
    df = spark.createDataFrame([("N", "enabled"), ("Y", "enabled"), ("N", "disabled"), (None, "enabled")], "d string, s string")
    assert [r.v for r in df.select(labels.effective_status(F.col("d"), F.col("s")).alias("v")).collect()] == ["enabled", "disabled", "disabled", "disabled"]
    calls = spark.createDataFrame([("k", f"2024-01-01 00:00:{s}") for s in ("00.000", "00.040", "00.100", "00.150")], "key string, at string").select("key", F.to_timestamp_ntz("at").alias("ts"))
    assert [r.too_close for r in Q.spaced_calls(calls, "key").orderBy("ts").collect()] == [False, True, False, False]


def test_time_without_a_zone_ignores_clock_changes(spark):
    calls = spark.createDataFrame([(1, "2024-03-31 01:59:59"), (1, "2024-03-31 03:00:00"), (1, "1969-12-31 23:59:59.5")], "key int, at string").select("key", F.to_timestamp_ntz("at").alias("ts"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = sorted(r.v for r in calls.select(Q.micros_of(calls, "ts").alias("v")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [-500_000, 1711850399 * 1_000_000, 1711854000 * 1_000_000]


def plain_merge(runs, longest, total):
    out, group, size = [], [], 0
    close = lambda: out.append((group[0][0], len(group), "".join(t for _, t, _ in group))) if group else None
    for i, text, style, bounded in runs:
        if bounded:
            close()
            group, size = [], 0
            continue
        if not re.search("[a-z]", text):
            continue
        if len(text) <= longest and (not group or group[-1][2] == style) and size + len(text) <= total:
            group, size = group + [(i, text, style)], size + len(text)
            continue
        close()
        group, size = [], 0
        out.append((i, 1, text))
    close()
    return out


@pytest.mark.parametrize("longest,total", [(20, 1000), (5, 10), (5, 1000)])
def test_merge_short(spark, longest, total):
    rng = random.Random(5)
    paras = {p: [(i, rng.choice(["a", "bb", "ccc", "...", "", "dddd eeee", "f" * 30]), rng.choice("xy"), rng.random() < 0.1) for i in range(rng.randrange(1, 25))] for p in range(30)}
    rows = [(p, *r) for p, rs in paras.items() for r in rs]
    df = spark.createDataFrame(rows, "para_id int, run_idx int, text string, hash string, bounded boolean")
    got = sorted((r.para_id, r.first_run, r.runs, r.text) for r in L.merge_short(df, longest, total).collect())
    assert got == sorted((p, *g) for p, rs in paras.items() for g in plain_merge(rs, longest, total))


def test_distribution_near_spaces(spark):
    rows = [(["aa", "bb", "cc"], "one two three four five six seven"), (["aaaa", "bbbb", "cccc"], "alpha betagamma"), (["abc", "def"], "abcdefg"), (["a", "b"], "longword"), (["only"], "text here")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, runs array<string>, t string")
    got = [r.v for r in df.select("i", L.distribute_near_spaces(F.col("runs"), F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [["one two three", "four five", "six seven"], ["alpha ", "beta", "gamma"], ["abc", "defg"], ["long", "word"], ["text here"]]
    joined = spark.createDataFrame([(["a ", " b", "", ", c", "d.", "e"],)], "p array<string>").select(L.join_spaced(F.col("p")).alias("v")).first().v
    assert joined == "a b, c d.e"


def test_boundaries_and_rates(spark):
    df = spark.createDataFrame([({"has_tab": True},), ({"has_tab": False, "has_field": None},), ({},)], "m map<string,boolean>")
    assert [r.v for r in df.select(L.is_bounded(F.col("m")).alias("v")).collect()] == [True, False, False] and len(L.BOUNDARIES) == 12
    assert [r.v for r in spark.createDataFrame([(1, 3), (0, 0)], "a int, b int").select(L.optimisation_rate(F.col("a"), F.col("b")).alias("v")).collect()] == ["33.3%", "0%"]


def test_fit_boxes(spark):
    columns = "page int, id int, x0 double, y0 double, x1 double, y1 double, font int, source string, target string"
    alone = [(1, 1, 0.0, 0.0, 100.0, 20.0, 10, "x" * 20, "y" * 22), (2, 1, 0.0, 0.0, 100.0, 20.0, 10, "x" * 20, "y" * 10), (3, 1, 0.0, 0.0, 100.0, 12.0, 10, "x" * 20, "y" * 60)]
    near = [(4, 1, 0.0, 0.0, 100.0, 12.0, 10, "x" * 20, "y" * 60), (4, 2, 0.0, 14.0, 100.0, 40.0, 10, "z", "z")]
    got = {(r.page, r.id): (r.font, r.y1) for r in L.fit_boxes(spark.createDataFrame(alone + near, columns)).collect()}
    assert got[1, 1] == (10.0, 20.0)  # about as long
    assert got[2, 1] == (12.0, 20.0)  # shorter: a larger font
    # three times as long: font 6, 27 to a line, three lines of 7.2 are 21.6; alone on its page, 0.3 more height at most
    assert got[3, 1] == (6.0, pytest.approx(15.6))
    # 18 would reach into the box at 14: the height that is safe is 12, where one line fits, and the font falls to its half
    assert got[4, 1] == (5.0, 12.0) and got[4, 2] == (10.0, 40.0)


def test_fit_boxes_keeps_a_gap_and_survives_empty_texts(spark):
    columns = "page int, id int, x0 double, y0 double, x1 double, y1 double, font int, source string, target string"
    # the box below starts 1 lower: 12 + 1 - 2 is safe, and one line of font 5 has to do
    near = [(1, 1, 0.0, 0.0, 100.0, 12.0, 10, "x" * 20, "y" * 60), (1, 2, 0.0, 13.0, 100.0, 40.0, 10, "z", "z")]
    # without a box in reach, half more height at most
    wide = [(2, 1, 0.0, 0.0, 100.0, 12.0, 10, "x" * 20, "y" * 60), (2, 2, 300.0, 0.0, 400.0, 40.0, 10, "z", "z")]
    odd = [(3, 1, 0.0, 0.0, 100.0, 12.0, 10, "x", ""), (3, 2, 0.0, 0.0, 100.0, 12.0, 10, "", "yy"), (3, 3, 0.0, 50.0, 100.0, 62.0, 1, "x", "yyyy"), (3, 4, 0.0, 70.0, 100.0, 82.0, 10, None, "y")]
    got = {(r.page, r.id): (r.font, r.y1) for r in L.fit_boxes(spark.createDataFrame(near + wide + odd, columns)).collect()}
    assert got[1, 1] == (5.0, 11.0) and got[2, 1] == (6.0, 18.0)
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, 1): (10.0, 12.0), (3, 2): (10.0, 12.0), (3, 3): (1.0, 62.0), (3, 4): (10.0, 82.0)}


def test_report_levels(spark):
    runs = [(p, i, "" if i == 0 else "a" if i < 8 else "text", str(i % 2), i == 3) for p in range(3) for i in range(12)]
    r = L.run_report(spark.createDataFrame(runs, "para_id int, run_idx int, text string, hash string, bounded boolean")).first()
    assert (r.paragraphs, r.runs, r.len_0, r.len_1, r.len_2_5, r.styles, r.bounded, r.problems, r.severe, r.score, r.level) == (3, 36, 3, 21, 12, 2, 3, 3, 0, 100, "high")


def test_fit_boxes_of_small_and_full_pages_agree(spark):
    """Pages gathered in a row give what grid cells give, with nulls, and either way in one table."""
    rng = random.Random(7)
    at = lambda most: None if rng.random() < 0.03 else float(rng.randrange(most))
    rows = []
    for page in [None, *range(60)]:
        for i in range(rng.choice((1, 2, 5, 12))):
            x, y = at(200), at(90)
            rows.append((page, i, x, y, None if x is None else x + 60, None if y is None else y + 14, 10, "x" * rng.randrange(1, 40), "y" * rng.randrange(90)))
    boxes = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double, font int, source string, target string")
    got = [sorted(map(tuple, L.fit_boxes(boxes, most=most).collect()), key=repr) for most in (0, 4, 64)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    plan = L.fit_boxes(boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
