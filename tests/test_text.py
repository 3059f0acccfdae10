"""Text scalars, segmentation and assembly against plain Python."""

from __future__ import annotations

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import labels, times
from lodestitch.functions import text as X
from lodestitch.operators import segmenting as S

SAMPLES = [
    "", " ", "12", "1,234.56", "1,23", "-.5", "1e5", "²", "½", "é", "é", "工业车辆", "图1", "℃", "😀", " x ", "1.1", "Intro —— 12", "!?.", "a b", "...", "①②", "，。",
    "★☆", "123 kg", "Sorry, I cannot do", "抱歉，无法", "x Sorry, I cannot", "aaaa", "abababab", "fine", "Chapter 1 ..... 7", "\x1c", "+1", "1,234,567", "12,34", ".", "1.", "1.2.3.", "(3)",
]
CJK = "：【】，。、？」「；！@￥（）"


def values(spark, f, samples=SAMPLES):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    return [r.v for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def test_punctuation(spark):
    plain = lambda t: all(c in string.punctuation or c.isdigit() or c.isdecimal() or c.isspace() or c in CJK for c in t)
    assert values(spark, X.is_punctuation_only) == [plain(t) for t in SAMPLES]


def test_punctuation_over_the_plane(spark):
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    plain = [c in string.punctuation or c.isdigit() or c.isdecimal() or c.isspace() or c in CJK for c in chars]
    assert values(spark, X.is_punctuation_only, chars) == plain


def test_numbers_and_symbols(spark):
    def number(t):
        t = t.strip()
        ok = bool(re.match(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", t.replace(",", "")))
        return ok and ("," not in t or bool(re.match(r"^[+-]?\d{1,3}(,\d{3})*(\.\d+)?(?:[eE][+-]?\d+)?$", t)))

    def symbol(t):
        t = t.strip()
        return not t or (len(t) <= 3 and bool(re.match(r"^[^\w一-鿿]+$", t)))

    assert values(spark, X.is_pure_number) == [number(t) for t in SAMPLES]
    keep = [t for t in SAMPLES if t != "é"]
    assert values(spark, X.is_pure_symbol, keep) == [symbol(t) for t in keep]


def test_counts(spark):
    plain = lambda t: sum(1 if "一" <= c <= "鿿" else 0 if c == " " else 0.5 for c in t)
    assert values(spark, X.weighted_count) == [plain(t) for t in SAMPLES]
    assert values(spark, X.token_estimate) == [int(plain(t)) if t.strip() else 0 for t in SAMPLES]
    assert values(spark, X.token_estimate, [None]) == [0]


def test_predicates(spark):
    assert dict(zip(SAMPLES, values(spark, X.is_refusal)))["Sorry, I cannot do"] and not dict(zip(SAMPLES, values(spark, X.is_refusal)))["x Sorry, I cannot"]
    abnormal = dict(zip(SAMPLES, values(spark, X.is_abnormal)))
    assert abnormal[""] and abnormal["aaaa"] and abnormal["abababab"] and abnormal["，。"] and not abnormal["fine"]
    pdf = dict(zip(SAMPLES, values(spark, X.pdf_should_translate)))
    assert pdf["图1"] and pdf["12"] and pdf["℃"] and not pdf["é"] and not pdf["1,234.56"] and pdf["fine"]
    word = dict(zip(SAMPLES, values(spark, X.word_check_text)))
    assert word["123 kg"] and word["1."] and not word["..."] and not word[" "] and not word["★☆"] and word["工业车辆"]
    toc = values(spark, X.toc_parts, ["Chapter 1 ..... 7", "Intro —— 12", "plain"])
    assert [(t.main, t.page) for t in toc] == [("Chapter 1 .....", " 7"), ("Intro", " —— 12"), ("plain", "")]


def plain_pack(text, limit):
    parts, held, size = [], [], 0
    for s in re.split(r"(?<=[.!?。！？;；:：…—]) +|(?<=[。！？；：…—])\s*", text):
        if size + len(s) <= limit:
            held, size = [*held, s], size + len(s)
        elif held:
            parts.append(" ".join(held))
            held, size = [s], len(s)
        else:
            parts.append(s)
    return parts + ([" ".join(held)] if held else [])


def test_packing(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab ", "c. ", "d! ", "句。", "长：", "x" * 30, "; "]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a" * 50, ""]
    for limit in (10, 40):
        assert values(spark, lambda c: X.pack_sentences(c, limit), texts) == [plain_pack(t, limit) for t in texts]  # noqa: B023


def test_cell_packing(spark):
    assert values(spark, lambda c: X.pack_cell_words(c, 6), ["aa bb cc", "abcdefgh i", "", "a"]) == [["aa bb", "cc"], ["", "abcdefgh", "i"], [], ["a"]]


def test_txt_round_trip(spark):
    texts = ["", "...", "a\n\n\n\nb", "x" * 1000, "y. " * 400, ("y. " * 400).strip() + "\n\n" + ("z! " * 400).strip(), "one\n\ntwo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    segments = S.txt_segments(docs)
    back = {r.doc_id: r.text for r in S.assemble_txt(segments).collect()}
    assert back[6] == "one\n\ntwo\n\n" and back[2] == "a\n\nb\n\n" and back[3] == "x" * 1000 + "\n\n" and 0 not in back and 1 not in back
    assert back[5].count("\n\n") == 1 and back[5].endswith("!\n")
    parity = {r.doc_id: r.text for r in S.assemble_txt(segments, parity=True).collect()}
    assert parity[5].count("\n\n") == 0 and parity[6] == back[6]
    assert all(len(r.text) <= 1000 + 400 for r in segments.collect())


def test_markdown(spark):
    text = "# H\n\n- a\n1. b\n> q\n---\n| a | b | c | d |\n|---|---|---|---|\n|---|---|\n[l](u)\nplain\n```py\n# not\n- x\n```\nafter\n...\n~~~\nopen"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    kinds = [r.type for r in S.md_lines(docs).orderBy("line").collect()]
    assert kinds == [
        "heading", "empty", "list_item", "ordered_item", "quote", "horizontal_rule", "table_row", "table_separator", "table_row", "link_image", "text", "code_block", "code_block",
        "code_block", "code_block", "text", "text", "code_block", "code_block",
    ]
    segments = S.md_segments(docs)
    assert S.assemble_md(segments).first().text == text
    assert [r.text for r in segments.where("not preserve").orderBy("seg_idx").collect()] == ["| a | b | c | d |", "plain", "after"]


def test_csv_cells(spark):
    cells = [(1, 0, 0, "same"), (1, 0, 1, "same"), (1, 1, 0, "12"), (1, 1, 1, None), (1, 2, 0, 'q"x,y')]
    df = spark.createDataFrame(cells, "doc_id int, row int, col int, cell string")
    upper = S.csv_segments(df).withColumn("text", F.upper("text"))
    done = {(r.row, r.col): r.cell for r in S.assemble_csv(df, upper).collect()}
    assert done == {(0, 0): "SAME", (0, 1): "SAME", (1, 0): "12", (1, 1): None, (2, 0): 'Q"X,Y'}
    assert {r.row: r.line for r in S.csv_lines(df).collect()} == {0: "same,same", 1: "12,", 2: '"q""x,y"'}


def test_placeholders_and_tags(spark):
    assert values(spark, lambda c: X.placeholders_too_dense(c), ["a♂b♂c", "long text ♂ here", "a♂♂b and more text", "none", "♂"]) == [True, False, True, False, True]
    masked = values(spark, X.mask_format_tags, ["<run1>a</run1><tags2/>b", "plain"])
    assert [(m.text, m.tags) for m in masked] == [("__FORMAT_TAG_0__a__FORMAT_TAG_1____FORMAT_TAG_2__b", ["<run1>", "</run1>", "<tags2/>"]), ("plain", [])]
    back = spark.createDataFrame([(m.text, m.tags) for m in masked], "t string, g array<string>").select(X.unmask_format_tags(F.col("t"), F.col("g")).alias("v"))
    assert {r.v for r in back.collect()} == {"<run1>a</run1><tags2/>b", "plain"}
    pairs = spark.createDataFrame([("1. Title", "Titre"), ("1. Title", "1. Titre"), ("x", "y"), ("  a ", "b")], "s string, t string")
    got = pairs.select(X.restore_numbering(F.col("s"), F.col("t")).alias("n"), X.pad_edges(F.col("s"), F.col("t")).alias("p")).collect()
    assert [r.n for r in got] == ["1. Titre", "1. Titre", "y", "b"] and got[3].p == "  b "


def test_labels_and_times(spark):
    assert values(spark, labels.file_type, ["a.DOCX", "b.md", "c", "", None, "d.tar.gz"]) == ["Word", "文本", "其他", "未知", "未知", "其他"]
    assert values(spark, labels.language_name, ["EN", "xx", "汉语"]) == ["英语", "xx", "中文"] and values(spark, labels.language_code, ["德文", "?"]) == ["de", "en"]
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' c, timestamp_ntz'2024-01-01 00:00:10' s, timestamp_ntz'2024-01-01 01:02:03' e")
    c, s, e = F.col("c"), F.col("s"), F.col("e")
    got = rows.select(times.elapsed(c, s, e).alias("a"), times.elapsed(c, e, s).alias("b"), times.elapsed(e, e, s).alias("d"), times.elapsed_tiers(s, e).alias("f"), times.to_shanghai(c).alias("g")).first()
    assert (got.a, got.b, got.d, got.f, got.g) == ("61分53秒", "0分10秒", "--", "1小时1分", "2024-01-01T08:00:00")


@pytest.mark.parametrize("seconds,left", [(0, 0), (-5, 0), (3600, 1), (86400, 2), (6 * 86400, 7), (9 * 86400, 7)])
def test_days_left(spark, seconds, left):
    df = spark.sql(f"select timestamp_ntz'2024-01-01 00:00:00' n, timestamp_ntz'2024-01-01 00:00:00' + interval '{seconds}' second e")
    assert df.select(times.days_left(F.col("e"), F.col("n")).alias("v")).first().v == left


def test_packing_grows_with_the_text(spark):
    """Eight times the sentences take less than twelve times as long."""

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"Sentence number {i} of a text goes on for a while." for i in range(n)),)], "t string")
        began = time.time()
        parts = df.select(X.pack_sentences(F.col("t")).alias("p")).first()["p"]
        assert " ".join(parts) == df.first()["t"] and max(map(len, parts)) <= 1100
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 12 * max(seconds(2_000), 0.3)
