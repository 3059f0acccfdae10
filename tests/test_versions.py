"""New table versions, observed counts and lines of files."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestitch.operators import versions as V
from lodestitch.sources import lines as L


def test_numbers_are_gapless(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), i, rng.choice(["x", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, i int, part string")
    got = [(r.k, r.i, r.n) for r in V.with_numbers(df, ["k", "i"], "n", 5).orderBy("n").collect()]
    assert got == [(k, i, 5 + at) for at, (k, i, _) in enumerate(sorted(rows, key=lambda r: r[:2]))]
    assert V.with_numbers(df.limit(0), ["k"]).collect() == []


def test_copies(spark):
    parents = spark.createDataFrame([(1, "a"), (7, "b"), (9, "c")], "id long, title string")
    children = spark.createDataFrame([(3, 7), (4, 1), (8, 7), (5, 9), (6, None)], "id long, parent_id long")
    new, own = V.copied(parents, children, F.col("title").isin("b", "c"), fresh={"title": F.concat("title", F.lit("-copy"))})
    assert sorted((r.id, r.title, r.copied_from) for r in new.collect()) == [(10, "b-copy", 7), (11, "c-copy", 9)]
    assert sorted((r.id, r.parent_id, r.copied_from) for r in own.collect()) == [(9, 10, 3), (10, 11, 5), (11, 10, 8)]
    nothing = V.copied(parents, children, F.lit(False))
    assert nothing[0].count() == nothing[1].count() == 0


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", None), (None, "n", 3), (4, "d", 4)], "id int, v string, w int")
    changes = spark.createDataFrame([(1, "x", 9, 1, None), (1, "y", None, 2, False), (2, "z", 5, 1, True), (None, "m", 8, 1, False), (5, "new", 7, 3, False), (5, "old", 6, 2, True)], "id int, v string, w int, ver int, gone boolean")
    got = {(r.id, r.v, r.w) for r in V.upserted(current, changes, ["id"], "ver", "gone").collect()}
    assert got == {(1, "y", None), (None, "m", 8), (4, "d", 4), (5, "new", 7)}
    assert V.upserted(current, changes.limit(0), ["id"], "ver").count() == 4 and V.upserted(current.limit(0), changes, ["id"], "ver", "gone").count() == 3


def test_defaults_and_ids(spark):
    rows = spark.createDataFrame([(1, None, "de")], "id int, lang string, x string")
    owners = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = {(r.id, r.lang, r.x) for r in V.with_defaults(rows, owners, ["id"], {"lang": F.lit("zh")}).collect()}
    assert got == {(1, None, "de"), (2, "zh", None)}  # a null of one's own stays
    df = spark.createDataFrame([([" 1", "", None, "22"],), (["", None],), (None,)], "ids array<string>")
    assert [r.v for r in df.select(V.cleaned_ids(F.col("ids")).alias("v")).collect()] == ["1,22", None, None]


def test_page_with_total_is_one_job(spark):
    df = spark.range(1000).where("id % 3 = 0")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("page", "page")
    rows, total = V.page_with_total(df, [F.desc("id")], 2, 10)
    assert [r.id for r in rows] == list(range(969, 939, -3)) and total == 334
    assert len(before.getJobIdsForGroup("page")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert V.page_with_total(df.limit(0), [F.desc("id")], 1, 10) == ([], 0)
    with pytest.raises(ValueError):
        V.page_with_total(df, [F.desc("id")], 1, 101)


def test_checked_batches(spark, tmp_path):
    sources = spark.range(5).withColumnRenamed("id", "k")
    good = sources.withColumn("t", F.lit("x"))
    assert V.written_checked(sources, good, ["k"], f"{tmp_path}/a") == {"sources": 5, "results": 5, "alone": 0}
    assert spark.read.parquet(f"{tmp_path}/a/rows").count() == 5
    for at, bad in enumerate((good.where("k < 4"), good.unionByName(good.where("k = 1")), good.withColumn("k", F.col("k") + 1))):
        with pytest.raises(V.LengthMismatch):
            V.written_checked(sources, bad, ["k"], f"{tmp_path}/b{at}")
        assert not (tmp_path / f"b{at}" / "rows").exists()


def files(spark, tmp_path):
    rng = random.Random(2)
    texts = {"a.txt": "".join(f"line {i} é{'x' * rng.randrange(40)}\n" for i in range(3000)), "b.txt": "one\r\ntwo\n\nlast without end", "c.txt": "only\n"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    return texts


def test_lines_over_splits(spark, tmp_path):
    texts = files(spark, tmp_path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = L.numbered_lines(spark, f"file://{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in texts.items():
        own = sorted((r.line, r.text, r.last) for r in rows if r.path.endswith(name))
        assert [x[0] for x in own] == list(range(len(own)))
        assert "".join(t + ("" if last else "\n") for _, t, last in own) == text


def test_replaced_lines_and_resumed_chunks(spark, tmp_path):
    texts = files(spark, tmp_path)
    lines = L.numbered_lines(spark, f"file://{tmp_path}/in")
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in lines.select("path").distinct().collect()}
    patches = spark.createDataFrame([(paths["a.txt"], 999, "new"), (paths["a.txt"], 1000, None), (paths["b.txt"], 1, "zwei"), (paths["c.txt"], 7, "behind the end")], "path string, line long, text string")
    L.write_files(L.replaced_lines(lines, patches, 100), f"file://{tmp_path}/out", lambda p: F.regexp_extract(p, "[^/]*$", 0))
    wanted = texts["a.txt"].split("\n")
    wanted[999] = "new"
    read = lambda name: "".join(p.read_bytes().decode() for p in sorted(Path(tmp_path / "out" / f"file={name}").glob("part-*")))
    assert read("a.txt") == "\n".join(wanted) and read("b.txt") == "one\r\nzwei\n\nlast without end\n" and read("c.txt") == "only\n"

    table, seen = f"file://{tmp_path}/chunks", []

    def work(df):
        seen.append(df.select("path", "chunk").distinct().count())
        return df.where("line % 2 = 0").select("path", "line", F.upper("text").alias("text"))

    part = L.work_on_chunks(lines.where("line < 1000"), work, table)
    assert part.count() == 1000 + 4 + 1
    whole = L.work_on_chunks(lines, work, table)
    assert seen == [3, 2]  # the chunks of the first run are not worked on again
    assert {r.line: r.text for r in whole.where(F.col("path") == paths["b.txt"]).collect()} == {0: "ONE\r", 1: "two\r"[:3], 2: "", 3: "last without end"}


def test_numbered_lines_stay_where_they_are(spark, tmp_path):
    """Lines are numbered by their splits' offsets: none is shuffled or sorted for it."""
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("x\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = L.numbered_lines(spark, f"file://{tmp_path}")
        rows = sorted((r.path[-5:], r.line, r.text, r.last) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [("a.txt", i, f"line {i}", False) for i in range(3000)] + [("b.txt", 0, "x", False), ("b.txt", 1, "", False), ("b.txt", 2, "y", True)]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
