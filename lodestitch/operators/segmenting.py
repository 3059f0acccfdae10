"""Documents to ordered segments and back.

Segments carry their order as columns; nothing relies on row order. Splitting and packing
happen inside the row; only the markdown fence state (a running count per document) and
reassembly group rows by document. Deviations from the surveyed system are named where they
are made; ``parity=True`` gives its behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import text as X

LIMIT = 1000


def txt_segments(docs: DataFrame, limit: int = LIMIT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, seg_idx, para, sub, text: paragraphs (split at an empty line) that need translation;
    those over the limit are packed sentence by sentence into sub-parts."""
    paras = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n\n")).alias("para", "body")).where(X.needs_translation(F.col("body")))
    long = F.length("body") > limit
    parts = F.when(long, X.pack_sentences(F.col("body"), limit)).otherwise(F.array("body"))
    out = paras.select("doc_id", "para", long.alias("sub"), F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("doc_id").orderBy("para", "part")
    return out.select("doc_id", (F.row_number().over(order) - 1).alias("seg_idx"), "para", "sub", "text")


def _in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def assemble_txt(segments: DataFrame, parity: bool = False) -> DataFrame:
    """doc_id, text: sub-parts join without separator, each group ends with a blank line, an open
    last group with one newline. With ``parity`` neighbouring long paragraphs run together;
    without it every paragraph is its own group."""
    if parity:
        order = Window.partitionBy("doc_id").orderBy("seg_idx")
        start = F.when(F.col("sub") & F.lag("sub", 1, False).over(order), 0).otherwise(1)
        grouped = segments.withColumn("group", F.sum(start).over(order))
    else:
        grouped = segments.withColumn("group", F.col("para"))
    blocks = grouped.groupBy("doc_id", "group", "sub").agg(F.min("seg_idx").alias("first"), F.array_join(F.transform(_in_order("seg_idx", "text"), lambda x: x["text"]), "").alias("block"))
    last = F.col("first") == F.max("first").over(Window.partitionBy("doc_id"))
    ended = blocks.withColumn("block", F.concat("block", F.when(last & F.col("sub"), F.lit("\n")).otherwise(F.lit("\n\n"))))
    return ended.groupBy("doc_id").agg(F.array_join(F.transform(_in_order("first", "block"), lambda x: x["block"]), "").alias("text"))


FENCE = r"^(?:```|~~~)"


def md_line_type(line: Column, in_code: Column) -> Column:
    """Kind of a markdown line; the first rule that fits decides."""
    bare = X.stripped(line)
    pipes = F.regexp_count(line, F.lit(r"\|"))
    separator = bare.rlike(r"^\|[\s|:\-]+\|$") & (F.regexp_count(bare, F.lit(r"\|")) == 5)
    return (
        F.when(in_code | bare.rlike(FENCE), "code_block")
        .when(bare == "", "empty")
        .when(bare.rlike(r"^#{1,6}\s"), "heading")
        .when(bare.rlike(r"^[*\-+]\s"), "list_item")
        .when(bare.rlike(r"^\p{Nd}+\.\s"), "ordered_item")
        .when(bare.rlike(r"^>"), "quote")
        .when(bare.rlike(r"^[-*_]{3,}$"), "horizontal_rule")
        .when(pipes >= 2, F.when(separator, "table_separator").otherwise("table_row"))
        .when(line.rlike(r"\[.*?\]\(.*?\)"), "link_image")
        .otherwise("text")
    )


def md_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line, content, type, element: a line inside an open fence belongs to the block."""
    lines = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    order = Window.partitionBy("doc_id").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.sum(X.stripped(F.col("content")).rlike(FENCE).cast("int")).over(before)
    typed = lines.withColumn("in_code", F.coalesce(marks, F.lit(0)) % 2 == 1)
    typed = typed.withColumn("type", md_line_type(F.col("content"), F.col("in_code")))
    return typed.withColumn("element", F.sum((~F.col("in_code")).cast("int")).over(order) - 1).drop("in_code")


def md_segments(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, seg_idx, type, preserve, text: code blocks whole, text and table rows to be
    translated (unless only punctuation), long ones packed; all else is preserved."""
    elements = (
        md_lines(docs)
        .groupBy("doc_id", "element")
        .agg(F.min_by("type", "line").alias("type"), F.array_join(F.transform(_in_order("line", "content"), lambda x: x["content"]), "\n").alias("body"))
    )
    preserve = ~F.col("type").isin("text", "table_row") | ~X.needs_translation(F.col("body"))
    parts = F.when(~preserve & (F.length("body") > limit), X.pack_sentences(F.col("body"), limit)).otherwise(F.array("body"))
    out = elements.select("doc_id", "element", "type", preserve.alias("preserve"), F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("doc_id").orderBy("element", "part")
    return out.select("doc_id", (F.row_number().over(order) - 1).alias("seg_idx"), "type", "preserve", "text")


def assemble_md(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(_in_order("seg_idx", "text"), lambda x: x["text"]), "\n").alias("text"))


def csv_segments(cells: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, row, col, part, text of cells (doc_id, row, col, cell) that need translation."""
    parts = F.when(F.length("cell") > limit, X.pack_cell_words(F.col("cell"), limit)).otherwise(F.array("cell"))
    return cells.where(X.needs_translation(F.col("cell"))).select("doc_id", "row", "col", F.posexplode(parts).alias("part", "text"))


def assemble_csv(cells: DataFrame, translated: DataFrame) -> DataFrame:
    """Cells with their translated parts (joined by spaces) in place. Cells are matched by
    position; the surveyed system matches by text, loses repeated cells and all after a split one."""
    whole = translated.groupBy("doc_id", "row", "col").agg(F.array_join(F.transform(_in_order("part", "text"), lambda x: x["text"]), " ").alias("done"))
    return cells.join(whole, ["doc_id", "row", "col"], "left").select("doc_id", "row", "col", F.coalesce("done", "cell").alias("cell"))


def csv_lines(cells: DataFrame) -> DataFrame:
    """doc_id, row, line: cells quoted where they hold a comma, quote or line end."""
    cell = F.coalesce("cell", F.lit(""))
    quoted = F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)
    return cells.withColumn("q", quoted).groupBy("doc_id", "row").agg(F.array_join(F.transform(_in_order("col", "q"), lambda x: x["q"]), ",").alias("line"))


def with_context(segments: DataFrame, chars: int = 200, k: int = 1) -> DataFrame:
    """Segments with what stands before and after them (at most ``chars`` characters of each
    neighbour); neighbours of symbols only are skipped."""
    order = Window.partitionBy("doc_id").orderBy("seg_idx")
    shown = lambda c: F.when(~X.is_pure_symbol(c), F.substring(c, 1, chars))
    if k == 1:
        return segments.withColumn("before", shown(F.lag("text").over(order))).withColumn("after", shown(F.lead("text").over(order)))
    near = lambda frame: F.array_join(F.collect_list(shown(F.col("text"))).over(frame), "")
    return segments.withColumn("before", near(order.rowsBetween(-k, -1))).withColumn("after", near(order.rowsBetween(1, k)))


def distinct_texts(segments: DataFrame) -> DataFrame:
    """text, first (smallest (doc_id, seg_idx)) and uses of every distinct text."""
    return segments.groupBy("text").agg(F.min(F.struct("doc_id", "seg_idx")).alias("first"), F.count("*").alias("uses"))


def line_chunks(lines: DataFrame, size: int = 1000) -> DataFrame:
    """Lines (doc_id, line) numbered into chunks of ``size``."""
    return lines.withColumn("chunk", F.floor(F.col("line") / size))


def sampled_cjk_ratio(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, chars, cjk and ratio of a sample of each document: its first five paragraphs (doc_id, para, text) and the first
    three by three cells of its first two tables (doc_id, tbl, row, col, text), trimmed. 0 for no characters."""
    head = paragraphs.where("para < 5").select("doc_id", "text").unionByName(cells.where("tbl < 2 AND row < 3 AND col < 3").select("doc_id", "text"))
    bare = X.stripped(F.coalesce("text", F.lit("")))
    sums = head.groupBy("doc_id").agg(F.sum(F.length(bare)).alias("chars"), F.sum(X.cjk_chars(bare)).cast("bigint").alias("cjk"))
    return sums.withColumn("ratio", F.coalesce(F.col("cjk") / F.nullif("chars", F.lit(0)), F.lit(0.0)))
