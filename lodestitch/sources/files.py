"""File sources and sinks.

Text, csv bytes and office documents are read as rows by Spark: the listing, splitting and
fetching of files is the ``binaryFile`` and ``text`` sources', and a small parser turns one
file's bytes into rows inside the task. A file that cannot be read raises; nothing is
swallowed. Zipped XML formats (xlsx, docx, pptx) and XLIFF need only the standard library.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "iso-8859-1")
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW_NS = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE_NS = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PLACEHOLDER = "♂"


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per UTF-8 file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "modificationTime", "length", "content")


def per_file(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``parse(content)`` for each file, with its path in front."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                out = pd.DataFrame(list(parse(bytes(content))), columns=names)
                out.insert(0, "path", path)
                yield out

    return files.select("path", "content").mapInPandas(run, "path string, " + schema)


def decode(content: bytes, encodings=ENCODINGS) -> str:
    """The text in the first encoding that fits."""
    for name in encodings:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def csv_cells(content: bytes) -> Iterator[tuple]:
    for r, row in enumerate(csv.reader(io.StringIO(decode(content), newline=""))):
        for c, cell in enumerate(row):
            yield r, c, cell


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, cell of csv files in any of the encodings."""
    return per_file(read_bytes(spark, path, "*.csv"), csv_cells, "row int, col int, cell string")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """sheet (place), row, col, cell of every sheet in workbook order; shared, inline and plain values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET_NS}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet")):
            target = links[sheet.get(f"{REL_NS}id")].lstrip("/")
            for cell in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET_NS}c"):
                value, kind = cell.find(f"{SHEET_NS}v"), cell.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{SHEET_NS}t"))
                else:
                    text = None if value is None else shared[int(value.text)] if kind == "s" else value.text
                if text is not None:
                    ref = cell.get("r")
                    yield s, int(re.search(r"\d+", ref)[0]) - 1, _column(ref), text


def read_xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    return per_file(read_bytes(spark, path, "*.xlsx"), xlsx_cells, "sheet int, row int, col int, cell string")


def docx_runs(content: bytes) -> Iterator[tuple]:
    """part, para, run, text, style of runs in body, tables, text boxes, headers, footers, comments."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in sorted(z.namelist()) if re.fullmatch(r"word/(document|header\d*|footer\d*|comments)\.xml", n)]
        for part in parts:
            for p, para in enumerate(ET.fromstring(z.read(part)).iter(f"{WORD_NS}p")):
                nested = {r for q in para.iter(f"{WORD_NS}p") if q is not para for r in q.iter(f"{WORD_NS}r")}
                for i, run in enumerate(r for r in para.iter(f"{WORD_NS}r") if r not in nested):
                    props = run.find(f"{WORD_NS}rPr")
                    style = sorted((x.tag.split("}")[1], *sorted(f"{k.split('}')[-1]}={v}" for k, v in x.attrib.items())) for x in props) if props is not None else []
                    inner = {t for q in run.iter(f"{WORD_NS}p") for t in q.iter(f"{WORD_NS}t")}
                    text = "".join(t.text or "" for t in run.iter(f"{WORD_NS}t") if t not in inner)
                    yield part[5:-4], p, i, text, ";".join(" ".join(x) for x in style)


def read_docx_runs(spark: SparkSession, path: str) -> DataFrame:
    return per_file(read_bytes(spark, path, "*.docx"), docx_runs, "part string, para int, run int, text string, style string")


def pptx_texts(content: bytes) -> Iterator[tuple]:
    """slide, shape, kind (paragraph or cell), row, col, para, text of slides in number order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        said = lambda e: "".join(t.text or "" for t in e.iter(f"{DRAW_NS}t"))
        for number, name in slides:
            tree = ET.fromstring(z.read(name))
            shapes = [e for e in tree.iter() if e.tag in (f"{SLIDE_NS}sp", f"{SLIDE_NS}graphicFrame")]
            for s, shape in enumerate(shapes):
                if shape.tag.endswith("graphicFrame"):
                    for r, row in enumerate(shape.iter(f"{DRAW_NS}tr")):
                        for c, cell in enumerate(row.iter(f"{DRAW_NS}tc")):
                            yield number, s, "cell", r, c, None, said(cell)
                else:
                    for p, para in enumerate(shape.iter(f"{DRAW_NS}p")):
                        yield number, s, "paragraph", None, None, p, said(para)


def read_pptx_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts of slides; equal texts at one place are one row."""
    rows = per_file(read_bytes(spark, path, "*.pptx"), pptx_texts, "slide int, shape int, kind string, row int, col int, para int, text string")
    return rows.where("trim(text) != ''").dropDuplicates(["path", "slide", "shape", "kind", "row", "col", "para", "text"])


def xliff_units(content: bytes) -> Iterator[tuple]:
    """id, source, marked, target of XLIFF 1.2 and 2.0 units: ``source`` without what stands in
    inline tags, ``marked`` with a placeholder for each inline tag."""
    tree = ET.fromstring(content)
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def marked(e) -> str:
        return (e.text or "") + "".join(PLACEHOLDER + (c.tail or "") for c in e)

    for unit in tree.iter():
        if local(unit) not in ("trans-unit", "unit"):
            continue
        source = next((e for e in unit.iter() if local(e) == "source"), None)
        target = next((e for e in unit.iter() if local(e) == "target"), None)
        if source is not None:
            plain = (source.text or "") + "".join(c.tail or "" for c in source)
            yield unit.get("id"), plain, marked(source), None if target is None else marked(target)


def read_xliff_units(spark: SparkSession, path: str) -> DataFrame:
    return per_file(read_bytes(spark, path, "*.xl*f*"), xliff_units, "id string, source string, marked string, target string")


def restore_placeholders(translated: Column, tags: Column, mark: str = PLACEHOLDER) -> Column:
    """Tags (array of strings) put back at the marks; surplus marks vanish, surplus tags go last."""
    pieces = F.split(translated, mark)
    inside = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(tags, i - 1), F.lit("")), p)))
    used = F.size(pieces) - 1
    rest = F.when(F.size(tags) > used, F.slice(tags, used + 1, F.size(tags) - used)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(inside, ""), F.array_join(rest, ""))


def import_glossary(cells: DataFrame, labels: dict[tuple[int, int], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Glossary workbooks (path, row, col, cell of a template) as (bases, terms).

    Row 2 holds the title, row 4 the languages, terms start in row 6, columns A and B; pairs with
    a blank side are left out. A workbook of fewer than 6 rows raises, as does one whose ``labels`` (by row and
    column, from 0) are others."""
    at = lambda r, c: F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.trim("cell")))
    given = lambda x, default: F.coalesce(F.nullif(x, F.lit("")), F.lit(default))
    bases = cells.groupBy("path").agg(
        F.max("row").alias("last_row"),
        given(at(1, 0), "untitled").alias("title"),
        given(at(3, 0), "").alias("source_lang"),
        given(at(3, 1), "").alias("target_lang"),
    )
    short = F.when(F.col("last_row") < 5, F.raise_error(F.concat(F.lit("fewer than 6 rows: "), F.col("path"))).cast("int")).otherwise(F.col("last_row"))
    bases = bases.withColumn("last_row", short)
    for (row, col), label in (labels or {}).items():
        seen = cells.groupBy("path").agg(at(row, col).alias("label"))
        wrong = F.raise_error(F.concat(F.lit(f"label {label!r} is missing in row {row + 1}: "), F.col("path"))).cast("int")
        checked = seen.select("path", F.when(F.coalesce(F.col("label") == label, F.lit(False)), F.lit(0)).otherwise(wrong).alias("_wrong"))
        bases = bases.join(checked, "path").withColumn("last_row", F.col("last_row") + F.col("_wrong")).drop("_wrong")
    terms = (
        cells.where("row >= 5 AND col <= 1")
        .groupBy("path", "row")
        .agg(F.max(F.when(F.col("col") == 0, F.trim("cell"))).alias("source"), F.max(F.when(F.col("col") == 1, F.trim("cell"))).alias("target"))
        .where("source != '' AND target != ''")
    )
    return bases, terms


def write_glossaries(exported: DataFrame, path: str) -> None:
    """One file for each base of ``export_glossary``, in a folder of its name."""
    exported.withColumnRenamed("lines", "value").repartition("base").write.partitionBy("base").option("lineSep", "\n").text(path)


def fill_cells(cells: DataFrame, translated: DataFrame, translatable: Column) -> DataFrame:
    """Workbook cells (doc_id, sheet, row, col, cell) with the translated items (doc_id, nth, text)
    in place: the n-th cell that ``translatable`` accepts takes item n, row by row and sheet by
    sheet. Fails where a document has another number of items than of such cells."""
    order = Window.partitionBy("doc_id").orderBy("sheet", "row", "col")
    marked = cells.withColumn("takes", F.coalesce(translatable, F.lit(False)))
    numbered = marked.withColumn("nth", F.when(F.col("takes"), F.sum(F.col("takes").cast("int")).over(order) - 1))
    filled = numbered.join(translated.withColumnRenamed("text", "item"), ["doc_id", "nth"], "full")
    odd = F.col("cell").isNull() & F.col("row").isNull() | (F.col("takes") & F.col("item").isNull())
    cell = F.when(odd, F.raise_error(F.concat(F.lit("items and cells differ in number: document "), F.col("doc_id").cast("string")))).otherwise(F.coalesce("item", "cell"))
    return filled.select("doc_id", "sheet", "row", "col", cell.alias("cell"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, text: chunk files (doc_id, name, text) joined in the order of their names."""
    parts = F.array_sort(F.collect_list(F.struct("name", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def join_units(units: DataFrame, translated: DataFrame) -> DataFrame:
    """XLIFF units (path, unit_id, source) with their targets by unit id; a unit without one keeps
    its source."""
    targets = translated.select("path", "unit_id", "target")
    return units.join(targets, ["path", "unit_id"], "left").withColumn("target", F.coalesce("target", "source"))


def csv_cell(cell: Column) -> Column:
    """A cell as csv has it: null as empty, quoted where it holds a comma, quote or line end."""
    cell = F.coalesce(cell, F.lit(""))
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def export_glossary(bases: DataFrame, terms: DataFrame) -> DataFrame:
    """base, lines: a header and the terms, newest first, as csv text; bases without terms keep the header."""
    row = F.concat_ws(",", csv_cell(F.col("source")), csv_cell(F.col("target")))
    lines = terms.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("term_id", row.alias("line"))), asc=False).alias("rows"))
    body = F.transform(F.coalesce("rows", F.array().cast("array<struct<term_id:bigint,line:string>>")), lambda x: x["line"])
    return bases.join(lines, "base", "left").select("base", F.array_join(F.concat(F.array(F.lit("source,target")), body), "\n").alias("lines"))


def storage_report(files: DataFrame, now: str | None = None) -> DataFrame:
    """Sizes by category, tenant, user and day with all subtotals, from paths like
    ``category/tenant/user/day/name``; image-to-PDF output is its own category."""
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    part = lambda i: F.element_at(F.split(path, "/"), -i)
    category = F.when(F.contains(path, F.lit("/images_to_pdf/")), "images_to_pdf").otherwise(part(5))
    kept = (category != "images_to_pdf") | (F.endswith(F.lower(path), F.lit(".pdf")) & (F.col("length") > 0))
    sized = files.where(kept).select(category.alias("category"), part(4).alias("tenant"), part(3).alias("user"), part(2).alias("day"), "length")
    return sized.rollup("category", "tenant", "user", "day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def expired_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return files.where(F.col("modificationTime") < now - F.expr(f"INTERVAL {hours} HOURS")).select("path", "modificationTime", "length")


def write_texts(texts: DataFrame, path: str) -> None:
    """One text per row as it stands, partitioned by document bucket."""
    texts.write.mode("errorifexists").text(path)


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append or replace a table; a replaced table appears whole or not at all."""
    df.write.mode(mode).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, batch: int = 1000) -> None:
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, properties: dict) -> DataFrame:
    """A table read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
