"""File readers on small files made here, glossary import, storage, streams against batch."""

from __future__ import annotations

import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestitch.plans import registry
from lodestitch.sources import files as X

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(path: Path, parts: dict[str, str]) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def workbook(path: Path, rows: list[list[str]]) -> None:
    cells = lambda r, row: "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None)
    sheet = f'<worksheet {S}><sheetData>{"".join(f"<row>{cells(r, row)}</row>" for r, row in enumerate(rows))}</sheetData></worksheet>'
    zipped(path, {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="x" r:id="r1"/><sheet name="y" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>sh</t><r><t>ared</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row><c r="AB3" t="s"><v>0</v></c><c r="A4"><v>1.5</v></c></row></sheetData></worksheet>',
    })


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["x", None, "z"], ["y"]])
    got = sorted((r.sheet, r.row, r.col, r.cell) for r in X.read_xlsx_cells(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0, "x"), (0, 0, 2, "z"), (0, 1, 0, "y"), (1, 2, 27, "shared"), (1, 3, 0, "1.5")]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, p="": f"<w:r>{p}<w:t>{t}</w:t></w:r>"
    body = f'<w:p>{run("Hello", "<w:rPr><w:b/></w:rPr>")}<w:hyperlink>{run(" link")}</w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl>'
    box = f'<w:p><w:r><w:pict><w:p>{run("boxed")}</w:p></w:pict></w:r></w:p>'
    zipped(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body>{body}{box}</w:body></w:document>", "word/header1.xml": f'<w:hdr {w}><w:p>{run("top")}</w:p></w:hdr>'})
    got = [(r.part, r.text, r.style) for r in X.read_docx_runs(spark, str(tmp_path)).orderBy("part", "para", "run").collect() if r.text]
    assert got == [("document", "Hello", "b"), ("document", " link", ""), ("document", "cell", ""), ("document", "boxed", ""), ("header1", "top", "")]


def test_pptx(spark, tmp_path):
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f'<p:sld {A}><p:sp><p:txBody>{para("one")}{para(" ")}{para("two")}</p:txBody></p:sp><p:graphicFrame><a:tbl><a:tr><a:tc>{para("c1")}</a:tc><a:tc>{para("c2")}</a:tc></a:tr></a:tbl></p:graphicFrame></p:sld>'
    zipped(tmp_path / "a.pptx", {"ppt/slides/slide2.xml": slide, "ppt/slides/slide10.xml": slide})
    got = sorted((r.slide, r.kind, r.text) for r in X.read_pptx_texts(spark, str(tmp_path)).collect())
    assert got == sorted((s, k, t) for s in (2, 10) for k, t in (("paragraph", "one"), ("paragraph", "two"), ("cell", "c1"), ("cell", "c2")))


def test_xliff(spark, tmp_path):
    (tmp_path / "a.xlf").write_text('<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body><trans-unit id="1"><source>a<g id="1">b</g> c<x id="2"/></source><target>t</target></trans-unit></body></file></xliff>')
    (tmp_path / "b.xliff").write_text('<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0"><file><unit id="u"><segment><source>plain</source></segment></unit></file></xliff>')
    got = {r.id: (r.source, r.marked, r.target) for r in X.read_xliff_units(spark, str(tmp_path)).collect()}
    assert got == {"1": ("a c", "a♂ c♂", "t"), "u": ("plain", "plain", None)}
    tags = spark.createDataFrame([("x♂y♂", ["<1/>", "<2/>"]), ("x♂y♂♂", ["<1/>"]), ("x", ["<1/>"])], "t string, g array<string>")
    assert [r.v for r in tags.select(X.restore_placeholders(F.col("t"), F.col("g")).alias("v")).collect()] == ["x<1/>y<2/>", "x<1/>y", "x<1/>"]


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes('a,"b,é"\n'.encode())
    (tmp_path / "g.csv").write_bytes("工,车\n".encode("gbk"))
    (tmp_path / "l.csv").write_bytes(b"\xe9,\xff\n")
    got = {(r.path[-5:], r.row, r.col): r.cell for r in X.read_csv_cells(spark, str(tmp_path)).collect()}
    assert got == {("u.csv", 0, 0): "a", ("u.csv", 0, 1): "b,é", ("g.csv", 0, 0): "工", ("g.csv", 0, 1): "车", ("l.csv", 0, 0): "é", ("l.csv", 0, 1): "ÿ"}


def test_glossary_template(spark, tmp_path):
    workbook(tmp_path / "g.xlsx", [["Title"], ["My base"], ["Source", "Target"], ["en", "de"], ["Term", "Term"], ["cat", " Katze "], ["", "x"], ["dog", None], ["bird", "Vogel"]])
    cells = X.read_xlsx_cells(spark, str(tmp_path)).where("sheet = 0")
    bases, terms = X.import_glossary(cells)
    assert [(r.title, r.source_lang, r.target_lang) for r in bases.collect()] == [("My base", "en", "de")]
    assert sorted((r.source, r.target) for r in terms.collect()) == [("bird", "Vogel"), ("cat", "Katze")]
    with pytest.raises(Exception, match="fewer than 6 rows"):
        X.import_glossary(cells.where("row < 4"))[0].collect()


def test_stream_agrees_with_batch(spark):
    sf = "/root/testdata/sf0.001"
    stream = registry.QUERIES["stream_rate"](spark, sf).groupBy("key", "in_window").count()
    batch = registry.QUERIES["rate_batch_twin"](spark, sf)
    assert stream.agg(F.sum("count")).first()[0] == batch.count()


def test_translate_stream(spark, tmp_path):
    from lodestitch.operators import translation as R
    from lodestitch.streaming import jobs as streams

    rows = [(1, 0, "one two"), (1, 1, "..."), (2, 0, "three four")]
    segments = spark.createDataFrame(rows, "doc_id int, seg_idx int, text string")
    segments.repartition(2).write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    work = lambda batch: R.translate_segments(batch, [R.reverse_words])
    for _ in range(2):  # a second start finds nothing new
        streams.translate_stream(files, f"{tmp_path}/out", f"{tmp_path}/state", work).awaitTermination()
    got = sorted((r.doc_id, r.seg_idx, r.translated) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, "two one"), (1, 1, "..."), (2, 0, "four three")]


def test_admission_stream_keeps_slots(spark, tmp_path):
    from lodestitch.streaming import jobs as streams

    def put(i, rows):
        df = spark.createDataFrame(rows, "queue string, id long, at string, status string").select("queue", "id", F.to_timestamp_ntz("at").alias("created_at"), "status")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        return df.schema

    schema = put(0, [("q", i, f"2024-01-01 00:00:0{i}", "queued") for i in range(5)])
    put(1, [("q", 0, "2024-01-01 00:01:00", "done")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        streams.admit_stream(stream, 2, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/started").collect()) == [0, 1, 2]
    assert sorted(r.id for r in streams.waiting_jobs(spark, f"{tmp_path}/out").collect()) == [3, 4]


def test_without_corpus_operators(tmp_path):
    """The rest imports and runs where the corpus subpackage and the pipeline are not there."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('lodestitch.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'status_distribution' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names)\n"
        "assert set(e.oracle_sql()) <= names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
