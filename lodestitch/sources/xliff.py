"""XLIFF 1.2 and 2.0 with their inline tags: units as rows, and rows as files.

A unit's text is mixed content. Read, it is a plain text, the same text with a mark at each inline tag, and the
tags as structs, so translators see marks only; written, tags go back to their marks with all attributes
and content. Files are read by the ``binaryFile`` source (any store) and parsed one by one in the tasks; they are
written by Spark's text writer, whose commit protocol shows a job's files all at once or not at all. Many small documents
share files of a bounded size (``write_bundles``), as XLIFF lets a file hold a ``file`` element for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.sources.files import PLACEHOLDER, read_bytes

TAGS = "array<struct<tag:string,attributes:map<string,string>,content:string,position:int>>"
#: Elements that hold native codes, whose visible text belongs to the unit's text.
CODES = ("bpt", "ept", "ph")
NAMESPACES = {"1.2": "urn:oasis:names:tc:xliff:document:1.2", "2.0": "urn:oasis:names:tc:xliff:document:2.0"}
#: Bytes of the documents that share a file; a document that is larger has one of its own size.
BUNDLE_BYTES = 4 << 20
#: What XML cannot hold, and what a parser would change.
_NOT_XML = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{fffe}\x{ffff}]"


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _inner(element: ET.Element) -> str:
    """The content of an element as XML without namespaces: all that is needed to write it again."""
    out = escape(element.text or "")
    for child in element:
        attributes = "".join(f' {k.rsplit("}", 1)[-1]}="{escape(v, {chr(34): "&quot;"})}"' for k, v in child.attrib.items())
        out += f"<{_local(child)}{attributes}>{_inner(child)}</{_local(child)}>" + escape(child.tail or "")
    return out


def _visible(code: str) -> str:
    """A native code without what stands in angle brackets."""
    out, depth = [], 0
    for c in code:
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">" and depth > 0
    return "".join(out)


def _mixed(element: ET.Element) -> tuple[str, str, list[dict]]:
    plain, marked, tags, position = element.text or "", element.text or "", [], 1 if element.text else 0
    for child in element:
        if _local(child) in CODES and (shown := _visible(child.text or "")):
            plain, marked, position = plain + shown, marked + shown, position + 1
        tags.append({"tag": _local(child), "attributes": [(k.rsplit("}", 1)[-1], v) for k, v in child.attrib.items()], "content": _inner(child), "position": position})
        marked += PLACEHOLDER
        if child.tail:
            plain, marked, position = plain + child.tail, marked + child.tail, position + 1
    return plain, marked, tags


def units_of(content: bytes) -> Iterator[tuple]:
    """place, id, source, marked, tags, target (marked as its source is; null where there is none) of a file's units, and
    what the ``file`` element around them names as its original."""
    place, original = 0, None
    for unit in ET.fromstring(content).iter():
        if _local(unit) == "file":
            original = unit.get("original")
        if _local(unit) not in ("trans-unit", "unit"):
            continue
        source = next((e for e in unit.iter() if _local(e) == "source"), None)
        target = next((e for e in unit.iter() if _local(e) == "target"), None)
        if source is not None:
            plain, marked, tags = _mixed(source)
            yield place, unit.get("id"), plain, marked, tags, None if target is None else _mixed(target)[1], original
            place += 1


def read_units(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, place, id, source, marked, tags, target and original of every unit; a file that is no XML raises."""
    tag = pa.struct([("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("content", pa.string()), ("position", pa.int32())])
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(tag), pa.string(), pa.string()]
    names = ["path", "place", "id", "source", "marked", "tags", "target", "original"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(at, *unit) for unit in units_of(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = read_bytes(spark, path, glob).select("path", "content")
    return files.mapInArrow(run, f"path string, place int, id string, source string, marked string, tags {TAGS}, target string, original string")


def escaped(text: Column, attribute: bool = False) -> Column:
    """A text as XML has it; characters that XML cannot hold are left out."""
    out = F.regexp_replace(text, _NOT_XML, "")
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), *((('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")) if attribute else ())):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def with_tags(marked: Column, tags: Column) -> Column:
    """XML of a text with marks: tags at their marks. Marks beyond the tags vanish, tags beyond the marks go last."""
    pairs = lambda t: F.array_join(F.transform(F.map_entries(t["attributes"]), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"'))), "")
    element = lambda t: F.concat(F.lit("<"), t["tag"], pairs(t), F.lit(">"), F.coalesce(t["content"], F.lit("")), F.lit("</"), t["tag"], F.lit(">"))
    pieces, found = F.split(marked, PLACEHOLDER), F.coalesce(tags, F.array().cast(TAGS))
    inside = F.transform(pieces, lambda p, i: F.concat(F.when((i > 0) & (i <= F.size(found)), element(F.get(found, i - 1))).otherwise(F.lit("")), escaped(p)))
    rest = F.when(F.size(found) >= F.size(pieces), F.transform(F.slice(found, F.size(pieces), F.size(found)), element)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(inside, ""), F.array_join(rest, ""))


def _unit(version: str) -> Column:
    """XML of a unit (id, marked, tags, target)."""
    name = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    target = F.when(F.col("target").isNotNull(), name("target", with_tags(F.col("target"), F.col("tags")))).otherwise(F.lit(""))
    body = F.concat(name("source", with_tags(F.col("marked"), F.col("tags"))), target)
    wrap = ('<trans-unit id="', '">', "</trans-unit>") if version == "1.2" else ('<unit id="', '"><segment>', "</segment></unit>")
    return F.concat(F.lit(wrap[0]), escaped(F.coalesce("id", F.lit("")), True), F.lit(wrap[1]), body, F.lit(wrap[2]))


def _root(version: str, languages: tuple[str, str]) -> str:
    known = "" if version == "1.2" else f' srcLang="{languages[0]}" trgLang="{languages[1]}"'
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff xmlns="{NAMESPACES[version]}" version="{version}"{known}>'


def write_units(units: DataFrame, out: str, version: str = "1.2", languages: tuple[str, str] = ("en", "en")) -> None:
    """A file for each doc of ``units`` (doc, place, id, marked, tags, target with marks or null), under ``out``/doc=. A doc's
    units are lines of one sorted task, from its head to its end, so no document is held as a whole. Where docs are many and
    small, ``write_bundles`` spares a file and a folder for each."""
    head, tail = f'{_root(version, languages)}<file id="f1">', "</file></xliff>"
    if version == "1.2":
        head = f'{_root(version, languages)}<file source-language="{languages[0]}" target-language="{languages[1]}" datatype="plaintext" original="document"><body>'
        tail = "</body></file></xliff>"
    docs = units.select("doc").distinct()
    edge = lambda turn, text: docs.select("doc", F.lit(turn).alias("turn"), F.lit(0).alias("place"), F.lit(text).alias("value"))
    lines = edge(0, head).unionByName(units.select("doc", F.lit(1).alias("turn"), F.col("place").cast("int").alias("place"), _unit(version).alias("value"))).unionByName(edge(2, tail))
    lines.repartition("doc").sortWithinPartitions("doc", "turn", "place").select("doc", "value").write.partitionBy("doc").text(out)


def write_bundles(units: DataFrame, out: str, version: str = "1.2", languages: tuple[str, str] = ("en", "en"), most_bytes: int = BUNDLE_BYTES) -> None:
    """The units of ``write_units`` with a ``file`` element for each doc, which it names as its original, in files of about
    ``most_bytes`` under ``out``/bundle=. The number of files follows the bytes, not the docs; a doc is not divided."""
    size = F.octet_length("marked") + F.coalesce(F.octet_length("target"), F.lit(0)) + 256
    bundles = 1 + (units.agg(F.sum(size)).first()[0] or 0) // most_bytes
    lines = units.select("doc", "place", _unit(version).alias("value"), F.pmod(F.xxhash64("doc"), F.lit(bundles)).alias("bundle"))
    order = Window.partitionBy("bundle").orderBy("doc", "place")
    # A struct tells a neighbour without a doc from no neighbour.
    own, before, after = F.struct("doc"), F.lag(F.struct("doc")).over(order), F.lead(F.struct("doc")).over(order)
    lines = lines.repartition(int(min(bundles, 1 << 16)), "bundle").withColumns({"own": own, "before": before, "after": after, "n": F.row_number().over(order)})
    original = F.when(F.col("doc").isNotNull(), F.concat(F.lit(' original="'), escaped(F.col("doc").cast("string"), True), F.lit('"'))).otherwise(F.lit(""))
    if version == "1.2":
        start, end = F.concat(F.lit(f'<file source-language="{languages[0]}" target-language="{languages[1]}" datatype="plaintext"'), original, F.lit("><body>\n")), "\n</body></file>"
    else:
        start, end = F.concat(F.lit('<file id="f'), F.col("n").cast("string"), F.lit('"'), original, F.lit(">\n")), "\n</file>"
    where = lambda test, text: F.when(test, text).otherwise(F.lit(""))
    value = F.concat(
        where(F.col("before").isNull(), F.lit(_root(version, languages) + "\n")), where(~F.col("before").eqNullSafe(F.col("own")), start), "value",
        where(~F.col("after").eqNullSafe(F.col("own")), F.lit(end)), where(F.col("after").isNull(), F.lit("\n</xliff>")),
    )
    lines.select("bundle", value.alias("value")).write.partitionBy("bundle").text(out)
