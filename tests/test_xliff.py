"""XLIFF with inline tags, read and written."""

from __future__ import annotations

import pytest

from lodestitch.plans import source_queries
from lodestitch.sources import xliff as XL

M = XL.PLACEHOLDER


@pytest.mark.parametrize("version", ["1.2", "2.0"])
def test_round_trip(spark, tmp_path, version):
    tag = lambda name, content="", **attributes: (name, attributes, content, 0)
    rows = [
        ("a", 1, "u1", f"one {M}two{M} <&> three", [tag("bpt", "&lt;b&gt;", id="1"), tag("ept", "", id="1", rid='q"<')], f"{M}ONE{M} \r\n&"),
        ("a", 0, 'u"0', "plain \x01text", [], None), ("a", 10, "u10", "", [], ""), ("b c", 0, None, f"x{M}", [tag("g", 'in <x id="7"></x> &amp; out', ctype="x-a")], "no mark"),
        ("b c", 1, "m", f"{M}y", [tag("x", id="1")], f"{M}a{M}b{M}c"),
    ]
    units = spark.createDataFrame(rows, f"doc string, place int, id string, marked string, tags {XL.TAGS}, target string")
    XL.write_units(units, f"{tmp_path}/out", version)
    got = {(r.path.split("doc=")[1].split("/")[0].replace("%20", " "), r.place): r for r in XL.read_units(spark, f"{tmp_path}/out", "part-*").collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("b c", 0), ("b c", 1)]  # places are those of the file
    zero, one, last, odd, more = (got[k] for k in sorted(got))
    assert (zero.source, zero.target, zero.tags, zero.id) == ("plain text", None, [], 'u"0')
    assert one.marked == f"one {M}two{M} <&> three" and one.source == "one two <&> three" and one.target == f"{M}ONE{M} \r\n&"
    assert [(t.tag, t.attributes, t.content, t.position) for t in one.tags] == [("bpt", {"id": "1"}, "&lt;b&gt;", 1), ("ept", {"id": "1", "rid": 'q"<'}, "", 2)]
    assert (last.source, last.target) == ("", "") and odd.tags[0].content == 'in <x id="7"></x> &amp; out' and odd.target == f"no mark{M}"
    assert more.target == f"{M}abc"  # marks beyond the tags vanish, no text does


@pytest.mark.parametrize("version", ["1.2", "2.0"])
def test_bundles(spark, tmp_path, version):
    """300 small documents share few files; a null, an empty and an odd name stay apart, and so do the turns of each."""
    docs = [f"d{i}" for i in range(300)] + [None, "", 'x<"&/é\n']
    rows = [(d, place, f"u{place}", f"{place} of {d}{M}", [("x", {"id": str(place)}, "", 0)], None if place == 2 else f"{M}{d} \n") for d in docs for place in (10, 2, 1)]
    units = spark.createDataFrame(rows, f"doc string, place int, id string, marked string, tags {XL.TAGS}, target string")
    XL.write_bundles(units, f"{tmp_path}/out", version, most_bytes=100_000)
    got = XL.read_units(spark, f"{tmp_path}/out", "part-*").collect()
    assert sorted(map(str, ((r.original, int(r.id[1:]), r.id, r.marked, r.target) for r in got))) == sorted(map(str, ((d, p, i, m, t) for d, p, i, m, _, t in rows)))
    assert 1 < len(list((tmp_path / "out").rglob("part-*"))) <= 4
    for name in docs:
        assert [r.id for r in sorted((r for r in got if r.original == name), key=lambda r: r.place)] == ["u1", "u2", "u10"]
    XL.write_bundles(units.limit(0), f"{tmp_path}/none", version)
    assert not list((tmp_path / "none").rglob("bundle=*"))


def test_registered_round_trip_writes_files_by_bytes(spark, tmp_path, monkeypatch):
    turns = spark.createDataFrame([(c, t, f"word {c} <more> {t}") for c in range(50) for t in range(3)], "conv_id long, turn long, text string")
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(source_queries, "shared_path", lambda spark, label: f"{tmp_path}/{label}")
    got = source_queries.xliff_round_trip(spark, str(tmp_path)).collect()
    assert {(r.doc, r.place) for r in got} == {(str(c), t) for c in range(50) for t in range(3)} and len(got) == 150
    assert len(list((tmp_path / "xliff").rglob("part-*"))) == 1


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.xlf").write_text('<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body/></file></xliff>')
    assert XL.read_units(spark, str(tmp_path)).collect() == []
    (tmp_path / "broken.xlf").write_text("<xliff><trans-unit>")
    with pytest.raises(Exception, match="ParseError"):
        XL.read_units(spark, str(tmp_path)).collect()
    none = spark.createDataFrame([], f"doc string, place int, id string, marked string, tags {XL.TAGS}, target string")
    XL.write_units(none, f"{tmp_path}/none")


def test_visible_codes():
    assert XL._visible("<run1>★</run1>") == "★" and XL._visible("a > b") == "a > b" and XL._visible("<open") == ""
