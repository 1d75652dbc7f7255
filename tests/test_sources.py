"""Readers and file-corpus jobs on small files."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.operators import export, lineage
from sievetable.sources import (
    archives,
    delimited,
    headers,
    inventory,
    json_docs,
    positions,
    xml_records,
)


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def issues(frame):
    return sorted((r.code, r.row, r.field) for r in frame.select("code", "row", "field").collect())


def test_delimited_values_stay_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿id,mesto,aktivno\n001,"Č, x",true\n\n2,"say ""hi""",false\n')
    rows = delimited.read_delimited(spark, path).collect()
    assert [tuple(r) for r in rows] == [("001", "Č, x", "true"), ("2", 'say "hi"', "false")]


def test_width_is_strict_unless_relaxed(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error type
        delimited.read_delimited(spark, path).collect()
    relaxed = delimited.read_delimited(spark, path, relaxed=True).collect()
    assert [tuple(r) for r in relaxed] == [("1", "2"), ("3", "4"), ("6", None)]


def test_ragged_file_issue(spark, tmp_path):
    path = write(tmp_path, "bad.csv", "id,mesto\n1,Ljubljana\n2,Maribor,extra\n")
    found = delimited.validate_delimited(spark, path)
    row = found.filter("code = 'INCONSISTENT_COLUMN_COUNT'").first()
    assert (row.row, row.severity, row.message) == (3, "error", "Row 3 has 3 columns; expected 2.")
    assert row.context == {"expected": "2", "actual": "3"}


def test_bad_headers(spark, tmp_path):
    path = write(tmp_path, "h.csv", "id,id,value,mostly_empty\n1,1,2,\n1,1,2,\n2,3,text,\n3,4,5,x\n")
    assert issues(delimited.validate_delimited(spark, path)) == [
        ("DUPLICATE_HEADER", 1, "id"),
        ("DUPLICATE_ROW", 3, None),
        ("MIXED_TYPES", None, "value"),
        ("NULL_HEAVY_COLUMN", None, "mostly_empty"),
    ]


def test_dates_and_formulas_in_a_file(spark, tmp_path):
    text = "date,value\n2026-01-01,=2+2\n2026-99-99,+cmd\n2026-01-02,-1\n2026-01-03,@SUM(A1)\n"
    found = issues(delimited.validate_delimited(spark, write(tmp_path, "d.csv", text)))
    assert ("INVALID_DATE", 3, "date") in found
    assert [f for f in found if f[0] == "FORMULA_LIKE_VALUE"] == [
        ("FORMULA_LIKE_VALUE", row, "value") for row in (2, 3, 4, 5)
    ]


def test_invalid_utf8_ends_the_check(spark, tmp_path):
    path = write(tmp_path, "e.csv", b"id,b\n1,\xff\xfe\n")
    assert issues(delimited.validate_delimited(spark, path)) == [("INVALID_ENCODING", None, None)]


@pytest.mark.parametrize(("encoding", "delimiter"), [("utf-16-le", "\t"), ("utf-16-be", ";")])
def test_utf16(spark, tmp_path, encoding, delimiter):
    mark = b"\xff\xfe" if encoding.endswith("le") else b"\xfe\xff"
    body = f"id{delimiter}name\n1{delimiter}Č\n"
    path = write(tmp_path, "u.txt", mark + body.encode(encoding))
    rows = delimited.read_delimited(spark, path, delimiter, encoding=encoding).collect()
    assert [tuple(r) for r in rows] == [("1", "Č")]


def test_typed_reading_keeps_null_apart_from_empty(spark, tmp_path):
    path = write(tmp_path, "n.csv", 'kind,value\na,\nb,""\n')
    rows = {r.kind: r.value for r in delimited.read_typed(spark, path).collect()}
    assert rows == {"a": None, "b": ""}
    codes = write(tmp_path, "c.csv", "code,n\n001,1\n")
    typed = delimited.read_typed(spark, codes, text=["code"])
    assert tuple(typed.first()) == ("001", 1)


def test_json_documents(spark, tmp_path):
    array = write(tmp_path, "a.json", '[{"id":1,"m":"x"},{"id":2}]')
    assert json_docs.read_json_document(spark, array).count() == 2
    single = write(tmp_path, "o.json", '{"id":1}')
    assert json_docs.read_json_document(spark, single).count() == 1
    scalars = write(tmp_path, "s.json", "[1, 2, 3]")
    assert [r.value for r in json_docs.read_json_document(spark, scalars).collect()] == ["1", "2", "3"]


def test_json_lines_problems(spark, tmp_path):
    path = write(tmp_path, "l.ndjson", '{"id":1}\n\nnot json\n{"id":2,"pad":"xxxxxxxxxxxxxxxxxxxx"}\n')
    found = json_docs.scan_json_lines(spark, path, "id int", max_record_bytes=30).collect()
    assert sorted((r.record.id if r.record else None, r.problem) for r in found if r.record) == [(1, None)]
    assert {r.problem for r in found} == {None, "INVALID_NDJSON", "RECORD_TOO_LARGE"}


def test_json_looking_text_stays_text(spark):
    frame = spark.createDataFrame([("null", "[1]"), ("true", "2")], "t string, j string")
    decoded = json_docs.json_columns_to_variant(frame, ["j"])
    assert [r.t for r in decoded.collect()] == ["null", "true"]
    assert decoded.schema["j"].dataType.typeName() == "variant"


def test_header_plan():
    plan = headers.plan_header(["a", "", "a", None], width=6)
    assert plan.names == ["a", "column_2", "a_2", "column_4", "extra_column_5", "extra_column_6"]
    assert plan.blank == [2, 4] and plan.repeated == [(3, "a")]


def test_text_row_numbers_over_several_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).write_text("".join(f"{name}{i:03d}\n" for i in range(50)))
    lines = spark.read.text(str(tmp_path)).select("value", "_metadata")
    numbered = positions.number_text_rows(lines, start=0).orderBy("row").collect()
    assert [r.value for r in numbered] == [f"{n}{i:03d}" for n in "abc" for i in range(50)]
    assert [r.row for r in numbered] == list(range(150))


STATIONS = """<?xml version="1.0"?>
<a:root xmlns:a="urn:a"><a:meta><a:made>x</a:made></a:meta>
<a:station id="1"><a:pm10> 12 </a:pm10><a:pos><a:lat unit="deg">46</a:lat></a:pos></a:station>
<a:station id="2"><a:pm10>7</a:pm10><a:pm10>8</a:pm10><a:gap> </a:gap></a:station></a:root>"""


def documents(spark, *texts, path=None):
    rows = [(f"d{i}", t, path) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document string, xml string, record_path string")


def test_record_path_is_found(spark):
    paths = xml_records.element_paths(documents(spark, STATIONS))
    assert xml_records.record_paths(paths).first().record_path == "/a:root/a:station"


def test_records_are_flat(spark):
    given = documents(spark, STATIONS, path="/a:root/a:station")
    rows = xml_records.xml_records(given).orderBy("record").collect()
    assert rows[0].fields == {"@id": ["1"], "a:pm10": ["12"], "a:pos/a:lat": ["46"], "a:pos/a:lat/@unit": ["deg"]}
    assert rows[1].fields == {"@id": ["2"], "a:pm10": ["7", "8"]}
    shown = xml_records.record_columns(xml_records.xml_records(given), ["@id", "a:pm10"])
    assert sorted(r["a:pm10"] for r in shown.collect()) == ["12", '["7","8"]']


def test_tie_and_broken_documents(spark):
    tie = "<root><a><x/></a><a><x/></a><b><y/></b><b><y/></b></root>"
    paths = xml_records.element_paths(documents(spark, tie, "<root><a>"))
    found = {r.document: (r.candidates, r.record_path) for r in xml_records.record_paths(paths).collect()}
    assert found == {"d0": (2, None)}
    assert paths.filter("error IS NOT NULL").count() == 1
    bomb = '<!DOCTYPE r [<!ENTITY e "x">]><r><a><b/></a><a><b/></a></r>'
    assert xml_records.element_paths(documents(spark, bomb)).first().error is not None


def zipped(**entries):
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as made:
        for name, body in entries.items():
            made.writestr(name, body)
    return bytearray(target.getvalue())


def test_archive_outcomes(spark):
    cases = {
        "one": (zipped(**{"a/data.csv": "x", "readme.md": "y"}), "selected"),
        "two": (zipped(**{"a.csv": "x", "b.json": "[]"}), "ARCHIVE_ENTRY_REQUIRED"),
        "none": (zipped(**{"readme.md": "y"}), "ARCHIVE_NO_SUPPORTED_ENTRY"),
        "up": (zipped(**{"../a.csv": "x"}), "UNSAFE_ARCHIVE_ENTRY"),
        "abs": (zipped(**{"/etc/a.csv": "x"}), "UNSAFE_ARCHIVE_ENTRY"),
        "drive": (zipped(**{"C:\\a.csv": "x"}), "UNSAFE_ARCHIVE_ENTRY"),
        "inner": (zipped(**{"a.csv": "x", "b.zip": "z"}), "UNSAFE_ARCHIVE_ENTRY"),
        "bomb": (zipped(**{"a.csv": "0" * 500_000}), "ARCHIVE_LIMIT_EXCEEDED"),
        "broken": (bytearray(b"PK\x03\x04rest"), "INVALID_ARCHIVE_DATA"),
    }
    frame = spark.createDataFrame([(k, c) for k, (c, _) in cases.items()], "archive string, content binary")
    chosen = archives.choose_entry(archives.archive_entries(frame))
    assert {r.archive: r.outcome for r in chosen.collect()} == {k: o for k, (_, o) in cases.items()}
    extracted = archives.extract_entries(frame, chosen).collect()
    assert [(r.archive, r.entry, bytes(r.content)) for r in extracted] == [("one", "a/data.csv", b"x")]


CASES = [
    ("a.bin", b"PAR1....PAR1", None, None, ("parquet", "signature", None, None)),
    ("a.csv", zipped(**{"x.csv": "1"}), None, None, ("zip", "signature", None, None)),
    ("a.zip", zipped(**{"xl/workbook.xml": "<x/>", "[Content_Types].xml": "<x/>"}), None, None, ("xlsx", "signature", None, None)),
    ("a.txt", b'{"a":1}\n{"a":2}\n', None, None, ("ndjson", "content", "utf-8", None)),
    ("a.txt", b'[{"a":1}', None, None, ("json", "content", "utf-8", None)),
    ("a.json", b'{"a":', None, None, ("json", "content", "utf-8", None)),
    ("a.txt", b"  <root/>", None, None, ("xml", "content", "utf-8", None)),
    ("a.csv", b"a\tb\n1\t2\n", None, None, ("tsv", "content", "utf-8", "\t")),
    ("a.csv", b"a;b;c,d\n1;2;3,4\n", None, None, ("csv", "content", "utf-8", ";")),
    ("a.x", b"a|b\n1|2\n", None, None, ("csv", "content", "utf-8", "|")),
    ("a.x", b"a,b\n1,2\n", "text/tab-separated-values", None, ("csv", "content", "utf-8", ",")),
    ("a.x", b"plain", "application/json; charset=utf-8", None, ("json", "media-type", "utf-8", None)),
    ("a.x", b"plain", None, ".JSONL", ("ndjson", "declared-format", None, None)),
    ("a.parquet", b"plain", None, None, ("parquet", "extension", None, None)),
    ("a.x", b"plain", None, None, ("unknown", "unknown", None, None)),
    ("a.px", b"plain", None, None, ("pcaxis", "extension", None, None)),
    ("a.txt", b'CHARSET="ANSI";\nAXIS-VERSION="2000";\nX="1";', None, None, ("pcaxis", "content", None, None)),
    ("a.txt", b'CODEPAGE="utf-8";MATRIX="a;b";STUB="x";VALUES("x")="1";DATA=1;', None, None, ("pcaxis", "content", None, None)),
    ("a.x", "a,b\n1,2\n".encode("utf-16"), None, None, ("csv", "content", "utf-16le", ",")),
    ("a.csv", b"a,b\n1,\xff\n", None, None, ("csv", "extension", None, None)),
]


@pytest.mark.parametrize("case", CASES, ids=[str(i) for i in range(len(CASES))])
def test_detection(spark, case):
    name, content, media, declared, expected = case
    frame = spark.createDataFrame(
        [(f"/x/{name}", bytearray(content), media, declared)],
        "path string, content binary, media_type string, declared string",
    )
    found = inventory.detect(frame).first()
    assert (found.format, found.confidence, found.encoding, found.delimiter) == expected


def test_convert_keeps_values_and_records(spark, tmp_path):
    rows = [("Ljubljana", 1.5, None, True), ("=x", 2.0, "", False)]
    frame = spark.createDataFrame(rows, "obcina string, vrednost double, opomba string, aktivna boolean")
    for target in ("csv", "tsv", "ndjson", "parquet"):
        path = str(tmp_path / target)
        records = lineage.convert(
            frame, path, target, source_format="json", source_sha256="0" * 64, spreadsheet=target == "csv"
        )
        outcome = lineage.verify(lineage.file_digests(spark, path, "part-*"), records)
        assert {r.outcome for r in outcome.collect()} == {"verified"}
        assert lineage.record_violations(records).count() == 0
    back = delimited.read_typed(spark, str(tmp_path / "csv")).orderBy("vrednost").collect()
    assert [tuple(r) for r in back] == [("Ljubljana", 1.5, None, True), ("'=x", 2.0, "", False)]
    again = spark.read.parquet(str(tmp_path / "parquet")).orderBy("vrednost").collect()
    assert [tuple(r) for r in again] == rows
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error type
        export.write_table(frame, str(tmp_path / "csv"), "csv")
    export.write_table(frame, str(tmp_path / "csv"), "csv", force=True)


def test_nested_values_become_json_text(spark):
    frame = spark.createDataFrame([(1, [1, 2], {"a": 'x"y'})], "id int, l array<int>, m map<string,string>")
    line = export.delimited_lines(frame).first().line
    assert line == '1,"[1,2]","{""a"":""x\\""y""}"'


def test_empty_input_is_an_error(spark):
    with pytest.raises(DataError):
        export.require_rows(spark.createDataFrame([], "a int"))


def test_table_digest_depends_on_content_only(spark):
    files = spark.createDataFrame([("a", 1, "00"), ("b", 2, "ff")], "path string, bytes bigint, sha256 string")
    renamed = files.withColumn("path", F.lit("z"))
    assert lineage.table_digest(files).first() == lineage.table_digest(renamed).first()
