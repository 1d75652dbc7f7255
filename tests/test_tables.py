"""Opening, validating and converting paths of any format."""

from __future__ import annotations

import pytest

from sievetable.errors import DataError
from sievetable.operators import export
from sievetable.plans import paths
from sievetable.sources import tables
from tests.test_cubes import PLACES
from tests.test_sources import STATIONS, write


def test_each_format_opens(spark, tmp_path):
    cases = {
        "a.csv": ("id;m\n1;Č\n2;b\n", "csv", 2),
        "a.tsv": ("id\tm\n1\tx\n2\ty\n", "tsv", 2),
        "a.json": ('[{"id":1},{"id":2}]', "json", 2),
        "a.ndjson": ('{"id":1}\n{"id":2}\n', "ndjson", 2),
        "a.xml": (STATIONS, "xml", 2),
        "a.px": (PLACES.encode("cp1250"), "pcaxis", 4),
    }
    for name, (content, form, rows) in cases.items():
        opened = tables.open_table(spark, write(tmp_path, name, content))
        assert (opened.format, opened.table.count()) == (form, rows)


def test_cube_columns(spark, tmp_path):
    opened = tables.open_table(spark, write(tmp_path, "a.px", PLACES.encode("cp1250")))
    assert opened.table.columns == ["Kraj", "Kraj__code", "Leto", "Leto__code", "value", "value__symbol"]
    assert opened.code_columns == ["Kraj__code", "Leto__code"]


def test_unknown_format_is_an_error(spark, tmp_path):
    with pytest.raises(DataError) as caught:
        tables.open_table(spark, write(tmp_path, "a.bin", "plain"))
    assert caught.value.code == "UNSUPPORTED_FORMAT"


def test_validation_by_format(spark, tmp_path):
    def codes(name, content):
        found = tables.validate_path(spark, write(tmp_path, name, content))
        return sorted((r.code, r.row) for r in found.collect())

    assert codes("m.tsv", "a,b\n=x,1\n") == [("DELIMITER_MISMATCH", None), ("FORMULA_LIKE_VALUE", 2)]
    repeated = '{"v":"=x","d":"2026-99-99"}\n' * 5
    assert codes("r.ndjson", repeated) == [
        ("DUPLICATE_ROW", 3),
        ("FORMULA_LIKE_VALUE", 2),
        ("INVALID_DATE", 2),
    ]
    px = codes("p.px", PLACES.encode("cp1250"))
    assert [c for c, _ in px].count("PCAXIS_DATA_SYMBOL") == 2


def test_parquet_rows_keep_their_places(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    frame = spark.range(1000).selectExpr("id % 600 AS id", "if(id = 700, '=x', 'y') AS s")
    frame.coalesce(1).write.parquet(path)
    found = tables.validate_path(spark, path)
    rows = {(r.code, r.row, r.occurrences) for r in found.collect()}
    assert ("FORMULA_LIKE_VALUE", 702, 1) in rows
    assert len([r for r in rows if r[0] == "DUPLICATE_ROW"]) == 399


def test_conversion_of_a_path(spark, tmp_path):
    source = write(tmp_path, "a.csv", "id,m\n1,=x\n2,b\n")
    output = str(tmp_path / "out")
    records = tables.convert_path(spark, source, output, "ndjson", spreadsheet=True)
    assert spark.read.json(output).orderBy("id").first().m == "'=x"
    step = records.first().transformations[0]
    assert step.operation == "convert" and step.details["spreadsheetSafeChanges"] == "1"
    assert len(step.inputSha256) == 64


def test_ndjson_beyond_the_sample_keeps_its_rows(spark, tmp_path):
    lines = "".join(f'{{"id":{i},"t":"{"x" * 40}"}}\n' for i in range(3000))
    for name in ("long.ndjson", "long.txt"):
        opened = tables.open_table(spark, write(tmp_path, name, lines))
        assert (opened.format, opened.table.count()) == ("ndjson", 3000)


def test_a_character_on_the_edge_of_the_sample(spark, tmp_path):
    start = "a,b\n" + "x,y\n" * 16383
    text = start[: 64 * 1024 - 1] + "é,z\n" + "x,y\n" * 10
    assert len(start[: 64 * 1024 - 1].encode()) == 64 * 1024 - 1
    found = tables.detect_path(spark, write(tmp_path, "edge.csv", text.encode()))
    assert found.format == "csv" and found.delimiter == ","


def test_one_broken_json_line_is_an_issue(spark, tmp_path):
    text = "".join(f'{{"id":{i}}}\n' for i in range(550)) + "{broken\n"
    found = tables.validate_path(spark, write(tmp_path, "late.ndjson", text)).collect()
    errors = [(r.code, r.row, r.severity) for r in found if r.code == "PARSE_ERROR"]
    assert errors == [("PARSE_ERROR", 552, "error")]


def test_rows_of_json_follow_the_file(spark, tmp_path):
    lines = '{"v":"b"}\n\n{"v":"=x"}\n{"v":"a"}\n{"v":"b"}\n'
    found = {(r.code, r.row) for r in tables.validate_path(spark, write(tmp_path, "o.ndjson", lines)).collect()}
    assert {("FORMULA_LIKE_VALUE", 3), ("DUPLICATE_ROW", 5)} <= found
    document = '[{"v":"b"},{"v":"=x"},{"v":"a"},{"v":"b"}]'
    found = {(r.code, r.row) for r in tables.validate_path(spark, write(tmp_path, "o.json", document)).collect()}
    assert {("FORMULA_LIKE_VALUE", 3), ("DUPLICATE_ROW", 5)} <= found


def test_folders_of_different_files_are_refused(spark, tmp_path):
    cases = {
        "MIXED_FORMATS": {"a.csv": "id,n\n1,2\n3,4\n", "b.json": '[{"id":1}]'},
        "MIXED_HEADERS": {"a.csv": "id,name\n1,x\n2,y\n", "b.csv": "name,id\nx,1\ny,2\n"},
    }
    for code, files in cases.items():
        folder = tmp_path / code
        folder.mkdir()
        for name, content in files.items():
            (folder / name).write_text(content)
        with pytest.raises(DataError) as caught:
            tables.open_table(spark, str(folder))
        assert caught.value.code == code


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'id,t\n1,"a\nb"\n2,"c ""d""\n\n"\n3,e\n')
    assert [r.t for r in tables.open_table(spark, path).table.orderBy("id").collect()] == ["a\nb", 'c "d"\n\n', "e"]
    assert tables.validate_path(spark, path).count() == 0


def test_bad_cubes_are_refused(spark, tmp_path):
    good = 'CHARSET="ANSI";CODEPAGE="windows-1250";MATRIX="m";STUB="a";VALUES("a")="x","y";DATA=\n1 2;'
    cases = {
        "cell.px": (good.replace("1 2", "1 x"), "INVALID_PCAXIS_DATA"),
        "values.px": (good.replace('STUB="a"', 'STUB="a","z"'), "INVALID_PCAXIS_DATA"),
        "list.px": (
            good.replace(";DATA", ';LANGUAGES="sl","en";STUB[en]="b";VALUES[en]("b")="only";DATA'),
            "INVALID_PCAXIS_DATA",
        ),
    }
    for name, (content, code) in cases.items():
        with pytest.raises(DataError) as caught:
            tables.open_table(spark, write(tmp_path, name, content))
        assert caught.value.code == code
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.px").write_text(good)
    (folder / "b.px").write_text(good.replace('STUB="a"', 'STUB="b"').replace('VALUES("a")', 'VALUES("b")'))
    with pytest.raises(DataError) as caught:
        tables.open_table(spark, str(folder))
    assert caught.value.code == "MIXED_CUBES"


def test_broken_xml_is_one_error(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "a.xml").write_text("<r><i><v>=1</v></i><i><v>2</v></i></r>")
    (folder / "b.xml").write_text("<r><i><v>1</v></i><i>")
    wide = '<?xml version="1.0" encoding="windows-1250"?><r><i><v>Č</v></i><i><v>ž</v></i></r>'
    (folder / "c.xml").write_bytes(wide.encode("cp1250"))
    found = [(r.code, r.row) for r in tables.validate_path(spark, str(folder), record_path="/r/i").collect()]
    assert sorted(c for c, _ in found) == ["FORMULA_LIKE_VALUE", "MIXED_TYPES", "PARSE_ERROR"]
    with pytest.raises(DataError) as caught:
        tables.open_table(spark, str(folder), record_path="/r/i")
    assert caught.value.code == "INVALID_XML"


def test_a_map_column_is_validated(spark):
    from sievetable.operators import quality

    frame = spark.createDataFrame([({"a": 1}, "x"), ({"a": 1}, "x")], "m map<string,int>, s string")
    assert [r.code for r in quality.validate(frame).collect()] == ["DUPLICATE_ROW"]


@pytest.mark.parametrize("header", ["id,name", "id;name"])
def test_header_without_rows_goes_with_the_other_files(spark, tmp_path, header):
    mark = header[2]
    (tmp_path / "part-0.csv").write_text(f"{header}\n")
    (tmp_path / "part-1.csv").write_text(f"{header}\n1{mark}x\n2{mark}y\n")
    found = tables.detect_path(spark, str(tmp_path))
    assert (found.format, found.delimiter, found.encoding, found.header) == ("csv", mark, "utf-8", header)
    assert sorted(map(tuple, tables.open_table(spark, str(tmp_path)).table.collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "part-2.csv").write_text("other\n")
    with pytest.raises(DataError, match="different headers"):
        tables.detect_path(spark, str(tmp_path))


def test_schema_of_a_table_whose_first_partition_is_empty(spark, tmp_path):
    rows = spark.range(20, numPartitions=4).filter("id >= 5").selectExpr("id", "concat('n', id) AS name")
    export.write_table(rows, str(tmp_path / "t"), "csv")
    found = {r.name: (r.type, r.sampled_rows) for r in paths.schema_path(spark, str(tmp_path / "t")).collect()}
    assert found == {"id": ("integer", 15), "name": ("string", 15)}
