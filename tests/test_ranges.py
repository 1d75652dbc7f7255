"""Edges and digests of files, read by offset."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievetable.operators import lineage
from sievetable.sources import inventory, ranges, tables

MIB = 1 << 20


@pytest.mark.parametrize("reach", [True, False])
@pytest.mark.parametrize("size", [3 * MIB, 66 * MIB])
def test_evidence_is_the_same_at_every_size(spark, tmp_path, monkeypatch, size, reach):
    monkeypatch.setattr(ranges, "reachable", lambda files: reach)
    wide = b"\xff\xfe" + "id,name\r\n1,Č\r\n".encode("utf-16-le") + "2,b\r\n".encode("utf-16-le") * (size // 10)
    (tmp_path / "wide data").write_bytes(wide)
    noise = os.urandom(size)
    pq.write_table(pa.table({"b": [noise]}), tmp_path / "columns", compression="none")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as archive:
        archive.writestr("xl/media/a.bin", noise)
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("xl/workbook.xml", "<workbook/>")
    (tmp_path / "book").write_bytes(book.getvalue())
    (tmp_path / "plain.zip").write_bytes(book.getvalue()[: size // 2])
    (tmp_path / "empty.csv").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[-1]: r for r in inventory.detect(inventory.read_heads(spark, str(tmp_path))).collect()}
    told = {name: (r.format, r.encoding, r.delimiter, r.header) for name, r in found.items()}
    assert told == {
        "wide data": ("csv", "utf-16le", ",", "id,name"),
        "columns": ("parquet", None, None, None),
        "book": ("xlsx", None, None, None),
        "plain.zip": ("zip", None, None, None),
    }
    assert {r.bytes for r in found.values()} >= {len(wide), len(book.getvalue())}


@pytest.mark.parametrize("length", [0, 1, 2 * ranges.EDGE_BYTES, 2 * ranges.EDGE_BYTES + 1, 300_000])
def test_edges(tmp_path, length):
    data = os.urandom(length)
    (tmp_path / "f").write_bytes(data)
    n = ranges.EDGE_BYTES
    assert ranges.edges(f"file:{tmp_path}/f", length) == (data if length <= 2 * n else data[:n] + data[-n:])
    assert ranges.digest(f"file:///{tmp_path}/f") == hashlib.sha256(data).hexdigest()


def test_digests_without_content(spark, tmp_path):
    for name, size in (("a", 0), ("b", 10), ("c d%20é", 9 * MIB)):
        (tmp_path / name).write_bytes(os.urandom(size))
    frame = lineage.file_digests(spark, str(tmp_path))
    assert "ReadSchema: struct<path:string,length:bigint>" in frame._jdf.queryExecution().executedPlan().toString()
    found = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.sha256) for r in frame.collect()}
    expected = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    assert found == expected


@pytest.mark.parametrize("reach", [True, False])
def test_digests_of_empty_files(spark, tmp_path, monkeypatch, reach):
    """They have a digest wherever they lie, are matched by name, and change the digest of their folder."""
    monkeypatch.setattr(ranges, "reachable", lambda files: reach)
    names = ["part-0", "in here%20č/part-1", "in here%20č/other", "in here%20č/_hidden"]
    (tmp_path / "in here%20č").mkdir()
    for name in names:
        (tmp_path / name).write_bytes(b"")

    def found(pattern):
        return sorted((r.path, r.bytes, r.sha256) for r in lineage.file_digests(spark, str(tmp_path), pattern).collect())

    def entry(name):
        data = (tmp_path / name).read_bytes()
        return f"file:{tmp_path}/{name}", len(data), hashlib.sha256(data).hexdigest()

    assert found("*") == sorted(map(entry, names[:3]))
    (tmp_path / "part 2").write_bytes(b"x")
    assert found("part*") == sorted(map(entry, [*names[:2], "part 2"]))
    before = lineage.table_digest(lineage.file_digests(spark, str(tmp_path))).first()
    (tmp_path / "more").write_bytes(b"")
    after = lineage.table_digest(lineage.file_digests(spark, str(tmp_path))).first()
    assert (before.bytes, after.bytes) == (1, 1) and before.sha256 != after.sha256


@pytest.mark.parametrize(
    "path, parts",
    [("file:/a/b c", ("file://", "/a/b c")), ("file:///a", ("file://", "/a")), ("/a:/b", ("", "/a:/b")),
     ("hdfs://h:1/a/b", ("hdfs://h:1", "/a/b")), ("s3a://k/a/b", ("s3://k", "k/a/b")), ("viewfs://x/a", ("viewfs://x", "/a"))],
)
def test_paths_in_stores(path, parts):
    assert ranges.located(path) == parts


def test_every_file_with_the_other_extension_is_counted(spark, tmp_path):
    for number, name in enumerate(["a.csv", "b.tsv", "c.tsv"]):
        (tmp_path / name).write_text(f"id,n\n{number},2\n{number},3\n")
    found = tables.validate_path(spark, str(tmp_path)).filter("code = 'DELIMITER_MISMATCH'").collect()
    assert [r.occurrences for r in found] == [2]
