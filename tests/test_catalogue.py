"""Catalogue, snapshot, retention, lineage, selection and presentation rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.functions import geo, text
from sievetable.operators import (
    catalogue,
    lineage,
    presentation,
    retention,
    selection,
    skew,
    snapshot,
    workbench,
)

PACKAGE = {
    "id": "d1",
    "name": "one",
    "title": "One",
    "notes": "",
    "license_id": "cc",
    "license_title": "",
    "tags": [{"name": "a"}, {"name": "b"}],
    "num_resources": 9,
    "unknown": {"kept": True},
    "resources": [
        {"id": "r1", "name": "", "url": "https://x.test/a.csv", "format": "CSV", "size": 12},
        {"id": "r2", "name": "Two", "url": "https://x.test/api/v1", "format": "JSON", "size": "big"},
    ],
}


def test_package_mapping(spark):
    raw = spark.createDataFrame([(json.dumps(PACKAGE),)], "value string")
    packages = catalogue.read_packages(raw)
    dataset = catalogue.map_datasets(packages, "portal").first()
    assert (dataset.description, dataset.license, dataset.resource_count) == (None, "cc", 2)
    assert dataset.reference == "portal:dataset:d1" and dataset.organization is None
    assert json.loads(dataset.raw)["unknown"] == {"kept": True}
    resources = catalogue.map_resources(packages, "portal").orderBy("place").collect()
    assert [(r.title, r.size_bytes) for r in resources] == [("r1", 12), ("Two", None)]


@pytest.mark.parametrize(
    ("form", "media", "url", "raw", "kind"),
    [
        ("HTML", "text/html", "https://example.test/file", None, "page"),
        ("JSON", "application/json", "https://example.test/api", None, "api"),
        ("ZIP", "application/zip", "https://example.test/file", None, "archive"),
        ("WMS", "application/xml", "https://example.test/file", None, "service"),
        ("CSV", None, "https://example.test/a.csv?x=a.zip", None, "file"),
        (None, None, "https://example.test/A.ZIP", None, "archive"),
        (None, None, "not a url", "Web Service", "service"),
        ("CSV", None, "https://example.test/apis/x", None, "file"),
    ],
)
def test_resource_kind(spark, form, media, url, raw, kind):
    frame = spark.createDataFrame(
        [(form, media, url, raw)], "format string, media_type string, url string, resource_type string"
    )
    assert frame.select(catalogue.resource_kind()).first()[0] == kind


@pytest.mark.parametrize(
    ("reference", "parsed"),
    [
        ("portal:dataset:a:b", ("portal", "dataset", "a:b")),
        ("portal:resource:x", ("portal", "resource", "x")),
        ("local:file:/a b", ("local", "file", "/a b")),
        ("local:dataset:x", None),
        ("portal:file:x", None),
        ("portal:dataset: ", None),
        (":dataset:x", None),
        ("portal::x", None),
        ("portal", None),
    ],
)
def test_references(spark, reference, parsed):
    found = spark.range(1).select(catalogue.parse_reference(F.lit(reference)).alias("p")).first().p
    assert (None if found is None else tuple(found)) == parsed


def test_unknown_filter_and_sort_are_errors(spark):
    frame = spark.range(1)
    with pytest.raises(DataError):
        catalogue.search(frame, filters={"colour": "red"})
    for sort in ([("relevance", "asc")], [("id", "asc")], [("title", "up")]):
        with pytest.raises(DataError):
            catalogue.sort_columns(sort)


@pytest.mark.parametrize(
    ("url", "shown"),
    [
        ("https://u:p@Host.test/a?token=1&b=2#f", "https://Host.test/a?token=REDACTED&b=2#f"),
        ("https://x.test", "https://x.test/"),
        ("https://x.test?API-KEY=1", "https://x.test/?API-KEY=REDACTED"),
        ("https://x.test/?mytoken=1&sig", "https://x.test/?mytoken=1&sig=REDACTED"),
        ("nope", text.INVALID_URL_MARKER),
        (None, text.INVALID_URL_MARKER),
    ],
)
def test_redaction(spark, url, shown):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(text.redact_url(F.col("u"))).first()[0] == shown


def test_escaping(spark):
    frame = spark.createDataFrame([("a‮b\x07",), ("plain",), (None,)], "t string")
    shown = [r[0] for r in frame.select(text.escape_text(F.col("t"))).collect()]
    assert shown == ["a\\u202eb\\u0007", "plain", ""]


def test_natural_order(spark):
    names = ["a10", "a2", "b1", "A1", "a02", "1", "10", "9"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    found = [r.n for r in selection.natural_sort(frame, "n").collect()]
    assert found[:3] == ["1", "9", "10"] and found[3] == "A1" and found[-2:] == ["a10", "b1"]


GEOMETRIES = [
    ('{"type":"Point","coordinates":[14.5,46]}', True),
    ('{"type":"Point","coordinates":[181,46]}', False),
    ('{"type":"Point","coordinates":[14.5]}', False),
    ('{"type":"Point","coordinates":[14.5,"46"]}', False),
    ('{"type":"Point","coordinates":[14.5,null]}', False),
    ('{"type":"Point","coordinates":[1,2],"x":1}', False),
    ('{"type":"LineString","coordinates":[[1,2],[3,4]]}', True),
    ('{"type":"LineString","coordinates":[[1,2]]}', False),
    ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', True),
    ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}', False),
    ('{"type":"Polygon","coordinates":[]}', False),
    ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}', True),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}', True),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,99]}]}', False),
    ('{"type":"GeometryCollection","geometries":[]}', True),
    ('{"type":"Circle","coordinates":[1,2]}', False),
    ("not json", False),
    (None, False),
]


def test_geometries(spark):
    frame = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(GEOMETRIES)], "i int, g string")
    checked = frame.select("i", geo.valid_geometry(F.col("g"), "EPSG:4326").alias("ok"))
    assert [r.ok for r in checked.orderBy("i").collect()] == [ok for _, ok in GEOMETRIES]


def test_metres_have_no_range(spark):
    geometry = F.lit('{"type":"Point","coordinates":[460000,100000]}')
    assert spark.range(1).select(geo.valid_geometry(geometry, "EPSG:3794")).first()[0] is True


def test_retention_matches_the_step_by_step_rule(spark):
    source = random.Random(3)
    entries = []
    for i in range(300):
        sha = source.randint(0, 80)
        entries.append((f"k{i:04d}", f"s{sha}", sha + 1, source.randint(0, 20), source.randint(0, 9), source.randint(0, 9)))
    frame = spark.createDataFrame(
        entries, "key string, sha256 string, bytes bigint, expires_at int, last_used_at int, created_at int"
    )
    live = sorted((e for e in entries if e[3] > 5), key=lambda e: (e[4], e[5], e[0]))
    references, total = {}, sum({e[1]: e[2] for e in live}.values())
    for e in live:
        references[e[1]] = references.get(e[1], 0) + 1
    expected = {e[0]: "expired" for e in entries if e[3] <= 5}
    for e in live:
        if total <= 1500:
            expected[e[0]] = "kept"
            continue
        expected[e[0]] = "evicted"
        references[e[1]] -= 1
        if references[e[1]] == 0:
            total -= e[2]
    plan = retention.retention_plan(frame, F.lit(5), 1500)
    assert {r.key: r.outcome for r in plan.collect()} == expected


def test_snapshot_checks(spark):
    rows = [(0, "b", "B", "n1"), (1, "a", "A", "n2"), (2, "a", "A", "n0"), (3, "c", "", "n3")]
    items = spark.createDataFrame(rows, "position bigint, id string, title string, name string")
    assert [r.position for r in snapshot.order_violations(items).collect()] == [2]
    verdict = snapshot.snapshot_verdict(items, 4).first()
    assert (verdict.blank, verdict.duplicate_ids, verdict.order_violations, verdict.valid) == (1, 1, 1, False)


def test_freshness_edges(spark):
    now = F.to_timestamp(F.lit("2026-01-02T00:00:00Z"))
    cases = {
        "2026-01-01T00:00:00Z": "fresh",
        "2025-12-31T23:59:59Z": "stale",
        "2026-01-02T00:05:00Z": "fresh",
        "2026-01-02T00:05:01Z": "invalid",
        "2026-01-01": "invalid",
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    found = frame.select("t", snapshot.freshness(F.col("t"), now).alias("s")).collect()
    assert {r.t: r.s for r in found} == cases


def test_count_guard(spark):
    runs = spark.createDataFrame(
        [("c", 1, 100, False), ("c", 2, 90, False), ("c", 3, 80, False), ("c", 4, 10, True)],
        "catalogue string, run int, count bigint, allow_reduction boolean",
    )
    assert [r.run for r in snapshot.count_reductions(runs).collect()] == [3]


def test_salted_join_is_whole_with_a_hot_key(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50)
    large = spark.range(9000).select(key.alias("k"), "id")
    small = large.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.salted_join(large, small, ["k"], "n", hot_weight=1000)
    expected = large.join(small, "k")
    assert joined.count() == expected.count() == 9000
    spread = skew.salted_join(large, small, ["k"], "n", hot_weight=10, spread_by=["id"])
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        placed = spread.withColumn("p", F.spark_partition_id()).filter("k = -1")
        hot = placed.select("p").distinct().count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert hot > 1
    assert joined.select("k", "id", "n").exceptAll(expected.select("k", "id", "n")).count() == 0


def test_quantiles_match_sorted_values(spark):
    source = random.Random(9)
    values = [source.choice([1.5, source.uniform(0, 100)]) for _ in range(1001)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = {r.share: r.quantile for r in workbench.quantile_table(frame, "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    ordered = sorted(values)
    assert found == {0.0: ordered[0], 0.1: ordered[100], 0.5: ordered[500], 1.0: ordered[1000]}


def test_reduction_chain(spark):
    reductions = spark.createDataFrame(
        [("a", 0, "f", 100, 50), ("a", 1, "g", 50, 10), ("b", 0, "f", 9, 9), ("c", 0, "f", 9, 5), ("c", 1, "g", 6, 1)],
        "presentation string, step bigint, method string, original_rows bigint, presented_rows bigint",
    )
    totals = spark.createDataFrame(
        [("a", 100, 10), ("b", 9, 9), ("c", 9, 1), ("d", 5, 4), ("e", 4, 4)],
        "presentation string, original_rows bigint, presented_rows bigint",
    )
    found = {(r.presentation, r.problem) for r in presentation.chain_problems(reductions, totals).collect()}
    assert found == {("b", "NOT_A_REDUCTION"), ("c", "CHAIN_BROKEN"), ("d", "REDUCTION_UNDISCLOSED")}


def test_excluded_rows_are_disclosed(spark):
    reductions = spark.createDataFrame(
        [("a", ["off map"], 10, 7), ("a", [], 7, 5), ("b", ["off map"], 10, 7)],
        "presentation string, exclusions array<string>, original_rows bigint, presented_rows bigint",
    )
    excluded = spark.createDataFrame([("a", 3), ("b", 2), ("c", 0)], "presentation string, excluded_records bigint")
    found = presentation.exclusions_disclosed(reductions, excluded).collect()
    assert {r.presentation: r.agrees for r in found} == {"a": True, "b": False, "c": True}


def test_selection_checks(spark):
    frame = spark.createDataFrame([(1, "a", 1.0, 2.0)], "id int, n string, x double, y double")
    with pytest.raises(DataError):
        selection.select_features(frame, properties=["missing"])
    with pytest.raises(DataError):
        selection.select_features(frame, filters={"missing": 1})
    with pytest.raises(DataError):
        selection.bounding_box("x", "y", (0, 0, float("nan"), 1))
    with pytest.raises(DataError):
        selection.parse_equality(["=x"])
    assert selection.parse_equality(["a=TRUE", "b=-2", "c=.5", "d=x=y"]) == {"a": True, "b": -2, "c": 0.5, "d": "x=y"}
    assert selection.project(frame, ["id", "gap"]).first().gap is None


def test_snapshot_list_has_three_fields(spark):
    frame = spark.createDataFrame([("i", "t", "n", "x")], "id string, title string, name string, other string")
    assert tuple(catalogue.listed_fields(frame).first()) == ("i", "t", "n")
    with pytest.raises(DataError):
        catalogue.listed_fields(frame, ["id", "other"])


def test_preview_flags_more_rows(spark):
    frame = spark.range(21)
    page = selection.preview(frame, 20, ["id"])
    assert page.rows.count() == 20 and page.truncated.first().truncated
    assert not selection.preview(frame, 21, ["id"]).truncated.first().truncated
    with pytest.raises(DataError):
        selection.preview(frame, 0)


def test_record_rules(spark):
    good = lineage.provenance_records(
        spark.createDataFrame([("p", 1, "a" * 64)], "path string, bytes bigint, sha256 string"),
        "convert",
        timestamp=F.current_timestamp(),
        input_sha256=F.lit(None).cast("string"),
        media_type="text/csv",
        details={},
    )
    assert lineage.record_violations(good).count() == 0
    bad = good.withColumns({"bytes": F.lit(-1).cast("bigint"), "sha256": F.lit("A" * 64)})
    assert {r.rule for r in lineage.record_violations(bad).collect()} == {"bytes", "sha256"}
