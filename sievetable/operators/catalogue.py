"""Dataset catalogues: mapping, references, search, kinds, metadata issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.functions.text import is_http_url, url_path
from sievetable.messages import DATASET_ISSUES, RESOURCE_ISSUES
from sievetable.operators.skew import salted_join

PACKAGE_SCHEMA = """
    id string, name string, title string, notes string, metadata_modified string,
    license_id string, license_title string, num_resources bigint,
    organization struct<id: string, name: string, title: string, description: string>,
    tags array<struct<name: string>>,
    resources array<struct<id: string, package_id: string, name: string, description: string,
      url: string, format: string, mimetype: string, size: string, last_modified: string,
      resource_type: string>>
"""
LIST_FIELDS = ("id", "title", "name")
SORT_FIELDS = ("relevance", "metadata_created", "metadata_modified", "name", "title")
MAX_ALL_RESULTS = 10_000

# Formats and media types that hold a table.
TABULAR_FORMATS = (
    "csv",
    "tsv",
    "json",
    "jsonl",
    "ndjson",
    "xlsx",
    "parquet",
    "xml",
    "zip",
)
TABULAR_MEDIA_TYPES = (
    "text/csv",
    "text/tab-separated-values",
    "application/json",
    "application/x-ndjson",
    "application/ndjson",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.apache.parquet",
    "application/parquet",
    "application/xml",
    "text/xml",
    "application/zip",
)

# Evidence for the kind of a resource, by format, media type and path.
SERVICE_FORMATS = r"\A(?:wms|wfs|wmts|sos|csw)\z"
ARCHIVE_FORMATS = r"\A(?:zip|7z|rar|tar|gz|gzip)\z"
ARCHIVE_MEDIA_TYPES = (
    r"\Aapplication/(?:zip|x-7z-compressed|x-rar-compressed|gzip|x-tar)\z"
)
ARCHIVE_PATHS = r"\.(?:zip|7z|rar|tar|gz)\z"
PAGE_FORMATS = r"\A(?:html?|website|web page)\z"
PAGE_PATHS = r"\.html?\z"
API_FORMATS = r"\A(?:api|json api|rest|soap|sparql)\z"
API_PATHS = r"(?:\A|/)api(?:/|\z)"


def _present(text: Column) -> Column:
    """Text, or null when it is empty."""
    return F.when(text != "", text)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def media_type(text: Column) -> Column:
    """Media type without parameters."""
    return F.lower(F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit(";"), F.lit(1))))


def dataset_reference(provider: str, identifier: Column) -> Column:
    return F.concat_ws(":", F.lit(provider), F.lit("dataset"), identifier)


def resource_reference(provider: str, identifier: Column) -> Column:
    return F.concat_ws(":", F.lit(provider), F.lit("resource"), identifier)


def parse_reference(reference: Column) -> Column:
    """Struct (provider, kind, id) of a reference; null when it is not one."""
    pattern = r"(?s)\A([^:]+):([^:]+):(.*)\z"
    provider = F.regexp_extract(reference, pattern, 1)
    kind = F.regexp_extract(reference, pattern, 2)
    identifier = F.regexp_extract(reference, pattern, 3)
    local = provider == "local"
    known = (local & (kind == "file")) | (~local & kind.isin("dataset", "resource"))
    return F.when(
        known & (F.trim(identifier) != ""),
        F.struct(provider.alias("provider"), kind.alias("kind"), identifier.alias("id")),
    )


def read_packages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Package JSON text as columns, the original kept as ``raw``."""
    parsed = F.from_json(F.col(column), PACKAGE_SCHEMA)
    return raw.select(parsed.alias("_p"), F.col(column).alias("raw")).select("_p.*", "raw")


def map_datasets(packages: DataFrame, provider: str) -> DataFrame:
    """One row per dataset; empty text is absent."""
    listed = F.when(F.col("resources").isNotNull(), F.size("resources"))
    title, identifier = F.col("license_title"), F.col("license_id")
    return packages.select(
        "id",
        F.lit(provider).alias("provider"),
        "name",
        "title",
        dataset_reference(provider, F.col("id")).alias("reference"),
        _present(F.col("notes")).alias("description"),
        F.col("organization.id").alias("organization_id"),
        F.col("organization.name").alias("organization"),
        _present(F.col("organization.title")).alias("organization_title"),
        F.coalesce(_present(title), _present(identifier)).alias("license"),
        _present(identifier).alias("license_id"),
        F.transform("tags", lambda t: t["name"]).alias("tags"),
        F.array_distinct(F.transform("resources", lambda r: r["format"])).alias("formats"),
        _present(F.col("metadata_modified")).alias("modified_at"),
        F.coalesce(listed.cast("bigint"), F.col("num_resources")).alias("resource_count"),
        "raw",
    )


def map_resources(packages: DataFrame, provider: str) -> DataFrame:
    """One row per resource of each dataset, in their listed order."""
    each = packages.select(F.col("id").alias("dataset_id"), F.posexplode("resources").alias("place", "r"))
    size = F.when(F.col("r.size").rlike(r"\A\d+\z"), F.col("r.size").try_cast("bigint"))
    return each.select(
        F.col("r.id").alias("id"),
        "dataset_id",
        "place",
        F.lit(provider).alias("provider"),
        F.coalesce(_present(F.col("r.name")), F.col("r.id")).alias("title"),
        F.col("r.url").alias("url"),
        resource_reference(provider, F.col("r.id")).alias("reference"),
        _present(F.col("r.description")).alias("description"),
        _present(F.col("r.format")).alias("format"),
        _present(F.col("r.mimetype")).alias("media_type"),
        F.when(size <= 2**53 - 1, size).alias("size_bytes"),
        _present(F.col("r.last_modified")).alias("modified_at"),
        F.col("r.resource_type").alias("resource_type"),
    )


def resource_kind() -> Column:
    """service, archive, page, api or file, from the columns of a resource row."""
    form = F.lower(F.trim(_text("format")))
    media = media_type(F.col("media_type"))
    path = url_path(_text("url"))
    raw = F.lower(_text("resource_type"))
    service = form.rlike(SERVICE_FORMATS) | raw.contains("service")
    archive = (
        form.rlike(ARCHIVE_FORMATS) | media.rlike(ARCHIVE_MEDIA_TYPES) | path.rlike(ARCHIVE_PATHS)
    )
    page = (
        form.rlike(PAGE_FORMATS)
        | path.rlike(PAGE_PATHS)
        | (media == "text/html")
        | raw.contains("page")
    )
    api = form.rlike(API_FORMATS) | path.rlike(API_PATHS) | raw.contains("api")
    return (
        F.when(service, "service")
        .when(archive, "archive")
        .when(page, "page")
        .when(api, "api")
        .otherwise("file")
    )


def access_operations(kind: Column, detected: Column) -> Column:
    """Operations that a resource of this kind and detected format supports."""
    data = F.lit(["preview", "schema", "validate", "query", "convert"])
    direct = ~F.coalesce(detected, F.lit("unknown")).isin("zip", "unknown")
    readable = kind.isin("file", "local") & direct
    return F.concat(
        F.array(F.lit("inspect")),
        F.when(readable | (kind == "archive"), data).otherwise(F.array().cast("array<string>")),
        F.when(kind.isin("file", "archive"), F.array(F.lit("download"))).otherwise(
            F.when(kind == "page", F.array(F.lit("open"))).otherwise(
                F.array().cast("array<string>")
            )
        ),
    )


def normalized_format(text: Column) -> Column:
    """Declared format in lower case without its dot; jsonl is ndjson."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\A\.", "")
    return F.when(bare == "jsonl", F.lit("ndjson")).otherwise(bare)


def _issue(entry: tuple, code: str, arguments: Sequence[Column] = ()) -> Column:
    severity, message, recommendation, field = entry
    text = F.format_string(message, *arguments) if arguments else F.lit(message)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        text.alias("message"),
        F.lit(recommendation).alias("recommendation"),
        F.lit(field).alias("field"),
    )


def _listed(df: DataFrame, tests: Sequence[tuple[Column, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, entry) for test, entry in tests]))
    return df.select("id", F.inline(found))


def _blank(name: str) -> Column:
    return F.trim(_text(name)) == ""


def dataset_issues(datasets: DataFrame) -> DataFrame:
    """Metadata issues of datasets, one row each."""
    modified = F.col("modified_at")
    parsed = F.coalesce(
        F.try_to_timestamp(modified), F.try_to_timestamp(modified, F.lit("yyyy-MM-dd"))
    )
    tests = {
        "MISSING_TITLE": _blank("title"),
        "MISSING_DESCRIPTION": _blank("description"),
        "MISSING_LICENSE": F.col("license").isNull(),
        "MISSING_ORGANIZATION": F.col("organization").isNull(),
        "MISSING_MODIFICATION_TIMESTAMP": parsed.isNull(),
    }
    return _listed(datasets, [(t, _issue(DATASET_ISSUES[c], c)) for c, t in tests.items()])


def resource_issues(resources: DataFrame, detected: str | None = None) -> DataFrame:
    """Metadata issues of resources; ``detected`` names a column with the real format."""
    tests = [
        (~is_http_url(F.col("url")), _issue(RESOURCE_ISSUES["INVALID_RESOURCE_URL"], "INVALID_RESOURCE_URL")),
        (_blank("title"), _issue(RESOURCE_ISSUES["MISSING_TITLE"], "MISSING_TITLE")),
        (_blank("description"), _issue(RESOURCE_ISSUES["MISSING_DESCRIPTION"], "MISSING_DESCRIPTION")),
    ]
    if detected is not None:
        code = "DECLARED_FORMAT_MISMATCH"
        mismatch = normalized_format(F.col("format")) != F.col(detected)
        tests.append((mismatch, _issue(RESOURCE_ISSUES[code], code, [F.col("format"), F.col(detected)])))
    return _listed(resources, tests)


def search(
    datasets: DataFrame,
    *,
    text: str | None = None,
    filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Datasets under every given filter; text is a plain substring test."""
    tests = []
    if text:
        words = F.lower(F.concat_ws(" ", F.col("title"), F.col("description")))
        tests.append(words.contains(text.lower()))
    for name, value in (filters or {}).items():
        if name == "organization":
            tests.append(F.col("organization") == value)
        elif name in ("tags", "formats"):
            tests.extend(F.array_contains(name, v) for v in value)
        elif name == "license":
            tests.append(F.col("license_id") == value)
        elif name == "modifiedAfter":
            tests.append(F.col("modified_at") >= value)
        elif name == "modifiedBefore":
            tests.append(F.col("modified_at") <= value)
        else:
            raise DataError("FILTER_UNSUPPORTED", f"Unknown search filter '{name}'.")
    return datasets.filter(reduce(and_, tests, F.lit(True)))


def sort_columns(sort: Sequence[tuple[str, str]] = ()) -> list[Column]:
    """Checked sort; relevance is a remote ranking and cannot be computed here."""
    chosen = list(sort) or [("metadata_modified", "desc")]
    columns = []
    for field, direction in chosen:
        if field not in SORT_FIELDS or field == "relevance" or direction not in ("asc", "desc"):
            raise DataError("SORT_UNSUPPORTED", f"Cannot sort by '{field} {direction}'.")
        column = F.col("modified_at" if field == "metadata_modified" else field)
        columns.append(column.asc() if direction == "asc" else column.desc_nulls_last())
    return [*columns, F.col("id").asc()]


def search_page(
    found: DataFrame, sort: Sequence[tuple[str, str]] = (), limit: int = 10, offset: int = 0
) -> DataFrame:
    """One page with ``total`` and ``next_offset`` on each row."""
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    following = F.lit(offset + limit)
    return (
        found.orderBy(*sort_columns(sort))
        .offset(offset)
        .limit(limit)
        .withColumn("total", total)
        .withColumn("next_offset", F.when(following < F.col("total"), following))
    )


def require_listable(found: DataFrame, offset: int = 0) -> None:
    """Listing every page of a search is bounded."""
    if found.count() - offset > MAX_ALL_RESULTS:
        raise DataError("SEARCH_RESULT_LIMIT_EXCEEDED", "Too many results to list.", maximum=MAX_ALL_RESULTS)


def listed_fields(datasets: DataFrame, fields: Sequence[str] = LIST_FIELDS) -> DataFrame:
    """Columns of a snapshot list; only id, title and name exist there."""
    unknown = [f for f in fields if f not in LIST_FIELDS]
    if unknown:
        raise DataError("FIELD_UNKNOWN", "A snapshot list has no such fields.", fields=unknown)
    return datasets.select(*fields)


def is_tabular() -> Column:
    """Resource rows whose format or media type holds a table."""
    return F.lower(_text("format")).isin(*TABULAR_FORMATS) | media_type(F.col("media_type")).isin(
        *TABULAR_MEDIA_TYPES
    )


def tabular_choice(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """Per dataset: tabular resources, and the one chosen when there is just one.

    The choice is an aggregate of two ids, whatever the number of resources.
    """
    per = (
        resources.filter(is_tabular())
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("tabular"), F.min("id").alias("only"))
    )
    joined = datasets.select(F.col("id").alias("dataset_id")).join(per, "dataset_id", "left")
    tabular = F.coalesce("tabular", F.lit(0))
    return joined.select(
        "dataset_id",
        tabular.alias("tabular"),
        F.when(tabular == 1, F.col("only")).alias("resource_id"),
        F.when(tabular == 1, F.lit("selected")).otherwise("AMBIGUOUS_RESOURCE").alias("outcome"),
    )


def parent_datasets(orphans: DataFrame, resources: DataFrame, **options: int) -> DataFrame:
    """Parent of resources that do not name one: same URL and same id.

    ``resources`` is reduced to one parent per (url, id) first.
    """
    known = resources.groupBy("url", "id").agg(F.min("dataset_id").alias("dataset_id"))
    # Equal rows of a hot key have nothing else that could spread them.
    placed = orphans.withColumn("_place", F.monotonically_increasing_id())
    return salted_join(placed, known, ["url", "id"], how="left", spread_by=["_place"], **options).drop("_place")


def dataset_resources(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """Each dataset with each of its resources; spread when one dataset has most."""
    sized = datasets.select(F.col("id").alias("dataset_id"), F.col("title").alias("dataset_title"), F.col("resource_count"))
    # Weighed by rows: the declared number of resources may be wrong.
    return salted_join(resources, sized, ["dataset_id"], spread_by=["id"])
