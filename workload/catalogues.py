"""Catalogue, snapshot, retention and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievetable.functions import text
from sievetable.operators import catalogue, lineage, retention, snapshot
from workload.registry import query
from workload.views import table

PROVIDER = "portal"


def package_json(spark, sf_dir):
    """A catalogue as package JSON: documents are datasets, pages their resources.

    Page ``p`` belongs to document ``p``; metadata has gaps by key.
    """
    key, page = F.col("doc_id"), F.col("page_id")
    form = (
        F.when(page % 8 == 0, "CSV")
        .when(page % 8 == 1, "WMS")
        .when(page % 8 == 2, "zip")
        .when(page % 8 == 3, "JSON API")
        .when(page % 8 == 4, "")
        .when(page % 8 == 5, "xlsx")
        .when(page % 8 == 6, ".JSONL")
    )
    resource = F.struct(
        F.concat(F.lit("r"), page.cast("string")).alias("id"),
        F.when(page % 5 == 0, "").otherwise(F.concat(F.lit("Page "), page.cast("string"))).alias("name"),
        F.when(page % 3 == 0, "A page").alias("description"),
        F.when(page % 17 == 0, "javascript:1").otherwise(F.col("url")).alias("url"),
        form.alias("format"),
        F.when(page % 9 == 0, "text/html; charset=utf-8").alias("mimetype"),
        F.length("html").alias("size"),
        F.when(page % 10 == 9, "web service").alias("resource_type"),
    )
    documents = table(spark, sf_dir, "documents").withColumn("join_key", key)
    pages = table(spark, sf_dir, "pages").select(page.alias("join_key"), resource.alias("resource"))
    # One page per document id, so the list holds at most one entry.
    joined = documents.join(pages, "join_key", "left")
    identifier = key.cast("string")
    package = F.struct(
        F.concat(F.lit("d"), identifier).alias("id"),
        F.concat(F.lit("n"), F.lpad((key * 7919 % 100003).cast("string"), 6, "0")).alias("name"),
        F.when(key % 41 == 0, " ").otherwise(F.concat(F.lit("Title "), identifier)).alias("title"),
        F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("About "), F.col("source"))).alias("notes"),
        F.when(key % 19 == 0, "not a date")
        .when(key % 23 != 0, F.concat(F.lit("2026-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
        .alias("metadata_modified"),
        F.when(key % 4 != 0, F.concat(F.lit("cc-"), (key % 3).cast("string"))).alias("license_id"),
        F.when(key % 4 == 1, "Open").otherwise(F.when(key % 4 == 2, "")).alias("license_title"),
        F.when(key % 13 != 0, F.struct(F.col("source").alias("id"), F.col("source").alias("name"))).alias("organization"),
        F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("all").alias("name"))).alias("tags"),
        F.when(F.col("resource").isNotNull(), F.array("resource")).alias("resources"),
        F.when(key % 2 == 0, (key % 5).cast("bigint")).alias("num_resources"),
    )
    return joined.select(F.to_json(package).alias("value"))


def _packages(spark, sf_dir):
    return catalogue.read_packages(package_json(spark, sf_dir))


def _datasets(spark, sf_dir):
    return catalogue.map_datasets(_packages(spark, sf_dir), PROVIDER)


def _resources(spark, sf_dir):
    return catalogue.map_resources(_packages(spark, sf_dir), PROVIDER)


_SOURCES = """
WITH d AS (
  SELECT doc_id AS k, 'd' || doc_id AS id,
         'n' || lpad(CAST(doc_id * 7919 % 100003 AS VARCHAR), 6, '0') AS name,
         CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE 'Title ' || doc_id END AS title,
         CASE WHEN doc_id % 6 <> 0 THEN 'About ' || source END AS description,
         CASE WHEN doc_id % 13 <> 0 THEN source END AS organization,
         CASE WHEN doc_id % 4 <> 0 THEN 'cc-' || doc_id % 3 END AS license_id,
         CASE WHEN doc_id % 4 = 1 THEN 'Open' WHEN doc_id % 4 <> 0 THEN 'cc-' || doc_id % 3 END AS license,
         lang || ',all' AS tags, lang,
         CASE WHEN doc_id % 19 = 0 THEN 'not a date'
              WHEN doc_id % 23 <> 0 THEN '2026-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z'
              END AS modified_at,
         doc_id IN (SELECT page_id FROM pages) AS has_page
  FROM documents),
r AS (
  SELECT page_id AS p, 'r' || page_id AS id, 'd' || page_id AS dataset_id,
         CASE WHEN page_id % 5 = 0 THEN 'r' || page_id ELSE 'Page ' || page_id END AS title,
         CASE WHEN page_id % 3 = 0 THEN 'A page' END AS description,
         CASE WHEN page_id % 17 = 0 THEN 'javascript:1' ELSE url END AS url,
         CASE page_id % 8 WHEN 0 THEN 'CSV' WHEN 1 THEN 'WMS' WHEN 2 THEN 'zip' WHEN 3 THEN 'JSON API'
              WHEN 5 THEN 'xlsx' WHEN 6 THEN '.JSONL' END AS format,
         CASE WHEN page_id % 9 = 0 THEN 'text/html; charset=utf-8' END AS media_type,
         CASE WHEN page_id % 10 = 9 THEN 'web service' END AS resource_type,
         length(html) AS size_bytes
  FROM pages WHERE page_id IN (SELECT doc_id FROM documents))
"""


@query(
    "cat_datasets",
    _SOURCES
    + """SELECT id, 'portal:dataset:' || id AS reference, title, description, organization, license,
 license_id, tags, modified_at, CASE WHEN has_page THEN 1 WHEN k % 2 = 0 THEN k % 5 END AS resource_count FROM d""",
)
def cat_datasets(spark, sf_dir):
    return _datasets(spark, sf_dir).select(
        "id",
        "reference",
        "title",
        "description",
        "organization",
        "license",
        "license_id",
        F.array_join("tags", ",").alias("tags"),
        "modified_at",
        "resource_count",
    )


@query(
    "cat_resources",
    _SOURCES
    + """SELECT id, dataset_id, 'portal:resource:' || id AS reference, title, description, url, format,
 media_type, size_bytes FROM r""",
)
def cat_resources(spark, sf_dir):
    return _resources(spark, sf_dir).select(
        "id", "dataset_id", "reference", "title", "description", "url", "format", "media_type", "size_bytes"
    )


_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


@query(
    "cat_resource_kind",
    _SOURCES
    + f"""SELECT id, CASE
  WHEN lower(coalesce(format, '')) IN ('wms', 'wfs', 'wmts', 'sos', 'csw') OR coalesce(resource_type, '') LIKE '%service%' THEN 'service'
  WHEN lower(coalesce(format, '')) IN ('zip', '7z', 'rar', 'tar', 'gz', 'gzip') OR regexp_matches({_PATH}, '\\.(zip|7z|rar|tar|gz)$') THEN 'archive'
  WHEN regexp_matches({_PATH}, '\\.html?$') OR coalesce(media_type, '') LIKE 'text/html%' THEN 'page'
  WHEN lower(coalesce(format, '')) IN ('api', 'json api', 'rest', 'soap', 'sparql') OR regexp_matches({_PATH}, '(^|/)api(/|$)') THEN 'api'
  ELSE 'file' END AS kind FROM r""",
)
def cat_resource_kind(spark, sf_dir):
    return _resources(spark, sf_dir).select("id", catalogue.resource_kind().alias("kind"))


@query(
    "cat_search",
    _SOURCES
    + """SELECT id, title FROM d WHERE lower(title || ' ' || coalesce(description, '')) LIKE '%title 1%'
 AND organization IS NOT NULL AND license_id = 'cc-1' AND modified_at >= '2026-01-05T00:00:00Z'
 AND modified_at <= '2026-01-20T23:59:59Z' AND lang IS NOT NULL""",
)
def cat_search(spark, sf_dir):
    found = catalogue.search(
        _datasets(spark, sf_dir).filter(F.col("organization").isNotNull()),
        text="TITLE 1",
        filters={
            "tags": ["all"],
            "license": "cc-1",
            "modifiedAfter": "2026-01-05T00:00:00Z",
            "modifiedBefore": "2026-01-20T23:59:59Z",
        },
    )
    return found.select("id", "title")


@query(
    "cat_search_page",
    _SOURCES
    + """SELECT id, title, (SELECT count(*) FROM d WHERE license_id = 'cc-2') AS total,
 CASE WHEN (SELECT count(*) FROM d WHERE license_id = 'cc-2') > 60 THEN 60 END AS next_offset
 FROM d WHERE license_id = 'cc-2' ORDER BY title, id LIMIT 20 OFFSET 40""",
)
def cat_search_page(spark, sf_dir):
    """Paging is the operator: the third page of twenty."""
    found = catalogue.search(_datasets(spark, sf_dir), filters={"license": "cc-2"})
    page = catalogue.search_page(found, [("title", "asc")], limit=20, offset=40)
    return page.select("id", "title", "total", "next_offset")


@query(
    "cat_metadata_issues",
    _SOURCES
    + """SELECT id, 'MISSING_TITLE' AS code, 'error' AS severity, 'title' AS field FROM d WHERE trim(title) = ''
UNION ALL SELECT id, 'MISSING_DESCRIPTION', 'warning', 'description' FROM d WHERE description IS NULL
UNION ALL SELECT id, 'MISSING_LICENSE', 'warning', 'license' FROM d WHERE license IS NULL
UNION ALL SELECT id, 'MISSING_ORGANIZATION', 'warning', 'organization' FROM d WHERE organization IS NULL
UNION ALL SELECT id, 'MISSING_MODIFICATION_TIMESTAMP', 'warning', 'modifiedAt' FROM d
 WHERE modified_at IS NULL OR modified_at = 'not a date'""",
)
def cat_metadata_issues(spark, sf_dir):
    return catalogue.dataset_issues(_datasets(spark, sf_dir)).select("id", "code", "severity", "field")


@query(
    "cat_resource_issues",
    _SOURCES
    + """SELECT id, 'INVALID_RESOURCE_URL' AS code, 'Resource URL is not a valid HTTP(S) URL.' AS message FROM r WHERE url = 'javascript:1'
UNION ALL SELECT id, 'MISSING_DESCRIPTION', 'Resource description is missing.' FROM r WHERE description IS NULL
UNION ALL SELECT id, 'DECLARED_FORMAT_MISMATCH', 'Declared format ''' || format || ''' disagrees with detected format ''csv''.'
 FROM r WHERE format IS NOT NULL AND format <> 'CSV'""",
)
def cat_resource_issues(spark, sf_dir):
    resources = _resources(spark, sf_dir).withColumn("detected", F.lit("csv"))
    return catalogue.resource_issues(resources, "detected").select("id", "code", "message")


@query(
    "cat_snapshot_order",
    _SOURCES
    + "SELECT row_number() OVER (ORDER BY name, id) - 1 AS position, id, title, name FROM d",
)
def cat_snapshot_order(spark, sf_dir):
    items = snapshot.snapshot_items(_datasets(spark, sf_dir))
    return items.select("position", "id", "title", "name")


@query(
    "cat_order_violations",
    _SOURCES
    + """, o AS (SELECT k AS position, id, name, lag(id) OVER (ORDER BY k) AS previous_id,
 lag(name) OVER (ORDER BY k) AS previous_name FROM d)
SELECT position, id, name, previous_id, previous_name FROM o
WHERE previous_name > name OR (previous_name = name AND previous_id > id)""",
)
def cat_order_violations(spark, sf_dir):
    """The datasets in document order, which is not catalogue order."""
    items = _datasets(spark, sf_dir).withColumn(
        "position", F.substring("id", 2, 20).cast("bigint")
    )
    return snapshot.order_violations(items)


@query(
    "cat_snapshot_verdict",
    _SOURCES
    + """SELECT count(*) AS items, 0::BIGINT AS blank, 0::BIGINT AS duplicate_ids, 0::BIGINT AS order_violations,
 true AS valid FROM d""",
)
def cat_snapshot_verdict(spark, sf_dir):
    return snapshot.snapshot_verdict(snapshot.snapshot_items(_datasets(spark, sf_dir)))


@query(
    "cat_page_problems",
    """WITH p AS (SELECT conv_id AS run, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page,
  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
q AS (SELECT run, page, n * 300 + CASE WHEN run % 5 = 0 AND page = 1 THEN 1 ELSE 0 END AS total,
  page * 300 AS page_offset,
  CASE WHEN page < n - 1 THEN (page + 1) * 300 - CASE WHEN run % 7 = 0 AND page = 0 THEN 300 ELSE 0 END END AS next_offset FROM p),
t AS (SELECT run FROM q GROUP BY run HAVING min(total) <> max(total) OR count(*) * 300 <> min(total)),
l AS (SELECT *, lag(next_offset) OVER (PARTITION BY run ORDER BY page) AS pn FROM q)
SELECT run, 'total' AS field FROM t
UNION ALL SELECT DISTINCT run, 'nextOffset' FROM l WHERE next_offset <= page_offset OR pn <> page_offset""",
)
def cat_page_problems(spark, sf_dir):
    """Every conversation as a paging run, some damaged by key."""
    talks = table(spark, sf_dir, "conversations")
    # A conversation's turns are numbered from zero without gaps.
    sizes = talks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    run, page = F.col("conv_id"), F.col("turn")
    total = F.col("n") * 300 + F.when((run % 5 == 0) & (page == 1), 1).otherwise(0)
    following = (page + 1) * 300 - F.when((run % 7 == 0) & (page == 0), 300).otherwise(0)
    pages = talks.join(sizes, "conv_id").select(
        run.alias("run"),
        page.alias("page"),
        total.alias("total"),
        F.lit(300).cast("bigint").alias("items"),
        (page * 300).alias("page_offset"),
        F.when(page < F.col("n") - 1, following).alias("next_offset"),
    )
    return snapshot.page_problems(pages)


_RUNS = """WITH runs AS (SELECT o_orderpriority AS catalogue, strftime(o_orderdate, '%Y-%m') AS run, count(*) AS count
 FROM orders GROUP BY ALL)"""


def _runs(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("catalogue"), month.alias("run")
    ).agg(F.count(F.lit(1)).alias("count"))


@query(
    "cat_count_guard",
    f"""{_RUNS}, l AS (SELECT *, lag(count) OVER (PARTITION BY catalogue ORDER BY run) AS previous FROM runs)
SELECT catalogue, run, count, previous FROM l WHERE count < previous * 0.9 AND NOT run LIKE '%-12'""",
)
def cat_count_guard(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("allow_reduction", F.col("run").endswith("-12"))
    return snapshot.count_reductions(runs).select("catalogue", "run", "count", "previous")


@query(
    "cat_manifests",
    """SELECT replace(g, ':', '-') AS stamp, 'v1/snapshots/' || replace(g, ':', '-') || '.json' AS snapshot_path,
 strlen(text) AS bytes, sha256(text) AS sha256, true AS valid
FROM (SELECT *, '2026-01-01T00:' || lpad(CAST(doc_id // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || 'Z' AS g FROM documents)""",
)
def cat_manifests(spark, sf_dir):
    """A manifest row for every document, taken as a snapshot file."""
    key = F.col("doc_id")
    minute = F.lpad((F.floor(key / 60) % 60).cast("string"), 2, "0")
    second = F.lpad((key % 60).cast("string"), 2, "0")
    stamp = F.concat(F.lit("2026-01-01T00:"), minute, F.lit(":"), second, F.lit("Z"))
    files = table(spark, sf_dir, "documents").select(
        stamp.alias("generated_at"), F.lit(1).alias("count"), F.col("text").alias("content")
    )
    rows = snapshot.manifests(files)
    return rows.select(
        F.regexp_replace("generated_at", ":", "-").alias("stamp"),
        "snapshot_path",
        "bytes",
        "sha256",
        snapshot.manifest_valid().alias("valid"),
    )


_EVENT_AGE = """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS generated_at,
 date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-15 00:00:00') AS age FROM events)"""


@query(
    "cat_freshness",
    f"""{_EVENT_AGE} SELECT event_id, CASE WHEN age < -300 THEN 'invalid' WHEN age > 86400 THEN 'stale' ELSE 'fresh' END
 AS state FROM e""",
)
def cat_freshness(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    now = F.to_timestamp(F.lit("2024-01-15T00:00:00Z"))
    state = snapshot.freshness(F.col("generated_at"), now)
    events = table(spark, sf_dir, "events").select("event_id", stamp.alias("generated_at"))
    return events.select("event_id", state.alias("state"))


@query(
    "cat_retention",
    f"""{_EVENT_AGE} SELECT generated_at, 'v1/snapshots/' || event_id || '.json' AS snapshot_path FROM e WHERE age <= 172800""",
)
def cat_retention(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = F.concat(F.lit("v1/snapshots/"), F.col("event_id").cast("string"), F.lit(".json"))
    rows = table(spark, sf_dir, "events").select(
        stamp.alias("generated_at"), path.alias("snapshot_path")
    )
    return snapshot.retained(rows, F.to_timestamp(F.lit("2024-01-15T00:00:00Z")))


@query(
    "cat_tabular_choice",
    _SOURCES
    + """, t AS (SELECT dataset_id, count(*) AS n, min(id) AS single FROM r
 WHERE lower(coalesce(format, '')) IN ('csv', 'tsv', 'json', 'jsonl', 'ndjson', 'xlsx', 'parquet', 'xml', 'zip') GROUP BY 1)
SELECT d.id AS dataset_id, coalesce(n, 0) AS tabular, CASE WHEN n = 1 THEN single END AS resource_id,
 CASE WHEN n = 1 THEN 'selected' ELSE 'AMBIGUOUS_RESOURCE' END AS outcome
FROM d LEFT JOIN t ON d.id = t.dataset_id""",
)
def cat_tabular_choice(spark, sf_dir):
    return catalogue.tabular_choice(_datasets(spark, sf_dir), _resources(spark, sf_dir))


@query("cat_parent_dataset", _SOURCES + "SELECT id, url, dataset_id FROM r")
def cat_parent_dataset(spark, sf_dir):
    resources = _resources(spark, sf_dir)
    return catalogue.parent_datasets(resources.select("id", "url"), resources)


@query(
    "cat_dataset_resources",
    _SOURCES + "SELECT d.id AS dataset_id, d.title AS dataset_title, r.id AS id FROM d JOIN r ON r.dataset_id = d.id",
)
def cat_dataset_resources(spark, sf_dir):
    joined = catalogue.dataset_resources(_datasets(spark, sf_dir), _resources(spark, sf_dir))
    return joined.select("dataset_id", "dataset_title", "id")


@query(
    "cat_references",
    """SELECT n_name, 'portal' AS provider, 'dataset' AS kind, 'a:' || n_nationkey AS id FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_name, NULL, NULL, NULL FROM nation WHERE n_nationkey % 3 = 1
UNION ALL SELECT n_name, 'local', 'file', '/x/' || n_nationkey FROM nation WHERE n_nationkey % 3 = 2""",
)
def cat_references(spark, sf_dir):
    key = F.col("n_nationkey")
    reference = (
        F.when(key % 3 == 0, F.concat(F.lit("portal:dataset:a:"), key.cast("string")))
        .when(key % 3 == 1, F.concat(F.lit("local:dataset:"), key.cast("string")))
        .otherwise(F.concat(F.lit("local:file:/x/"), key.cast("string")))
    )
    parsed = table(spark, sf_dir, "nation").select("n_name", catalogue.parse_reference(reference).alias("p"))
    return parsed.select("n_name", "p.provider", "p.kind", "p.id")


@query(
    "cat_access",
    _SOURCES
    + f"""SELECT id, CASE
  WHEN lower(coalesce(format, '')) = 'wms' OR coalesce(resource_type, '') LIKE '%service%' THEN 'inspect'
  WHEN lower(coalesce(format, '')) = 'zip' OR regexp_matches({_PATH}, '\\.(zip|7z|rar|tar|gz)$') THEN 'inspect,preview,schema,validate,query,convert,download'
  WHEN regexp_matches({_PATH}, '\\.html?$') OR coalesce(media_type, '') LIKE 'text/html%' THEN 'inspect,open'
  WHEN lower(coalesce(format, '')) = 'json api' OR regexp_matches({_PATH}, '(^|/)api(/|$)') THEN 'inspect'
  ELSE 'inspect,preview,schema,validate,query,convert,download' END AS operations FROM r""",
)
def cat_access(spark, sf_dir):
    operations = catalogue.access_operations(catalogue.resource_kind(), F.lit("csv"))
    return _resources(spark, sf_dir).select("id", F.array_join(operations, ",").alias("operations"))


# Storage.


def _entries(spark, sf_dir):
    """Line items as stored artefacts: five entries share an object."""
    key = F.col("o_orderkey")
    base = F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    hours = (key * 7919 % 1000).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), F.lpad(key.cast("string"), 12, "0")).alias("key"),
        F.concat(F.lit("s"), (key % 3001).cast("string")).alias("sha256"),
        (key % 3001 % 97 * 10 + 5).cast("bigint").alias("bytes"),
        F.timestamp_add("HOUR", (key % 50).cast("int") - 10, base).alias("expires_at"),
        F.timestamp_add("MINUTE", hours, base).cast("string").alias("last_used_at"),
        F.timestamp_add("MINUTE", (key % 100).cast("int"), base).cast("string").alias("created_at"),
    )


_ENTRIES = """WITH entries AS (
 SELECT 'k' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, 's' || o_orderkey % 3001 AS sha256,
        o_orderkey % 3001 % 97 * 10 + 5 AS bytes, o_orderkey % 50 - 10 <= 0 AS expired,
        o_orderkey * 7919 % 1000 AS used, o_orderkey % 100 AS created FROM orders),
live AS (SELECT *, row_number() OVER (ORDER BY used, created, key) AS pos FROM entries WHERE NOT expired),
marked AS (SELECT *, pos = max(pos) OVER (PARTITION BY sha256) AS last FROM live),
freed AS (SELECT *, coalesce(sum(CASE WHEN last THEN bytes ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM marked),
total AS (SELECT sum(bytes) AS t FROM (SELECT DISTINCT sha256, bytes FROM live)),
plan AS (SELECT key, sha256, bytes, CASE WHEN t - freed_before > 700000 THEN 'evicted' ELSE 'kept' END AS outcome FROM freed, total
 UNION ALL SELECT key, sha256, bytes, 'expired' FROM entries WHERE expired)"""


@query("retention_plan", f"{_ENTRIES} SELECT key, outcome FROM plan")
def retention_plan(spark, sf_dir):
    now = F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    plan = retention.retention_plan(_entries(spark, sf_dir), now, 700_000)
    return plan.select("key", "outcome")


@query(
    "retention_objects",
    f"{_ENTRIES} SELECT sha256, max(bytes) AS bytes FROM plan GROUP BY 1 HAVING count(*) FILTER (outcome = 'kept') = 0",
)
def retention_objects(spark, sf_dir):
    now = F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    return retention.removable_objects(
        retention.retention_plan(_entries(spark, sf_dir), now, 700_000)
    )


@query(
    "storage_totals",
    f"{_ENTRIES} SELECT count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT sha256, bytes FROM entries)",
)
def storage_totals(spark, sf_dir):
    return retention.storage_totals(_entries(spark, sf_dir))


@query(
    "unreferenced_objects",
    f"{_ENTRIES} SELECT 's' || p_partkey AS sha256 FROM part WHERE 's' || p_partkey NOT IN (SELECT sha256 FROM live)",
)
def unreferenced_objects(spark, sf_dir):
    objects = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sha256")
    )
    now = F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    return retention.unreferenced(objects, _entries(spark, sf_dir), now)


# Lineage.


@query(
    "redact_urls",
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '[REDACTED_INVALID_URL]' ELSE
 regexp_replace(url, '^(https?://[^/?#]+)([?#]|$)', '\\1/\\2') END
 || CASE WHEN page_id % 11 = 0 THEN '' WHEN url LIKE '%#%' THEN '' WHEN url LIKE '%?%' THEN '&token=REDACTED&a=1'
         ELSE '?API_KEY=REDACTED' END AS url FROM pages""",
)
def redact_urls(spark, sf_dir):
    """Page URLs with credentials and secrets put in."""
    url, page = F.col("url"), F.col("page_id")
    secret = (
        F.when(url.contains("#"), url)
        .when(url.contains("?"), F.concat(url, F.lit("&token=abc123&a=1")))
        .otherwise(F.concat(url, F.lit("?API_KEY=s3cret")))
    )
    signed = F.regexp_replace(secret, "://", "://user:pw@")
    given = F.when(page % 11 == 0, F.concat(F.lit("not a url "), url)).otherwise(signed)
    return table(spark, sf_dir, "pages").select("page_id", text.redact_url(given).alias("url"))


@query(
    "provenance_verify",
    """SELECT 'doc-' || doc_id AS path, CASE doc_id % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'unrecorded'
 WHEN 2 THEN 'missing' ELSE 'verified' END AS outcome FROM documents""",
)
def provenance_verify(spark, sf_dir):
    """Documents as files, and records of them that are partly wrong."""
    documents = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    facts = documents.select(
        key,
        F.concat(F.lit("doc-"), key.cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.sha2("text", 256).alias("sha256"),
    )
    files = facts.filter(key % 5 != 2).select("path", "bytes", "sha256")
    recorded = facts.filter(key % 5 != 1).withColumn(
        "bytes", F.col("bytes") + F.when(key % 5 == 0, 1).otherwise(0)
    )
    records = lineage.provenance_records(
        recorded,
        "convert",
        timestamp=F.to_timestamp(F.lit("2026-01-01T00:00:00Z")),
        input_sha256=F.col("sha256"),
        media_type="text/csv",
        details={"rows": F.lit(1)},
    )
    return lineage.verify(files, records)


@query(
    "provenance_violations",
    """SELECT 'doc-' || doc_id AS path, 'sha256' AS rule FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'doc-' || doc_id, 'bytes' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT 'doc-' || doc_id, 'transformation' FROM documents WHERE doc_id % 5 = 0""",
)
def provenance_violations(spark, sf_dir):
    key = F.col("doc_id")
    digest = F.sha2("text", 256)
    records = lineage.provenance_records(
        table(spark, sf_dir, "documents").select(
            key,
            F.concat(F.lit("doc-"), key.cast("string")).alias("path"),
            F.when(key % 4 == 0, -1).otherwise(1).cast("bigint").alias("bytes"),
            F.when(key % 3 == 0, F.upper(F.concat(digest, F.lit("x")))).otherwise(digest).alias("sha256"),
            F.when(key % 5 == 0, "short").alias("input"),
        ),
        "convert",
        timestamp=F.to_timestamp(F.lit("2026-01-01T00:00:00Z")),
        input_sha256=F.col("input"),
        media_type="text/csv",
        details={},
    )
    return lineage.record_violations(records).select(F.col("localPath").alias("path"), "rule")
