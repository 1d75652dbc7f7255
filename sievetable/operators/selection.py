"""Projection, filters, paging and set operations on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import isfinite
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.functions import cells
from sievetable.functions.text import natural_key

PREVIEW_ROWS = 20


class Page(NamedTuple):
    """Rows of one page and whether more follow (a one-row frame)."""

    rows: DataFrame
    truncated: DataFrame


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named columns; an unknown one is null."""
    return df.select(
        *[
            F.col(cells.quoted(f)) if f in df.columns else F.lit(None).cast("string").alias(f)
            for f in fields
        ]
    )


def checked_project(df: DataFrame, fields: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """The named columns; an unknown or disallowed one is an error."""
    known = set(allowed if allowed is not None else df.columns)
    missing = [f for f in fields if f not in known]
    if missing:
        raise DataError("FIELD_UNKNOWN", "Unknown fields.", fields=missing)
    return df.select(*[cells.quoted(f) for f in fields])


def missing_fields(requested: DataFrame, schema: DataFrame) -> DataFrame:
    """Requested names that a layer does not have."""
    return requested.join(schema.select("name"), "name", "left_anti")


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: Sequence[Column | str] = ()) -> Page:
    """The first rows, and whether there are more."""
    if rows <= 0:
        raise DataError("INVALID_PREVIEW_LIMIT", "Preview row limit must be positive.")
    head = df.orderBy(*order_by).limit(rows + 1) if order_by else df.limit(rows + 1)
    more = head.agg((F.count(F.lit(1)) > rows).alias("truncated"))
    return Page(head.limit(rows), more)


def page(df: DataFrame, order_by: Sequence[Column | str], limit: int, offset: int = 0) -> Page:
    """Rows ``offset`` to ``offset + limit`` in the given order (a top-k plan)."""
    if limit <= 0 or offset < 0:
        raise DataError("PAGE_INVALID", "Limit must be positive and offset not negative.")
    window = df.orderBy(*order_by).offset(offset).limit(limit + 1)
    more = window.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return Page(window.limit(limit), more)


def equality(filters: Mapping[str, bool | int | float | str]) -> Column:
    """All of the given columns equal the given typed values."""
    tests = [F.col(cells.quoted(name)) == F.lit(value) for name, value in filters.items()]
    return reduce(and_, tests, F.lit(True))


def parse_equality(texts: Sequence[str]) -> dict[str, bool | int | float | str]:
    """``field=value`` texts as typed filters."""
    filters = {}
    for text in texts:
        name, sign, value = text.partition("=")
        if not sign or not name:
            raise DataError("FILTER_INVALID", "Equality filters must use field=value.")
        filters[name] = cells.typed_literal(value)
    return filters


def bounding_box(x: str, y: str, box: Sequence[float]) -> Column:
    """Point columns inside ``(min x, min y, max x, max y)``, edges included."""
    if len(box) != 4 or not all(isfinite(v) for v in box):
        raise DataError("BBOX_INVALID", "A bounding box has four finite coordinates.")
    return F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])


def select_features(
    df: DataFrame,
    *,
    properties: Sequence[str] | None = None,
    filters: Mapping[str, bool | int | float | str] | None = None,
    box: Sequence[float] | None = None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Feature rows under equality filters and a box, with checked columns.

    Filters stay plain column comparisons, so they reach the file scan.
    """
    checked_project(df, list(filters or {}))
    kept = df.filter(equality(filters)) if filters else df
    if box is not None:
        kept = kept.filter(bounding_box(x, y, box))
    return kept if properties is None else checked_project(kept, properties)


def feature_count(df: DataFrame, **selection: object) -> DataFrame:
    """One row: number of features selected."""
    return select_features(df, **selection).agg(F.count(F.lit(1)).alias("hits"))


def contains_text(filters: Mapping[str, str]) -> Column:
    """Every set field contains its text, without case; blank text is no filter."""
    tests = [
        F.lower(F.coalesce(F.col(cells.quoted(f)).cast("string"), F.lit(""))).contains(text.lower())
        for f, text in filters.items()
        if text != ""
    ]
    return reduce(and_, tests, F.lit(True))


def filtered_share(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """One row: matching rows and all rows."""
    matched = F.count(F.when(contains_text(filters), True))
    return df.agg(matched.alias("matching"), F.count(F.lit(1)).alias("total"))


def natural_sort(df: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    """Order by a column's text, digits compared as numbers."""
    key = natural_key(F.col(cells.quoted(field)).cast("string"))
    return df.orderBy(key.asc() if ascending else key.desc())


def union_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns in order of first appearance, gaps null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The earliest row of each key, as an aggregate.

    A key with very many rows is reduced before the shuffle, unlike a window.
    """
    position = F.struct(*[F.col(c) for c in order_by])
    first = F.min_by(F.struct(*[F.col(cells.quoted(c)) for c in df.columns]), position)
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*")
