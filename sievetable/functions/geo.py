"""Structural checks of positions and GeoJSON geometries."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coordinate systems whose positions are degrees.
DEGREE_SYSTEMS = ("EPSG:4326", "OGC:CRS84")
SHAPE_LEVELS = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}


def valid_lat_lon(latitude: Column, longitude: Column) -> Column:
    """Both numbers are finite and inside the globe; null counts as invalid."""
    inside = latitude.between(-90, 90) & longitude.between(-180, 180)
    return F.coalesce(inside, F.lit(False))


def _position(crs: str) -> Callable[[Column], Column]:
    def valid(p: Column) -> Column:
        number = F.forall(
            p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        )
        ok = (F.size(p) >= 2) & number
        if crs in DEGREE_SYSTEMS:
            ok = ok & p[0].between(-180, 180) & p[1].between(-90, 90)
        return F.coalesce(ok, F.lit(False))

    return valid


def _all(valid: Callable[[Column], Column], least: int) -> Callable[[Column], Column]:
    def check(values: Column) -> Column:
        return F.coalesce((F.size(values) >= least) & F.forall(values, valid), F.lit(False))

    return check


def _ring(crs: str) -> Callable[[Column], Column]:
    line = _all(_position(crs), 4)

    def check(ring: Column) -> Column:
        return F.coalesce(line(ring) & (ring[0] == F.element_at(ring, -1)), F.lit(False))

    return check


def _collection_valid(text: str, degrees: bool) -> bool:
    """A geometry collection and all its members, whatever their depth."""

    def point(p: object) -> bool:
        if not isinstance(p, list) or len(p) < 2:
            return False
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in p):
            return False
        return not degrees or (-180 <= p[0] <= 180 and -90 <= p[1] <= 90)

    def listed(values: object, least: int, check: Callable[[object], bool]) -> bool:
        return isinstance(values, list) and len(values) >= least and all(map(check, values))

    def ring(values: object) -> bool:
        return listed(values, 4, point) and values[0] == values[-1]

    def line(values: object) -> bool:
        return listed(values, 2, point)

    checks = {
        "Point": point,
        "MultiPoint": lambda v: listed(v, 1, point),
        "LineString": line,
        "MultiLineString": lambda v: listed(v, 1, line),
        "Polygon": lambda v: listed(v, 1, ring),
        "MultiPolygon": lambda v: listed(v, 1, lambda polygon: listed(polygon, 1, ring)),
    }
    try:
        waiting = [json.loads(text)]
    except (ValueError, RecursionError):
        return False
    while waiting:
        g = waiting.pop()
        if not isinstance(g, dict):
            return False
        kind = g.get("type")
        if kind == "GeometryCollection":
            if set(g) != {"type", "geometries"} or not isinstance(g["geometries"], list):
                return False
            waiting.extend(g["geometries"])
        elif kind not in checks or set(g) != {"type", "coordinates"} or not checks[kind](g["coordinates"]):
            return False
    return True


def _valid_collection(collection: Column, degrees: bool) -> Column:
    """Collections nest without a limit, which no fixed expression can follow."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _collection_valid(t, degrees))

    return check(collection)


def valid_geometry(geometry: Column, crs: str) -> Column:
    """GeoJSON text is a well-formed geometry in the given coordinate system.

    Plain geometries are checked by expressions. Only collections are sent to
    Python, in Arrow batches, and followed to any depth.
    """
    kind = F.get_json_object(geometry, "$.type")
    keys = F.array_sort(F.json_object_keys(geometry))
    raw = F.get_json_object(geometry, "$.coordinates")
    point, ring = _position(crs), _ring(crs)
    checks = {
        "Point": point,
        "MultiPoint": _all(point, 1),
        "LineString": _all(point, 2),
        "MultiLineString": _all(_all(point, 2), 1),
        "Polygon": _all(ring, 1),
        "MultiPolygon": _all(_all(ring, 1), 1),
    }
    simple = F.lit(False)
    for name, check in checks.items():
        levels = SHAPE_LEVELS[name]
        schema = "array<" * levels + "double" + ">" * levels
        simple = F.when(kind == name, check(F.from_json(raw, schema))).otherwise(simple)
    plain = simple & (keys == F.array(F.lit("coordinates"), F.lit("type")))
    collection = F.when(kind == "GeometryCollection", geometry)
    nested = _valid_collection(collection, crs in DEGREE_SYSTEMS)
    return F.coalesce(F.when(kind == "GeometryCollection", nested).otherwise(plain), F.lit(False))
