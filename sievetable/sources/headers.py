"""Column names for tables whose header line is ragged, blank or repeated."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HeaderPlan(NamedTuple):
    """Names to use, blank places, and (place, name) of each repeat; places from 1."""

    names: list[str]
    blank: list[int]
    repeated: list[tuple[int, str]]


def plan_header(cells: Sequence[str | None], width: int | None = None) -> HeaderPlan:
    """Blank becomes ``column_N``, a repeat ``name_2``, overflow ``extra_column_N``."""
    names, blank, repeated = [], [], []
    uses: dict[str, int] = {}
    for place, cell in enumerate(cells, start=1):
        if not cell:
            blank.append(place)
        base = cell or f"column_{place}"
        uses[base] = uses.get(base, 0) + 1
        if uses[base] > 1:
            repeated.append((place, base))
        names.append(base if uses[base] == 1 else f"{base}_{uses[base]}")
    for place in range(len(names) + 1, (width or 0) + 1):
        names.append(f"extra_column_{place}")
    return HeaderPlan(names, blank, repeated)


def cells_to_columns(rows: DataFrame, cells: str, header: Sequence[str | None]) -> DataFrame:
    """A row per array of cells; missing cells are null, overflow gets columns."""
    widest = rows.agg(F.max(F.size(cells))).first()[0] or 0
    plan = plan_header(header, max(widest, len(header)))
    kept = [c for c in rows.columns if c != cells]
    picked = [F.get(F.col(cells), F.lit(i)).alias(n) for i, n in enumerate(plan.names)]
    return rows.select(*kept, *picked)
