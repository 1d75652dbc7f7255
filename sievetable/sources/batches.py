"""Frames of bounded size from rows made inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd


def in_frames(
    rows: Iterable[tuple], columns: Sequence[str], most: int = 10_000
) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``most`` rows, made as they are asked for."""
    pending = iter(rows)
    while part := list(islice(pending, most)):
        yield pd.DataFrame(part, columns=list(columns))
