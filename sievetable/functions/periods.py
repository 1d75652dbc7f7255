"""Ordinals of calendar periods written as text.

Scales: A year, H half-year, Q quarter, M month, W ISO week, D day. An ordinal
is null when the text is not a period of its scale, so a range or a gap check
is integer arithmetic on a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms of a period per scale.
PERIOD_TEXT = {
    "A": r"\A\d{4}\z",
    "H": r"\A\d{4}[Hh]?[12]\z",
    "Q": r"\A\d{4}[Qq]?[1-4]\z",
    "M": r"\A\d{4}[Mm]?(?:0[1-9]|1[0-2])\z",
    "W": r"\A\d{4}[Ww]?(?:0[1-9]|[1-4]\d|5[0-3])\z",
    "D": r"\A\d{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\z",
}


def iso_weeks_in_year(year: Column) -> Column:
    """52 or 53: the ISO week that 28 December falls in."""
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def period_ordinal(text: Column, scale: str) -> Column:
    """Ordinal of one period of the given scale, or null."""
    shaped = text.rlike(PERIOD_TEXT[scale])
    # The pattern fixes where the parts are, so plain substrings take them out.
    year = F.substring(text, 1, 4).try_cast("int")
    part = F.substring(text, -1 if scale in "HQ" else -2, 2).try_cast("int")
    if scale == "A":
        ordinal = year
    elif scale == "H":
        ordinal = year * 2 + part - 1
    elif scale == "Q":
        ordinal = year * 4 + part - 1
    elif scale == "M":
        ordinal = year * 12 + part - 1
    elif scale == "W":
        # Monday of the week that holds 4 January, then whole weeks on.
        fourth = F.unix_date(F.make_date(year, F.lit(1), F.lit(4)))
        monday = fourth - F.pmod(fourth + 3, F.lit(7))
        weeks = F.floor((monday + (part - 1) * 7) / 7)
        ordinal = F.when(part <= iso_weeks_in_year(year), weeks)
    else:
        month, day = F.substring(text, 5, 2), F.substring(text, 7, 2)
        iso = F.concat_ws("-", F.substring(text, 1, 4), month, day)
        ordinal = F.unix_date(iso.try_cast("date"))
    return F.when(shaped, ordinal).cast("bigint")


def any_period_ordinal(text: Column, scale: Column) -> Column:
    """Ordinal where the scale is itself a column."""
    letter = F.upper(F.substring(scale, 1, 1))
    return F.coalesce(*[F.when(letter == s, period_ordinal(text, s)) for s in PERIOD_TEXT])


def period_count(first: Column, last: Column, scale: str) -> Column:
    """Length of an inclusive range; null when it is empty or not a range."""
    length = period_ordinal(last, scale) - period_ordinal(first, scale) + 1
    return F.when(length > 0, length)
