"""Cell classification against fixed examples and a plain restatement of the rules."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sievetable.functions import cells

EXAMPLES = [
    (None, "null"),
    ("", "null"),
    (" ", "string"),
    ("true", "boolean"),
    (" FALSE ", "boolean"),
    ("truee", "string"),
    ("12", "integer"),
    ("-7", "integer"),
    ("+7", "integer"),
    (" 12\t", "integer"),
    (" 12 ", "integer"),
    ("12345678901234567890123", "integer"),
    ("1.5", "double"),
    (".5", "double"),
    ("5.", "double"),
    ("2e10", "double"),
    ("123e-45678", "double"),
    ("1.5e3", "string"),
    ("-", "string"),
    ("--1", "string"),
    ("12\x01", "string"),
    ("2026-01-31", "date"),
    (" 2026-01-31 ", "date"),
    ("2026-02-30", "string"),
    ("2026-2-3", "string"),
    ("0050-01-01", "string"),
    ("0100-01-01", "date"),
    ("2024-02-29", "date"),
    ("2023-02-29", "string"),
    ("2026-01-31T10:00:00Z", "timestamp"),
    ("2026-01-31T10:00", "timestamp"),
    ("2026-01-31T10:00:00.123+02:00", "timestamp"),
    ("2026-01-31 10:00:00", "string"),
    ("2026-01-31T25:00:00Z", "string"),
    ("2026-13-31T10:00:00Z", "string"),
    ("abc", "string"),
    ("čas", "string"),
    ("true\n", "boolean"),
    ("2026-01-31\n", "date"),
    ("1\n", "integer"),
]


def classify(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string")
    kind = cells.text_type(F.col("t"))
    named = F.when(kind == 0, "null").otherwise(cells.type_names(kind))
    return [r.kind for r in frame.select("i", named.alias("kind")).orderBy("i").collect()]


def test_examples(spark):
    found = classify(spark, [t for t, _ in EXAMPLES])
    assert list(zip([t for t, _ in EXAMPLES], found, strict=True)) == EXAMPLES


def plain_rule(text):
    if text is None or text == "":
        return "null"
    text = text.strip(" \t\n\r\f\v ﻿ 　")
    if text.lower() in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return "integer"
    if re.fullmatch(r"[+-]?([0-9]+\.[0-9]*|[0-9]*\.[0-9]+|[0-9]+[eE][+-]?[0-9]+)", text):
        return "double"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        try:
            return "date" if datetime.date.fromisoformat(text).year >= 100 else "string"
        except ValueError:
            return "string"
    return "string"


def test_random_text(spark):
    source = random.Random(5)
    alphabet = "0123456789+-.eE tf\ttrue "
    texts = ["".join(source.choices(alphabet, k=source.randint(0, 8))) for _ in range(4000)]
    days = [
        f"{source.randint(0, 2100):04d}-{source.randint(0, 13):02d}-{source.randint(0, 32):02d}"
        for _ in range(2000)
    ]
    found = classify(spark, texts + days)
    wrong = [
        (t, f, plain_rule(t)) for t, f in zip(texts + days, found, strict=True) if f != plain_rule(t)
    ]
    assert wrong == []


@pytest.mark.parametrize(
    ("text", "value"),
    [("TRUE", True), ("-4", -4), ("1.5", 1.5), (".5", 0.5), ("5.", "5."), ("x", "x"), ("1e3", "1e3")],
)
def test_typed_literal(text, value):
    found = cells.typed_literal(text)
    assert found == value and type(found) is type(value)


def test_formula_and_impossible_date(spark):
    texts = ["=1", "+a", "-1", "@x", " =1", "", None, "2026-02-30", "2026-02-28", "0001-01-01", "2026-02-30 "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `a b` string")
    rows = frame.select(
        "i", cells.is_formula_like("a b").alias("f"), cells.is_impossible_date("a b").alias("d")
    ).collect()
    assert [r.i for r in rows if r.f] == [0, 1, 2, 3]
    assert [r.i for r in rows if r.d] == [7, 9]


def test_canonical_timestamp(spark):
    texts = ["2026-01-01T00:00:00.000Z", "2026-01-01T00:00:00Z", "2026-02-30T00:00:00.000Z", None, "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(cells.is_canonical_timestamp(F.col("t"))).collect()]
    assert found == [True, False, False, False, False]
