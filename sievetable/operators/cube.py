"""Dense cubes to long tables.

A cube arrives as chunks of cells in row-major order (the last dimension moves
fastest) with the index of each chunk's first cell. A cell's coordinates follow
from its index by integer division, so chunks are decoded independently and in
any order; there is no walk over the cube.

``dimensions``: cube, dimension (1-based), name, position (0-based), label, code.
``chunks``:     cube, base, cells (array of tokens as written, quotes kept).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievetable.errors import DataError
from sievetable.operators.quality import issue
from sievetable.operators.skew import salted_join

# Cell grammar and default bounds.
SYMBOL_TOKEN = r'\A"(-|\.{1,6})"\z'
NUMBER_TOKEN = r"\A[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?\z"
MAX_DIMENSIONS = 64
MAX_VALUES_PER_DIMENSION = 1_000_000
MAX_CELLS = 100_000_000
RESERVED_NAMES = ("value", "value__symbol")
# Labels of a cube that one row holds, and labels of a page beyond that.
LABELS_IN_ROW = 65_536
PAGE = 1024


@dataclass(frozen=True)
class Binding:
    """Column names of one dimension."""

    label: str
    code: str | None


def unused_name(wanted: str, used: set[str]) -> str:
    """``wanted``, with the first number from 2 that makes it unlike all used names (in lower case)."""
    numbered = chain([wanted], (f"{wanted}__{n}" for n in count(2)))
    return next(name for name in numbered if name.lower() not in used)


def column_bindings(dimensions: Sequence[tuple[str, bool]]) -> list[Binding]:
    """Column names for (dimension name, has codes) pairs, all different whatever their case.

    ``value`` and ``value__symbol`` belong to the cells; a blank name is ``dimension``.
    """
    used = set(RESERVED_NAMES)
    bindings: list[Binding] = []
    for name, coded in dimensions:
        label = unused_name(name.strip() or "dimension", used)
        code = unused_name(f"{label}__code", used | {label.lower()}) if coded else None
        used.update(c.lower() for c in (label, code) if c is not None)
        bindings.append(Binding(label, code))
    return bindings


def cell_symbol(token: Column) -> Column:
    """The missing-value symbol of a quoted token, else null."""
    return F.when(token.rlike(SYMBOL_TOKEN), F.regexp_extract(token, SYMBOL_TOKEN, 1))


def cell_value(token: Column) -> Column:
    """The finite number of an unquoted token, else null."""
    value = F.when(token.rlike(NUMBER_TOKEN), token.try_cast("double"))
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def shapes(dimensions: DataFrame, *, max_cells: int | None = MAX_CELLS) -> DataFrame:
    """One row per cube: names, cardinalities, strides, labels, codes, cells.

    The lists are file metadata: at most 64 dimensions of a million values.
    ``expected`` is null when the product passes ``max_cells`` (or 64 bits).
    """
    lists = dimensions.groupBy("cube", "dimension").agg(
        F.max("name").alias("name"),
        F.count(F.lit(1)).alias("size"),
        F.array_sort(F.collect_list(F.struct("position", "label", "code"))).alias("values"),
    )
    entry = F.struct("dimension", "name", "size", "values")
    cubes = lists.groupBy("cube").agg(F.array_sort(F.collect_list(entry)).alias("d"))
    sizes = F.transform("d", lambda x: x["size"])

    def product(values: Column) -> Column:
        return F.aggregate(values, F.lit(1).cast("bigint"), lambda a, x: F.try_multiply(a, x))

    strides = F.transform(
        F.col("d"), lambda x, i: product(F.slice(sizes, i + 2, F.size("d") - i - 1))
    )
    expected = product(sizes)
    if max_cells is not None:
        expected = F.when(expected <= max_cells, expected)
    return cubes.select(
        "cube",
        F.transform("d", lambda x: x["name"]).alias("names"),
        sizes.alias("sizes"),
        strides.alias("strides"),
        F.transform("d", lambda x: F.transform(x["values"], lambda v: v["label"])).alias("labels"),
        F.transform("d", lambda x: F.transform(x["values"], lambda v: v["code"])).alias("codes"),
        expected.alias("expected"),
    )


def check_dimensions(dimensions: DataFrame) -> DataFrame:
    """One row per broken bound: too many dimensions, too many values."""
    sizes = dimensions.groupBy("cube", "dimension").agg(F.count(F.lit(1)).alias("actual"))
    wide = sizes.filter(F.col("actual") > MAX_VALUES_PER_DIMENSION).select(
        "cube", F.lit("too many values").alias("problem"), "actual"
    )
    many = (
        sizes.groupBy("cube")
        .agg(F.count(F.lit(1)).alias("actual"))
        .filter(F.col("actual") > MAX_DIMENSIONS)
        .select("cube", F.lit("too many dimensions").alias("problem"), "actual")
    )
    return wide.unionByName(many)


def layouts(dimensions: DataFrame) -> DataFrame:
    """One row per cube: sizes and strides of its dimensions, and its cells (null beyond 64 bits)."""
    counted = dimensions.groupBy("cube", "dimension").agg(F.count(F.lit(1)).alias("size"))
    entry = F.array_sort(F.collect_list(F.struct("dimension", "size")))
    sizes = counted.groupBy("cube").agg(F.transform(entry, lambda x: x["size"]).alias("sizes"))

    def product(values: Column) -> Column:
        return F.aggregate(values, F.lit(1).cast("bigint"), lambda a, x: F.try_multiply(a, x))

    strides = F.transform("sizes", lambda x, i: product(F.slice("sizes", i + 2, F.size("sizes") - i - 1)))
    return sizes.select("cube", "sizes", strides.alias("strides"), product(F.col("sizes")).alias("expected"))


def decode(chunks: DataFrame, dimensions: DataFrame, *, labels_in_row: int = LABELS_IN_ROW) -> DataFrame:
    """One row per cell: cube, index, labels, codes, value, symbol, token.

    Labels join the chunks, not the cells. All labels of a cube stand in one row where
    no cube has more than ``labels_in_row``; beyond that a chunk gets its own labels alone.
    """
    most = dimensions.groupBy("cube").count().agg(F.max("count")).first()[0] or 0
    cells = _labelled_by_row(chunks, dimensions) if most <= labels_in_row else _labelled_by_page(chunks, dimensions)
    return cells.select(
        "cube",
        "index",
        "labels",
        "codes",
        cell_value(F.col("token")).alias("value"),
        cell_symbol(F.col("token")).alias("value__symbol"),
        "token",
    )


def _labelled_by_row(chunks: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(cube, index, labels, codes, token) from one row of lists per cube.

    A cube with very many chunks is spread over several tasks.
    """
    meta = shapes(dimensions, max_cells=None).select(
        "cube", "sizes", "strides", "labels", "codes", "expected"
    )
    placed = salted_join(
        chunks, meta, ["cube"], "expected", hot_weight=10_000_000, spread_by=["base"]
    )
    # Labels are picked inside the chunk, so the exploded rows carry only their
    # own labels and not the lists they were picked from.
    pick = "transform(strides, (s, d) -> {0}[d][CAST(((base + at) DIV s) % sizes[d] AS INT)])"
    cells = F.expr(
        f"""transform(cells, (token, at) -> struct(
              base + at AS index,
              {pick.format("labels")} AS labels,
              {pick.format("codes")} AS codes,
              token))"""
    )
    return placed.select("cube", F.inline(cells))


def page_requests(spans: DataFrame) -> DataFrame:
    """(cube, base, dimension, page, turn, low, high): the positions that each chunk needs, by page.

    A chunk's cells run through a stretch of positions of each dimension, which may go on
    at position 0; that part is turn 1. ``high`` is exclusive.
    """
    axes = F.expr(
        """transform(strides, (s, d) -> named_struct('dimension', d, 'size', sizes[d], 'low', (base DIV s) % sizes[d],
             'count', least(sizes[d], (base + size(cells) - 1) DIV s - base DIV s + 1)))"""
    )
    needed = spans.select("cube", "base", F.inline(axes))
    turns = F.expr(
        """filter(array(named_struct('turn', 0, 'low', low, 'high', least(size, low + count)),
             named_struct('turn', 1, 'low', CAST(0 AS BIGINT), 'high', low + count - size)), x -> x.high > x.low)"""
    )
    parts = needed.select("cube", "base", "dimension", F.inline(turns))
    page = F.explode(F.sequence(F.floor(F.col("low") / PAGE), F.floor((F.col("high") - 1) / PAGE))).alias("page")
    cut = parts.select("*", page)
    return cut.withColumns(
        {
            "low": F.greatest(F.col("low"), F.col("page") * PAGE),
            "high": F.least(F.col("high"), (F.col("page") + 1) * PAGE),
        }
    )


def _labelled_by_page(chunks: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(cube, index, labels, codes, token) with labels as pages of rows.

    A chunk asks for the pages of the positions it runs through, and gets their labels cut
    to these. A page that very many chunks ask for is spread over several tasks.
    """
    values = F.array_sort(F.collect_list(F.struct("position", "label", "code")))
    place = F.dense_rank().over(Window.partitionBy("cube").orderBy("dimension")) - 1
    axes = dimensions.select("cube", "dimension").distinct().withColumn("place", place)
    pages = (
        dimensions.join(axes, ["cube", "dimension"])
        .groupBy("cube", F.col("place").alias("dimension"), F.floor(F.col("position") / PAGE).alias("page"))
        .agg(values.alias("values"))
    )
    layout = layouts(dimensions).select("cube", "sizes", "strides", "expected")
    spans = salted_join(
        chunks, layout, ["cube"], "expected", hot_weight=10_000_000, spread_by=["base"]
    ).filter(F.size("cells") > 0)
    found = salted_join(page_requests(spans), pages, ["cube", "dimension", "page"], spread_by=["base"])
    own = F.slice("values", (F.col("low") - F.col("page") * PAGE + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    part = F.struct("dimension", "turn", "page", own.alias("values"))
    lists = found.groupBy("cube", "base").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    own_lists = F.expr(
        "transform(strides, (s, d) -> flatten(transform(filter(parts, x -> x.dimension = d), x -> x.values)))"
    )
    placed = spans.join(lists, ["cube", "base"]).withColumn("lists", own_lists)
    at = "CAST((((base + at) DIV s) - (base DIV s)) % sizes[d] AS INT)"
    cells = F.expr(
        f"""transform(cells, (token, at) -> struct(
              base + at AS index,
              transform(strides, (s, d) -> lists[d][{at}].label) AS labels,
              transform(strides, (s, d) -> lists[d][{at}].code) AS codes,
              token))"""
    )
    return placed.select("cube", F.inline(cells))


def to_columns(
    cells: DataFrame, bindings: Sequence[Binding], keep: Sequence[str] = ()
) -> DataFrame:
    """Long table of one kind of cube, a column per label and code."""
    columns = []
    for i, binding in enumerate(bindings):
        columns.append(F.col("labels")[i].alias(binding.label))
        if binding.code is not None:
            columns.append(F.col("codes")[i].alias(binding.code))
    return cells.select(*keep, "index", *columns, "value", "value__symbol")


def prefix(chunks: DataFrame, rows: int) -> DataFrame:
    """Chunks cut to the first ``rows`` cells of each cube, before expansion."""
    keep = F.greatest(F.lit(0), F.least(F.size("cells"), (F.lit(rows) - F.col("base")).cast("int")))
    kept = chunks.filter(F.col("base") < rows)
    return kept.withColumn("cells", F.slice("cells", F.lit(1), keep))


def symbol_counts(cells: DataFrame) -> DataFrame:
    """Occurrences of each missing-value symbol."""
    return (
        cells.filter(F.col("value__symbol").isNotNull())
        .groupBy("cube", F.col("value__symbol").alias("symbol"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def symbol_issues(cells: DataFrame) -> DataFrame:
    """PCAXIS_DATA_SYMBOL warnings."""
    context = F.create_map(
        F.lit("symbol"), F.col("symbol"), F.lit("occurrences"), F.col("occurrences").cast("string")
    )
    return symbol_counts(cells).select(
        "cube",
        *issue(
            "PCAXIS_DATA_SYMBOL",
            arguments=[F.col("symbol")],
            occurrences=F.col("occurrences"),
            context=context,
        ),
    )


def cell_counts(chunks: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Expected and actual number of cells per cube."""
    actual = chunks.groupBy("cube").agg(F.sum(F.size("cells")).alias("actual"))
    expected = layouts(dimensions).select("cube", "expected")
    joined = expected.join(actual, "cube", "full")
    return joined.select(
        "cube",
        "expected",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("complete"),
    )


def invalid_cells(cells: DataFrame) -> DataFrame:
    """Cells that are neither a finite number nor a known quoted symbol."""
    return cells.filter(F.col("value").isNull() & F.col("value__symbol").isNull())


def invalid_tokens(chunks: DataFrame) -> DataFrame:
    """(cube, token) of the cells that are neither a finite number nor a known symbol."""
    tokens = chunks.select("cube", F.explode("cells").alias("token"))
    return tokens.filter(cell_value(F.col("token")).isNull() & cell_symbol(F.col("token")).isNull())


def require_complete(chunks: DataFrame, dimensions: DataFrame) -> None:
    """Raise when a cube's cells do not fill its dimensions."""
    wrong = cell_counts(chunks, dimensions).filter(~F.col("complete")).limit(1).collect()
    if wrong:
        raise DataError(
            "PCAXIS_CELL_COUNT_MISMATCH",
            "The cells do not fill the dimensions.",
            cube=wrong[0].cube,
            expected=wrong[0].expected,
            actual=wrong[0].actual,
        )
