"""Records in XML documents: discovery of the record path, and flattening.

Documents are rows of text, or of bytes in the encoding they declare (one per
file); each is parsed on its own inside a task and leaves as narrow rows, so
counting and choosing are Spark aggregates. A document that cannot be read is one
row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievetable.functions.cells import quoted
from sievetable.sources.batches import in_frames

RECORD_PATH = r"\A(?:/[^/\s]+)+\z"
MAX_DEPTH = 128


def _open(xml: str | bytes, on_start: object, on_end: object, on_text: object = None) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = on_start, on_end
    if on_text is not None:
        parser.CharacterDataHandler = on_text

    def no_entities(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    parser.EntityDeclHandler = no_entities
    parser.Parse(xml, True)


def _element_paths(xml: str | bytes) -> list[tuple[str, int, int]]:
    """(path, occurrences, occurrences with children) of one document."""
    stack: list[list] = []
    counts: dict[str, list[int]] = {}

    def start(name: str, _: dict) -> None:
        if len(stack) >= MAX_DEPTH:
            raise ValueError("the nesting is too deep")
        if stack:
            stack[-1][1] = True
        stack.append([f"{stack[-1][0] if stack else ''}/{name}", False])

    def end(_: str) -> None:
        path, parent = stack.pop()
        entry = counts.setdefault(path, [0, 0])
        entry[0] += 1
        entry[1] += parent

    _open(xml, start, end)
    return [(path, n, parents) for path, (n, parents) in counts.items()]


def element_paths(documents: DataFrame) -> DataFrame:
    """(document, path, occurrences, parents, error) from (document, xml)."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for document, xml in zip(batch["document"], batch["xml"], strict=True):
            try:
                yield from [(document, *entry, None) for entry in _element_paths(xml)]
            except (expat.ExpatError, ValueError, LookupError) as error:
                yield document, None, 0, 0, str(error)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["document", "path", "occurrences", "parents", "error"]
        for batch in batches:
            yield from in_frames(rows(batch), names)

    schema = "document string, path string, occurrences bigint, parents bigint, error string"
    return documents.select("document", "xml").mapInPandas(count, schema)


def record_paths(paths: DataFrame, *, per_document: bool = True) -> DataFrame:
    """The repeated path with children that occurs most; none when two tie.

    Returns (document,) candidates, occurrences, record_path.
    """
    by = ["document"] if per_document else []
    totals = (
        paths.filter(F.col("path").isNotNull())
        .groupBy(*by, "path")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("parents").alias("parents"))
        .filter((F.col("occurrences") > 1) & (F.col("parents") > 0))
    )
    best = totals.groupBy(*by).agg(
        F.max("occurrences").alias("occurrences"),
    )
    tied = totals.join(best, [*by, "occurrences"])
    return tied.groupBy(*by, "occurrences").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.when(F.count(F.lit(1)) == 1, F.min("path")).alias("record_path"),
    )


def _records(xml: str | bytes, record_path: str) -> Iterator[dict[str, list[str]]]:
    """Leaves and attributes of each record, by path relative to the record."""
    stack: list[str] = []
    texts: list[list] = []
    records: list[dict[str, list[str]]] = []
    current: dict[str, list[str]] | None = None
    depth = 0

    def start(name: str, attributes: dict) -> None:
        nonlocal current, depth
        if len(stack) >= MAX_DEPTH:
            raise ValueError("the nesting is too deep")
        if texts:
            texts[-1][1] = True
        stack.append(name)
        texts.append([[], False])
        if current is None and "/" + "/".join(stack) == record_path:
            current, depth = {}, len(stack)
        if current is not None:
            inner = "/".join(stack[depth:])
            for key, value in attributes.items():
                current.setdefault(f"{inner}/@{key}" if inner else f"@{key}", []).append(value)

    def text(data: str) -> None:
        if current is not None:
            texts[-1][0].append(data)

    def end(_: str) -> None:
        nonlocal current
        parts, has_child = texts.pop()
        inner = "/".join(stack[depth:])
        if current is not None:
            value = "".join(parts).strip()
            if inner and value and not has_child:
                current.setdefault(inner, []).append(value)
            if len(stack) == depth:
                records.append(current)
                current = None
        stack.pop()

    _open(xml, start, end, text)
    return iter(records)


def xml_records(documents: DataFrame) -> DataFrame:
    """(document, record, fields, error) from (document, xml, record_path).

    ``fields`` maps a relative path to its values: ``a/b`` a leaf, ``@x`` an
    attribute of the record, ``a/@x`` one further in. Repeats are kept in order.
    """

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for document, xml, path in zip(
            batch["document"], batch["xml"], batch["record_path"], strict=True
        ):
            try:
                yield from [(document, place, fields, None) for place, fields in enumerate(_records(xml, path))]
            except (expat.ExpatError, ValueError, LookupError) as error:
                yield document, None, None, str(error)

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame in in_frames(rows(batch), ["document", "record", "fields", "error"]):
                yield frame.astype({"record": "Int64"})

    schema = "document string, record bigint, fields map<string, array<string>>, error string"
    chosen = documents.filter(F.col("record_path").rlike(RECORD_PATH))
    return chosen.select("document", "xml", "record_path").mapInPandas(flatten, schema)


def record_columns(records: DataFrame, names: list[str]) -> DataFrame:
    """Chosen fields as text columns: one value as is, repeats as a JSON list.

    Rows of documents that could not be read are left out.
    """

    def shown(name: str) -> Column:
        values = F.col("fields")[name]
        return F.when(F.size(values) > 1, F.to_json(values)).otherwise(values[0]).alias(name)

    read = records.filter(F.col("record").isNotNull())
    return read.select("document", "record", *[shown(n) for n in names])


def _element_type(names: list[list[str]]) -> T.DataType:
    """Schema of an element from the inner paths that are wanted of it; a leaf may have attributes."""
    fields: dict[str, list[list[str]]] = {}
    for steps in names:
        if steps:
            fields.setdefault(steps[0], []).append(steps[1:])
    if not fields:
        return T.StringType()
    made = [
        T.StructField(name, T.StringType() if name.startswith("@") else T.ArrayType(_element_type(inner)))
        for name, inner in fields.items()
    ]
    if any(not steps for steps in names):
        made.append(T.StructField("_VALUE", T.StringType()))
    return T.StructType(made)


def _values(element: Column, data_type: T.DataType, steps: list[str]) -> Column:
    """All texts at an inner path of an element, in order."""
    if not steps:
        return F.array(element["_VALUE"] if isinstance(data_type, T.StructType) else element)
    if steps[0].startswith("@"):
        return F.array(element[steps[0]])
    inner = data_type[steps[0]].dataType.elementType
    each = F.coalesce(element[steps[0]], F.array().cast(T.ArrayType(inner)))
    return F.flatten(F.transform(each, lambda x: _values(x, inner, steps[1:])))


def _children(name: str, data_type: T.DataType) -> Callable[[Column], Column]:
    """The elements of a name inside an element; none is an empty list."""
    return lambda x: F.coalesce(x[name], F.array().cast(data_type))


def record_rows(documents: DataFrame, record_path: str, names: list[str]) -> DataFrame:
    """(document, record, error, one text column per name) by Spark's XML functions.

    Names are paths inside a record as in ``xml_records``; repeats become a JSON
    list. A document that is not well-formed is one row with an error.
    """
    steps = [s for s in record_path.split("/") if s][1:]
    inner = [[s for s in name.split("/") if s] for name in names]
    record = _element_type(inner)
    root: T.DataType = record
    for step in reversed(steps):
        root = T.StructType([T.StructField(step, T.ArrayType(root))])
    schema = T.StructType([*root.fields, T.StructField("_broken", T.StringType())])
    options = {"attributePrefix": "@", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = documents.select("document", F.from_xml("xml", schema, options).alias("root"))
    found, data_type = F.array("root"), T.ArrayType(schema)
    for step in steps:
        data_type = data_type.elementType[step].dataType
        found = F.flatten(F.transform(found, _children(step, data_type)))
    broken = parsed.filter(F.col("root").isNull() | F.col("root._broken").isNotNull()).select(
        "document",
        F.lit(None).cast("bigint").alias("record"),
        F.lit("not well-formed").alias("error"),
        *[F.lit(None).cast("string").alias(n) for n in names],
    )
    rows = parsed.filter(F.col("root._broken").isNull()).select("document", F.posexplode(found).alias("place", "element"))

    def shown(path: list[str], name: str) -> Column:
        texts = F.filter(
            F.transform(_values(F.col("element"), record, path), lambda v: F.trim(v)), lambda v: v != ""
        )
        return F.when(F.size(texts) > 1, F.to_json(texts)).otherwise(F.get(texts, F.lit(0))).alias(name)

    flat = rows.select(
        "document",
        F.col("place").cast("bigint").alias("record"),
        F.lit(None).cast("string").alias("error"),
        *[shown(p, n) for p, n in zip(inner, names, strict=True)],
    )
    return flat.unionByName(broken)


def field_names(records: DataFrame) -> DataFrame:
    """Every field with the number of records that have it."""
    each = records.select(F.explode(F.map_keys("fields")).alias("field"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("records"))


def choices(paths: DataFrame) -> DataFrame:
    """Candidate record paths per document, most frequent first."""
    totals = paths.filter((F.col("occurrences") > 1) & (F.col("parents") > 0))
    rank = F.rank().over(Window.partitionBy("document").orderBy(F.col("occurrences").desc()))
    return totals.withColumn("rank", rank).select("document", "path", "occurrences", "rank")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Elements named ``row_tag`` as flat text columns, with Spark's XML reader.

    Attributes get ``@``; a nested leaf ``b`` of ``a`` becomes ``a/b``. Use
    ``xml_records`` where the same tag occurs at several depths.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@")
    table = reader.option("inferSchema", False).option("mode", "FAILFAST").load(path)
    return flatten_structs(table)


def flatten_structs(table: DataFrame) -> DataFrame:
    """Struct columns opened into ``a/b`` columns; the text of ``a`` keeps its name."""
    picked = []

    def visit(data_type: T.DataType, column: str, name: str) -> None:
        if not isinstance(data_type, T.StructType):
            picked.append(F.col(column).alias(name))
            return
        for f in data_type.fields:
            steps = [name, "" if f.name == "_VALUE" else f.name]
            inner = "/".join(s for s in steps if s)
            visit(f.dataType, f"{column}.{quoted(f.name)}", inner)

    for f in table.schema:
        visit(f.dataType, quoted(f.name), f.name)
    return table.select(*picked)
