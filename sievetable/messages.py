"""Texts of data-quality issues.

Fixed values: code -> (severity, message, recommendation). Messages are
``format_string`` templates.
"""

from __future__ import annotations

from pyspark.sql import types as T

DATA_ISSUES = {
    "DUPLICATE_HEADER": (
        "error",
        "Header '%s' is duplicated.",
        "Rename columns so every header is unique.",
    ),
    "INCONSISTENT_COLUMN_COUNT": (
        "error",
        "Row %d has %d columns; expected %d.",
        "Add or remove fields so the row matches the header width.",
    ),
    "DUPLICATE_ROW": (
        "warning",
        "Row %d duplicates row %d.",
        "Confirm the duplicate is intentional or remove it.",
    ),
    "FORMULA_LIKE_VALUE": (
        "warning",
        "A value begins with a spreadsheet formula trigger.",
        "Treat the value as untrusted text.",
    ),
    "INVALID_DATE": (
        "warning",
        "Value '%s' looks like an invalid calendar date.",
        "Use a real YYYY-MM-DD date.",
    ),
    "MIXED_TYPES": (
        "warning",
        "Column '%s' contains mixed value types.",
        "Normalize the column to one type.",
    ),
    "NULL_HEAVY_COLUMN": (
        "warning",
        "Column '%s' is at least 50%% empty.",
        "Document missing values.",
    ),
    "INVALID_ENCODING": (
        "error",
        "The file is not valid UTF-8.",
        "Convert the source to UTF-8 without replacing invalid bytes.",
    ),
    "DELIMITER_MISMATCH": (
        "warning",
        "The file extension disagrees with the detected %s delimiter.",
        "Rename the file or correct its delimiter.",
    ),
    "MALFORMED_DELIMITED_DATA": (
        "error",
        "The delimited file cannot be parsed.",
        "Repair quoting, escaping, and record boundaries.",
    ),
    "PARSE_ERROR": (
        "error",
        "The structured data cannot be parsed.",
        "Repair the malformed record or replace the file.",
    ),
    "EMPTY_HEADER": ("warning", "Header is empty.", "Name every column."),
    "PCAXIS_DATA_SYMBOL": (
        "warning",
        "The source DATA contains the PC-Axis symbol \"%s\", emitted as null.",
        "Review the source metadata before interpreting missing or suppressed values.",
    ),
}

DATASET_ISSUES = {
    "MISSING_TITLE": (
        "error",
        "Dataset title is missing.",
        "Add a concise, descriptive dataset title.",
        "title",
    ),
    "MISSING_DESCRIPTION": (
        "warning",
        "Dataset description is missing.",
        "Explain the dataset's purpose, coverage, and limitations.",
        "description",
    ),
    "MISSING_LICENSE": (
        "warning",
        "Dataset license is missing.",
        "Declare a machine-readable reuse license.",
        "license",
    ),
    "MISSING_ORGANIZATION": (
        "warning",
        "Dataset organization is missing.",
        "Identify the organization responsible for the dataset.",
        "organization",
    ),
    "MISSING_MODIFICATION_TIMESTAMP": (
        "warning",
        "Dataset modification timestamp is missing or invalid.",
        "Publish a valid ISO 8601 modification timestamp.",
        "modifiedAt",
    ),
}

RESOURCE_ISSUES = {
    "INVALID_RESOURCE_URL": (
        "error",
        "Resource URL is not a valid HTTP(S) URL.",
        "Publish an absolute HTTPS URL for the resource.",
        "url",
    ),
    "MISSING_TITLE": (
        "error",
        "Resource title is missing.",
        "Add a concise resource title.",
        "title",
    ),
    "MISSING_DESCRIPTION": (
        "warning",
        "Resource description is missing.",
        "Describe this resource's contents and structure.",
        "description",
    ),
    "DECLARED_FORMAT_MISMATCH": (
        "warning",
        "Declared format '%s' disagrees with detected format '%s'.",
        "Correct the declared format or replace the resource with matching content.",
        "format",
    ),
}

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("field", T.StringType()),
        T.StructField("occurrences", T.LongType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]
)
