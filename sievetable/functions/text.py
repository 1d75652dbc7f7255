"""Text clean-up: line folding, escaping, ordering keys, URL redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control and bidirectional characters shown as \uXXXX.
UNSAFE_TEXT = r"[\x{00}-\x{1F}\x{7F}-\x{9F}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
UNSAFE_JSON = r"[\x{7F}-\x{9F}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"

# Query parameters that hold secrets.
SECRET_PARAMETERS = (
    r"access[_-]?token|api[_-]?key|authorization|credential|key|password|secret|sig|signature|token"
)
INVALID_URL_MARKER = "[REDACTED_INVALID_URL]"

HTTP_URL = r"(?i)\Ahttps?://(?:[^\s/?#]*@)?[^\s/?#@<>\[\]^|%\\:]+(?::\d{0,5})?(?:[/?#].*)?\z"


def fold_line_wraps(text: Column) -> Column:
    """A line break and the blanks around it become one space."""
    return F.regexp_replace(text, r"[ \t]*(?:\r\n|\r|\n)[ \t]*", " ")


def _escape(text: Column, unsafe: str) -> Column:
    def one(character: Column) -> Column:
        code = F.lpad(F.lower(F.hex(F.ascii(character).cast("bigint"))), 4, "0")
        return F.when(character.rlike(unsafe), F.concat(F.lit("\\u"), code)).otherwise(character)

    # Only text that has such a character is taken apart.
    escaped = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(unsafe), escaped).otherwise(text)


def escape_text(text: Column) -> Column:
    """Text safe to print on a terminal."""
    return _escape(F.coalesce(text, F.lit("")), UNSAFE_TEXT)


def escape_json(json: Column) -> Column:
    """JSON text without hidden or direction-changing characters."""
    return _escape(json, UNSAFE_JSON)


def is_http_url(url: Column) -> Column:
    """Absolute URL with scheme http or https and a host."""
    return F.coalesce(F.trim(url).rlike(HTTP_URL), F.lit(False))


def url_path(url: Column) -> Column:
    """Lower-case path of a URL, or empty text."""
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def redact_url(url: Column) -> Column:
    """URL without user, password or secret query values."""
    bare = F.regexp_replace(F.trim(url), r"\A([A-Za-z]+://)[^/?#]*@", "$1")
    rooted = F.regexp_replace(bare, r"\A([A-Za-z]+://[^/?#]+)(\z|[?#])", "$1/$2")
    hidden = F.regexp_replace(
        rooted, rf"(?i)([?&])({SECRET_PARAMETERS})(?:=[^&#]*)?(?=[&#]|\z)", "$1$2=REDACTED"
    )
    return F.when(is_http_url(url), hidden).otherwise(F.lit(INVALID_URL_MARKER))


def natural_key(text: Column) -> Column:
    """Sort key that compares runs of digits as numbers and ignores case."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))

    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, r"\A0+(?=\d)", "")
        number = F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)
        return F.when(part.rlike(r"\A\d"), F.concat(F.lit("0"), number)).otherwise(
            F.concat(F.lit("1"), F.lower(part))
        )

    return F.transform(parts, key)
