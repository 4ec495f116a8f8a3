"""Text helpers, all built from Spark column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import as_column

# Characters with a meaning in HTML; the ampersand goes first (fixed values).
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
)


def contains_text(column: Column | str, query: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` are plain characters.

    A null text counts as empty. Both sides go through Spark's ``lower``.
    """
    text = F.lower(F.coalesce(as_column(column), F.lit("")))
    return F.contains(text, F.lower(F.lit(query)))


def escape_html(column: Column | str) -> Column:
    """Text safe inside HTML; null becomes empty text."""
    text = F.coalesce(as_column(column).cast("string"), F.lit(""))
    for plain, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def thousands(column: Column | str) -> Column:
    """Whole number with comma groups: 18400 becomes ``18,400``."""
    return F.format_number(as_column(column), 0)
