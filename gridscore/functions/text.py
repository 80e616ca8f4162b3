"""Text helpers with the whitespace and counting rules of the record format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
SPACE_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set, and every character but a line terminator, for regular expressions.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
ANY = "[^\\n\\r\\u2028\\u2029]"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE_CHARACTERS))


def truncated(value: Column, code_points: int) -> Column:
    """First ``code_points`` characters; Spark counts code points, so pairs stay whole."""
    return F.substring(value, 1, code_points)


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(trimmed(value)) == 0, F.lit(True))


def round_half_up(value: Column) -> Column:
    """Round to an integer with halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def escape_xml(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value
