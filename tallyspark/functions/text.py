"""Text expressions shared by ingest and the report/prompt operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``),
# written as a Java regex class.
PY_SPACE_CLASS = (r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as code points, for ``btrim`` (a character-set trim, no regex).
PY_SPACE_CHARS = "".join(chr(c) for c in [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def bold_to_tags(c) -> Column:
    """``**x**`` -> ``<b>x</b>``, shortest match, left to right.

    ``(?s)`` lets ``.`` cross ``\\r`` and other breaks, as Python's ``.``
    does for text without ``\\n``.
    """
    return F.regexp_replace(_col(c), r"(?s)\*\*(.*?)\*\*", "<b>$1</b>")


def json_string(c) -> Column:
    r"""A string as ``json.dumps`` writes it: quotes, Python's escape table,
    and every character outside printable ASCII as a lower-case ``\uXXXX``
    (above U+FFFF as a surrogate pair). Null gives ``null``.

    Printable-ASCII strings (the common case) take two ``replace`` calls;
    others are escaped code point by code point.
    """
    x = _col(c)
    simple = F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'),
                                            F.lit('\\"')), F.lit('"'))
    chars = F.regexp_extract_all(x, F.lit(r"(?s)(.)"), 1)

    def esc(ch):
        cp = F.ascii(ch)
        hi = F.lit(0xD800) + F.shiftright(cp - F.lit(0x10000), 10)
        lo = F.lit(0xDC00) + (cp - F.lit(0x10000)).bitwiseAND(F.lit(0x3FF))
        return (F.when(ch == "\\", F.lit("\\\\")).when(ch == '"', F.lit('\\"'))
                 .when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r"))
                 .when(ch == "\t", F.lit("\\t")).when(ch == "\b", F.lit("\\b"))
                 .when(ch == "\f", F.lit("\\f"))
                 .when((cp >= 32) & (cp < 127), ch)
                 .when(cp < 0x10000, F.format_string("\\u%04x", cp))
                 .otherwise(F.format_string("\\u%04x\\u%04x", hi, lo)))
    full = F.concat(F.lit('"'), F.array_join(F.transform(chars, esc), ""), F.lit('"'))
    return (F.when(x.isNull(), F.lit("null"))
             .when(x.rlike(r"^[\x20-\x7E]*\z"), simple)
             .otherwise(full))
