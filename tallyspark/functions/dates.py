"""Date expressions: month buckets, parsing under one elected format, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate formats for statement dates, tried in this order;
# the first that parses every non-null value of a file is used for the file.
# "iso" means Spark's own cast (yyyy-MM-dd with an optional time part).
DATE_FORMATS = ["iso", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "yyyyMMdd",
                "yyyy/M/d", "d.M.yyyy", "d-MMM-yyyy", "MMMM d, yyyy",
                "M/d/yy", "d/M/yy", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss",
                "d/M/yyyy H:mm:ss", "d MMM yyyy", "d MMMM yyyy", "M-d-yyyy", "d-M-yyyy"]
# Two-digit years: the first year of the hundred they stand for, as strptime takes them.
TWO_DIGIT_FROM = 1969

# A loose shape every text parseable by the pattern has. Texts without it are
# not handed to the parser at all: a failed parse costs an exception inside
# Spark, a failed regex test does not.
FORMAT_SHAPES = {
    "M/d/yyyy": r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4}$",
    "d/M/yyyy": r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d{4}$",
    "M/d/yy": r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d\d$",
    "d/M/yy": r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d\d$",
    "M/d/yyyy H:mm": r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4} \d{1,2}:\d\d$",
    "d/M/yyyy H:mm": r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d{4} \d{1,2}:\d\d$",
    "M/d/yyyy H:mm:ss": r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])/\d{4} \d{1,2}:\d\d:\d\d$",
    "d/M/yyyy H:mm:ss": r"^(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/\d{4} \d{1,2}:\d\d:\d\d$",
    "d MMM yyyy": r"^\d{1,2} \p{L}+ \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} \p{L}+ \d{4}$",
    "M-d-yyyy": r"^(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])-\d{4}$",
    "d-M-yyyy": r"^(0?[1-9]|[12]\d|3[01])-(0?[1-9]|1[0-2])-\d{4}$",
    "MMM d, yyyy": r"^\p{L}+ \d{1,2}, \d+$",
    "yyyyMMdd": r"^\d{8,}$",
    "yyyy/M/d": r"^\d+/(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])$",
    "d.M.yyyy": r"^(0?[1-9]|[12]\d|3[01])\.(0?[1-9]|1[0-2])\.\d+$",
    "d-MMM-yyyy": r"^\d{1,2}-\p{L}+-\d+$",
    "MMMM d, yyyy": r"^\p{L}+ \d{1,2}, \d+$",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_as(raw, fmt: str) -> Column:
    """Parse text with one format into TIMESTAMP_NTZ; null when it does not fit.

    Time zone independent: the text is read as a wall-clock date/time.
    """
    s = F.trim(_col(raw))
    if fmt == "iso":
        return s.try_cast("timestamp_ntz")
    if "H" in fmt:  # date and time are parsed apart: the wall clock, whatever the session's zone
        day = F.try_to_date(F.substring_index(s, " ", 1), fmt.split(" ")[0])
        parsed = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.substring_index(s, " ", -1)).try_cast("timestamp_ntz")
        parsed = F.when(day.isNotNull(), parsed)
    else:
        day = F.try_to_date(s, fmt)
        if "yyyy" not in fmt and "yy" in fmt:
            day = F.when(F.year(day) >= TWO_DIGIT_FROM + 100, F.add_months(day, -1200)).otherwise(day)
        parsed = day.cast("timestamp_ntz")
    shape = FORMAT_SHAPES.get(fmt)
    return F.when(s.rlike(shape), parsed) if shape else parsed


# Formats by the shape of their texts; a text is only handed to the parsers of its own shape.
_SLASH, _DASH, _WORD = r"^\d{1,2}/\d{1,2}/", r"^\d{1,2}-", r"^\p{L}|^\d{1,2}[ -]\p{L}"
_FAMILIES = [
    (_SLASH, ("M/d/yyyy", "d/M/yyyy", "M/d/yy", "d/M/yy", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss")),
    (_WORD, ("MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy")),
    (r"^\d{1,2}\.", ("d.M.yyyy",)),
    (_DASH, ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d+/", ("yyyy/M/d",)),
    (r"^\d{8,}$", ("yyyyMMdd",)),
]


def date_format_bits(raw, formats=None) -> Column:
    """An integer with bit i set if format i parses the text; all bits for null.

    The bits of a file's values are merged by ``bit_and``; the lowest one that
    is left is the file's format. A value is tried only with the formats whose
    texts look like it.
    """
    formats = DATE_FORMATS if formats is None else formats
    raw = _col(raw)
    s = F.trim(raw)
    bit = lambda f: F.when(parse_date_as(raw, f).isNotNull(), F.lit(1 << formats.index(f))).otherwise(F.lit(0))
    known, bits = {"iso"}, None
    for shape, family in _FAMILIES:
        known |= set(family)
        found = F.lit(0)
        for f in family:
            if f in formats:
                found = found.bitwiseOR(bit(f))
        bits = F.when(s.rlike(shape), found) if bits is None else bits.when(s.rlike(shape), found)
    bits = bits.otherwise(bit("iso") if "iso" in formats else F.lit(0))
    for f in formats:
        if f not in known:  # a caller's own format
            bits = bits.bitwiseOR(bit(f))
    return F.when(raw.isNull(), F.lit((1 << len(formats)) - 1)).otherwise(bits)


def lowest_bit(bits) -> Column:
    """Index of the lowest bit that is set; null for 0."""
    b = _col(bits)
    return F.when(b != 0, F.log2(b.bitwiseAND(-b)).cast("int"))


def month_start(c) -> Column:
    """First day of the month as DATE (pandas ``to_period('M')``)."""
    return F.trunc(_col(c), "month")


def month_label(c) -> Column:
    """``YYYY-MM`` text of a month."""
    return F.date_format(_col(c), "yyyy-MM")


def day_ordinal(c) -> Column:
    """Days since 1970-01-01; a constant shift of Python's ``toordinal``."""
    return F.unix_date(_col(c).cast("date"))


def wall_micros(c) -> Column:
    """Microseconds of a wall-clock time since 1970-01-01, whatever the session's time zone."""
    x = _col(c)
    seconds = F.unix_date(x.cast("date")).cast("bigint") * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    return seconds * 1_000_000 + F.date_format(x, "SSSSSS").cast("bigint")
