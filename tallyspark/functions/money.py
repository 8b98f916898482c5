"""Money expressions: exact sums, amount parsing, and text forms.

All are Column -> Column builders over built-in Spark functions, so they stay
inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.schema import MONEY_DECIMAL, ROW_DECIMAL

# Characters removed from amount text before parsing, and the
# shape a cleaned amount must have to count as a number (sign, digits, an
# optional point, an optional exponent; surrounding white space allowed).
CURRENCY_CHARS = "$€£,"
NUMERIC_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """Sum of money as an exact decimal (order-independent, unlike doubles); null when there is nothing to sum.

    Rows are summed with ten decimal places and never rounded one by one. Rows
    of 1e18 or more have no decimal places left to lose and are added in double
    precision; a sum that even the wide decimal can't hold is null. Nothing
    raises.
    """
    x = _col(c)
    row = x.try_cast(ROW_DECIMAL)
    beyond = F.sum(F.when(row.isNull(), x.cast("double")))
    wide = (beyond + F.coalesce(F.try_sum(row).cast("double"), F.lit(0.0))).try_cast(MONEY_DECIMAL)
    return F.when(beyond.isNull(), F.try_sum(row)).otherwise(wide)


def exact_total(c) -> Column:
    """``exact_sum`` with 0 for an empty group (and null only for a sum out of range)."""
    x = _col(c)
    return F.when(F.count(x) == 0, F.lit(0).cast(MONEY_DECIMAL)).otherwise(exact_sum(x))


def to_cents(c) -> Column:
    """Round an exact decimal to cents (HALF_UP) and return a double."""
    return F.round(_col(c), 2).cast("double")


def safe_ratio_pct(num, den) -> Column:
    """``num / den * 100`` when ``den > 0`` else 0.0 (ANSI-safe division)."""
    num, den = _col(num), _col(den)
    return F.when(den > 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))


def round_half_up(c, digits: int) -> Column:
    """Round a double HALF_UP on its shortest decimal text, returning double.

    The double is first taken to an exact decimal with ten places, so both
    Spark and SQL engines that round the binary value agree.
    """
    return F.round(_col(c).try_cast("decimal(38,10)"), digits).cast("double")


def clean_amount(raw) -> Column:
    """Parse amount text: drop currency signs and commas, coerce, else 0.0.

    Text that is not a plain number (``(45.00)``, ``12.5d``, ``n/a``, null,
    ``inf``, ``nan``) becomes 0.0, as in the reference's coercion. Digits are
    ASCII only (Python's ``float`` would also take other scripts' digits).
    """
    stripped = F.regexp_replace(_col(raw).cast("string"), "[$€£,]", "")
    parsed = F.when(stripped.rlike(NUMERIC_SHAPE), stripped.try_cast("double"))
    finite = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    return F.coalesce(finite, F.lit(0.0))


def classify_type(amount) -> Column:
    """'Credit' for ``Amount >= 0`` (so 0 is a credit), else 'Debit'."""
    return F.when(_col(amount) >= 0, F.lit("Credit")).otherwise(F.lit("Debit"))


def amount_text(c) -> Column:
    """Python's ``str(float)`` for a double (Spark prints 1.0E7, Python 10000000.0).

    Plain digits for 1e-4 <= |x| < 1e16 (Spark's own text, or an exact decimal
    for the ranges where Java switches to exponent form); Python's exponent
    form (``1e-05``, ``1.5e+16``) outside it; ``inf``/``nan`` as Python. Digits
    are Java's shortest-form digits, which on JDK 17 are rarely one longer
    than Python's (e.g. subnormals).
    """
    x = _col(c)
    java = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0*$", "$1")
    sci_re = r"^(-?\d+)(?:\.(\d+))?E(-?)(\d+)$"
    frac = F.regexp_extract(java, sci_re, 2)
    mant = F.when(frac == "0", F.regexp_extract(java, sci_re, 1)).otherwise(
        F.concat(F.regexp_extract(java, sci_re, 1), F.lit("."), frac))
    digits = F.regexp_extract(java, sci_re, 4)
    exp = F.concat(F.when(F.regexp_extract(java, sci_re, 3) == "-", F.lit("-")).otherwise(F.lit("+")),
                   F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    sci = F.concat(mant, F.lit("e"), exp)
    ax = F.abs(x)
    return (F.when(F.isnan(x), F.lit("nan"))
             .when(x == float("inf"), F.lit("inf"))
             .when(x == float("-inf"), F.lit("-inf"))
             .when((ax >= 1e16) | ((x != 0) & (ax < 1e-4)), sci)
             .when((ax >= 1e7) | ((x != 0) & (ax < 1e-3)), plain)
             .otherwise(java))


def money_text(c) -> Column:
    """``f"${x:,.2f}"``: ``$1,234.56``, negatives as ``$-1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(_col(c), 2))


def percent_text(c, digits: int = 1) -> Column:
    """``f"{x:.1f}%"``: no thousands separator."""
    return F.concat(F.regexp_replace(F.format_number(_col(c), digits), ",", ""), F.lit("%"))


def float_commas_text(c) -> Column:
    """``f"{x:,}"`` for a value already rounded to at most 2 decimals.

    Python prints the shortest form with at least one decimal, e.g.
    ``5,000.0``, ``1,234.5``, ``0.25``.
    """
    two = F.format_number(_col(c), 2)
    return F.regexp_replace(two, r"(\.\d)0$", "$1")
