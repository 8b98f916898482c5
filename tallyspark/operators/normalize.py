"""Statement normalisation: raw text columns -> the ledger.

Front ends:
  * ``standardize_statement(raw)``: one header layout; the raw DataFrame's
    column names are the statement header.
  * ``sources.statements.read_statements(...)``: many CSV files with
    differing headers; builds the same role columns per layout.

Both end in ``normalize_roles``, a chain of projections plus one small
aggregate (the per-file date format election) joined back on the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.categorize import categorize
from tallyspark.functions.dates import DATE_FORMATS, date_format_bits, lowest_bit, parse_date_as
from tallyspark.functions.money import classify_type, clean_amount
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, DATE, DESC, TXN, TYPE

# Header keywords (lower-case substrings), checked left to right
# over the trimmed header names; the first header containing one wins.
DATE_KEYWORDS = ["date"]
DESC_KEYWORDS = ["desc", "detail", "payee", "merchant", "transaction"]
AMOUNT_KEYWORDS = ["amount", "value", "price"]
CATEGORY_KEYWORDS = ["cat", "tag"]

# Cell texts read as missing (pandas' default NA tokens).
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

REJECT_DATE = "no single date format fits the file"

META_COLUMNS = ("source_file", "line_no", ACCOUNT)


@dataclass(frozen=True)
class HeaderMap:
    """Positions of the mapped roles in one header (``category`` may be None)."""
    date: int
    description: int
    amount: int
    category: int | None


def map_headers(headers: list[str], columns: dict | None = None) -> HeaderMap:
    """Map a header row to roles; ``columns`` overrides by role name.

    Raises ``ValueError`` when date, description or amount stay unmapped.
    """
    names = [h.strip() for h in headers]
    low = [n.lower() for n in names]

    def first(keywords):
        return next((i for i, n in enumerate(low) if any(k in n for k in keywords)), None)

    found = {"date": first(DATE_KEYWORDS), "description": first(DESC_KEYWORDS),
             "amount": first(AMOUNT_KEYWORDS), "category": first(CATEGORY_KEYWORDS)}
    for role, name in (columns or {}).items():
        if role not in found:
            raise ValueError(f"unknown role {role!r}")
        if name is None:
            found[role] = None
            continue
        if name.strip() not in names:
            raise ValueError(f"column {name!r} not in header {names}")
        found[role] = names.index(name.strip())
    if found["date"] is None or found["description"] is None or found["amount"] is None:
        raise ValueError("Error parsing statement: Could not automatically map Date, Description, "
                         "and Amount columns. Check your CSV schema.")
    return HeaderMap(found["date"], found["description"], found["amount"], found["category"])


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TOKENS), c)


def standardize_roles(raw: DataFrame, columns: dict | None = None) -> DataFrame:
    """Single-layout raw frame -> role columns (raw_date, raw_desc, raw_amount, raw_cat)."""
    data_cols = [c for c in raw.columns if c not in META_COLUMNS]
    hm = map_headers(data_cols, columns)
    meta = [c for c in META_COLUMNS if c in raw.columns]
    cat = F.col(f"`{data_cols[hm.category]}`") if hm.category is not None else F.lit(None)
    return raw.select(
        *meta,
        F.col(f"`{data_cols[hm.date]}`").cast("string").alias("raw_date"),
        F.col(f"`{data_cols[hm.description]}`").cast("string").alias("raw_desc"),
        F.col(f"`{data_cols[hm.amount]}`").cast("string").alias("raw_amount"),
        cat.cast("string").alias("raw_cat"),
        F.lit(hm.category is not None).alias("has_category"))


def elect_date_formats(roles: DataFrame, formats=None) -> DataFrame:
    """Per file: ``date_bits``, a bit for each format that parses every non-null date.

    One ``bit_and`` per file (partial before the shuffle) over one integer a
    value; output has one row per file. No bit is left when no candidate fits.
    """
    d = missing_to_null(F.col("raw_date"))
    return roles.select("source_file", date_format_bits(d, formats).alias("bits")).groupBy("source_file").agg(
        F.bit_and("bits").alias("date_bits"))


def normalize_roles(roles: DataFrame, rules=None, formats=None, date_format: str | None = None,
                    elected: DataFrame | None = None) -> DataFrame:
    """Role columns -> ledger columns plus ``source_file`` and ``reject_reason``.

    ``elected`` (source_file, date_bits) is the date election if it was made before.
    """
    formats = DATE_FORMATS if formats is None else formats
    if "source_file" not in roles.columns:  # a plain frame is one file
        roles = roles.withColumn("source_file", F.lit("statement"))
    own_reason = F.col("row_reason") if "row_reason" in roles.columns else F.lit(None).cast("string")
    if date_format is not None:
        formats = [date_format]
        elected = roles.withColumn("fmt_idx", F.lit(0))
    else:
        if elected is None:
            elected = elect_date_formats(roles.where(own_reason.isNull()), formats)
        formats_of = elected.select("source_file", lowest_bit("date_bits").alias("fmt_idx"))
        elected = roles.join(formats_of, "source_file", "left")
    d = missing_to_null(F.col("raw_date"))
    date = None
    for i, f in enumerate(formats):
        date = (F.when(F.col("fmt_idx") == i, parse_date_as(d, f)) if date is None
                else date.when(F.col("fmt_idx") == i, parse_date_as(d, f)))
    desc = F.coalesce(missing_to_null(F.col("raw_desc")), F.lit(""))
    amount = clean_amount(missing_to_null(F.col("raw_amount")))
    category = F.when(F.col("has_category"),
                      F.coalesce(missing_to_null(F.col("raw_cat")), F.lit("Uncategorized"))
                      ).otherwise(categorize(desc, rules))
    reason = F.coalesce(own_reason, F.when(F.col("fmt_idx").isNull(), F.lit(REJECT_DATE)))
    account = F.col(ACCOUNT) if ACCOUNT in roles.columns else F.col("source_file")
    txn = F.col("line_no") if "line_no" in roles.columns else F.monotonically_increasing_id()
    return elected.select(
        account.alias(ACCOUNT), txn.alias(TXN), date.alias(DATE), desc.alias(DESC),
        amount.alias(AMOUNT), category.alias(CATEGORY), classify_type(amount).alias(TYPE),
        "source_file", "raw_date", "raw_amount", "raw_cat", formats_label(formats).alias("date_format"),
        reason.alias("reject_reason"))


def formats_label(formats) -> Column:
    expr = None
    for i, f in enumerate(formats):
        expr = (F.when(F.col("fmt_idx") == i, F.lit(f)) if expr is None
                else expr.when(F.col("fmt_idx") == i, F.lit(f)))
    return expr


LEDGER_OUT = [ACCOUNT, TXN, DATE, DESC, AMOUNT, CATEGORY, TYPE, "source_file"]


def finish(normalized: DataFrame, on_error: str = "quarantine") -> DataFrame:
    """Accepted rows as a ledger. ``on_error="fail"`` raises if any row is rejected
    (one counting job), as the reference aborts the whole file."""
    if on_error not in ("fail", "quarantine"):
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    if on_error == "fail":
        bad = normalized.where(F.col("reject_reason").isNotNull()).limit(1).collect()
        if bad:
            raise ValueError(f"Error parsing statement: {bad[0]['reject_reason']} "
                             f"({bad[0]['source_file']})")
    return normalized.where(F.col("reject_reason").isNull()).select(*LEDGER_OUT)


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reject_reason").isNotNull()).select(
        ACCOUNT, TXN, "source_file", "raw_date", "raw_amount", "reject_reason")


def standardize_statement(raw: DataFrame, columns: dict | None = None, rules=None,
                          date_format: str | None = None, on_error: str = "quarantine") -> DataFrame:
    """Raw statement (header names as columns, text cells) -> ledger."""
    roles = standardize_roles(raw, columns)
    return finish(normalize_roles(roles, rules, date_format=date_format), on_error)


def statement_rejects(raw: DataFrame, columns: dict | None = None, rules=None) -> DataFrame:
    return rejected(normalize_roles(standardize_roles(raw, columns), rules))


def parsed_dates(raw: DataFrame, columns: dict | None = None) -> DataFrame:
    """Date parsing detail: raw text, elected format per file, parsed Date."""
    n = normalize_roles(standardize_roles(raw, columns))
    return n.select(ACCOUNT, TXN, "source_file", "raw_date", "date_format", DATE)


def filled_categories(raw: DataFrame, columns: dict | None = None, rules=None) -> DataFrame:
    """Category detail: raw category text and the ledger Category."""
    n = normalize_roles(standardize_roles(raw, columns), rules)
    return n.select(ACCOUNT, TXN, "raw_cat", CATEGORY)


def cleaned_amounts(raw: DataFrame, columns: dict | None = None) -> DataFrame:
    """Amount parsing detail: raw text, parsed Amount and its Type."""
    roles = standardize_roles(raw, columns)
    amount = clean_amount(missing_to_null(F.col("raw_amount")))
    txn = F.col("line_no") if "line_no" in roles.columns else F.monotonically_increasing_id()
    return roles.select(txn.alias(TXN), "raw_amount", amount.alias(AMOUNT),
                        classify_type(amount).alias(TYPE))
