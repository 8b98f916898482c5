"""CSV bank statements with differing headers -> one ledger.

Spark's CSV reader binds columns by position to one header, so a folder that
mixes layouts cannot be read by name. Instead files are read as text, by many
tasks each, and put together to records (``sources.records``):

1. the first record of each file is its header;
2. header names are mapped to roles with array functions, file by file;
3. the files' role positions are joined to the records, the role fields are
   picked by position from as many fields as there are, and written with a bit
   for each date format that fits (``functions.dates.date_format_bits``);
4. the bits of a file are and-ed, and each date is parsed once, by the first
   format that is left.

No header or row passes through the driver, and the plan does not grow with
the number of layouts. Every file that is listed gives rows or one reject:
wrong suffix, no byte, no header, a header without the roles, a quoted field
that is never closed, bytes that can't be read. A record with more fields than
its header is one reject. All other files and records go on.

Counts of files, records and rejects are taken by observers while the tables
are written (``Ingest.metrics``); no job runs for them alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import DATE_FORMATS, date_format_bits
from tallyspark.operators.normalize import (AMOUNT_KEYWORDS, CATEGORY_KEYWORDS, DATE_KEYWORDS,
                                            DESC_KEYWORDS, REJECT_DATE, finish, missing_to_null,
                                            normalize_roles, rejected)
from tallyspark.schema import ACCOUNT, TXN
from tallyspark.session import materialize
from tallyspark.sources.records import Records, accepted, list_files, read_records, record_fields

ACCEPTED_SUFFIXES = (".csv",)

REJECT_SUFFIX = "unsupported file format"
REJECT_EMPTY = "no header line"
REJECT_HEADER = "could not map date, description and amount columns"
REJECT_WIDE = "more fields than the header"
REJECT_OPEN = "a quoted field is never closed"
REJECT_READ = "could not be read"
WARN_TWO_ROLES = "one header fills two roles"

ROLE_KEYWORDS = {"date": DATE_KEYWORDS, "description": DESC_KEYWORDS,
                 "amount": AMOUNT_KEYWORDS, "category": CATEGORY_KEYWORDS}


def field_count(text: Column, width: int, sep: str) -> Column:
    """Fields of a record, counted on its own text; records of exactly ``width`` fields come without."""
    bare = F.regexp_replace(text, r'(?s)"(?:[^"]|"")*"', "")
    return F.when(text.isNull(), F.lit(width)).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1)


def _position(names: Column, keywords: list[str]) -> Column:
    """1-based position of the first name that holds a keyword; null if none does."""
    def holds(name):
        cond = F.lit(False)
        for k in keywords:
            cond = cond | name.contains(k)
        return cond
    return F.nullif(F.array_position(F.transform(names, lambda x: holds(F.lower(x))), True), F.lit(0))


def statement_layouts(spark: SparkSession, paths, records: Records, columns: dict | None = None,
                      suffixes=ACCEPTED_SUFFIXES, sep: str = ",") -> DataFrame:
    """One row per listed file: its header, the position of each role in it, warnings, and why it is rejected (or null).

    ``columns`` names the header of a role (or None for no such column)
    instead of the keywords. A header that fills two roles is named in
    ``warnings``.
    """
    for role in columns or {}:
        if role not in ROLE_KEYWORDS:
            raise ValueError(f"unknown role {role!r}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = records.heads().select(
        "source_file", F.transform(record_fields(F.col("value"), sep),
                                   lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))).alias("header"))
    files = (list_files(spark, paths).join(records.files.withColumnRenamed("bytes", "read"), "source_file", "left")
             .join(heads, "source_file", "left").withColumn("width", F.size("header")))
    for role, keywords in ROLE_KEYWORDS.items():
        if role in (columns or {}):
            name = columns[role]
            found = (F.lit(None).cast("bigint") if name is None
                     else F.nullif(F.array_position("header", name.strip()), F.lit(0)))
        else:
            found = _position(F.col("header"), keywords)
        files = files.withColumn(f"{role}_at", found.cast("int"))
    places = [F.col(f"{role}_at") for role in ROLE_KEYWORDS]
    # array_position gives the first role of a header: a later one of the same header shares it.
    shared = F.filter(F.array(*places), lambda p: F.size(F.filter(F.array(*places), lambda q: q == p)) > 1)
    files = files.withColumn("warnings", F.transform(F.array_distinct(shared), lambda p: F.concat(
        F.lit(WARN_TWO_ROLES + ": "), F.get("header", p - 1))))
    unmapped = F.col("date_at").isNull() | F.col("description_at").isNull() | F.col("amount_at").isNull()
    # Bytes of a whole file: every line and its line feed, which the last one may lack; a mark of three bytes is skipped.
    gap = F.col("size") - F.coalesce("read", F.lit(0))
    cut_off = ~gap.isin(-1, 0, 2, 3) & (F.col("size") > 0)
    reason = (F.when(~accepted(F.col("source_file"), suffixes), F.lit(REJECT_SUFFIX))
               .when(cut_off, F.lit(REJECT_READ))
               .when(F.col("open_end"), F.lit(REJECT_OPEN))
               .when(F.col("header").isNull(), F.lit(REJECT_EMPTY))
               .when(unmapped, F.lit(REJECT_HEADER)))
    return files.withColumn("file_reason", reason).drop("size", "read")


def rejected_files(layouts: DataFrame) -> DataFrame:
    """Files that give no row, in the shape of row rejects (no line, no texts)."""
    text = F.lit(None).cast("string")
    return layouts.where(F.col("file_reason").isNotNull()).select(
        F.col("source_file").alias(ACCOUNT), F.lit(None).cast("bigint").alias(TXN), "source_file",
        text.alias("raw_date"), text.alias("raw_amount"), F.col("file_reason").alias("reject_reason"))


def statement_roles(records: Records, layouts: DataFrame, sep: str = ",") -> DataFrame:
    """Role columns of all usable files; ``line_no`` counts a file's records from its header (0)."""
    usable = layouts.where(F.col("file_reason").isNull()).select(
        "source_file", "plain", "splits", "width", *[f"{role}_at" for role in ROLE_KEYWORDS])
    rows = records.numbered(usable).where(F.col("rec_no") > 1).withColumn("fields", record_fields(F.col("value"), sep))

    def cell(role):
        return F.get("fields", F.col(f"{role}_at") - 1)
    wide = F.size("fields") > F.col("width")
    return rows.select(
        "source_file", (F.col("rec_no") - 1).alias("line_no"),
        cell("date").alias("raw_date"), cell("description").alias("raw_desc"),
        cell("amount").alias("raw_amount"), cell("category").alias("raw_cat"),
        F.col("category_at").isNotNull().alias("has_category"),
        F.when(wide, F.lit(REJECT_WIDE)).alias("row_reason")).withColumn(
        # A rejected record has no vote: all its bits are set.
        "date_bits", date_format_bits(missing_to_null(F.when(F.col("row_reason").isNull(), F.col("raw_date"))), DATE_FORMATS))


@dataclass
class Ingest:
    """What a read of statements gives; ``layouts`` has every file, ``metrics`` the counts of the writes."""
    ledger: DataFrame
    rejects: DataFrame
    layouts: DataFrame
    metrics: dict[str, int]


def ingest_statements(spark: SparkSession, paths, columns: dict | None = None, rules=None, sep: str = ",",
                      on_error: str = "quarantine", suffixes=ACCEPTED_SUFFIXES) -> Ingest:
    """Read CSV statements (files or folders): ledger, rejects, file layouts and counts.

    Every file is its own account (``account_id`` = file path) unless the
    caller re-keys the result; ``txn_id`` is the record's position in its
    file. ``on_error="quarantine"`` leaves out rejected files and records;
    ``"fail"`` raises if there is any, by the counts of the writes.
    """
    if on_error not in ("fail", "quarantine"):
        raise ValueError("on_error must be 'fail' or 'quarantine'")
    paths = [paths] if isinstance(paths, str) else list(paths)
    records = read_records(spark, paths, sep, suffixes, skip_unreadable=on_error == "quarantine")
    seen_files, seen_rows, seen_dates = Observation(), Observation(), Observation()
    some = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    layouts = statement_layouts(spark, paths, records, columns, suffixes, sep)
    layouts = materialize(layouts.observe(
        seen_files, F.count(F.lit(1)).alias("files"), some(F.col("file_reason").isNotNull()).alias("rejected_files"),
        F.min("file_reason").alias("reason")), "statement-layouts")
    metrics = dict(seen_files.get)
    reason = metrics.pop("reason")
    if on_error == "fail" and reason:
        raise ValueError(f"Error parsing statement: {reason} ({_first(layouts.where('file_reason IS NOT NULL'))})")
    # The date election and the main pass both read the role columns.
    roles = statement_roles(records, layouts, sep)
    roles = materialize(roles.observe(
        seen_rows, F.count(F.lit(1)).alias("records"), some(F.col("row_reason").isNotNull()).alias("rejected_records")),
        "statement-roles")
    metrics |= seen_rows.get
    if on_error == "fail" and metrics["rejected_records"]:
        raise ValueError(f"Error parsing statement: {REJECT_WIDE} ({_first(roles.where('row_reason IS NOT NULL'))})")
    elected = roles.groupBy("source_file").agg(F.bit_and("date_bits").alias("date_bits"))
    elected = materialize(elected.observe(seen_dates, some(F.col("date_bits") == 0).alias("files_without_date_format")), "statement-dates")
    metrics |= seen_dates.get
    if on_error == "fail" and metrics["files_without_date_format"]:
        raise ValueError(f"Error parsing statement: {REJECT_DATE} ({_first(elected.where('date_bits = 0'))})")
    norm = normalize_roles(roles, rules, elected=elected)
    return Ingest(finish(norm), rejected(norm).unionByName(rejected_files(layouts)), layouts, metrics)


def file_report(made: Ingest) -> DataFrame:
    """One row per listed file: why it is rejected (or null), warnings, ledger rows and rejected records."""
    rows = made.ledger.groupBy("source_file").agg(F.count(F.lit(1)).alias("ledger_rows"))
    bad = made.rejects.where(F.col(TXN).isNotNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("rejected_records"))
    files = made.layouts.select("source_file", "file_reason", "warnings")
    return files.join(rows, "source_file", "left").join(bad, "source_file", "left").na.fill(0, ["ledger_rows", "rejected_records"])


def _first(df: DataFrame) -> str:
    return df.agg(F.min("source_file")).first()[0]


def read_statements(spark: SparkSession, paths, columns: dict | None = None, rules=None,
                    sep: str = ",", on_error: str = "quarantine", with_rejects: bool = False,
                    suffixes=ACCEPTED_SUFFIXES):
    """``ingest_statements`` as the ledger, or ``(ledger, rejects)`` with ``with_rejects=True``."""
    made = ingest_statements(spark, paths, columns, rules, sep, on_error, suffixes)
    return (made.ledger, made.rejects) if with_rejects else made.ledger
