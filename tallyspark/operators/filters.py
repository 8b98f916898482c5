"""Row filters: transaction search and the history/projection splits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import amount_text
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, DESC


def search_transactions(ledger: DataFrame, query: str, mode: str = "regex") -> DataFrame:
    """Rows whose Description or Category matches ``query`` (case-insensitive),
    or whose amount text matches it (case-sensitive). Empty query: no filter.

    ``mode="regex"`` treats the query as a regular expression, as the
    reference does; ``mode="literal"`` as plain text. The pattern is checked
    on the driver first so a bad pattern fails before any job starts.
    """
    if not query:
        return ledger
    if mode == "literal":
        java = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    elif mode == "regex":
        try:
            re.compile(query)
        except re.error as exc:
            raise ValueError(f"invalid search pattern {query!r}: {exc}") from exc
        java = _python_to_java_regex(query)
    else:
        raise ValueError("mode must be 'regex' or 'literal'")
    ci = "(?iuU)" + java  # Python's classes (\\w, \\d, \\b) are Unicode ones
    _check_java_regex(ledger, ci)
    cond = (F.col(DESC).rlike(ci) | F.col(CATEGORY).rlike(ci)
            | amount_text(F.col(AMOUNT)).rlike("(?U)" + java))
    return ledger.where(cond)


def _python_to_java_regex(pattern: str) -> str:
    """Rewrite the Python-only named-group forms; the rest of the syntax in
    common use is shared by Python and Java. Java's group names are letters
    and digits only, so groups get new names in the order they are opened."""
    names: dict[str, str] = {}

    def opened(m):
        names[m.group(1)] = f"g{len(names)}"
        return f"(?<{names[m.group(1)]}>"

    pattern = re.sub(r"\(\?P<(\w+)>", opened, pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{names.get(m.group(1), m.group(1))}>", pattern)


def _check_java_regex(ledger: DataFrame, java: str) -> None:
    """Compile the translated pattern on the driver, so a bad one fails before any job."""
    try:
        ledger.sparkSession._jvm.java.util.regex.Pattern.compile(java)
    except Exception as exc:
        raise ValueError(f"invalid search pattern {java!r}") from exc


def projection_split(forecast: DataFrame, projected: bool) -> DataFrame:
    """History (``projected=False``) or projections (``True``) of a forecast."""
    flag = F.col("IsProjected")
    return forecast.where(flag if projected else ~flag)


def projection_trend_line(forecast: DataFrame, by=ACCOUNT) -> DataFrame:
    """Last historical month plus all projections, so a chart line joins up.

    The window runs over forecast rows (months + horizon per account), not
    over transactions.
    """
    keys = [by] if isinstance(by, str) else list(by)
    last_hist = F.max(F.when(~F.col("IsProjected"), F.col("MonthDate"))).over(Window.partitionBy(*keys))
    return (forecast.withColumn("_last_hist", last_hist)
            .where(F.col("IsProjected") | (F.col("MonthDate") == F.col("_last_hist")))
            .drop("_last_hist"))
