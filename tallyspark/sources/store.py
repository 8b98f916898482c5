"""A stored ledger laid out by account, and totals that are refreshed by month.

**Ledger.** ``store_ledger`` writes a table bucketed by account and sorted by
account and date. Every per-account operator over it plans without an
exchange. An account with more than ``hot_rows`` rows would keep one task busy
alone, so such accounts go to a second table that isn't bucketed, where
partial aggregation spreads them; ``per_account`` runs an operator on both
parts and unites the results, as no operator looks past an account.

**Totals.** ``refresh_totals`` keeps the sums of each (account, month,
category, type) by statement file, one folder a month. A file that is sent
again, corrected or late replaces its own part: only the months that it
touches, now or before, are rewritten (dynamic partition overwrite), and the
result equals a full run. All dashboard totals are sums over this table.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_label, month_start
from tallyspark.functions.money import safe_ratio_pct, to_cents
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, CREDIT, DATE, DEBIT, MONEY_DECIMAL, ROW_DECIMAL, TXN, TYPE
from tallyspark.session import drop_staged, materialize

# Rows from which an account is kept apart: some minutes' work for one task.
HOT_ROWS = 20_000_000


@dataclass
class StoredLedger:
    """The two parts of a stored ledger; every account lies in one of them."""
    bucketed: DataFrame
    hot: DataFrame


def store_ledger(ledger: DataFrame, table: str, path: str, buckets: int, hot_rows: int = HOT_ROWS) -> StoredLedger:
    """Write ``ledger`` as tables ``<table>`` (bucketed) and ``<table>_hot`` under ``path`` and return them.

    ``ledger`` is read twice, for the row counts of its accounts and to be
    written; hot accounts are at most rows / hot_rows.
    """
    spark = ledger.sparkSession
    hot = ledger.groupBy(ACCOUNT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(F.col(ACCOUNT).alias("_hot"))
    hot = materialize(hot, "hot-accounts")
    same = ledger[ACCOUNT].eqNullSafe(F.col("_hot"))
    few = F.broadcast(hot)  # rows / hot_rows of the ledger at most
    cold = ledger.join(few, same, "left_anti")
    (cold.repartition(buckets, ACCOUNT).write.mode("overwrite").bucketBy(buckets, ACCOUNT).sortBy(ACCOUNT, DATE)
     .option("path", os.path.join(path, "bucketed")).saveAsTable(table))
    (ledger.join(few, same, "left_semi").write.mode("overwrite")
     .option("path", os.path.join(path, "hot")).saveAsTable(f"{table}_hot"))
    drop_staged(hot)
    return stored_ledger(spark, table)


def stored_ledger(spark: SparkSession, table: str) -> StoredLedger:
    return StoredLedger(spark.table(table), spark.table(f"{table}_hot"))


def per_account(stored: StoredLedger, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a per-account operator over both parts."""
    return operator(stored.bucketed).unionByName(operator(stored.hot))


TOTAL_KEYS = ["source_file", ACCOUNT, CATEGORY, TYPE]
UNDATED = "undated"


def file_totals(ledger: DataFrame) -> DataFrame:
    """Exact sums and row counts of each (file, account, month, category, type); ``month`` is ``YYYY-MM`` or ``undated``."""
    month = F.coalesce(month_label(month_start(F.col(DATE))), F.lit(UNDATED)).alias("month")
    return ledger.groupBy(*TOTAL_KEYS, month).agg(
        F.try_sum(F.col(AMOUNT).try_cast(ROW_DECIMAL)).cast(MONEY_DECIMAL).alias("amount"),
        # Rows too large for the decimal add up in double precision, as in ``exact_sum``.
        F.sum(F.when(F.col(AMOUNT).try_cast(ROW_DECIMAL).isNull(), F.col(AMOUNT))).alias("beyond"),
        F.count(F.lit(1)).alias("n"))


def refresh_totals(ledger: DataFrame, files: DataFrame, path: str) -> list[str]:
    """Put the totals of ``files`` (source_file) into the table at ``path``; returns the months rewritten.

    ``ledger`` holds all rows that these files give now, which may be none.
    The new months are staged before the table is touched, so a job that is
    run again after a failure gives the same table. A month that a file leaves
    keeps a row without a count for it; ``read_totals`` passes over those.
    """
    spark = ledger.sparkSession
    names = files.select("source_file").distinct()
    new = materialize(file_totals(ledger.join(names, "source_file", "left_semi")), "totals-new")
    old = _stored_totals(spark, path)
    touched = new.select("month")
    if old is not None:
        own = old.join(names, "source_file", "left_semi")
        touched = touched.unionByName(own.select("month"))
    months = sorted(r["month"] for r in touched.distinct().collect())  # as many as the calendar has
    result = new
    if old is not None:
        here = old.where(F.col("month").isin(months))  # reads the folders of these months only
        kept = here.join(names, "source_file", "left_anti")
        # What a file no longer gives stays as an empty row, so that its month's folder is rewritten, too.
        left = here.join(names, "source_file", "left_semi").join(new, [*TOTAL_KEYS, "month"], "left_anti")
        empty = left.withColumns({"amount": F.lit(0).cast(MONEY_DECIMAL), "beyond": F.lit(None).cast("double"), "n": F.lit(0).cast("bigint")})
        result = kept.unionByName(new).unionByName(empty.select(kept.columns))
    staged = materialize(result, "totals-months")
    (staged.repartition("month", F.pmod(F.xxhash64("source_file"), F.lit(64))).write.mode("overwrite").partitionBy("month")
     .option("partitionOverwriteMode", "dynamic").parquet(path))
    drop_staged(new)
    drop_staged(staged)
    return months


def _stored_totals(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path).withColumn("month", F.col("month").cast("string"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals by file; rows without a count are left out."""
    return _stored_totals(spark, path).where(F.col("n") > 0)


def _sides(totals: DataFrame, keys: list) -> DataFrame:
    def side(kind):
        mine = F.col(TYPE) == kind
        exact, beyond = F.try_sum(F.when(mine, F.col("amount"))), F.sum(F.when(mine, F.col("beyond")))
        far = (beyond + F.coalesce(exact.cast("double"), F.lit(0.0))).try_cast(MONEY_DECIMAL)
        whole = F.when(beyond.isNull(), exact).otherwise(far)
        return F.when(F.count(F.when(mine, 1)) == 0, F.lit(0).cast(MONEY_DECIMAL)).otherwise(whole)
    return totals.groupBy(*keys).agg(side(CREDIT).alias("_inc"), F.abs(side(DEBIT)).alias("_exp"))


def kpis_of_totals(totals: DataFrame) -> DataFrame:
    """``aggregates.kpi_summary`` from totals."""
    inc, exp, net = to_cents("_inc"), to_cents("_exp"), to_cents(F.col("_inc") - F.col("_exp"))
    rate = safe_ratio_pct(net, inc)
    return _sides(totals, [ACCOUNT]).select(
        ACCOUNT, inc.alias("total_income"), exp.alias("total_expenses"), net.alias("net_savings"), rate.alias("savings_rate"),
        F.when(rate >= 20, F.lit("green")).otherwise(F.lit("blue")).alias("rate_band"))


def months_of_totals(totals: DataFrame) -> DataFrame:
    """``aggregates.monthly_summary`` from totals."""
    inc, net = to_cents("_inc"), to_cents(F.col("_inc") - F.col("_exp"))
    return _sides(totals.where(F.col("month") != UNDATED), [ACCOUNT, "month"]).select(
        ACCOUNT, F.col("month").alias("Month"), inc.alias("Income"), to_cents("_exp").alias("Expenses"),
        net.alias("Savings"), safe_ratio_pct(net, inc).alias("SavingsRate"))


def categories_of_totals(totals: DataFrame) -> DataFrame:
    """``aggregates.category_expenses`` from totals."""
    return _sides(totals.where(F.col(TYPE) == DEBIT), [ACCOUNT, CATEGORY]).select(ACCOUNT, CATEGORY, to_cents("_exp").alias("Amount"))
