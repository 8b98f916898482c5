"""Per-account aggregates: KPIs, months, categories, top-k, chart datasets.

Every function takes a ledger DataFrame (see ``tallyspark.schema``) and
returns a DataFrame keyed by ``account_id``. Money is summed as exact
decimals (order independent) and reported in cents as doubles. Each grouped
result is one partial+final hash aggregate around one exchange, so a hot
account is reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_label, month_start, wall_micros
from tallyspark.functions.money import exact_sum, exact_total, safe_ratio_pct, to_cents
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, CREDIT, DATE, DEBIT, TXN, TYPE


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _credit_debit_sums(ledger: DataFrame, keys: list) -> DataFrame:
    """Exact credit and debit sums per key (``_inc`` >= 0, ``_exp`` = abs(sum debits))."""
    return ledger.groupBy(*keys).agg(
        exact_total(F.when(F.col(TYPE) == CREDIT, F.col(AMOUNT))).alias("_inc"),
        F.abs(exact_total(F.when(F.col(TYPE) == DEBIT, F.col(AMOUNT)))).alias("_exp"))


def _money_columns(prefix: str = "") -> list:
    inc, exp = to_cents(F.col("_inc")), to_cents(F.col("_exp"))
    net = to_cents(F.col("_inc") - F.col("_exp"))
    return [inc.alias(f"{prefix}Income" if prefix else "Income"),
            exp.alias(f"{prefix}Expenses" if prefix else "Expenses"),
            net.alias(f"{prefix}Savings" if prefix else "Savings")]


def kpi_summary(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Overall KPIs per account (dated and undated rows).

    total_income = sum(credits); total_expenses = abs(sum(debits));
    net_savings = income - expenses; savings_rate = net/income*100, 0 when
    income is 0; rate_band 'green' when the rate is at least 20 else 'blue'.
    """
    keys = _keys(by)
    sums = _credit_debit_sums(ledger, keys)
    inc, exp = to_cents(F.col("_inc")), to_cents(F.col("_exp"))
    net = to_cents(F.col("_inc") - F.col("_exp"))
    rate = safe_ratio_pct(net, inc)
    return sums.select(
        *keys, inc.alias("total_income"), exp.alias("total_expenses"),
        net.alias("net_savings"), rate.alias("savings_rate"),
        F.when(rate >= 20, F.lit("green")).otherwise(F.lit("blue")).alias("rate_band"))


def monthly_totals(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Exact sums per (account, month); rows without a date are left out."""
    keys = _keys(by)
    dated = ledger.where(F.col(DATE).isNotNull()).withColumn("MonthDate", month_start(F.col(DATE)))
    return _credit_debit_sums(dated, keys + ["MonthDate"])


def monthly_summary(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Month (``YYYY-MM``), Income, Expenses, Savings, SavingsRate per account.

    Months without rows are absent (no gap fill).
    """
    keys = _keys(by)
    inc = to_cents(F.col("_inc"))
    net = to_cents(F.col("_inc") - F.col("_exp"))
    return monthly_totals(ledger, keys).select(
        *keys, month_label(F.col("MonthDate")).alias("Month"), *_money_columns(),
        safe_ratio_pct(net, inc).alias("SavingsRate"))


def monthly_series(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """MonthDate (DATE), Income, Expenses, Savings and the month's position: the forecaster's input.

    ``position`` counts an account's months from 1, oldest first; the window
    runs over aggregated rows, one per month with data.
    """
    keys = _keys(by)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("MonthDate"))
    return monthly_totals(ledger, keys).select(*keys, "MonthDate", *_money_columns(),
                                               position.alias("position"))


def debits_only(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col(TYPE) == DEBIT)


def credits_only(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col(TYPE) == CREDIT)


def category_expenses(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Expense total per category: abs(sum of debits), one row per (account, Category)."""
    keys = _keys(by)
    return (debits_only(ledger).groupBy(*keys, CATEGORY)
            .agg(to_cents(F.abs(exact_sum(AMOUNT))).alias("Amount")))


def category_share(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Category totals with their share of all debits (percent, 0 if none).

    The account total is a window over the already aggregated category rows
    (a handful per account), not over raw transactions.
    """
    keys = _keys(by)
    cats = (debits_only(ledger).groupBy(*keys, CATEGORY)
            .agg(F.abs(exact_sum(AMOUNT)).alias("_amt")))
    total = to_cents(F.try_sum("_amt").over(Window.partitionBy(*keys)))
    amt = to_cents(F.col("_amt"))
    return cats.select(*keys, CATEGORY, amt.alias("Amount"), total.alias("total_expenses"),
                       safe_ratio_pct(amt, total).alias("share_pct"))


def default_contribution(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Average monthly net savings floored at 100; 500 when no month has data.

    The net counts undated rows, the month count does not (as in the
    reference). Single aggregate; the distinct month count is planned as a
    two-level aggregate on (account, month) then account.
    """
    keys = _keys(by)
    sums = ledger.groupBy(*keys).agg(
        exact_total(F.when(F.col(TYPE) == CREDIT, F.col(AMOUNT))).alias("_inc"),
        F.abs(exact_total(F.when(F.col(TYPE) == DEBIT, F.col(AMOUNT)))).alias("_exp"),
        F.count_distinct(month_start(F.col(DATE))).alias("n_months"))
    net = to_cents(F.col("_inc") - F.col("_exp"))
    contrib = F.when(F.col("n_months") > 0,
                     F.greatest(F.lit(100.0), net / F.col("n_months"))).otherwise(F.lit(500.0))
    return sums.select(*keys, net.alias("net_savings"), "n_months",
                       contrib.alias("monthly_contribution"))


def latest_month(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Last month with data and its Income/Expenses/Savings."""
    keys = _keys(by)
    ser = monthly_series(ledger, keys)
    return ser.groupBy(*keys).agg(
        F.max("MonthDate").alias("last_month"),
        F.max_by("Income", "MonthDate").alias("Income"),
        F.max_by("Expenses", "MonthDate").alias("Expenses"),
        F.max_by("Savings", "MonthDate").alias("Savings"),
        F.count(F.lit(1)).alias("n_months"))


def top_transactions(ledger: DataFrame, k: int = 5, by=ACCOUNT, tie=(TXN,)) -> DataFrame:
    """The k largest transactions by ``abs(Amount)`` per account, credits and debits.

    Ties break on newer date, then the transaction key. ``row_number() <= k``
    plans as a partial WindowGroupLimit before the shuffle, so each map task
    forwards at most k rows per account (a hot account cannot swamp a task).
    """
    keys = _keys(by)
    order = [F.abs(F.col(AMOUNT)).desc(), F.col(DATE).desc_nulls_last()] + [F.col(c).asc() for c in tie]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (ledger.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def ledger_newest_first(ledger: DataFrame, tie=(TXN,)) -> DataFrame:
    """Presentation order: newest first, undated last (a global range sort).

    For one account's view this is the reference's order. The order itself is
    carried by ``sort_key``, the negative microseconds since 1970, so that a
    reader of the written table can restore it with a plain sort (account,
    sort_key, tie); undated rows have the largest key.
    """
    keyed = ledger.withColumn("sort_key", F.coalesce(-wall_micros(F.col(DATE)), F.lit((1 << 63) - 1)))
    return keyed.orderBy(F.col(ACCOUNT), F.col("sort_key"), *[F.col(c) for c in tie])


def monthly_cash_flow_long(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Chart dataset: one row per (account, Month, series) for Income and Expenses."""
    keys = _keys(by)
    wide = monthly_summary(ledger, keys).select(*keys, "Month", "Income", "Expenses")
    return wide.unpivot(keys + ["Month"], ["Income", "Expenses"], "variable", "value")


__all__ = [
    "kpi_summary", "monthly_totals", "monthly_summary", "monthly_series", "debits_only",
    "credits_only", "category_expenses", "category_share", "default_contribution", "latest_month",
    "top_transactions", "ledger_newest_first", "monthly_cash_flow_long",
]
