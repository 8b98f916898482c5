"""Per-account linear trend forecast of monthly income and expenses.

The least-squares line of each series on the day number of the month start
is fitted from five mergeable sums (n, sum x, sum x^2, sum y, sum xy), so one
grouped aggregate fits every account at once, with partial aggregation before
the shuffle. The sums are exact integers (x in days, y in cents), and a
prediction is the exact fraction

    y(x*) = (Sy*D + N*(n*x* - Sx)) / (n*D),   D = n*Sxx - Sx^2,  N = n*Sxy - Sx*Sy

rounded half away from zero to a cent, so results do not depend on summation
order or floating-point error. All of it is decimal of 38 digits; what passes
them is null for that account and stops nothing. Projections of income and expenses are clamped
at 0; savings = income - expenses may be negative. An account with one month
uses the fallback: income held, expenses times (1 - 0.015*i), not clamped. An
account without dated rows has no forecast rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import day_ordinal
from tallyspark.operators.aggregates import monthly_totals
from tallyspark.schema import ACCOUNT

WIDE = "decimal(38,0)"

# The fallback's monthly expense decline is 1.5% per month,
# written as 15 per mille so it stays exact.
FALLBACK_PER_MILLE = 15
# Fixed value: the longest horizon that the dashboard offers.
MOST_MONTHS = 12


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _half_up_div(num: str, den: str) -> str:
    """SQL for round(num / den) half away from zero of decimal integers; null unless den > 0 or if out of range."""
    twice, of = f"try_add(try_multiply(2, abs({num})), {den})", f"try_multiply(2, {den})"
    whole = f"CAST(try_divide(try_subtract({twice}, try_mod({twice}, {of})), {of}) AS {WIDE})"
    return f"CASE WHEN {den} > 0 THEN sign({num}) * {whole} END"


def _not_below_0(c: str) -> str:
    """SQL: at least 0, null stays null."""
    return f"CASE WHEN {c} < 0 THEN CAST(0 AS {WIDE}) ELSE {c} END"


def monthly_cents(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Monthly income and expenses in whole cents (exact), plus the day number."""
    keys = _keys(by)
    return monthly_totals(ledger, keys).select(
        *keys, "MonthDate",
        day_ordinal(F.col("MonthDate")).cast("bigint").alias("x"),
        (F.round("_inc", 2) * 100).try_cast(WIDE).alias("inc_c"),
        (F.round("_exp", 2) * 100).try_cast(WIDE).alias("exp_c"))


def trend_sums(ledger: DataFrame, by=ACCOUNT, with_history: bool = False) -> DataFrame:
    """One row per account: the regression sums and the last month's values.

    With ``with_history`` the row also carries ``_hist``, the account's
    monthly (MonthDate, inc_c, exp_c) records: at most one per calendar month
    with data, so its size is bounded by the date range, not by row counts.
    """
    keys = _keys(by)
    m = monthly_cents(ledger, keys)
    x = F.col("x").cast(WIDE)
    times = lambda c: F.try_sum(F.try_multiply(x, F.col(c)))
    aggs = [
        F.count(F.lit(1)).cast(WIDE).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(x * x).alias("sxx"),
        F.try_sum("inc_c").alias("sy_inc"),
        times("inc_c").alias("sxy_inc"),
        F.try_sum("exp_c").alias("sy_exp"),
        times("exp_c").alias("sxy_exp"),
        F.max("MonthDate").alias("last_month"),
        F.max_by("inc_c", "MonthDate").alias("last_inc_c"),
        F.max_by("exp_c", "MonthDate").alias("last_exp_c")]
    if with_history:
        aggs.append(F.collect_list(F.struct("MonthDate", "inc_c", "exp_c")).alias("_hist"))
    s = m.groupBy(*keys).agg(*aggs)
    slope = lambda y: F.expr(f"try_subtract(try_multiply(n, sxy_{y}), try_multiply(sx, sy_{y}))")
    s = s.withColumns({"D": F.expr("n * sxx - sx * sx"), "N_inc": slope("inc"), "N_exp": slope("exp")})
    return s


def fit_trend(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Slopes of income and expenses in dollars per day (6 decimals); null with one month."""
    keys = _keys(by)
    s = trend_sums(ledger, keys)
    cols = [*keys, F.col("n").cast("bigint").alias("n_months"), "last_month"]
    for series in ("inc", "exp"):
        name = "income" if series == "inc" else "expenses"
        slope = F.expr(_half_up_div(f"try_multiply(N_{series}, 10000)", "D")).cast("double") / F.lit(1e6)
        cols.append(F.when(F.col("D") > 0, slope).alias(f"{name}_slope_per_day"))
    return s.select(*cols)


def forecast_horizon(ledger: DataFrame, months: int = 3, by=ACCOUNT) -> DataFrame:
    """The ``months`` month starts after each account's last month with data."""
    keys = _keys(by)
    _check_horizon(months)
    last = monthly_cents(ledger, keys).groupBy(*keys).agg(F.max("MonthDate").alias("last_month"))
    return (last.select(*keys, "last_month", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("step"))
            .select(*keys, "step", F.add_months("last_month", F.col("step")).alias("MonthDate")))


def _check_horizon(months: int) -> None:
    if not isinstance(months, int) or isinstance(months, bool) or not 1 <= months <= MOST_MONTHS:
        raise ValueError(f"months must be an integer from 1 to {MOST_MONTHS}")


def _projected_array(months: int) -> str:
    """SQL: array of projected (MonthDate, inc_c, exp_c, IsProjected) for steps 1..months."""
    xf = f"CAST(unix_date(add_months(last_month, i)) AS {WIDE})"
    ahead = f"try_subtract(try_multiply(n, {xf}), sx)"

    def projected(y: str) -> str:
        at = f"try_add(try_multiply(sy_{y}, D), try_multiply(N_{y}, {ahead}))"
        return _not_below_0(_half_up_div(at, "try_multiply(n, D)"))
    fb = f"try_multiply(last_exp_c, CAST(1000 - {FALLBACK_PER_MILLE} * i AS {WIDE}))"
    return f"""transform(sequence(1, {months}), i -> named_struct(
        'MonthDate', add_months(last_month, i),
        'inc_c', CASE WHEN n >= 2 THEN {projected('inc')} ELSE last_inc_c END,
        'exp_c', CASE WHEN n >= 2 THEN {projected('exp')} ELSE {_half_up_div(fb, f'CAST(1000 AS {WIDE})')} END,
        'IsProjected', true))"""


_HISTORY_ARRAY = ("transform(_hist, h -> named_struct('MonthDate', h.MonthDate, 'inc_c', h.inc_c, "
                  "'exp_c', h.exp_c, 'IsProjected', false))")


def _rows(ledger: DataFrame, months: int | None, history_rows: bool, keys: list) -> DataFrame:
    """Explode history and/or projections from one aggregate row per account.

    A single branch: one scan, the (account, month) aggregate, then the
    per-account aggregate; no union of two plans over the ledger.
    """
    s = trend_sums(ledger, keys, with_history=history_rows)
    parts = []
    if history_rows:
        parts.append(_HISTORY_ARRAY)
    if months is not None:
        parts.append(_projected_array(months))
    arr = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    r = s.select(*keys, F.explode(F.expr(arr)).alias("r"))
    inc, exp = F.col("r.inc_c"), F.col("r.exp_c")
    return r.select(
        *keys, F.col("r.MonthDate").alias("MonthDate"),
        (inc.cast("double") / F.lit(100.0)).alias("Income"),
        (exp.cast("double") / F.lit(100.0)).alias("Expenses"),
        (F.try_subtract(inc, exp).cast("double") / F.lit(100.0)).alias("Savings"),
        F.col("r.IsProjected").alias("IsProjected"))


def projections(ledger: DataFrame, months: int = 3, by=ACCOUNT) -> DataFrame:
    """Projected rows only: MonthDate, Income, Expenses, Savings, IsProjected=true."""
    _check_horizon(months)
    return _rows(ledger, months, False, _keys(by))


def forecast(ledger: DataFrame, months: int = 3, by=ACCOUNT) -> DataFrame:
    """History followed by ``months`` projections per account, flagged ``IsProjected``.

    Both kinds of row come out of one exploded array per account, so the
    ledger is scanned once.
    """
    _check_horizon(months)
    return _rows(ledger, months, True, _keys(by))
