"""Savings goals: input bounds, remaining balance, months needed, target month.

A goals table has ``account_id, goal_name, target_amount, current_savings,
monthly_contribution`` (the contribution may be null: the ledger default of
``aggregates.default_contribution`` applies). ``as_of`` is an explicit
parameter, never the wall clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import money_text
from tallyspark.operators.aggregates import default_contribution
from tallyspark.schema import ACCOUNT

# Input bounds of the goal form.
MIN_TARGET = 100.0
MIN_CURRENT = 0.0
MIN_MONTHLY = 10.0
FALLBACK_MONTHLY = 500.0


def _with_contribution(goals: DataFrame, ledger: DataFrame | None) -> DataFrame:
    if ledger is None:
        return goals.withColumn("_monthly", F.coalesce("monthly_contribution", F.lit(FALLBACK_MONTHLY)))
    defaults = default_contribution(ledger).select(
        ACCOUNT, F.col("monthly_contribution").alias("_default"))
    return (goals.join(defaults, ACCOUNT, "left")
            .withColumn("_monthly", F.coalesce("monthly_contribution", "_default",
                                               F.lit(FALLBACK_MONTHLY)))
            .drop("_default"))


def _reason():
    return (F.when(F.col("target_amount").isNull() | (F.col("target_amount") < MIN_TARGET),
                   F.lit("target_amount below 100"))
             .when(F.col("current_savings").isNull() | (F.col("current_savings") < MIN_CURRENT),
                   F.lit("current_savings below 0"))
             .when(F.col("_monthly") < MIN_MONTHLY, F.lit("monthly_contribution below 10")))


def goal_validation(goals: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Goals that break the input bounds, with the first broken rule."""
    g = _with_contribution(goals, ledger).withColumn("reject_reason", _reason())
    return (g.where(F.col("reject_reason").isNotNull())
            .withColumnRenamed("_monthly", "effective_monthly_contribution"))


def savings_goal(goals: DataFrame, ledger: DataFrame | None, as_of: dt.date | str) -> DataFrame:
    """Timeline per valid goal: remaining, achieved flag, months required, target month.

    ``as_of`` has no default: a forgotten date would silently shift every goal.
    A goal beyond the last date that can be written (9999-12-31) has its months
    and no target date.
    """
    g = _with_contribution(goals, ledger).where(_reason().isNull())
    remaining = F.col("target_amount") - F.col("current_savings")
    achieved = remaining <= 0
    months = F.when(~achieved, remaining / F.col("_monthly"))
    as_of_col = F.lit(str(as_of)).cast("date")
    whole = F.ceil(months)
    fits = whole <= F.months_between(F.lit("9999-12-01").cast("date"), as_of_col)
    target = F.when(fits, F.add_months(as_of_col, F.when(fits, whole).cast("int")))
    return g.select(
        ACCOUNT, "goal_name", "target_amount", "current_savings",
        F.col("_monthly").alias("monthly_contribution"),
        remaining.alias("remaining"), money_text(remaining).alias("remaining_text"),
        achieved.alias("achieved"),
        months.alias("months_required"),
        F.regexp_replace(F.format_number(months, 1), ",", "").alias("months_required_text"),
        target.alias("target_date"),
        F.date_format(target, "MMMM yyyy").alias("target_month"))
