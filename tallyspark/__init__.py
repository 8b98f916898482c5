"""tallyspark: per-account ledger analytics on Spark.

Every operator takes a ledger DataFrame (see ``tallyspark.schema``) and
returns a DataFrame keyed by ``account_id``; nothing runs until an action.
"""

from tallyspark.operators.aggregates import (category_expenses, category_share, credits_only,
                                             debits_only, default_contribution, kpi_summary,
                                             latest_month, ledger_newest_first,
                                             monthly_cash_flow_long, monthly_series,
                                             monthly_summary, top_transactions)
from tallyspark.operators.context import (category_lists, chat_context, dialog_assembly,
                                          financial_context, kpi_display, report_categories,
                                          report_document,
                                          report_kpis, review_prompt, text_blocks,
                                          top_transaction_lines, transactions_display)
from tallyspark.operators.filters import projection_split, projection_trend_line, search_transactions
from tallyspark.operators.forecast import fit_trend, forecast, forecast_horizon, projections
from tallyspark.operators.goals import goal_validation, savings_goal
from tallyspark.operators.normalize import map_headers, standardize_statement, statement_rejects
from tallyspark.sources.sinks import write_report
from tallyspark.sources.statements import read_statements

__version__ = "0.1.0"

__all__ = [
    "category_expenses", "category_share", "credits_only", "debits_only", "default_contribution",
    "kpi_summary", "latest_month", "ledger_newest_first", "monthly_cash_flow_long",
    "monthly_series", "monthly_summary", "top_transactions", "category_lists", "chat_context",
    "dialog_assembly", "financial_context", "kpi_display", "report_categories", "report_kpis",
    "review_prompt", "report_document", "text_blocks", "top_transaction_lines", "transactions_display",
    "projection_split", "projection_trend_line", "search_transactions", "fit_trend", "forecast",
    "forecast_horizon", "projections", "goal_validation", "savings_goal", "map_headers",
    "standardize_statement", "statement_rejects", "write_report", "read_statements",
]
