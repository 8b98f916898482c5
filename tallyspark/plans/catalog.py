"""Registered queries: one Spark plan per operator, each with its SQL oracle.

Every query reads whole driver tables (or data Spark derives from them) and
returns a DataFrame; no row caps, id subsets or sampling.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.categorize import DEFAULT_RULES, categorize
from tallyspark.functions.money import classify_type
from tallyspark.operators import aggregates as agg
from tallyspark.operators import context, filters, forecast, goals, normalize
from tallyspark.plans import oracle_sql as sql
from tallyspark.session import ensure_checkpoint_dir
from tallyspark.sources import sinks, statements, store, tables
from tallyspark.sources.records import read_records

# Fixed parameters of the registered queries.
SEARCH_PATTERN = "high|99"
SEARCH_TEXT = "order 12"
TOP_K = 5
HORIZON = 3
AS_OF = "2026-07-01"
GENERATED_AT = "2026-07-01 09:00:00"

QueryFn = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders_ledger(tables.read_table(spark, sf_dir, "orders"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_ledger(tables.read_table(spark, sf_dir, "events"))


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineitem_ledger(tables.read_table(spark, sf_dir, "lineitem"),
                                  tables.read_table(spark, sf_dir, "orders"))


def _hot_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem ledger where one account holds a third of all rows."""
    return tables.lineitem_ledger(tables.read_table(spark, sf_dir, "lineitem"),
                                  tables.read_table(spark, sf_dir, "orders"), hot_every=3)


_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, fn: QueryFn, oracle: str | None) -> None:
    _REGISTRY[name] = (fn, oracle)


# --- aggregates over the orders ledger -----------------------------------
register("monthly_summary", lambda s, d: agg.monthly_summary(_orders(s, d)),
         sql.monthly_summary(sql.ORDERS_LEDGER))
register("kpi_summary", lambda s, d: agg.kpi_summary(_orders(s, d)),
         sql.kpi_summary(sql.ORDERS_LEDGER))
register("category_expenses", lambda s, d: agg.category_expenses(_orders(s, d)),
         sql.category_expenses(sql.ORDERS_LEDGER))
register("category_share", lambda s, d: agg.category_share(_orders(s, d)),
         sql.category_share(sql.ORDERS_LEDGER))
register("top_transactions", lambda s, d: agg.top_transactions(_orders(s, d), TOP_K),
         sql.top_transactions(sql.ORDERS_LEDGER, TOP_K))
register("debits_only", lambda s, d: agg.debits_only(_orders(s, d)),
         sql.debits_only(sql.ORDERS_LEDGER))
register("credits_only", lambda s, d: agg.credits_only(_orders(s, d)),
         sql.credits_only(sql.ORDERS_LEDGER))
register("ledger_newest_first", lambda s, d: agg.ledger_newest_first(_orders(s, d)),
         sql.ledger_newest_first(sql.ORDERS_LEDGER))
register("monthly_series", lambda s, d: agg.monthly_series(_orders(s, d)),
         sql.monthly_series(sql.ORDERS_LEDGER))
register("default_contribution", lambda s, d: agg.default_contribution(_orders(s, d)),
         sql.default_contribution(sql.ORDERS_LEDGER))
register("latest_month", lambda s, d: agg.latest_month(_orders(s, d)),
         sql.latest_month(sql.ORDERS_LEDGER))
register("monthly_cash_flow_long", lambda s, d: agg.monthly_cash_flow_long(_orders(s, d)),
         sql.monthly_cash_flow_long(sql.ORDERS_LEDGER))
register("search_transactions",
         lambda s, d: filters.search_transactions(_orders(s, d), SEARCH_PATTERN),
         sql.search_transactions(sql.ORDERS_LEDGER, SEARCH_PATTERN))
register("search_literal",
         lambda s, d: filters.search_transactions(_orders(s, d), SEARCH_TEXT, mode="literal"),
         sql.search_literal(sql.ORDERS_LEDGER, SEARCH_TEXT))

# --- the same operators over the other ledgers ---------------------------
register("lineitem_monthly_summary", lambda s, d: agg.monthly_summary(_lineitem(s, d)),
         sql.monthly_summary(sql.LINEITEM_LEDGER))
register("lineitem_kpi_summary", lambda s, d: agg.kpi_summary(_lineitem(s, d)),
         sql.kpi_summary(sql.LINEITEM_LEDGER))
register("events_category_share", lambda s, d: agg.category_share(_events(s, d)),
         sql.category_share(sql.EVENTS_LEDGER))
register("events_monthly_summary", lambda s, d: agg.monthly_summary(_events(s, d)),
         sql.monthly_summary(sql.EVENTS_LEDGER))
def _top_lines(spark: SparkSession, sf_dir: str, hot_every: int | None = None) -> DataFrame:
    """Ranked on the native key columns; key text and description are built for the rows that remain."""
    keyed = tables.lineitem_keyed(tables.read_table(spark, sf_dir, "lineitem"),
                                  tables.read_table(spark, sf_dir, "orders"), hot_every)
    return tables.lineitem_texts(agg.top_transactions(keyed, TOP_K, tie=tables.LINE_KEY), ["rank"])


register("lineitem_top_transactions", _top_lines,
         sql.top_transactions(sql.LINEITEM_LEDGER, TOP_K, sql.LINE_KEY))
register("lineitem_category_share", lambda s, d: agg.category_share(_lineitem(s, d)),
         sql.category_share(sql.LINEITEM_LEDGER))

# --- forecast ---------------------------------------------------------------
register("fit_trend", lambda s, d: forecast.fit_trend(_orders(s, d)), sql.fit_trend(sql.ORDERS_LEDGER))
register("forecast_horizon", lambda s, d: forecast.forecast_horizon(_orders(s, d), HORIZON),
         sql.forecast_horizon(sql.ORDERS_LEDGER, HORIZON))
register("forecast", lambda s, d: forecast.forecast(_orders(s, d), HORIZON),
         sql.forecast(sql.ORDERS_LEDGER, HORIZON))
register("projection_split",
         lambda s, d: filters.projection_split(forecast.forecast(_orders(s, d), HORIZON), True),
         sql.projection_split(sql.ORDERS_LEDGER, HORIZON))
register("projection_trend_line",
         lambda s, d: filters.projection_trend_line(forecast.forecast(_orders(s, d), HORIZON)),
         sql.projection_trend_line(sql.ORDERS_LEDGER, HORIZON))
register("forecast_fallback", lambda s, d: forecast.forecast(_events(s, d), HORIZON),
         sql.forecast(sql.EVENTS_LEDGER, HORIZON))
register("lineitem_forecast", lambda s, d: forecast.forecast(_lineitem(s, d), 12),
         sql.forecast(sql.LINEITEM_LEDGER, 12))

# --- savings goals (one goal per customer) ----------------------------------
register("savings_goal",
         lambda s, d: goals.savings_goal(tables.goals_table(tables.read_table(s, d, "customer")),
                                         _orders(s, d), AS_OF),
         sql.savings_goal(sql.ORDERS_LEDGER, AS_OF))
register("goal_validation",
         lambda s, d: goals.goal_validation(tables.goals_table(tables.read_table(s, d, "customer")),
                                            _orders(s, d)),
         sql.goal_validation(sql.ORDERS_LEDGER))

# --- statement ingest over the raw statement text built from orders --------
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_statement(tables.read_table(spark, sf_dir, "orders"))


register("parse_statement", lambda s, d: normalize.standardize_statement(_raw(s, d)),
         sql.parse_statement())


# Rows without a date: left out of months, kept among the largest.
register("statement_monthly_summary",
         lambda s, d: agg.monthly_summary(normalize.standardize_statement(_raw(s, d))),
         sql.statement_monthly_summary())
register("statement_top_lines",
         lambda s, d: context.top_transaction_lines(normalize.standardize_statement(_raw(s, d)), TOP_K),
         sql.statement_top_lines(TOP_K))
register("rejected_rows", lambda s, d: normalize.statement_rejects(_raw(s, d)), sql.rejected_rows())
register("parse_dates", lambda s, d: normalize.parsed_dates(_raw(s, d)), sql.parse_dates())
register("fill_category", lambda s, d: normalize.filled_categories(_raw(s, d)), sql.fill_category())
register("clean_amounts", lambda s, d: normalize.cleaned_amounts(_raw(s, d)), sql.clean_amounts())
register("classify_type",
         lambda s, d: _orders(s, d).select("txn_id", "Amount", classify_type("Amount").alias("Type")),
         sql.classify_type(sql.ORDERS_LEDGER))
register("categorize_keywords",
         lambda s, d: tables.read_table(s, d, "documents").select(
             "doc_id", categorize("text").alias("Category")),
         sql.categorize_keywords(DEFAULT_RULES))

# --- CSV text: statements written from orders, then read back --------------
def _statement_files(spark: SparkSession, sf_dir: str) -> str:
    folder = os.path.join(ensure_checkpoint_dir(spark), "tables", f"statement-files-{uuid.uuid4().hex[:12]}")
    return tables.write_statement_lines(tables.read_table(spark, sf_dir, "orders"), folder)


def _statement_no():
    return F.regexp_extract("source_file", r"statement=(\d+)", 1).cast("bigint").alias("account_id")


TEXT_FILES = (".txt",)


def _read_statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = statements.read_statements(spark, _statement_files(spark, sf_dir), suffixes=TEXT_FILES)
    return ledger.select(_statement_no(), "txn_id", "Date", "Description", "Amount", "Category", "Type")


def _rejected_statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = statements.read_statements(spark, _statement_files(spark, sf_dir), suffixes=TEXT_FILES,
                                            with_rejects=True)
    return rejects.select(_statement_no(), "txn_id", "reject_reason")


def _statement_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _statement_files(spark, sf_dir)
    found = statements.statement_layouts(spark, [folder], read_records(spark, [folder], suffixes=TEXT_FILES), suffixes=TEXT_FILES)
    return found.select(_statement_no(), F.array_join("header", "|").alias("header"), "date_at",
                        "description_at", "amount_at", "category_at",
                        F.array_join("warnings", "; ").alias("warnings"))


def _statement_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tables.write_unusable_files(tables.read_table(spark, sf_dir, "region"), _statement_files(spark, sf_dir))
    made = statements.ingest_statements(spark, folder, suffixes=TEXT_FILES)
    number = F.regexp_extract("source_file", r"statement=(-?\d+)", 1).cast("bigint").alias("account_id")
    return statements.file_report(made).select(number, F.col("file_reason").alias("reject_reason"), "ledger_rows", "rejected_records")


register("statement_file_report", _statement_file_report, sql.statement_file_report(DEFAULT_RULES))
register("read_statement_lines", _read_statement_lines, sql.read_statement_lines(DEFAULT_RULES))
register("rejected_files", _rejected_statement_lines, sql.rejected_statement_lines(DEFAULT_RULES))
register("statement_layouts", _statement_layouts, sql.statement_layouts())

# --- context, prompts, display and report tables ----------------------------
register("top_transaction_lines", lambda s, d: context.top_transaction_lines(_orders(s, d), TOP_K),
         sql.top_transaction_lines(sql.ORDERS_LEDGER, TOP_K))
register("category_json",
         lambda s, d: context.category_lists(_orders(s, d)).select(
             "account_id", "category_json", "category_json_indented"),
         sql.category_json(sql.ORDERS_LEDGER))
register("financial_context",
         lambda s, d: context.financial_context(_orders(s, d), TOP_K).select(
             "account_id", "total_income", "total_expenses", "net_savings", "savings_rate_pct",
             "category_json", "context_json"),
         sql.financial_context(sql.ORDERS_LEDGER, TOP_K))
register("review_prompt", lambda s, d: context.review_prompt(_orders(s, d)),
         sql.review_prompt(sql.ORDERS_LEDGER,
                           context.REVIEW_PROMPT.replace("{advisor}", context.DEFAULT_ADVISOR)))
register("dialog_assembly",
         lambda s, d: context.dialog_assembly(tables.read_table(s, d, "conversations"), _orders(s, d)),
         sql.dialog_assembly(sql.ORDERS_LEDGER,
                             context.CHAT_CONTEXT.replace("{advisor}", context.DEFAULT_ADVISOR),
                             context.CHAT_OPENING_USER.replace("{advisor}", context.DEFAULT_ADVISOR),
                             context.CHAT_OPENING_MODEL.replace("{advisor}", context.DEFAULT_ADVISOR)))
register("text_blocks",
         lambda s, d: context.text_blocks(tables.read_table(s, d, "documents")),
         sql.text_blocks())
register("review_blocks",
         lambda s, d: context.text_blocks(tables.review_text(tables.read_table(s, d, "documents"))),
         sql.review_blocks())
register("context_categories",
         lambda s, d: context.financial_context(_orders(s, d), TOP_K).select(
             "account_id", F.posexplode("category_expenses").alias("pos", "c")).select(
             "account_id", "pos", "c.Category", F.col("c.`Total Spent`").alias("total_spent")),
         sql.context_categories(sql.ORDERS_LEDGER))
register("context_top_lines",
         lambda s, d: context.financial_context(_orders(s, d), TOP_K).select(
             "account_id", F.posexplode("top_5_largest_transactions").alias("pos", "line")),
         sql.context_top_lines(sql.ORDERS_LEDGER, TOP_K))
register("kpi_display", lambda s, d: context.kpi_display(_orders(s, d)), sql.kpi_display(sql.ORDERS_LEDGER))
register("transactions_display", lambda s, d: context.transactions_display(_orders(s, d)),
         sql.transactions_display(sql.ORDERS_LEDGER))
register("report_kpis", lambda s, d: context.report_kpis(_orders(s, d)),
         sql.report_kpis(sql.ORDERS_LEDGER, context.REPORT_KPI_LABELS))
register("report_categories", lambda s, d: context.report_categories(_orders(s, d)),
         sql.report_categories(sql.ORDERS_LEDGER))
register("report_document", lambda s, d: context.report_document(_orders(s, d), GENERATED_AT),
         sql.report_document(sql.ORDERS_LEDGER, GENERATED_AT, context.REPORT_TITLE,
                             context.REPORT_KPI_LABELS, context.REPORT_KPI_HEADER,
                             context.REPORT_CATEGORY_HEADER,
                             [context.REPORT_SECTION_1, context.REPORT_SECTION_2,
                              context.REPORT_SECTION_3]))

# --- skew: one account with a third of all lineitem rows --------------------
register("hot_account_kpi_summary", lambda s, d: agg.kpi_summary(_hot_lineitem(s, d)),
         sql.kpi_summary(sql.HOT_LINEITEM_LEDGER))
register("hot_account_top_transactions", lambda s, d: _top_lines(s, d, hot_every=3),
         sql.top_transactions(sql.HOT_LINEITEM_LEDGER, TOP_K, sql.LINE_KEY))
register("hot_account_forecast", lambda s, d: forecast.forecast(_hot_lineitem(s, d), HORIZON),
         sql.forecast(sql.HOT_LINEITEM_LEDGER, HORIZON))
register("hot_account_financial_context",
         lambda s, d: context.financial_context(_hot_lineitem(s, d), TOP_K).select(
             "account_id", "total_income", "total_expenses", "net_savings", "savings_rate_pct",
             "category_json", "context_json"),
         sql.financial_context(sql.HOT_LINEITEM_LEDGER, TOP_K))


def queries() -> dict[str, QueryFn]:
    return {name: fn for name, (fn, _) in _REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {name: q for name, (_, q) in _REGISTRY.items() if q is not None}


# --- stored ledger, refreshed totals, committed report -----------------------
def _staging(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


# The account of a third of all rows goes to the part that isn't bucketed.
STORED_BUCKETS, STORED_HOT_ROWS = 16, 10_000


def _stored(spark: SparkSession, sf_dir: str) -> store.StoredLedger:
    name = f"ledger_{uuid.uuid4().hex[:12]}"
    return store.store_ledger(_hot_lineitem(spark, sf_dir), name, _staging(spark, "stored-ledger"), STORED_BUCKETS, STORED_HOT_ROWS)


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders by file (order key modulo 7): file 3 is first sent with wrong amounts and months, file 5 comes late."""
    ledger = _orders(spark, sf_dir).withColumn("source_file", (F.col("txn_id") % 7).cast("string"))
    path, fix = _staging(spark, "totals"), F.col("source_file") == "3"
    wrong = ledger.withColumns({"Amount": F.when(fix, F.col("Amount") * 2).otherwise(F.col("Amount")),
                                "Date": F.when(fix, F.add_months("Date", 1).cast("timestamp_ntz")).otherwise(F.col("Date"))})
    files = ledger.select("source_file").distinct()
    store.refresh_totals(wrong.where("source_file <> '5'"), files.where("source_file <> '5'"), path)
    store.refresh_totals(ledger.where("source_file IN ('3', '5')"), files.where("source_file IN ('3', '5')"), path)
    return store.read_totals(spark, path)


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _staging(spark, "report")
    sinks.write_report(_orders(spark, sf_dir), out, generated_at=GENERATED_AT)
    return sinks.read_report(spark, out, "report_document").drop("bucket")


def _sql(name: str) -> str | None:
    return _REGISTRY[name][1]


register("stored_kpi_summary", lambda s, d: store.per_account(_stored(s, d), agg.kpi_summary), _sql("hot_account_kpi_summary"))
register("stored_forecast", lambda s, d: store.per_account(_stored(s, d), lambda led: forecast.forecast(led, HORIZON)),
         _sql("hot_account_forecast"))
register("refreshed_kpi_summary", lambda s, d: store.kpis_of_totals(_refreshed(s, d)), _sql("kpi_summary"))
register("refreshed_monthly_summary", lambda s, d: store.months_of_totals(_refreshed(s, d)), _sql("monthly_summary"))
register("refreshed_category_expenses", lambda s, d: store.categories_of_totals(_refreshed(s, d)), _sql("category_expenses"))
register("committed_report_document", _committed, _sql("report_document"))
