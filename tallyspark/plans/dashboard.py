"""The whole dashboard as one batch job over many accounts.

read statements -> normalise -> stage the ledger once (shared checkpoint
folder) -> write every per-account output. Each output is its own Spark job
reading the staged parquet ledger, so ingest runs once, and a failure in one
output re-runs only that output's stages.

    python -m tallyspark.plans.dashboard --statements <csv folder> --out <folder> \
        --as-of 2026-07-01 [--goals <parquet>] [--months 3] [--format parquet]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import aggregates as agg
from tallyspark.operators import context, forecast, goals
from tallyspark.session import drop_staged, materialize
from tallyspark.sources.sinks import write_table
from tallyspark.sources.statements import read_statements


def dashboard_outputs(ledger: DataFrame, as_of: str, months: int = 3, goals_df: DataFrame | None = None,
                      advisor: str = context.DEFAULT_ADVISOR) -> dict[str, DataFrame]:
    """Every per-account output of the dashboard, as DataFrames (no actions)."""
    out = {
        "kpis": agg.kpi_summary(ledger),
        "kpi_display": context.kpi_display(ledger),
        "monthly_summary": agg.monthly_summary(ledger),
        "monthly_cash_flow_long": agg.monthly_cash_flow_long(ledger),
        "category_share": agg.category_share(ledger),
        "top_transactions": agg.top_transactions(ledger),
        "forecast": forecast.forecast(ledger, months),
        "financial_context": context.financial_context(ledger).drop("category_expenses",
                                                                    "top_5_largest_transactions"),
        "review_prompt": context.review_prompt(ledger, advisor),
        "report_kpis": context.report_kpis(ledger),
        "report_categories": context.report_categories(ledger),
        "report_document": context.report_document(ledger, f"{as_of} 00:00:00"),
        "default_contribution": agg.default_contribution(ledger),
    }
    if goals_df is not None:
        out["savings_goal"] = goals.savings_goal(goals_df, ledger, as_of)
        out["goal_rejects"] = goals.goal_validation(goals_df, ledger)
    return out


def run_dashboard(spark: SparkSession, statements: str, out_dir: str, as_of: str, months: int = 3,
                  goals_path: str | None = None, fmt: str = "parquet") -> dict[str, str]:
    """Ingest statements, stage the ledger, write all outputs; returns paths.

    ``as_of`` dates the goals and the report and has no default. The staged
    ledger is deleted at the end.
    """
    ledger, rejects = read_statements(spark, statements, with_rejects=True)
    staged = materialize(ledger, "dashboard-ledger")
    goals_df = spark.read.parquet(goals_path) if goals_path else None
    paths = {"rejects": write_table(rejects, os.path.join(out_dir, "rejects"), fmt)}
    for name, df in dashboard_outputs(staged, as_of, months, goals_df).items():
        paths[name] = write_table(df, os.path.join(out_dir, name), fmt)
    drop_staged(staged)
    return paths


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--statements", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--goals")
    ap.add_argument("--months", type=int, default=3)
    ap.add_argument("--as-of", required=True)
    ap.add_argument("--format", default="parquet")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from tallyspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    for name, path in run_dashboard(spark, args.statements, args.out, args.as_of, args.months,
                                    args.goals, args.format).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
