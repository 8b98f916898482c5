"""Sums without caps, robust search and goals, Python's repr, order carried by columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as agg
from tallyspark.operators.context import py_str_repr
from tallyspark.operators.filters import search_transactions
from tallyspark.operators.goals import savings_goal
from tallyspark.session import drop_staged, materialize

LEDGER = ("account_id bigint, txn_id bigint, Date timestamp_ntz, Description string, "
          "Amount double, Category string, Type string")
D = dt.datetime


def _ledger(spark, rows):
    return spark.createDataFrame([(a, i, d, t, x, c, "Credit" if x >= 0 else "Debit")
                                  for i, (a, d, t, x, c) in enumerate(rows)], LEDGER)


def test_sub_cent_amounts_add_up(spark):
    rows = spark.range(100_000).select(
        F.lit(1).cast("bigint").alias("account_id"), F.col("id").alias("txn_id"),
        F.lit("2026-01-05").cast("timestamp_ntz").alias("Date"), F.lit("x").alias("Description"),
        F.lit(0.00004).alias("Amount"), F.lit("c").alias("Category"), F.lit("Credit").alias("Type"))
    r = agg.kpi_summary(rows).first()
    assert (r["total_income"], r["savings_rate"], r["rate_band"]) == (4.0, 100.0, "green")
    assert agg.monthly_summary(rows).first()["Income"] == 4.0


def test_large_amounts_are_kept_and_stop_nothing(spark):
    day = D(2026, 1, 5)
    led = _ledger(spark, [(1, day, "a", 1e15, "c"), (2, day, "a", -2e14, "c"), (2, day, "b", 1.25, "c"),
                          (3, day, "a", 3e20, "c"), (3, day, "b", -1e30, "c"), (4, day, "a", 10.0, "c")])
    got = {r["account_id"]: r for r in agg.kpi_summary(led).collect()}
    assert got[1]["total_income"] == 1e15
    assert (got[2]["total_income"], got[2]["total_expenses"]) == (1.25, 2e14)
    assert got[3]["total_income"] == 3e20 and got[3]["total_expenses"] is None  # beyond 1e28
    assert got[4]["total_income"] == 10.0
    for out in (agg.category_share(led), agg.monthly_summary(led), agg.default_contribution(led)):
        assert out.count() > 0


def test_search_takes_python_classes_and_group_names(spark):
    led = _ledger(spark, [(1, D(2026, 1, 5), "caf\u00e9", -1.0, "c"), (1, D(2026, 1, 5), "ab ab", -2.0, "c")])
    hit = lambda q: {r["Description"] for r in search_transactions(led, q).collect()}
    assert hit(r"caf\w$") == {"caf\u00e9"}
    assert hit(r"(?P<a_b>ab) (?P=a_b)") == {"ab ab"}
    with pytest.raises(ValueError):
        search_transactions(led, r"(?P<x>a)(?(x)b|c)")


def test_a_goal_beyond_all_dates_has_no_date(spark):
    goals = spark.createDataFrame([(1, "far", 1e13, 0.0, 10.0), (2, "near", 1000.0, 0.0, 100.0)],
                                  "account_id bigint, goal_name string, target_amount double, "
                                  "current_savings double, monthly_contribution double")
    got = {r["goal_name"]: r for r in savings_goal(goals, None, "2026-07-01").collect()}
    assert got["far"]["target_date"] is None and got["far"]["months_required"] == 1e12
    assert got["near"]["target_date"] == dt.date(2027, 5, 1)
    with pytest.raises(TypeError):
        savings_goal(goals, None)


def test_repr_is_pythons(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "a\\b", "\n\r\t", "\x07\x00\x7f", "\xa0\u200b\u2028", "\U0001f642 \U000e0001", "\u00e9 \u6f22", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", py_str_repr(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == {t: repr(t) for t in texts}


def test_order_is_carried_by_columns(spark):
    led = _ledger(spark, [(1, D(2026, 1, 5, 1), "a", 1.0, "c"), (1, None, "b", 1.0, "c"), (1, D(2026, 3, 5), "c", 1.0, "c"),
                          (1, D(2026, 1, 5, 2), "d", 1.0, "c"), (2, D(1960, 1, 1), "e", 1.0, "c")])
    out = agg.ledger_newest_first(led)
    assert [r["Description"] for r in out.collect()] == ["c", "d", "a", "b", "e"]
    again = sorted(out.collect()[::-1], key=lambda r: (r["account_id"], r["sort_key"], r["txn_id"]))
    assert [r["Description"] for r in again] == ["c", "d", "a", "b", "e"]
    months = agg.monthly_series(led).where("account_id = 1").collect()
    assert sorted((r["position"], r["MonthDate"]) for r in months) == [(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 3, 1))]


def test_staged_tables_can_be_dropped(spark):
    staged = materialize(spark.range(5), "drop-me")
    assert staged.count() == 5
    path = staged.inputFiles()[0]
    drop_staged(staged)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_json_text_with_a_final_line_break(spark):
    import json

    from tallyspark.functions.text import json_string
    texts = ["\r", "a\n", "a\r\n", "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string("t").alias("j"))
    assert {r["t"]: r["j"] for r in df.collect()} == {t: json.dumps(t) for t in texts}
