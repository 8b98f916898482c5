"""Per-operator checks on literal ledgers with hand-computed answers."""

import datetime as dt

import pytest

from tallyspark.operators import aggregates as agg
from tallyspark.operators import context, filters, forecast, goals

SCHEMA = "account_id bigint, txn_id bigint, Date timestamp_ntz, Description string, Amount double, " \
         "Category string, Type string"


def ledger(spark, rows):
    """rows: (account, txn, date 'YYYY-MM-DD' or None, desc, amount, category)."""
    data = [(a, t, dt.datetime.fromisoformat(d) if d else None, desc, amt, cat,
             "Credit" if amt >= 0 else "Debit") for a, t, d, desc, amt, cat in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def trend(spark):
    rows = []
    for i, (m, e) in enumerate([(4, 100.0), (5, 200.0), (6, 300.0)]):
        rows.append((1, 10 * i, f"2026-0{m}-01", "Salary", 5000.0, "Income"))
        rows.append((1, 10 * i + 1, f"2026-0{m}-01", "Bill", -e, "Utilities"))
    return ledger(spark, rows)


def test_trend_projection(trend):
    proj = forecast.projections(trend, 1).collect()
    assert len(proj) == 1
    r = proj[0]
    assert r["MonthDate"] == dt.date(2026, 7, 1)
    assert (r["Income"], r["Expenses"], r["Savings"]) == (5000.0, 398.89, 4601.11)
    fit = forecast.fit_trend(trend).collect()[0]
    assert fit["n_months"] == 3 and fit["income_slope_per_day"] == 0.0
    assert fit["expenses_slope_per_day"] == round(6100 / 1860.6666666666667, 6)


def test_forecast_union_and_flags(trend):
    rows = forecast.forecast(trend, 3).orderBy("MonthDate").collect()
    assert [r["IsProjected"] for r in rows] == [False] * 3 + [True] * 3
    assert [r["MonthDate"] for r in rows][-1] == dt.date(2026, 9, 1)
    line = filters.projection_trend_line(forecast.forecast(trend, 3)).collect()
    assert sorted(r["MonthDate"] for r in line)[0] == dt.date(2026, 6, 1) and len(line) == 4


def test_fallback_single_month(spark):
    led = ledger(spark, [(2, 1, "2026-06-01", "Pay", 5000.0, "Income"),
                         (2, 2, "2026-06-03", "Rent", -3500.0, "Rent")])
    rows = forecast.projections(led, 3).orderBy("MonthDate").collect()
    assert [r["Expenses"] for r in rows] == [3447.5, 3395.0, 3342.5]
    assert [r["Savings"] for r in rows] == [1552.5, 1605.0, 1657.5]
    assert [r["Income"] for r in rows] == [5000.0] * 3


def test_clamp_at_zero(spark):
    rows = []
    for i, (m, e) in enumerate([(4, 300.0), (5, 200.0), (6, 100.0)]):
        rows.append((3, i, f"2026-0{m}-10", "Bill", -e, "Bills"))
    proj = forecast.projections(ledger(spark, rows), 12).collect()
    assert min(r["Expenses"] for r in proj) == 0.0
    assert all(r["Income"] == 0.0 for r in proj)


def test_horizon_must_be_positive(trend):
    with pytest.raises(ValueError):
        forecast.forecast(trend, 0)


def test_empty_groups(spark):
    led = ledger(spark, [
        (10, 1, "2026-01-05", "Rent", -100.0, "Rent"),          # debits only
        (11, 2, "2026-01-05", "Pay", 50.0, "Income"),            # credits only
        (12, 3, None, "Pay", 20.0, "Income"),                    # undated only
        (12, 4, None, "Shop", -5.0, "Shopping")])
    k = {r["account_id"]: r for r in agg.kpi_summary(led).collect()}
    assert (k[10]["total_income"], k[10]["savings_rate"]) == (0.0, 0.0)
    assert k[11]["total_expenses"] == 0.0 and k[11]["savings_rate"] == 100.0
    assert (k[12]["total_income"], k[12]["total_expenses"], k[12]["net_savings"]) == (20.0, 5.0, 15.0)
    cats = {r["account_id"] for r in agg.category_expenses(led).collect()}
    assert 11 not in cats and 12 in cats
    months = {r["account_id"] for r in agg.monthly_summary(led).collect()}
    assert months == {10, 11}
    assert {r["account_id"] for r in forecast.forecast(led, 3).collect()} == {10, 11}
    dc = {r["account_id"]: r["monthly_contribution"] for r in agg.default_contribution(led).collect()}
    assert dc == {10: 100.0, 11: 100.0, 12: 500.0}
    ctx = {r["account_id"]: r for r in context.financial_context(led).collect()}
    assert ctx[11]["category_json"] == "[]" and ctx[11]["category_expenses"] == []
    assert ctx[11]["category_json_indented"] == "[]"


def test_goal_timeline(spark):
    g = spark.createDataFrame(
        [(1, "Emergency Fund", 10000.0, 2000.0, 500.0), (2, "Car", 1500.0, 2000.0, 500.0),
         (3, "Bad", 50.0, 0.0, 500.0)],
        "account_id bigint, goal_name string, target_amount double, current_savings double, "
        "monthly_contribution double")
    out = {r["account_id"]: r for r in goals.savings_goal(g, None, "2026-07-01").collect()}
    assert out[1]["months_required"] == 16.0 and out[1]["months_required_text"] == "16.0"
    assert out[1]["remaining_text"] == "$8,000.00"
    assert out[1]["target_date"] == dt.date(2027, 11, 1) and out[1]["target_month"] == "November 2027"
    assert out[2]["achieved"] is True and out[2]["target_date"] is None
    assert 3 not in out
    bad = goals.goal_validation(g).collect()
    assert [(r["account_id"], r["reject_reason"]) for r in bad] == [(3, "target_amount below 100")]


def test_top_transactions_and_lines(spark):
    led = ledger(spark, [(1, i, "2026-01-0%d" % (i % 9 + 1), f"t{i}", float(a), "X")
                         for i, a in enumerate([-5, 10, -300, 40, 2500, -2500, 1, 7])])
    top = agg.top_transactions(led, 5).orderBy("rank").collect()
    assert [r["Amount"] for r in top] == [-2500.0, 2500.0, -300.0, 40.0, 10.0]
    lines = context.top_transaction_lines(led, 2).orderBy("rank").collect()
    assert lines[0]["line"] == "2026-01-06 - t5: $-2500.0"


def test_kpi_and_category_invariants(spark):
    rows = [(a, i, f"2026-0{1 + i % 6}-1{i % 9}", f"d{i}", float(((i * 37) % 200) - 120) + 0.25,
             f"c{i % 4}") for a in (1, 2, 3) for i in range(40)]
    rows += [(1, 99, None, "undated", -12.5, "c0")]
    led = ledger(spark, rows)
    k = {r["account_id"]: r for r in agg.kpi_summary(led).collect()}
    share = agg.category_share(led).collect()
    for acct in (1, 2, 3):
        mine = [r for r in share if r["account_id"] == acct]
        assert round(sum(r["Amount"] for r in mine), 2) == k[acct]["total_expenses"]
        assert abs(sum(r["share_pct"] for r in mine) - 100.0) < 1e-9
    months = agg.monthly_summary(led).collect()
    inc = sum(r["Income"] for r in months if r["account_id"] == 1)
    assert round(inc, 2) == k[1]["total_income"]  # the undated row is a debit
    again = {r["account_id"]: r for r in agg.kpi_summary(led.repartition(7, "txn_id")).collect()}
    assert again == k


def test_search_regex_and_literal(spark):
    led = ledger(spark, [(1, 1, "2026-01-01", "Whole Foods", -12.5, "Food"),
                         (1, 2, "2026-01-01", "Uber", -7.0, "Travel"),
                         (1, 3, "2026-01-01", "a+b shop", 1200.0, "Shopping")])
    ids = lambda df: sorted(r["txn_id"] for r in df.collect())
    assert ids(filters.search_transactions(led, "FOOD|uber")) == [1, 2]
    assert ids(filters.search_transactions(led, "12")) == [1, 3]
    assert ids(filters.search_transactions(led, "a+b", mode="literal")) == [3]
    assert ids(filters.search_transactions(led, "")) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.search_transactions(led, "(")


def test_text_blocks(spark):
    text = "# Title **x**\n- a **b**\n**b** c\n\n\t plain line \r\n* star\n#"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [(r["kind"], r["text"], r["markup"]) for r in
           context.text_blocks(docs).orderBy("line_no").collect()]
    assert got == [("heading", "Title **x**", "<b>Title **x**</b>"),
                   ("bullet", "a <b>b</b>", "• a <b>b</b>"),
                   ("bullet", "<b>b</b> c", "• <b>b</b> c"),
                   ("paragraph", "plain line", "plain line"),
                   ("bullet", "star", "• star"),
                   ("heading", "", "<b></b>")]


def test_display_strings(spark):
    led = ledger(spark, [(1, 1, "2026-01-01", "Pay", 1234.5, "Income"),
                         (1, 2, "2026-01-02", "Rent", -1000.25, "Rent")])
    d = context.kpi_display(led).collect()[0]
    assert (d["income_text"], d["expenses_text"], d["net_text"], d["rate_text"]) == \
        ("$1,234.50", "$1,000.25", "$234.25", "19.0%")
    assert d["rate_band"] == "blue"
    p = context.review_prompt(led).collect()[0]["prompt"]
    assert "- Total Income: $1,234.5\n" in p and "- Savings Rate: 18.98%" in p
    assert '"Category": "Rent",\n    "Total Spent": 1000.25' in p


def test_dialog_assembly_order_and_roles(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
                                  (1, 2, "system", "note"), (1, 3, "user", "last")],
                                 "conv_id bigint, turn bigint, role string, text string")
    led = ledger(spark, [(1, 1, "2026-01-01", "Pay", 10.0, "Income")])
    rows = context.dialog_assembly(conv, led).orderBy("position").collect()
    assert [r["role"] for r in rows] == ["user", "model", "user", "model", "model", "user"]
    assert rows[0]["text"].startswith("System Context: \nYou are ")
    assert rows[-1]["text"] == "last"


def test_unpivot_chart_dataset(trend):
    rows = agg.monthly_cash_flow_long(trend).collect()
    assert len(rows) == 6 and {r["variable"] for r in rows} == {"Income", "Expenses"}


def test_write_report(spark):
    import os
    import tempfile

    from tallyspark.sources.sinks import write_report
    led = ledger(spark, [(1, 1, "2026-01-01", "Pay", 100.0, "Income"),
                         (1, 2, "2026-01-02", "Rent", -40.0, "Rent")])
    review = spark.createDataFrame([(1, "# Plan\n- save **more**")], "account_id bigint, text string")
    out = write_report(led, tempfile.mkdtemp(prefix="report-"), "csv", review)
    assert set(out) == {"kpis", "categories", "review_blocks"}
    kp = spark.read.option("header", True).csv(out["kpis"]).orderBy("position").collect()
    assert [r["value"] for r in kp] == ["$100.00", "$40.00", "$60.00", "60.0%"]
    assert os.path.isdir(out["review_blocks"])
    cats = spark.read.option("header", True).csv(out["categories"]).collect()
    assert [(r["Category"], r["amount_text"], r["share_text"]) for r in cats] == [("Rent", "$40.00", "100.0%")]


def test_results_of_disjoint_ledgers_union(spark):
    a = ledger(spark, [(1, i, f"2026-0{1 + i % 5}-0{1 + i % 8}", f"a{i}", float(i * 7 % 90 - 40), "x")
                       for i in range(30)])
    b = ledger(spark, [(2, i, f"2026-0{2 + i % 4}-1{i % 9}", f"b{i}", float(i * 11 % 70 - 30), "y")
                       for i in range(25)])
    both = a.unionByName(b)
    for op in (agg.kpi_summary, agg.monthly_summary, agg.category_share,
               lambda df: forecast.forecast(df, 4), lambda df: agg.top_transactions(df, 3)):
        whole = sorted(tuple(r) for r in op(both).collect())
        parts = sorted(tuple(r) for r in op(a).collect()) + sorted(tuple(r) for r in op(b).collect())
        assert whole == sorted(parts)


def test_search_python_named_groups(spark):
    led = ledger(spark, [(1, 1, "2026-01-01", "abab shop", -1.0, "X"),
                         (1, 2, "2026-01-01", "abcd", -2.0, "X")])
    got = [r["txn_id"] for r in filters.search_transactions(led, r"(?P<x>ab)(?P=x)").collect()]
    assert got == [1]


def test_report_document(spark):
    led = ledger(spark, [(1, 1, "2026-01-01", "Pay", 100.0, "Income"),
                         (1, 2, "2026-01-02", "Rent", -40.0, "Rent"),
                         (1, 3, "2026-01-03", "Food", -10.0, "Food")])
    rv = spark.createDataFrame([(1, "# Plan\n- save **more**")], "account_id bigint, text string")
    rows = [tuple(r)[1:] for r in
            context.report_document(led, "2026-07-01 09:05:00", rv).orderBy("section", "seq").collect()]
    assert rows[1] == (0, 1, "subtitle", "Report Generated: July 01, 2026 at 09:05 AM", None, None)
    assert rows[7] == (1, 5, "table_row", "Calculated Savings Rate", "50.0%", None)
    assert rows[10:12] == [(2, 2, "table_row", "Rent", "$40.00", "80.0%"),
                           (2, 3, "table_row", "Food", "$10.00", "20.0%")]
    assert rows[12][2] == "page_break"
    assert rows[-2:] == [(4, 1, "heading", "<b>Plan</b>", None, None),
                         (4, 2, "bullet", "• save <b>more</b>", None, None)]


def test_undated_top_line_and_missing_description(spark):
    led = ledger(spark, [(1, 1, None, "Big refund", 900.0, "Other"),
                         (1, 2, "2026-02-01", "Small", -5.0, "Other")])
    lines = [r["line"] for r in context.top_transaction_lines(led, 5).orderBy("rank").collect()]
    assert lines == [" - Big refund: $900.0", "2026-02-01 - Small: $-5.0"]
    from tallyspark.operators.normalize import standardize_statement
    raw = spark.createDataFrame([("s.csv", 0, "2026-01-05", None, "1"), ("s.csv", 1, "2026-01-06", "NA", "2")],
                                "source_file string, line_no bigint, Date string, Description string, "
                                "Amount string")
    assert sorted(r["Description"] for r in standardize_statement(raw).collect()) == ["", ""]
