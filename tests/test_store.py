"""Stored ledger without exchanges, totals refreshed by month, reports committed whole."""

import datetime as dt
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as agg
from tallyspark.operators import context, forecast
from tallyspark.sources import sinks, store

LEDGER = "account_id bigint, txn_id bigint, Date timestamp_ntz, Description string, Amount double, Category string, Type string, source_file string"
OPERATORS = {
    "kpi_summary": agg.kpi_summary, "monthly_summary": agg.monthly_summary, "category_share": agg.category_share,
    "top_transactions": lambda d: agg.top_transactions(d, 5), "fit_trend": forecast.fit_trend, "forecast": forecast.forecast,
    "financial_context": lambda d: context.financial_context(d).select("account_id", "total_income", "category_expenses", "top_5_largest_transactions"),
}


def _rows(n, seed=1, accounts=9, files=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = round(rng.uniform(-500, 400), 2)
        day = None if rng.random() < 0.05 else dt.datetime(2026, rng.randint(1, 6), rng.randint(1, 28))
        out.append((rng.choice([1, 1, 1, *range(accounts)]), i, day, f"row {i}", x, rng.choice("abc"), "Credit" if x >= 0 else "Debit", f"f{rng.randrange(files)}"))
    return out


def _same(a, b):
    key = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    assert key(a) == key(b)


@pytest.fixture(scope="module")
def stored(spark):
    led = spark.createDataFrame(_rows(600), LEDGER)
    folder = tempfile.mkdtemp(prefix="store-")
    name = f"ledger_{uuid.uuid4().hex[:8]}"
    yield led, store.store_ledger(led, name, folder, buckets=4, hot_rows=100)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"DROP TABLE {name}_hot")


@pytest.mark.parametrize("name", OPERATORS)
def test_per_account_results_without_an_exchange(stored, name):
    led, parts = stored
    operator = OPERATORS[name]
    _same(store.per_account(parts, operator), operator(led))
    plan = operator(parts.bucketed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan, plan


def test_hot_accounts_lie_apart(stored):
    led, parts = stored
    assert [r["account_id"] for r in parts.hot.select("account_id").distinct().collect()] == [1]
    assert parts.bucketed.where("account_id = 1").count() == 0
    assert parts.bucketed.count() + parts.hot.count() == led.count()


def _check_totals(spark, path, rows):
    led = spark.createDataFrame(rows, LEDGER)
    totals = store.read_totals(spark, path)
    _same(store.kpis_of_totals(totals), agg.kpi_summary(led))
    _same(store.months_of_totals(totals), agg.monthly_summary(led))
    _same(store.categories_of_totals(totals), agg.category_expenses(led))


def _files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_file string")


def test_late_and_corrected_files_replace_their_own_part(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="totals-"), "t")
    rows = _rows(300)
    led = lambda some: spark.createDataFrame(some, LEDGER)
    store.refresh_totals(led([r for r in rows if r[7] in ("f0", "f1")]), _files(spark, "f0", "f1"), path)
    _check_totals(spark, path, [r for r in rows if r[7] in ("f0", "f1")])
    months = store.refresh_totals(led([r for r in rows if r[7] == "f2"]), _files(spark, "f2"), path)  # a late file
    assert "undated" in months
    now = [r for r in rows if r[7] in ("f0", "f1", "f2")]
    _check_totals(spark, path, now)
    # f1 is sent again with all its rows in one month; its old months are corrected, others not touched.
    before = {f: os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path)}
    sent = [(r[0], r[1], dt.datetime(2026, 2, 3), *r[3:4], -1.25, r[5], "Debit", "f9") for r in rows[:10]]
    assert store.refresh_totals(led(sent), _files(spark, "f9"), path) == ["2026-02"]
    after = {f: os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path)}
    assert {f for f in after if f.startswith("month=") and after[f] != before[f]} == {"month=2026-02"}
    now += sent
    _check_totals(spark, path, now)
    corrected = [(r[0], r[1], dt.datetime(2026, 7, 1), *r[3:]) for r in now if r[7] == "f1"]
    store.refresh_totals(led(corrected), _files(spark, "f1"), path)
    now = [r for r in now if r[7] != "f1"] + corrected
    _check_totals(spark, path, now)
    store.refresh_totals(led(corrected), _files(spark, "f1"), path)  # once more: the same
    _check_totals(spark, path, now)
    store.refresh_totals(led([]), _files(spark, "f0", "f1", "f2", "f9"), path)  # files that give nothing any more
    assert store.read_totals(spark, path).count() == 0


def test_report_is_committed_whole(spark, monkeypatch):
    out = tempfile.mkdtemp(prefix="report-")
    led = spark.createDataFrame(_rows(100), LEDGER)
    review = spark.createDataFrame([(1, "# Head\n- a **b**")], "account_id bigint, text string")
    stamp = "2026-07-01 09:00:00"
    sinks.write_report(led, out, review_text=review, generated_at=stamp, buckets=4)
    doc = sinks.read_report(spark, out, "report_document")
    _same(doc.drop("bucket"), context.report_document(led, stamp, review))
    _same(sinks.read_report(spark, out, "kpis").drop("bucket"), context.report_kpis(led))
    assert sinks.read_report(spark, out, "review_blocks").count() == 2
    first = sinks.read_current(spark, out)["version"]
    mine = doc.where(F.col("bucket") == doc.where("account_id = 1").first()["bucket"])
    assert "PartitionFilters: [isnotnull(bucket" in mine._jdf.queryExecution().executedPlan().toString()

    # A job that fails half-way leaves the former report.
    monkeypatch.setattr(context, "report_document", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sinks.write_report(led.where("account_id = 1"), out, generated_at=stamp)
    real = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, path, *a, **k: real(df, path, *a, **k) if "kpis" in path else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sinks.write_report(led.where("account_id = 1"), out)
    monkeypatch.undo()
    assert sinks.read_current(spark, out)["version"] == first
    _same(sinks.read_report(spark, out, "kpis").drop("bucket"), context.report_kpis(led))

    sinks.write_report(led.where("account_id = 1"), out, "csv")
    assert sinks.read_report(spark, out, "kpis").count() == context.report_kpis(led.where("account_id = 1")).count()
    gone = sinks.drop_old_reports(spark, out)
    assert first in gone and len(gone) == 2 and sinks.read_report(spark, out, "kpis").count() > 0
