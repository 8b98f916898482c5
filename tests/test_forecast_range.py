"""Forecast of very large ledgers: exact up to 38 digits, null beyond, and no account stops the job."""

import datetime as dt
from fractions import Fraction

import pytest

from tallyspark.operators import forecast as fc

LEDGER = "account_id bigint, txn_id bigint, Date timestamp_ntz, Description string, Amount double, Category string, Type string"


def _ledger(spark, scales):
    rows = []
    for a, x in scales.items():
        for m, k in ((1, 1.0), (2, 2.0), (3, 4.0)):
            rows += [(a, m, dt.datetime(2026, m, 5), "in", x * k, "c", "Credit"), (a, 10 + m, dt.datetime(2026, m, 6), "out", -x, "c", "Debit")]
    return spark.createDataFrame(rows, LEDGER)


def _plain(x, step):
    days = [(dt.date(2026, m, 1) - dt.date(1970, 1, 1)).days for m in (1, 2, 3)]
    cents = [int(Fraction(x) * k * 100) for k in (1, 2, 4)]
    n, sx, sxx, sy = 3, sum(days), sum(d * d for d in days), sum(cents)
    slope = Fraction(n * sum(d * c for d, c in zip(days, cents)) - sx * sy, n * sxx - sx * sx)
    at = (dt.date(2026, 3 + step, 1) - dt.date(1970, 1, 1)).days
    y = Fraction(sy, n) + slope * (at - Fraction(sx, n))
    return float(max(0, int(y + Fraction(1, 2)))) / 100, float(round(slope * 10000)) / 1e6


def test_large_accounts_are_exact(spark):
    scales = {1: 10.0, 2: 1e12, 3: 1e15, 4: 1e17, 5: 1e18}
    led = _ledger(spark, scales)
    got = {(r["account_id"], r["MonthDate"].month): r for r in fc.forecast(led, 2).collect() if r["IsProjected"]}
    slopes = {r["account_id"]: r["income_slope_per_day"] for r in fc.fit_trend(led).collect()}
    for a, x in scales.items():
        for step in (1, 2):
            assert got[a, 3 + step]["Income"] == pytest.approx(_plain(x, step)[0], rel=1e-15)
            assert got[a, 3 + step]["Expenses"] == pytest.approx(x, rel=1e-15)
        assert slopes[a] == pytest.approx(_plain(x, 1)[1], rel=1e-15)


def test_accounts_out_of_range_are_null_and_stop_nothing(spark):
    led = _ledger(spark, {1: 10.0, 2: 1e27, 3: 1e30})
    rows = fc.forecast(led, 3).collect()
    assert len(rows) == 3 * 6
    by = {(r["account_id"], r["MonthDate"].month): r for r in rows}
    assert by[1, 4]["Income"] == _plain(10.0, 1)[0]
    assert by[2, 4]["Income"] == pytest.approx(_plain(1e27, 1)[0], rel=1e-12) and by[2, 1]["Income"] == pytest.approx(1e27, rel=1e-12)
    assert by[3, 4]["Income"] is None and by[3, 1]["Income"] is None
    assert {r["account_id"]: r["income_slope_per_day"] for r in fc.fit_trend(led).collect()}[3] is None
    assert len(fc.projections(led, 3).collect()) == 9 and fc.forecast_horizon(led, 3).count() == 9


def test_single_months_and_horizon_bounds(spark):
    led = _ledger(spark, {1: 10.0, 2: 1e20}).where("txn_id IN (1, 11)")
    got = {r["account_id"]: r for r in fc.projections(led, 1).collect()}
    assert (got[1]["Income"], got[1]["Expenses"]) == (10.0, 9.85)
    assert got[2]["Expenses"] == pytest.approx(9.85e19)
    for bad in (0, 13, "3", True):
        with pytest.raises(ValueError):
            fc.forecast(led, bad)
