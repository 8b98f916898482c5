"""Statement ingest: header mapping, amounts, dates, categoriser, CSV layouts."""

import datetime as dt
import os
import tempfile

import pytest

from tallyspark.functions.categorize import DEFAULT_RULES
from tallyspark.operators.normalize import map_headers, standardize_statement, statement_rejects
from tallyspark.sources.statements import read_statements


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def _raw(spark, header, rows, source="s.csv"):
    cols = ["source_file", "line_no"] + header
    data = [(source, i) + tuple(r) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{c}` {'bigint' if c == 'line_no' else 'string'}" for c in cols)
    return spark.createDataFrame(data, schema)


def test_header_mapping_first_match():
    hm = map_headers([" Transaction Date ", "Details", "Amount"])
    assert (hm.date, hm.description, hm.amount, hm.category) == (0, 0, 2, None)
    hm = map_headers(["Date", "Payee", "Value", "Location"])
    assert (hm.date, hm.description, hm.amount, hm.category) == (0, 1, 2, 3)
    with pytest.raises(ValueError):
        map_headers(["Date", "Memo", "Amount"])
    hm = map_headers(["Date", "Memo", "Amount"], columns={"description": "Memo"})
    assert hm.description == 1


def test_amount_cleaning(spark):
    texts = ["$1,200.50", "€12", "-£3.10", "(45.00)", "n/a", "", "1e3", "12.5d", "0", None, "inf"]
    raw = _raw(spark, ["Date", "Description", "Amount"],
               [("2026-01-05", f"row {i}", t) for i, t in enumerate(texts)])
    out = {r["txn_id"]: (r["Amount"], r["Type"]) for r in standardize_statement(raw).collect()}
    got = [out[i] for i in range(len(texts))]
    assert got == [(1200.5, "Credit"), (12.0, "Credit"), (-3.1, "Debit"), (0.0, "Credit"),
                   (0.0, "Credit"), (0.0, "Credit"), (1000.0, "Credit"), (0.0, "Credit"),
                   (0.0, "Credit"), (0.0, "Credit"), (0.0, "Credit")]


def _dates(spark, values, source):
    raw = _raw(spark, ["Date", "Description", "Amount"],
               [(v, "x", "1") for v in values], source=source)
    return raw


def test_date_election_per_file(spark):
    raw = (_dates(spark, ["01/02/2026", "02/14/2026"], "a.csv")
           .unionByName(_dates(spark, ["01/02/2026", "13/02/2026"], "b.csv"))
           .unionByName(_dates(spark, ["2026-01-05", None], "c.csv"))
           .unionByName(_dates(spark, ["01/02/2026", "2026-01-05"], "d.csv")))
    led = standardize_statement(raw)
    got = sorted((r["source_file"], r["txn_id"], r["Date"]) for r in led.collect())
    assert got == [
        ("a.csv", 0, dt.datetime(2026, 1, 2)), ("a.csv", 1, dt.datetime(2026, 2, 14)),
        ("b.csv", 0, dt.datetime(2026, 2, 1)), ("b.csv", 1, dt.datetime(2026, 2, 13)),
        ("c.csv", 0, dt.datetime(2026, 1, 5)), ("c.csv", 1, None)]
    rej = statement_rejects(raw).collect()
    assert {r["source_file"] for r in rej} == {"d.csv"} and len(rej) == 2
    with pytest.raises(ValueError):
        standardize_statement(raw, on_error="fail")


def test_category_passthrough_and_keywords(spark):
    raw = _raw(spark, ["Date", "Description", "Amount", "Category"],
               [("2026-01-05", "a", "-1", "Food"), ("2026-01-05", "b", "-1", "N/A")])
    cats = sorted(r["Category"] for r in standardize_statement(raw).collect())
    assert cats == ["Food", "Uncategorized"]
    cases = {"Amazon.com Marketplace": "Food & Dining", "Delta Flight 22": "Utilities & Bills",
             "Current Account Fee": "Rent & Housing", "Las Vegas Hotel": "Travel & Transport",
             "Public Storage": "Food & Dining", "Miracle Gym": "Investments & Savings",
             "Interest Charge": "Income", "Cable One": "Travel & Transport", "Virgin Pass": "Other"}
    rows = [("2026-01-05", d, "-1") for d in cases]
    raw = _raw(spark, ["Date", "Description", "Amount"], rows)
    got = {r["Description"]: r["Category"] for r in standardize_statement(raw).collect()}
    assert got == cases


def test_every_keyword_hits_its_rule_or_an_earlier_one(spark):
    rows, expect = [], {}
    order = [c for c, _ in DEFAULT_RULES]
    for cat, kws in DEFAULT_RULES:
        for kw in kws:
            d = f"XX {kw.upper()} YY"
            rows.append(("2026-01-05", d, "-1"))
            expect[d] = cat
    raw = _raw(spark, ["Date", "Description", "Amount"], rows)
    got = {r["Description"]: r["Category"] for r in standardize_statement(raw).collect()}
    for d, cat in expect.items():
        assert order.index(got[d]) <= order.index(cat), d
    assert got["XX FLIGHT YY"] == "Utilities & Bills"


def test_csv_folder_with_mixed_layouts(spark):
    folder = tempfile.mkdtemp(prefix="stmt-")
    _write(folder, "a.csv", "Date,Description,Amount,Category\n2026-01-05,Salary,\"$2,500.00\",Income\n"
                            "2026-01-06,Rent,-1200,Housing\n")
    _write(folder, "b.csv", " Amount ,Payee,Posting Date\n-12.50,Starbucks,01/31/2026\n"
                            "(3.00),Kroger,02/01/2026\n")
    led, rej = read_statements(spark, folder, with_rejects=True)
    got = sorted((os.path.basename(r["source_file"]), r["Description"], r["Amount"], r["Category"],
                  r["Date"]) for r in led.collect())
    assert got == [
        ("a.csv", "Rent", -1200.0, "Housing", dt.datetime(2026, 1, 6)),
        ("a.csv", "Salary", 2500.0, "Income", dt.datetime(2026, 1, 5)),
        ("b.csv", "Kroger", 0.0, "Food & Dining", dt.datetime(2026, 2, 1)),
        ("b.csv", "Starbucks", -12.5, "Food & Dining", dt.datetime(2026, 1, 31)),
    ]
    assert rej.count() == 0


def test_unsupported_suffix_rejected(spark):
    folder = tempfile.mkdtemp(prefix="stmt-")
    _write(folder, "a.txt", "Date,Description,Amount\n2026-01-05,x,1\n")
    with pytest.raises(ValueError):
        read_statements(spark, folder, on_error="fail")
    led, rej = read_statements(spark, folder, with_rejects=True)
    assert led.count() == 0
    assert [r["reject_reason"] for r in rej.collect()] == ["unsupported file format"]


def test_bad_files_are_rejected_and_good_ones_kept(spark):
    folder = tempfile.mkdtemp(prefix="stmt-")
    _write(folder, "good.csv", "\ufeffDate,Description,Amount\r\n2026-01-05,x,1\r\n\r\n2026-01-06,y,2\r\n")
    _write(folder, "late.csv", "\n  \nDate,Description,Amount\n2026-01-07,z,3\n")
    _write(folder, "empty.csv", "")
    _write(folder, "blank.csv", "\n\n")
    _write(folder, "header.csv", "When,Who,How Much\n2026-01-05,x,1\n")
    _write(folder, "only.csv", "Date,Description,Amount\n")
    _write(folder, "book.xlsx", "PK\x03\x04")
    led, rej = read_statements(spark, folder, with_rejects=True)
    assert sorted((os.path.basename(r["source_file"]), r["txn_id"], r["Amount"]) for r in led.collect()) == [
        ("good.csv", 1, 1.0), ("good.csv", 2, 2.0), ("late.csv", 1, 3.0)]
    assert sorted((os.path.basename(r["source_file"]), r["reject_reason"]) for r in rej.collect()) == [
        ("blank.csv", "no header line"), ("book.xlsx", "unsupported file format"), ("empty.csv", "no header line"),
        ("header.csv", "could not map date, description and amount columns")]
    with pytest.raises(ValueError):
        read_statements(spark, folder, on_error="fail")
    named, _ = read_statements(spark, os.path.join(folder, "header.csv"), with_rejects=True,
                               columns={"date": "When", "description": "Who", "amount": "How Much"})
    assert [tuple(r) for r in named.select("Description", "Amount").collect()] == [("x", 1.0)]


def test_quotes_line_breaks_and_wide_rows(spark):
    folder = tempfile.mkdtemp(prefix="stmt-")
    _write(folder, "q.csv", 'Date,Description,Amount,Note\n'
                            '2026-01-05,"Joe ""Big"" Deli, NY","-1,200.50",a\n'
                            '2026-01-06,Rent,-1,200.50,b\n'
                            '2026-01-07,"two\nlines",3\n'
                            '2026-01-08,"",4,\n'
                            '2026-01-09,extra,5,,\n')
    led, rej = read_statements(spark, folder, with_rejects=True)
    got = sorted((r["txn_id"], r["Description"], r["Amount"]) for r in led.collect())
    assert got == [(1, 'Joe "Big" Deli, NY', -1200.5), (3, "two\nlines", 3.0), (4, "", 4.0)]
    assert sorted((r["txn_id"], r["reject_reason"]) for r in rej.collect()) == [
        (2, "more fields than the header"), (5, "more fields than the header")]


def test_a_plain_frame_without_a_file_column(spark):
    df = spark.createDataFrame([("1/5/26", "a", "1"), ("12/31/68", "b", "2"), ("1/1/69", "c", "3")],
                               "Date string, Description string, Amount string")
    got = {r["Description"]: r["Date"] for r in standardize_statement(df).collect()}
    assert got == {"a": dt.datetime(2026, 1, 5), "b": dt.datetime(2068, 12, 31), "c": dt.datetime(1969, 1, 1)}


def test_dates_with_time_and_other_layouts(spark):
    files = {"a": ["01/05/2026 14:30", "12/31/2026 9:05"], "b": ["5 Jan 2026", "31 Dec 2026"],
             "c": ["01-25-2026", "12-31-2026"], "d": ["25-01-2026", "31-12-2026"], "e": ["25/01/2026 14:30:59"],
             "f": ["5 January 2026"]}
    raw = None
    for name, values in files.items():
        part = _dates(spark, values, name)
        raw = part if raw is None else raw.unionByName(part)
    got = sorted((r["source_file"], r["Date"]) for r in standardize_statement(raw).collect())
    d = dt.datetime
    assert got == [("a", d(2026, 1, 5, 14, 30)), ("a", d(2026, 12, 31, 9, 5)), ("b", d(2026, 1, 5)), ("b", d(2026, 12, 31)),
                   ("c", d(2026, 1, 25)), ("c", d(2026, 12, 31)), ("d", d(2026, 1, 25)), ("d", d(2026, 12, 31)),
                   ("e", d(2026, 1, 25, 14, 30, 59)), ("f", d(2026, 1, 5))]


def test_csv_round_trip_of_statements_built_from_orders(spark):
    """Spark writes the raw statements as CSV (two layouts, one folder per
    account) and reads them back; the result equals the in-memory path."""
    import pyspark.sql.functions as F

    from tallyspark.operators.normalize import standardize_statement
    from tallyspark.sources import tables
    raw = tables.raw_statement(tables.read_table(spark, "/root/testdata/sf0.001", "orders"))
    folder = tables.export_raw_statements(raw, os.path.join(tempfile.mkdtemp(prefix="export-"), "s"))
    led = read_statements(spark, folder)
    acct = F.regexp_extract("source_file", r"account_id=(-?\d+)", 1).cast("bigint")
    cols = ["Date", "Description", "Amount", "Category", "Type"]
    got = sorted((tuple(r) for r in led.select(acct.alias("account_id"), *cols).collect()), key=repr)
    want = sorted((tuple(r) for r in standardize_statement(raw).select("account_id", *cols).collect()), key=repr)
    assert got == want and len(got) > 1000


def test_dashboard_job_end_to_end(spark):
    from tallyspark.plans.dashboard import run_dashboard
    base = tempfile.mkdtemp(prefix="dash-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _write(src, "alice.csv", "Date,Description,Amount\n2026-04-01,Corporate Salary Direct Deposit,2500\n"
                             "2026-04-01,Apt 4B Monthly Rental Pay,-1200\n2026-05-01,Payroll,2500\n"
                             "2026-05-05,Comcast High-Speed Internet,-65\n2026-06-01,Payroll,2500\n"
                             "2026-06-20,Vanguard Brokerage ETF VOO,-500\n")
    _write(src, "bob.csv", "Posting Date,Payee,Value,Tag\n03/02/2026,Shell,-40.00,Travel\n"
                           "03/15/2026,Refund,12.50,\n")
    paths = run_dashboard(spark, src, os.path.join(base, "out"), months=2, as_of="2026-07-01")
    assert {"kpis", "forecast", "review_prompt", "report_categories", "rejects"} <= set(paths)
    k = {os.path.basename(r["account_id"]): r for r in spark.read.parquet(paths["kpis"]).collect()}
    assert (k["alice.csv"]["total_income"], k["alice.csv"]["total_expenses"]) == (7500.0, 1765.0)
    assert (k["bob.csv"]["total_income"], k["bob.csv"]["total_expenses"]) == (12.5, 40.0)
    fc = spark.read.parquet(paths["forecast"]).collect()
    assert len(fc) == 3 + 2 + 1 + 2
    cats = {(os.path.basename(r["account_id"]), r["Category"])
            for r in spark.read.parquet(paths["category_share"]).collect()}
    assert ("alice.csv", "Rent & Housing") in cats and ("bob.csv", "Travel") in cats


def test_more_date_layouts(spark):
    raw = (_dates(spark, ["2026/01/05", "2026/12/31"], "e.csv")
           .unionByName(_dates(spark, ["05.01.2026", "31.12.2026"], "f.csv"))
           .unionByName(_dates(spark, ["05-Jan-2026", "31-Dec-2026"], "g.csv"))
           .unionByName(_dates(spark, ["January 5, 2026", "December 31, 2026"], "h.csv")))
    got = sorted((r["source_file"], r["Date"]) for r in standardize_statement(raw).collect())
    want = sorted((f, d) for f in ("e.csv", "f.csv", "g.csv", "h.csv")
                  for d in (dt.datetime(2026, 1, 5), dt.datetime(2026, 12, 31)))
    assert got == want
