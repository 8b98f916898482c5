"""File-stream ingest and the streaming monthly aggregate agree with batch."""

import os
import tempfile

from tallyspark.operators import aggregates as agg
from tallyspark.sources.statements import read_statements
from tallyspark.streaming.ingest import (compact_monthly_totals, read_monthly_totals,
                                         start_monthly_totals, start_statement_ingest)

HEADER = ["Date", "Description", "Amount"]


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(",".join(HEADER) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")


def test_stream_ingest_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _write(src, "a.csv", [("01/05/2026", "Salary", "$2,500.00"), ("01/07/2026", "Kroger", "-85.10"),
                          ("02/03/2026", "Rent", "-1200")])
    _write(src, "b.csv", [("2026-02-01", "Uber", "-12.5"), ("2026-03-09", "Payroll", "100")])
    _write(src, "c.csv", [("01/02/2026", "x", "1"), ("2026-01-05", "y", "2")])  # mixed: rejected
    q = start_statement_ingest(spark, src, HEADER, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(base, "out", "ledger"))
    batch = read_statements(spark, src)
    cols = ["Date", "Description", "Amount", "Category", "Type"]
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(streamed) == key(batch)
    assert spark.read.parquet(os.path.join(base, "out", "rejects")).count() == 3  # two in c.csv, and the unquoted comma in a.csv

    ledger_stream = spark.readStream.schema(streamed.schema).parquet(os.path.join(base, "out", "ledger"))
    totals = os.path.join(base, "totals")
    mq = start_monthly_totals(ledger_stream.drop("batch_id"), totals, os.path.join(base, "ckpt2"))
    mq.awaitTermination(120)
    assert _months(read_monthly_totals(spark, totals)) == _months(agg.monthly_summary(batch))


def _months(df):
    return sorted((r["account_id"], r["Month"], r["Income"], r["Expenses"], r["Savings"], r["SavingsRate"])
                  for r in df.collect())


def test_an_older_statement_that_comes_later_is_not_lost(spark):
    import datetime as dt
    base = tempfile.mkdtemp(prefix="late-")
    src, out = os.path.join(base, "ledger"), os.path.join(base, "totals")
    schema = ("account_id bigint, txn_id bigint, Date timestamp_ntz, Description string, "
              "Amount double, Category string, Type string")
    batches = [
        [(1, 1, dt.datetime(2026, 6, 5), "b", 20.0, "c", "Credit"), (1, 2, None, "undated", 5.0, "c", "Credit")],
        [(2, 3, dt.datetime(2026, 1, 5), "a", 10.0, "c", "Credit"), (2, 4, dt.datetime(2026, 2, 5), "a", -3.0, "c", "Debit")],
        [(1, 5, dt.datetime(2019, 3, 1), "old", 99.0, "c", "Credit"), (1, 6, dt.datetime(2026, 6, 6), "b", -4.0, "c", "Debit")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        start_monthly_totals(stream, out, os.path.join(base, "ckpt")).awaitTermination(120)
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = _months(agg.monthly_summary(everything))
    assert len(want) == 4 and _months(read_monthly_totals(spark, out)) == want
    to = compact_monthly_totals(spark, out, os.path.join(base, "compact"))
    assert _months(read_monthly_totals(spark, to)) == want
