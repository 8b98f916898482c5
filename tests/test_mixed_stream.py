"""Streamed statements with differing headers equal the batch read, also when a batch runs again."""

import os
import tempfile

from tallyspark.sources.statements import read_statements
from tallyspark.streaming.ingest import start_mixed_ingest

FILES = {
    "a.csv": "Date,Description,Amount\n2026-01-05,Payroll,100\n2026-01-06,\"two\nlines\",-5\n",
    "b.csv": "Amount (USD),Payee,Posting Date,Tag\n-3.50,Shell,13/02/2026,Travel\n",
    "c.csv": "When,Who,How Much\n2026-01-05,x,1\n",
    "d.csv": "Value,Merchant,Transaction Date\n7,Uber,02/28/2026\n1,x,2,3\n",
    "e.txt": "not a statement",
}


def _write(folder, names):
    for name in names:
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(FILES[name])


def _rows(df):
    return sorted((os.path.basename(r["source_file"]), r["txn_id"], r["Description"], r["Amount"], str(r["Date"]), r["Category"]) for r in df.collect())


def test_mixed_headers_in_a_stream(spark):
    folder, out, check = (tempfile.mkdtemp(prefix=f"mixed-{k}-") for k in ("in", "out", "check"))
    _write(folder, ["a.csv", "b.csv", "e.txt"])
    run = lambda: start_mixed_ingest(spark, folder, out, check, max_files_per_trigger=2).awaitTermination()
    run()
    first = _rows(spark.read.parquet(os.path.join(out, "ledger")))
    assert [r[0] for r in first] == ["a.csv", "a.csv", "b.csv"]
    _write(folder, ["c.csv", "d.csv"])
    run()
    want, rejects = read_statements(spark, folder, with_rejects=True)
    assert _rows(spark.read.parquet(os.path.join(out, "ledger"))) == _rows(want)
    reasons = lambda df: sorted((os.path.basename(r["source_file"]), r["reject_reason"]) for r in df.collect())
    assert reasons(spark.read.parquet(os.path.join(out, "rejects"))) == reasons(rejects) and rejects.count() == 3
    assert len(os.listdir(os.path.join(out, "ledger"))) >= 3  # batches of at most two files

    # The last batch runs again, as after a failure before its commit: the same rows, none twice.
    commits = sorted((f for f in os.listdir(os.path.join(check, "commits")) if f.isdigit()), key=int)
    os.remove(os.path.join(check, "commits", commits[-1]))
    crc = os.path.join(check, "commits", f".{commits[-1]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    run()
    assert _rows(spark.read.parquet(os.path.join(out, "ledger"))) == _rows(want)
