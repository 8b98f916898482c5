"""CSV records read by many tasks: split borders, odd files, width, dates by bits, counts of the writes."""

import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.dates import DATE_FORMATS, date_format_bits, lowest_bit, parse_date_as
from tallyspark.sources import records as records_module
from tallyspark.sources import statements
from tallyspark.sources.records import leaves_open, list_files, read_records, record_fields, text_lines
from tallyspark.sources.statements import ingest_statements, read_statements


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as fh:
        fh.write(text)


def _random_csv(rng, rows, line_end):
    bits = ["a", "b c", "é", '""', ",", "\n", "\r\n", "x" * 30, "1,5", ""]
    out = [["Date", "Description", "Amount", "Note"]]
    for i in range(rows):
        out.append([f"2026-01-{i % 28 + 1:02d}", f"row {i} " + "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), str(i), rng.choice(bits)])
    text = io.StringIO()
    csv.writer(text, lineterminator=line_end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(out)
    return text.getvalue(), out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_breaks_over_split_borders(spark, small_splits):
    rng, folder, want = random.Random(3), tempfile.mkdtemp(prefix="rec-"), {}
    for k in range(6):
        text, rows = _random_csv(rng, 40, "\n" if k % 2 else "\r\n")
        _write(folder, f"f{k}.csv", text)
        want[f"f{k}.csv"] = rows
    records = read_records(spark, [folder])
    assert records.lines.select("source_file", "block").distinct().count() > 40  # every file lies in many splits
    files = records.files.select("source_file", "plain", "splits")
    got = {}
    for r in records.numbered(files).select("source_file", "rec_no", record_fields(F.col("value")).alias("f")).collect():
        got.setdefault(os.path.basename(r["source_file"]), {})[r["rec_no"]] = r["f"]
    assert {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()} == want


def test_blank_lines_beside_records_and_inside_fields_over_split_borders(spark, small_splits):
    rng, folder, want = random.Random(11), tempfile.mkdtemp(prefix="rec-"), {}
    for k in range(3):
        rows, text = [["Date", "Description", "Amount"]], "\n \nDate,Description,Amount\n"
        for i in range(30):
            note = f"row {i}" + "".join(rng.choice(["\n", "\n\n", "\n  \n", '"', "\r", " x" * 20]) for _ in range(rng.randint(0, 5)))
            rows.append(["2026-01-05", note, str(i)])
            text += '2026-01-05,"' + note.replace('"', '""') + f'",{i}\n' + rng.choice(["", "", "\n", "\t\n\n"])
        _write(folder, f"f{k}.csv", text)
        want[f"f{k}.csv"] = rows
    got = {}
    for r in read_records(spark, [folder]).odd.select("source_file", "rec_no", record_fields(F.col("value")).alias("f")).collect():
        got.setdefault(os.path.basename(r["source_file"]), {})[r["rec_no"]] = r["f"]
    assert {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()} == want


def test_lines_of_odd_files_are_sorted_only_once(spark, monkeypatch):
    """Lines are put in order by one shuffle for the sums of their splits; the records need none but that of their pieces."""
    folder, plans, write = tempfile.mkdtemp(prefix="rec-"), {}, records_module.materialize
    _write(folder, "a.csv", 'Date,Description,Amount\n2026-01-05,"x\ny",1\n')

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)
    monkeypatch.setattr(records_module, "materialize", kept)
    assert [r["value"] for r in read_records(spark, [folder]).odd.orderBy("rec_no").collect()] == ["Date,Description,Amount", '2026-01-05,"x\ny",1']
    assert "Window" in plans["statement-odd-lines"]
    assert "Window" not in plans["statement-odd-records"]


def test_many_folders_are_listed_by_a_bounded_number_of_tasks(spark):
    folder, key = tempfile.mkdtemp(prefix="rec-"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(300):
        os.mkdir(os.path.join(folder, f"n={i}"))
        _write(folder, f"n={i}/a.csv", "Date,Description,Amount\n")
    sc, given = spark.sparkContext, spark.conf.get(key)
    most = max(200, 4 * sc.defaultParallelism)
    for name, run in (("list", lambda: list_files(spark, [folder])), ("lines", lambda: text_lines(spark, [folder], (".csv",)))):
        sc.setJobGroup(f"listing-{name}", "")
        df = run()
        sc.setJobGroup("other", "")
        assert df.select("source_file").distinct().count() == 300
        stages = [s for j in sc.statusTracker().getJobIdsForGroup(f"listing-{name}") for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert stages and max(sc.statusTracker().getStageInfo(s).numTasks for s in stages) <= most < 300
    assert spark.conf.get(key) == given


def test_plain_files_are_read_by_many_tasks_without_a_shuffle(spark, small_splits):
    folder = tempfile.mkdtemp(prefix="rec-")
    _write(folder, "p.csv", "Date,Description,Amount\n" + "".join(f"2026-01-05,plain {i},{i}\n" for i in range(300)))
    records = read_records(spark, [folder])
    assert records.files.first()["plain"] and records.odd.count() == 0
    got = records.numbered(records.files.select("source_file", "plain", "splits")).select("rec_no", "value").collect()
    assert sorted(r["rec_no"] for r in got) == list(range(1, 302))
    assert {r["rec_no"]: r["value"] for r in got}[101] == "2026-01-05,plain 99,99"


def test_fields_as_the_csv_module_reads_them(spark):
    rng = random.Random(5)
    parts = ['"', '""', ",", "a", " ", "é", ";"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    one = lambda t: next(csv.reader([t]), [""])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", record_fields(F.col("t")).alias("f"), leaves_open(F.col("t"), ",").alias("o")).collect()
    checked = 0
    for r in rows:
        assert r["o"] == (sum(1 for _ in csv.reader([r["t"], "z"])) == 1), r["t"]  # the next line belongs to the field
        if not r["o"]:
            assert r["f"] == (one(r["t"]) or [""]), r["t"]
            checked += 1
    assert checked > 200


def test_columns_without_a_cap_and_other_separators(spark):
    folder = tempfile.mkdtemp(prefix="rec-")
    head = [f"c{i}" for i in range(200)]
    head[150], head[160], head[199] = "Date", "Payee", "Amount"
    row = ["v"] * 200
    row[150], row[160], row[199] = "2026-02-03", '"x, y"', "-4.5"
    _write(folder, "wide.csv", ",".join(head) + "\n" + ",".join(row) + "\n")
    got = read_statements(spark, folder).first()
    assert (got["Description"], got["Amount"], str(got["Date"])) == ("x, y", -4.5, "2026-02-03 00:00:00")
    folder = tempfile.mkdtemp(prefix="rec-")
    _write(folder, "semi.csv", 'Date;Payee;Amount\n2026-02-03;"a;b";1,5\n2026-02-03;p|q;2\n')
    assert sorted(r["Description"] for r in read_statements(spark, folder, sep=";").collect()) == ["a;b", "p|q"]


def test_every_listed_file_gives_rows_or_one_reject(spark):
    folder = tempfile.mkdtemp(prefix="rec-")
    os.mkdir(os.path.join(folder, "sub dir"))
    good = "Date,Description,Amount\n2026-01-05,x,1\n"
    for name, text in {"good.csv": good, "sub dir/sp ace é.csv": good, "zero.csv": "", "blank.csv": "\n \n", "mac.csv": good.replace("\n", "\r"),
                       "open.csv": 'Date,Description,Amount\n2026-01-05,"x,1\n' + good, "bom.csv": "﻿" + good.strip(), "two.csv": "Transaction Date,Amount\n2026-01-05,1\n"}.items():
        _write(folder, name, text)
    made = ingest_statements(spark, folder)
    base = lambda r: os.path.basename(r["source_file"]).replace("%20", " ").replace("%C3%A9", "é")
    assert sorted(base(r) for r in made.ledger.collect()) == ["bom.csv", "good.csv", "mac.csv", "sp ace é.csv", "two.csv"]
    assert sorted((base(r), r["reject_reason"]) for r in made.rejects.collect()) == [
        ("blank.csv", "no header line"), ("open.csv", "a quoted field is never closed"), ("zero.csv", "no header line")]
    assert {base(r): r["warnings"] for r in made.layouts.collect() if r["warnings"]} == {"two.csv": ["one header fills two roles: Transaction Date"]}
    assert made.metrics == {"files": 8, "rejected_files": 3, "records": 5, "rejected_records": 0, "files_without_date_format": 0}
    report = {base(r): (r["file_reason"], r["ledger_rows"], r["rejected_records"]) for r in statements.file_report(made).collect()}
    assert report["zero.csv"] == ("no header line", 0, 0) and report["mac.csv"] == (None, 1, 0) and len(report) == 8


def test_a_file_that_goes_or_cannot_be_read_on_is_rejected(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="rec-")
    for name in ("stays.csv", "goes.csv"):
        _write(folder, name, "Date,Description,Amount\n2026-01-05,x,1\n")
    before = text_lines(spark, [folder], (".csv",), skip_unreadable=True)
    listed = spark.createDataFrame(list_files(spark, [folder]).collect(), "source_file string, size long")
    os.remove(os.path.join(folder, "goes.csv"))
    monkeypatch.setattr("tallyspark.sources.records.text_lines", lambda *a, **k: before)
    monkeypatch.setattr(statements, "list_files", lambda *a: listed)
    made = ingest_statements(spark, folder)
    assert made.ledger.count() == 1
    assert [(os.path.basename(r["source_file"]), r["reject_reason"]) for r in made.rejects.collect()] == [("goes.csv", "could not be read")]


def test_fail_raises_for_each_kind_of_reject(spark):
    good = "Date,Description,Amount\n2026-01-05,x,1\n"
    for text, said in (("", "no header line"), (good + "2026-01-06,y,2,3,4\n", "more fields"), (good + "31/31/2026,y,2\n", "no single date format")):
        folder = tempfile.mkdtemp(prefix="rec-")
        _write(folder, "a.csv", text)
        with pytest.raises(ValueError, match=said):
            ingest_statements(spark, folder, on_error="fail")
    _write(folder, "a.csv", good)
    assert ingest_statements(spark, folder, on_error="fail").ledger.count() == 1


def test_bits_are_those_of_trying_every_format(spark):
    rng = random.Random(7)
    shapes = ["{m}/{d}/{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}", "{y}-{m:02d}-{d:02d}", "{y}/{m}/{d}", "{d}.{m}.{y}", "{d}-Jan-{y}", "Feb {d}, {y}", "March {d}, {y}",
              "{y}{m:02d}{d:02d}", "{m}/{d}/{s:02d}", "{m}/{d}/{y} 7:05", "{d}/{m}/{y} 17:05:09", "{d} Jan {y}", "{d} January {y}", "{m}-{d}-{y}", "{y}-{m}", "{y}", "{y}-{m:02d}-{d:02d} 10:11:12", " {m}/{d}/{y} ", "junk {d}", "{s}/{m}/{d}", "T12:30", "now", "{y}-{m:02d}-{d:02d}T01:02:03Z"]
    texts = [rng.choice(shapes).format(m=rng.randint(0, 14), d=rng.randint(0, 33), y=rng.choice([26, 1999, 2026, 20261]), s=rng.randint(0, 99)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " "]], "t string")
    rows = df.select("t", date_format_bits(F.col("t")).alias("bits"), lowest_bit(date_format_bits(F.col("t"))).alias("low"),
                     *[parse_date_as(F.col("t"), f).isNotNull().alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]).collect()
    for r in rows:
        want = (1 << len(DATE_FORMATS)) - 1 if r["t"] is None else sum(r[f"f{i}"] << i for i in range(len(DATE_FORMATS)))
        assert r["bits"] == want, r["t"]
        assert r["low"] == ((want & -want).bit_length() - 1 if want else None)


def test_metrics_need_no_job_of_their_own(spark):
    """The counts of the writes equal the tables."""
    folder = tempfile.mkdtemp(prefix="rec-")
    _write(folder, "a.csv", "Date,Description,Amount\n2026-01-05,x,1\n2026-01-05,x,1,2,3\n")
    _write(folder, "b.csv", "Date,Description,Amount\n99/99/99,x,1\n")
    _write(folder, "c.txt", "x")
    made = ingest_statements(spark, folder)
    assert made.metrics == {"files": 3, "rejected_files": 1, "records": 3, "rejected_records": 1, "files_without_date_format": 1}
    assert made.rejects.count() == 3 and made.ledger.count() == 1
