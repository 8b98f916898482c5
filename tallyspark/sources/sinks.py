"""Sinks: the report as one committed version of all its tables.

``write_report`` first materialises the ledger once into the shared
checkpoint folder (``spark.checkpoint.dir``), so the several outputs read a
written table instead of each re-running ingest, and a lost executor only
costs the stage it ran.

A report is written to a folder of its own, ``<out>/versions/<id>/<table>``,
every table partitioned by a bucket of the account. Once all are there, the
file ``<out>/CURRENT`` is replaced in one step; it names the version and its
tables. A reader goes by that file, so it sees the former report until the new
one is whole, and a job that fails leaves the former one readable.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import context
from tallyspark.schema import ACCOUNT
from tallyspark.session import drop_staged, materialize

FORMATS = ("parquet", "csv", "json", "orc")
CURRENT = "CURRENT"
BUCKETS = 64


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple = ()) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    getattr(writer, fmt)(path)
    return path


def report_tables(ledger: DataFrame, generated_at: str | None = None, review_text: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report's tables; the document (with a ``generated_at`` line) if a time is given."""
    out = {"kpis": context.report_kpis(ledger), "categories": context.report_categories(ledger)}
    if review_text is not None:
        out["review_blocks"] = context.text_blocks(review_text, "text", ACCOUNT)
    if generated_at is not None:
        out["report_document"] = context.report_document(ledger, generated_at, review_text)
    return out


def account_bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col(ACCOUNT)), F.lit(buckets)).cast("int").alias("bucket")


def write_report(ledger: DataFrame, out_dir: str, fmt: str = "parquet", review_text: DataFrame | None = None,
                 stage_ledger: bool = True, generated_at: str | None = None, buckets: int = BUCKETS) -> dict[str, str]:
    """Write the report of every account as one version; ``review_text`` (``account_id, text``)
    adds its blocks, ``generated_at`` the whole document. Returns the written paths by name."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    spark = ledger.sparkSession
    led = materialize(ledger, "report-ledger") if stage_ledger else ledger
    version = uuid.uuid4().hex[:16]
    names = {}
    for name, df in report_tables(led, generated_at, review_text).items():
        names[name] = os.path.join("versions", version, name)
        dealt = df.withColumn("bucket", account_bucket(buckets))
        write_table(dealt, os.path.join(out_dir, names[name]), fmt, partition_by=("bucket",))
    replace_file(spark, os.path.join(out_dir, CURRENT), json.dumps({"version": version, "format": fmt, "buckets": buckets, "tables": names}))
    if stage_ledger:
        drop_staged(led)
    return {name: os.path.join(out_dir, path) for name, path in names.items()}


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place in one step (a rename over the old one)."""
    fs, jvm = _files(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    rename[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    to = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(temporary), fs.makeQualified(to), rename)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def read_current(spark: SparkSession, out_dir: str) -> dict:
    """What the committed version is: version, format, buckets, tables."""
    text = spark.read.text(os.path.join(out_dir, CURRENT), wholetext=True).first()
    return json.loads(text["value"])


def read_report(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table of the committed report; a filter on ``bucket`` reads the accounts of that bucket only."""
    now = read_current(spark, out_dir)
    reader = spark.read.format(now["format"])
    if now["format"] == "csv":
        reader = reader.option("header", "true")
    return reader.load(os.path.join(out_dir, now["tables"][table]))


def drop_old_reports(spark: SparkSession, out_dir: str) -> list[str]:
    """Delete all versions but the committed one (also those that a failed job left); returns their names."""
    fs, jvm = _files(spark, out_dir)
    kept, gone = read_current(spark, out_dir)["version"], []
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(os.path.join(out_dir, "versions"))):
        if status.getPath().getName() != kept:
            gone.append(status.getPath().getName())
            fs.delete(status.getPath(), True)
    return gone
