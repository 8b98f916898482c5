"""Structured Streaming: statements arriving as CSV files in a folder.

``start_statement_ingest`` reads new files with ``readStream.csv`` and
normalises each micro-batch with the batch operators in ``foreachBatch``. The
file source hands over whole files per micro-batch, so the one-date-format-
per-file election still sees every row of a file. Output goes to
``<out>/ledger/batch_id=<n>`` and ``<out>/rejects/batch_id=<n>`` with
overwrite: a batch re-run after a failure rewrites the same folder, so the
sink is exactly-once together with the checkpoint.

``start_mixed_ingest`` takes files of any header: the stream carries their
names, and every micro-batch finds the headers, roles and date formats of its
own files.

``start_monthly_totals`` keeps monthly totals per account over a ledger stream.
Statements upload history in any order, so it has no watermark: each
micro-batch adds its own sums, and no row is dropped as late.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.dates import month_label, month_start
from tallyspark.functions.money import exact_total, safe_ratio_pct, to_cents
from tallyspark.operators.normalize import finish, map_headers, normalize_roles, rejected
from tallyspark.schema import ACCOUNT, AMOUNT, CREDIT, DATE, DEBIT, TYPE
from tallyspark.sources.statements import ACCEPTED_SUFFIXES, REJECT_WIDE, field_count, ingest_statements


def statement_stream(spark: SparkSession, folder: str, header: list[str], sep: str = ",",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Role columns of a stream of CSV files that share ``header``."""
    hm = map_headers(header)
    names = [f"_c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_text"]])
    reader = (spark.readStream.schema(schema).option("header", "true").option("sep", sep)
              .option("quote", '"').option("escape", '"').option("multiLine", "true")
              .option("columnNameOfCorruptRecord", "_text").option("enforceSchema", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.csv(folder).select("*", F.col("_metadata.file_path").alias("source_file"))
    cat = F.col(f"_c{hm.category}") if hm.category is not None else F.lit(None).cast("string")
    return raw.select("source_file", F.col(f"_c{hm.date}").alias("raw_date"),
                      F.col(f"_c{hm.description}").alias("raw_desc"),
                      F.col(f"_c{hm.amount}").alias("raw_amount"), cat.alias("raw_cat"),
                      F.lit(hm.category is not None).alias("has_category"),
                      F.when(field_count(F.col("_text"), len(header), sep) > len(header),
                             F.lit(REJECT_WIDE)).alias("row_reason"))


def start_statement_ingest(spark: SparkSession, folder: str, header: list[str], out: str,
                           checkpoint: str, rules=None, available_now: bool = True,
                           processing_time: str | None = None) -> StreamingQuery:
    """Start the file-stream ingest; returns the running query."""
    roles = statement_stream(spark, folder, header)

    def process(batch: DataFrame, batch_id: int) -> None:
        # Row key: batch id in the high bits, position in the batch below.
        keyed = batch.withColumn("line_no", F.lit(batch_id).cast("bigint") * F.lit(1 << 40)
                                 + F.monotonically_increasing_id())
        # The batch feeds the election, the ledger and the rejects: parse it once.
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            norm = normalize_roles(keyed, rules)
            finish(norm).write.mode("overwrite").parquet(
                os.path.join(out, "ledger", f"batch_id={batch_id}"))
            rejected(norm).write.mode("overwrite").parquet(
                os.path.join(out, "rejects", f"batch_id={batch_id}"))
        finally:
            keyed.unpersist()

    return _started(roles.writeStream.foreachBatch(process), checkpoint, available_now, processing_time)


def _started(writer, checkpoint: str, available_now: bool, processing_time: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


# Fixed value: the columns of Spark's binary file source.
FILE_COLUMNS = "path string, modificationTime timestamp, length long, content binary"


def start_mixed_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, rules=None, suffixes=ACCEPTED_SUFFIXES,
                       max_files_per_trigger: int = 1000, available_now: bool = True,
                       processing_time: str | None = None) -> StreamingQuery:
    """Stream a folder whose files have differing headers: each micro-batch is read by ``ingest_statements``.

    The stream itself carries file names only, at most ``max_files_per_trigger``
    a batch, so a batch's headers and date formats are elected from its own
    files. A transaction's key is its file and its place there, whatever batch
    the file comes in; a batch that runs again writes the same folder. Files
    without a byte are no event for Spark's file source and come into no batch.
    """
    names = (spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", str(max_files_per_trigger)).load(folder).select("path"))

    def process(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r["path"] for r in batch.collect())  # at most max_files_per_trigger names
        if not files:
            return
        made = ingest_statements(spark, files, rules=rules, suffixes=suffixes)
        for name, df in (("ledger", made.ledger), ("rejects", made.rejects), ("layouts", made.layouts.drop("splits", "plain", "open_end"))):
            df.write.mode("overwrite").parquet(os.path.join(out, name, f"batch_id={batch_id}"))

    return _started(names.writeStream.foreachBatch(process), checkpoint, available_now, processing_time)



def start_monthly_totals(ledger: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """Keep monthly totals per account over a ledger stream, however late a row comes.

    A new account's first statement reaches years back, so no row is ever too
    late: there is no watermark and nothing is dropped. Each micro-batch is
    reduced to its (account, month) sums and written to ``<out>/batch_id=<n>``
    with overwrite, so a batch that runs again replaces its own folder. Sums
    add up; ``read_monthly_totals`` gives the totals of all batches, and
    ``compact_monthly_totals`` merges finished batches into one table.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        dated = (batch.where(F.col(DATE).isNotNull())
                 .withColumn("MonthStart", month_start(F.col(DATE))))
        sums = dated.groupBy(ACCOUNT, "MonthStart").agg(
            exact_total(F.when(F.col(TYPE) == CREDIT, F.col(AMOUNT))).alias("credits"),
            exact_total(F.when(F.col(TYPE) == DEBIT, F.col(AMOUNT))).alias("debits"))
        sums.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    writer = ledger.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def merged_sums(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.option("basePath", out).parquet(out)
    return parts.groupBy(ACCOUNT, "MonthStart").agg(F.try_sum("credits").alias("credits"),
                                                    F.try_sum("debits").alias("debits"))


def read_monthly_totals(spark: SparkSession, out: str) -> DataFrame:
    """``monthly_summary`` of all rows streamed so far."""
    exp = F.abs(F.col("debits"))
    inc, net = to_cents(F.col("credits")), to_cents(F.col("credits") - exp)
    return merged_sums(spark, out).select(
        ACCOUNT, month_label(F.col("MonthStart")).alias("Month"), inc.alias("Income"),
        to_cents(exp).alias("Expenses"), net.alias("Savings"),
        safe_ratio_pct(net, inc).alias("SavingsRate"))


def compact_monthly_totals(spark: SparkSession, out: str, to: str) -> str:
    """Write the merged sums to ``to`` as ``batch_id=-1``: a folder of the same kind to go on from
    (start the stream anew with ``to`` as its output and the same checkpoint)."""
    merged_sums(spark, out).write.mode("errorifexists").parquet(os.path.join(to, "batch_id=-1"))
    return to
