"""Session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. These helpers exist for tests, the bench and the examples.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. All are plain Spark settings; on a cluster
# they belong in the job's submit config and are only defaults here.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Suggested submit-time settings for a ~100 TB ledger on a large cluster (not
# applied by the library; see README "Cluster settings"). Scans split at
# 256 MB; the few shuffles of raw rows (lineitem join, global sort, a large
# date-election join) start wide and AQE coalesces them to ~256 MB; per-account
# aggregates shuffle only partially aggregated rows.
CLUSTER_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "100000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (``local[N]``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system path)
    and is only read here; if it is unset there, this raises instead of
    falling back to a machine-local folder. Only in local mode (tests) a
    private folder is created when it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: configure a shared folder "
                             "(HDFS/S3/...) that every executor can reach")
        path = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table into the shared checkpoint folder and read it back.

    The table survives executor loss and can be read by later jobs. Never a
    local checkpoint. ``drop_staged`` removes it.
    """
    spark = df.sparkSession
    out = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application.

    Spark's own way: ``addPyFile`` with a zip of the package. Where the package
    is installed on the executors it is the same code.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_tallyspark_shipped", False) or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-code-"), "tallyspark_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tallyspark_shipped = True


def drop_staged(staged: DataFrame) -> None:
    """Delete the folders of a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = staged.sparkSession
    jvm, base = spark._jvm, os.path.join(ensure_checkpoint_dir(spark), "tables")
    for folder in {os.path.dirname(f) for f in staged.inputFiles()}:
        if "/tables/" in folder and os.path.basename(base) == "tables":
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
