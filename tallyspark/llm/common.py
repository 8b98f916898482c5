"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import materialize, ship_package

#: Where public_tokenizers files are found; a parameter of the operators.
BPE_RANKS = "byte_bpe_50k.tiktoken"
BPE_JSON = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_struct(fn: Callable[[], Callable[[list], dict]], schema: str, as_list: bool = True) -> Callable[..., Column]:
    """A struct column computed from text columns, Arrow batch by Arrow batch.

    ``fn()`` is called once per task and returns a function from the batch's
    values (a Python list, or the Arrow array) to a dict of equally long lists or
    arrays, one for each field of ``schema``. Marked non-deterministic so that the optimiser
    never evaluates it a second time for a filter pushed below it.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    ship_package(SparkSession.active())
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_type(kind)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = fn()
        for batch in batches:
            out = made(batch.to_pylist() if as_list else batch)
            yield pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in arrow], fields=list(arrow))

    one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(one, returnType=kind).asNondeterministic()


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the text ``""``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def number_in_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows from 0 in the order of ``order`` (one row for each value of it).

    Rows are dealt by ranges and numbered side by side; only the ranges' row
    counts are brought together.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before, shifts = 0, []
    for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():  # one row a range
        shifts.append((r["__range"], before))
        before += r["n"]
    given = F.broadcast(df.sparkSession.createDataFrame(shifts, "__of int, __before long"))
    within = Window.partitionBy("__range").orderBy(*order)
    numbered = dealt.join(given, F.col("__range") == F.col("__of")).withColumn(out, (F.col("__before") + F.row_number().over(within) - 1).cast("long"))
    return numbered.drop("__range", "__of", "__before")


def number_within(df: DataFrame, group: str, order: list[str], out: str, rows_per_task: int = 200_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Each group is dealt over as many salts as its row count asks for; rows are
    numbered inside a (group, salt) and shifted by the counts of the salts
    before. Only the counts are ever brought together per group; broadcast are
    one row per group and one per (group, salt), that is rows / rows_per_task
    and the number of groups. Meant for few, large groups; ``df`` should be a
    written table, as it is read three times.
    """
    salted = df.withColumn("__salt_of", F.xxhash64(*order))
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__salts", F.ceil(F.col("__n") / rows_per_task).cast("int"))
    salted = salted.join(F.broadcast(sizes.select("__g", "__salts")), salted[group].eqNullSafe(F.col("__g"))).withColumn(
        "__salt", F.pmod("__salt_of", F.col("__salts"))
    ).drop("__g", "__salts", "__salt_of")
    counts = salted.groupBy(F.col(group).alias("__g"), F.col("__salt").alias("__s")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__g", "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(group, "__salt").orderBy(*order)
    ranked = salted.withColumn("__at", F.row_number().over(within) - 1)
    return (
        ranked.join(F.broadcast(shifts), ranked[group].eqNullSafe(F.col("__g")) & (F.col("__salt") == F.col("__s")))
        .withColumn(out, (F.col("__at") + F.col("__shift")).cast("long"))
        .drop("__g", "__s", "__shift", "__salt", "__at")
    )
