"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``tallyspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``; the
last returns the packed pieces with their token ids.

Empty tables pass through every stage; null texts are rejected by the first
one as they have no language. Repeated rows are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, langid, packing, secrets, simhash
from tallyspark.llm.common import BPE_JSON, table
from tallyspark.session import materialize


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told; those with a narrow margin or without a letter go."""
    learned = langid.learn_dictionaries(docs, langid.training_rows())
    judged = langid.identify_language(docs, learned, out="__language")
    return judged.where("NOT __language.rejected").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    found = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), out="__hits")
    return found.where("size(__hits) = 0").select(*docs.columns)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; no document goes. ``n_chars`` follows the text."""
    clean = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut and pack all documents into sequences; the ids stay aside while lengths are packed."""
    pieces = packing.token_pieces(docs, added_tokens=BPE_JSON, keep_ids=True).withColumn("__piece", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pipeline-pieces")
    packed = packing.pack(pieces.drop("ids"))
    ids = pieces.select(F.col("__piece").alias("__of"), "ids")
    return packed.join(ids, F.col("__piece") == F.col("__of")).drop("__piece", "__of")


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", scan_secrets),
    ("best_fit_packing", pack),
]

#: Compression, tokenisation and packing can't be written in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
