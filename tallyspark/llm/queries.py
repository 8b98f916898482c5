"""The registered queries ``opN_<name>``, one per operator, and their SQL.

Each applies its operator with production parameters to the whole table of
``sf_dir`` and returns the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import collocations, decontam, hmm, importance, kdshard, langid, licenses, minhash, packing, quality, secrets, simhash, urls
from tallyspark.llm.common import BPE_JSON, crc_mod, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn_dictionaries(docs, langid.training_rows())
    judged = langid.identify_language(docs.select("doc_id", "text"), learned)
    return judged.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs.select("doc_id", licenses.document_path().alias("path"), "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train_filter(urls.labelled_table(spark))
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = hmm.train(docs, hmm.training_rows())
    scored = hmm.score(docs, model, counts)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), added_tokens=BPE_JSON))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.score_documents(docs, table(spark, sf_dir, "benchmark").select("text"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = crc_mod("doc_id", 5) == 0
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.GOOD_FROM).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_license_scan, op4_decontamination, op5_url_filter, op6_hmm_scoring, op7_best_fit_packing, op8_fingerprints, op9_kd_tree_sharding, op10_simhash, op11_importance_resampling, op12_phrase_collocations, op13_quality_classifier)
}
ORACLES: dict[str, str] = {"op3_license_scan": licenses.oracle_sql(), "op12_phrase_collocations": collocations.oracle_sql()}
