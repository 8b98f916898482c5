"""The pipeline's stages, each on its own input, against brute force."""

import re

import corpus_pipeline
import pytest

from tallyspark.llm import simhash
from test_packing import check_bins, plain_pieces
from test_secrets import plain_base
from test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    """(docs, result) of each stage, every result written and read again."""
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, data_dir).write.parquet(path)
        result = spark.read.parquet(path)
        out[name] = docs, result
        docs = result
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name, (docs, out) in list(stages.items())[:-1]:
        assert out.columns == docs.columns, name


def test_language_stage_keeps_clean_documents(stages):
    docs, out = stages["language_id"]
    assert out.count() >= 0.98 * docs.count()
    before = texts(docs)
    assert all(before[k] == t for k, t in texts(out).items())


def test_dedup_keeps_the_least_of_each_component(stages):
    docs, out = stages["simhash_near_dedup"]
    rows = sorted(texts(docs).items())
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    assert set(texts(out)) == set(plain_components(prints))
    assert out.count() == len(set(plain_components(prints)))


def test_decontamination_drops_holders_only(stages, spark, data_dir):
    docs, out = stages["benchmark_decontamination"]
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    holders = {k for k, t in texts(docs).items() if any(f" {i} " in f" {plain(t)} " for i in items)}
    gone = set(texts(docs)) - set(texts(out))
    assert holders <= gone and len(gone) <= len(holders) + 0.005 * docs.count()


def test_secrets_are_gone_and_no_document(stages):
    docs, out = stages["secret_scan"]
    before, after = texts(docs), texts(out)
    assert before.keys() == after.keys()
    assert sum(bool(plain_base(t)) for t in before.values()) > 0
    for k, t in after.items():
        assert not [s for s in plain_base(t) if not s.startswith("assign")]
        if not plain_base(before[k]) and "[SECRET]" not in t:
            assert t == before[k]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_packing_takes_all(stages):
    docs, out = stages["best_fit_packing"]
    rows = out.collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(plain_pieces(texts(docs).items()))
    assert check_bins(rows) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_run_gives_the_last_stage(stages, spark, data_dir):
    *_, (_, last) = stages.values()
    assert corpus_pipeline.run(spark, data_dir).select("doc_id", "piece").orderBy("doc_id", "piece").collect() == last.select("doc_id", "piece").orderBy("doc_id", "piece").collect()


EDGE = [(None, "some words in here for all to see", "en", "s", 5), (None, "quite other words are in this one", "en", "s", 5), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "x", None, None, 1), (7, "the same text twice over", "en", "s", 1), (7, "the same text twice over", "en", "s", 1), (8, "word " * 30_000, "en", "s", 1)]


def test_edge_rows_and_extra_columns(spark, data_dir):
    df = spark.createDataFrame([(*r, "keep", 1) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, fp string, rejected int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, data_dir)
        assert out.columns == df.columns
        assert out.count() <= len(EDGE)
        assert stage(spark, df.limit(0), data_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), data_dir).count() == 0
    kept = simhash.keep_one(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "7", "8", "None", "None"]
