"""Language identification: held-out accuracy and the defined edge results."""

import corpus_pipeline
import duckdb
import pytest
import zstandard

from tallyspark.llm import langid, queries


def plain(model, text):
    """(lang_pred, rejected) by compressing every block of a text with every dictionary, one call at a time."""
    data = langid.OTHER.sub(" ", (text or "").lower())
    if not model or not any(c.isalpha() for c in data):
        return "und", True
    data, sizes = data.encode("utf-8", "replace"), {}
    for lang, content in model.items():
        options = zstandard.ZstdCompressionParameters.from_level(3, **langid.MATCHER, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        total = 0
        for i in range(0, len(data), langid.BLOCK):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(dict_data=own, compression_params=options).compress(langid.CARRIER + data[i : i + langid.BLOCK]))
        sizes[lang] = total
    (least, lang), *rest = sorted((n, k) for k, n in sizes.items())
    return lang, bool(rest) and (rest[0][0] - least) / rest[0][0] < langid.MIN_MARGIN


@pytest.fixture(scope="module")
def fixture_docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, "\u00b2 \u00bd \u2460 \u2167", "en"), (9002, None, "de"), (9003, "a", "en"), (9004, "\u6f22\u5b57", None), (9005, "le la les " * 3000, "fr")]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema))


def test_equals_compressing_one_by_one(spark, fixture_docs):
    model = langid.learn_dictionaries(fixture_docs, langid.training_rows())
    got = langid.identify_language(fixture_docs, model).collect()
    assert len(got) == 205 and sum(r["language"]["rejected"] for r in got) >= 3
    for r in got:
        assert (r["language"]["lang_pred"], r["language"]["rejected"]) == plain(model, r["text"]), r["doc_id"]


def test_pipeline_stage_keeps_what_is_told(spark, fixture_docs, data_dir):
    model = langid.learn_dictionaries(fixture_docs, langid.training_rows())
    kept = corpus_pipeline.identify(spark, fixture_docs, data_dir)
    assert kept.columns == fixture_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in fixture_docs.collect() if not plain(model, r["text"])[1])


def test_a_column_of_the_results_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "the cat", "en", 7, "x")], "doc_id long, text string, lang string, language int, __language string")
    got = langid.identify_language(df, {"en": b"the cat sat"})
    assert got.columns == df.columns and got.first()["language"]["lang_pred"] == "en" and got.first()["__language"] == "x"


def test_held_out_accuracy(spark, data_dir):
    out = queries.op2_language_id(spark, data_dir).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{data_dir}/documents.parquet'").fetchall())
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and held
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.02 * len(out)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat sat on the mat", "en"), (5, "le chat est sur la table", "fr"), (6, "the dog", None), (7, "the cat sat on the mat " * 20_000, "fr"), (4, "the cat sat on the mat", "en"), (None, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS language0", "'x' AS score")
    model = langid.learn_dictionaries(df, langid.training_rows())
    got = {r["doc_id"]: r["language"] for r in langid.identify_language(df, model).collect()}
    for i in (1, 2, 3):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert all(got[i]["lang_pred"] in model for i in (4, 5, 6, 7, None))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learn_dictionaries(empty, langid.training_rows())
    assert model == {}
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.identify_language(df, model).first()["language"]["lang_pred"] == "und"
    assert langid.identify_language(empty, model).count() == 0
