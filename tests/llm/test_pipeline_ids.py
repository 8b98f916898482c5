"""The pipeline's result holds the token ids, so that sequences can be written from it."""

import zlib

import corpus_pipeline
import numpy as np

TEXTS = ["some words in here", "", None, "word " * 5000, "same text", "same text"]


def test_sequences_can_be_made_from_the_result(spark, data_dir):
    docs = spark.createDataFrame([(None if i > 3 else i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = corpus_pipeline.pack(spark, docs, data_dir).collect()
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 3, None} and len(rows) == 5 + 3
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        made = sequences.setdefault(r["sequence_id"], [])
        assert len(made) == r["offset"]
        made += r["ids"]
    assert all(len(s) <= 2048 for s in sequences.values())
    assert sum(map(len, sequences.values())) == sum(r["length"] for r in rows)


def test_columns_of_the_results_names_and_odd_rows(spark, data_dir):
    rows = [(i, t, "a", [1], i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, ids array<int>, length long").selectExpr("*", "7 AS piece", "'o' AS `offset`", "1 AS __piece")
    got = corpus_pipeline.pack(spark, docs, data_dir).collect()
    assert sorted((r["doc_id"], r["piece"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (4, 0), (5, 0)]
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert corpus_pipeline.pack(spark, docs.limit(0), data_dir).count() == 0
