"""Importance resampling against a plain version, and its defined edge results."""

import hashlib
import math
import re
import zlib
from collections import Counter

from tallyspark.llm import importance, queries


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    """{doc_id: (n_features, weight, score, rank)} of (doc_id, text) with distinct ids."""
    buckets = lambda t: [zlib.crc32(f.encode()) % 10_000 for f in features_of(t)]
    own = {d: buckets(t) for d, t in docs}
    s, t = Counter(b for x in own.values() for b in x), Counter(b for x in target for b in buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = {}
    for d, _ in docs:
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own[d])
        out[d] = [len(own[d]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[d][2], d) for d, t in docs if len(words_of(t)) >= 20)
    for i, (_, d) in enumerate(able[: 5 * len(able) // 100]):
        out[d][3] = i + 1
    return {d: tuple(x) for d, x in out.items()}


def test_query_is_the_plain_one(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    out = queries.op11_importance_resampling(spark, data_dir)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == plain(docs, target)


def test_edges(spark):
    long_ = "Word, other--word 7 été " * 6
    docs = [(1, None), (2, ""), (3, "-- ;;"), (4, "one"), (5, "A b"), (6, "Été Æon x"), (7, long_), (8, "x " * 200_000), (9, "tab\tnul\x00end   wide"), (10, long_ * 2)]
    docs += [(i, f"{long_} number {i % 4}") for i in range(11, 90)]
    target = [long_, None, "", "one two three"]
    d = spark.createDataFrame([(*x, i, "c") for i, x in enumerate(docs)], "doc_id long, text string, weight int, rank string").selectExpr("*", "1 AS n_words", "2 AS buckets", "3 AS s")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.score_documents(d, t).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == plain(docs, target)
    drawn = importance.resample(d, t).collect()
    assert {r["doc_id"] for r in drawn} == {r["doc_id"] for r in got if r["rank"]} and drawn[0]["text"]


def test_repeated_rows_ties_and_null_keys(spark):
    text = "some words that are long enough to be drawn as they are more than twenty in all and so on and on and on"
    d = spark.createDataFrame([(1, text)] * 60 + [(2, text)] * 60 + [(None, text)] * 3, "doc_id long, text string")
    t = spark.createDataFrame([(text,)], "text string")
    got = importance.score_documents(d, t).collect()
    assert len(got) == 123 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    best = max(got, key=lambda r: r["score"])["score"]
    assert all(r["score"] == best for r in got if r["rank"])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = d.limit(0)
    assert importance.score_documents(none, d).count() == 0
    [r] = importance.score_documents(d, none).collect()
    assert r["n_features"] == 6 and r["rank"] is None


def test_many_tied_scores_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 3 AS long) AS score")
    got = importance.rank_highest(rows.repartition(7), "score", "doc_id", 2000).collect()
    want = sorted(((-(i % 3), i) for i in range(5000)))[:2000]
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == {i: k + 1 for k, (_, i) in enumerate(want)}
    assert len(got) == 5000
