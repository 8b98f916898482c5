"""Hidden Markov model: expected counts and likelihood against plain versions, base score against the formula."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hmm, queries


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def by_paths(seq, step, emit, begin):
    """Likelihood and expected counts by summing over every path of states."""
    k = len(step)
    total, first, moves, shown = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    for path in product(range(k), repeat=len(seq)):
        p = begin[path[0]] * emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= step[a, b] * emit[b, o]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for a, o in zip(path, seq):
            shown[a, o] += p
    return total, first / total, moves / total, shown / total


def test_expected_counts_and_forward_match_all_paths():
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    step, emit, begin = norm(rng.random((3, 3))), norm(rng.random((3, 5))), norm(rng.random((2, 3)))
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 6, 3, 6, 2)]
    first = [True, False, True, True, False]
    sums = {"log": 0.0, "step": np.zeros((3, 3)), "begin": np.zeros((2, 3)), "emit": np.zeros((3, 5))}
    hmm.expected_counts(seqs, first, step, emit, begin, sums)
    want = {"log": 0.0, "step": np.zeros((3, 3)), "begin": np.zeros((2, 3)), "emit": np.zeros((3, 5))}
    for s, f in zip(seqs, first):
        p, b, m, e = by_paths(s, step, emit, begin[0 if f else 1])
        want["log"] += math.log(p)
        want["step"] += m
        want["begin"][0 if f else 1] += b
        want["emit"] += e
    for k in want:
        np.testing.assert_allclose(sums[k], want[k], rtol=2e-5)
    model = hmm.Model(pa.array([], pa.string()), np.zeros(0), np.zeros(0), 0, 0, 0, {}, 3, 0, 4)
    model.step, model.emit, model.begin = step, emit, begin
    np.testing.assert_allclose(hmm.forward(seqs, model), [math.log(by_paths(s, step, emit, begin[0])[0]) for s in seqs])


@pytest.mark.parametrize("counted", [hmm.COUNTED, 300])
def test_query_base_columns_and_learning(spark, data_dir, counted):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    if counted == hmm.COUNTED:
        got = queries.op6_hmm_scoring(spark, data_dir).collect()
    else:  # the join of the words that aren't broadcast carries most of them
        model, counts = hmm.train(docs, hmm.training_rows(), symbols=200, counted=counted, rounds=1)
        scored = hmm.score(docs, model, counts)
        got = scored.select("*", F.lit(model.tokens).alias("train_tokens"), (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out")).collect()
    texts = {r["doc_id"]: plain_words(r["text"]) for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert len(got) == len(texts)
    better = 0
    for r in got:
        ws = texts[r["doc_id"]]
        c = [counts[w] for w in ws] + [ends]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(c), sum(x > 0 for x in c), n)
        assert math.isclose(r["base_score"], sum(math.log10((x + 1) / (n + 1 * (v + 1))) for x in c), rel_tol=1e-9)
        assert r["score"] < 0
        better += r["held_out"] and r["score"] > r["base_score"]
    if counted == hmm.COUNTED:
        assert better >= 0.9 * sum(held.values())


def test_word_shares_sum_to_one(spark):
    """Over all words and one unknown word per class the model gives at most one, as a distribution must."""
    rows = [(i, f"the cat{i % 7} sat on mat{i % 3} the end{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = hmm.train(df, F.lit(True), symbols=4, classes=8, counted=20, rounds=2, states=2)
    words = {r["word"]: r["c"] for r in counts.collect()}
    shares = Counter()
    ranked = set(model.ranked.to_pylist()[: model.words])
    assert ranked and all(words[w] >= hmm.SYMBOL_COUNT for w in ranked)
    for w, c in words.items():
        if w not in ranked:
            k = zlib.crc32(w.encode()[-3:]) % 8
            shares[k] += 10 ** (math.log10(c + 1) - model.class_room[k])
    for k in range(8):
        assert math.isclose(shares[k] + 10 ** -model.class_room[k], 1.0)


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Word wörd WORD\x0bword", 0), (3, "Word wörd WORD\x0bword", 0), (None, "x", 0), (4, "long " * 30_000, 0), (5, "y" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model, counts = hmm.train(df, hmm.training_rows())
    got = hmm.score(df, model, counts).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2, 5, 5, 30_001]
    assert all(math.isfinite(r["score"]) for r in got)
    none, counts = hmm.train(df, F.lit(False))
    got = hmm.score(df, none, counts).collect()
    assert {r["n_known"] for r in got} == {0} and {r["base_score"] for r in got} == {0.0}
    assert hmm.score(df.limit(0), model, counts).count() == 0
