"""Phrase collocations against counting every n-gram, and the defined edge results."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyspark.llm import collocations as col


def pieces_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def plain(docs, min_count, most=2000):
    f = Counter()
    for lang, text in docs:
        for w in pieces_of(text):
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    cand = {x: c for x, c in f.items() if len(x[1]) >= 2 and c >= min_count}
    runs = lambda p: {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}
    inside = {(lang, s) for (lang, p), c in cand.items() for s in runs(p) if c >= cand[lang, s]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, size, -score) for lang, rows in out.items() for i, (score, a, p, left, right, size) in enumerate(sorted(rows)[:most])}


def corpus(n=300):
    rng = random.Random(5)
    words = ["the", "of", "red", "green", "House", "été", "Straße", "x", "to", "be"]
    docs = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            t[5:5] = "new york stock exchange of london".split()
        docs.append((["en", "fr", None, "en"][i % 4], "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for w in t)))
    docs += [("en", "The quick brown fox jumps over the lazy dog and runs off")] * 60
    docs += [("en", "a " * 700), ("fr", "bla bla bla " * 150), ("en", None), ("en", ""), (None, " .,;"), ("en", "nbsp\xa0joined\x1cwords here")]
    return docs


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in df.collect()}


def test_chunks_overlap_and_hold_every_word_once():
    for spacing in (1, 3, 32):
        for lang, text in corpus(40):
            chunks = list(col.parse([text], 4, spacing))
            owned = [w for _, c, tail in chunks for w in c.split(" ")[: len(c.split(" ")) - tail]]
            assert owned == [w for p in pieces_of(text) for w in p]
            grams = Counter(tuple(w[i : i + k]) for _, c, tail in chunks for w in [c.split(" ")] for k in range(1, 6) for i in range(len(w) - k + 1) if i < len(w) - tail)
            assert grams == Counter(tuple(w[i : i + k]) for w in pieces_of(text) for k in range(1, 6) for i in range(len(w) - k + 1))


def test_equal_passages_are_cut_alike():
    rng = random.Random(2)
    same = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    a, b = ({c for _, c, _ in col.parse([f"{head} {same}"], 4, 16)} for head in ("one other start", "x y z u v w"))
    assert len(a & b) >= len(a) - 2


def test_equals_counting_every_ngram(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(docs)], "doc_id long, lang string, text string, rank int").selectExpr("*", "1 AS chunk", "2 AS f", "3 AS n")
    for spacing, bits in ((col.SPACING, col.MOST_BITS), (2, 15)):
        assert rows_of(col.collocations(df.repartition(5), min_count=20, spacing=spacing, most_bits=bits)) == plain(docs, 20)
    assert rows_of(col.collocations(df, min_count=20, most=3)) == plain(docs, 20, 3)


def test_full_bit_set_only_costs_counting(spark):
    docs = corpus(60)
    df = spark.createDataFrame(docs, "lang string, text string")
    dictionary = col.chunk_dictionary(df)
    ones = col.count_words(dictionary)
    want = {(r["lang"], r["phrase"]): r["f"] for r in col.count_phrases(dictionary, ones, 2, 1).collect()}
    plain_counts = Counter((lang or "und", " ".join(w[i : i + 2])) for lang, t in docs for w in pieces_of(t) for i in range(len(w) - 1))
    assert want == plain_counts


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 4 * 10**12, 10**12 + 1, 3 * 10**12)], "a long, n long, l long, r long")
    got = big.selectExpr(f"{col.SCORE} AS s").first()["s"]
    assert got == 1000 * 10**12 * 4 * 10**12 // ((10**12 + 1) * 3 * 10**12)


def test_empty_and_too_few(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert col.collocations(df.limit(0)).count() == 0
    assert col.collocations(df).count() == 0


def test_rolling_hash_is_of_the_window():
    h = np.arange(20, dtype=np.uint64)
    assert (col.rolling(h, 3)[4:5] == col.rolling(h[4:7], 3)[:1]).all()


def test_parsing_hashes_words_together(monkeypatch):
    """Not one call for each word, of which there are as many as the input has."""
    calls = []
    digest = col.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(col.xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or digest(w))
    assert sum(1 for _ in col.parse([t for _, t in corpus(40)])) > 40
    assert not calls
    assert [c for _, c, _ in col.parse(["a " + "b" * 100])] == ["a " + "b" * 100] and len(calls) == 1


def test_a_word_has_one_hash_wherever_it_stands():
    words = [("abcdefgh" * 20)[:n] for n in range(1, 161)] + ["é", "éa", "日本語", "日本語日本語", "a\x00", "a\x00\x00"]
    for joined_by in (" ", "  .", "\n"):
        data = joined_by.join(words + words[::-1]).encode()
        begins, at = [], 0
        for w in words + words[::-1]:
            begins.append(data.index(w.encode(), at))
            at = begins[-1] + len(w.encode())
        sizes = [len(w.encode()) for w in words + words[::-1]]
        h = col.hashes_at(np.frombuffer(data, np.uint8), np.array(begins), np.array(begins) + np.array(sizes))
        assert (h == h[::-1]).all() and len(set(h.tolist())) == len(words)


def dictionary_of(docs):
    uses = Counter((lang or "und", c, tail) for lang, t in docs for _, c, tail in col.parse([t], 4, 3))
    langs, chunks, tails = zip(*uses) if uses else ((), (), ())
    return pa.table([pa.array(langs, pa.string()), pa.array(chunks, pa.string()), pa.array(tails, pa.int32()), pa.array(list(uses.values()), pa.int64())], names=["lang", "chunk", "tail", "uses"])


def test_counts_leave_a_task_as_one_row_a_range():
    """Every phrase's count is in it, however many phrases there are."""
    for docs in (corpus(60), []):
        words = col.Words(dictionary_of(docs))
        for k in (1, 2, 5):
            want = Counter((lang or "und", tuple(w[i : i + k])) for lang, t in docs for w in pieces_of(t) for i in range(len(w) - k + 1))
            for bits in (0, 3):
                rows = words.packed(k, {}, bits).to_pylist()
                assert len(rows) <= 2**bits and all(r["keys"] for r in rows)
                keys, counts = (np.concatenate([np.zeros(0, t)] + [np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", np.uint64), ("counts", np.int64)))
                assert sorted(counts.tolist()) == sorted(want.values()) and (np.diff(keys) > 0).all()
                assert all((np.frombuffer(r["keys"], np.uint64) >> np.uint64(61) == r["range"]).all() for r in rows) or not bits
            assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in words.phrases(k, {}).to_pylist()} == want


def test_equal_hashes_leave_the_count_exact(monkeypatch):
    docs = corpus(60)
    monkeypatch.setattr(col, "hashes_at", lambda data, begins, ends: np.zeros(len(begins), np.uint64))
    words = col.Words(dictionary_of(docs))
    every = np.full(1 << 12, 255, np.uint8), 15
    for sets in ({}, {2: every}, {1: every}):
        want = Counter((lang or "und", " ".join(w[i : i + 2])) for lang, t in docs for w in pieces_of(t) for i in range(len(w) - 1))
        assert {(r["lang"], r["phrase"]): r["f"] for r in words.phrases(2, sets).to_pylist()} == want


def test_many_ranges_of_hashes(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(col, "RANGE_WORDS", 500)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert rows_of(col.collocations(df, min_count=20)) == plain(docs, 20)
