"""Decontamination: planted copies, edits, a full-matrix aligner and edge cases."""

import random

import numpy as np

from tallyspark.llm import decontam, queries


def plain_align(a, b):
    """Best local score by the full matrix."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_is_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 60))
        assert decontam.align(a, b)[0] == plain_align(a.tolist(), b.tolist())


def test_query_finds_all_whole_copies_and_nothing_far(spark, data_dir):
    words = lambda t: " ".join(decontam.words_of(t))
    docs = [(r["doc_id"], f" {words(r['text'])} ") for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in t}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op4_decontamination(spark, data_dir).collect()}
    assert want and want <= set(got)
    by_doc, by_item = dict(docs), dict(items)
    for d, i in got:
        a, b = by_item[i].split(), by_doc[d].split()
        ids = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
        score = decontam.align(np.array([ids[w] for w in a]), np.array([ids[w] for w in b]))[0]
        assert score >= decontam.MIN_SCORE * 2 * len(a)


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(2000)] + ["the", "of", "and", "a"] * 100
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(20)]
    docs, planted = [], set()
    for d in range(200):
        body = text(150).split()
        if d % 4 == 0:
            i, t = items[d // 4 % 20]
            copy = t.split()
            for _ in range(len(copy) // 7):  # about one word in seven replaced, dropped or added
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([["other"], [], [copy[k], "more"]])
            body[70:70] = copy
            planted.add((d, i))
        docs.append((d, " ".join(body)))
    return items, docs, planted


def test_edited_copies_are_found_and_clean_documents_left(spark):
    items, docs, planted = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (decontam.BLOCK_CHARS, 1500):  # one block, or many
        found = decontam.benchmark_hits(d, b, block_chars=block_chars).collect()
        got = {(r["doc_id"], h["item_id"]) for r in found for h in r["hits"]}
        assert got == planted
        assert all(0 <= h["start"] < h["end"] <= len(r["text"]) for r in found for h in r["hits"])


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, item.upper() + "!", 1), (3, item, 1), (None, "x " + item, 1), (5, "İ " * 30 + item, 1), (6, "q " * 50_000 + item, 1), (7, "yes", 1)], "doc_id long, text string, hits int")
    b = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "yes"), (None, item)], "item_id long, text string")
    got = [(r["doc_id"], len(r["hits"])) for r in decontam.benchmark_hits(d, b).collect()]
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2), (None, 2), (5, 2), (6, 2), (7, 0)]
    assert decontam.benchmark_hits(d, b.limit(0)).where("size(hits) > 0").count() == 0
    assert decontam.benchmark_hits(d.limit(0), b).count() == 0


def test_items_inside_text_without_spaces(spark):
    item = "\u4eca\u65e5\u306f\u3068\u3066\u3082\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u660e\u65e5\u3082\u6674\u308c\u308b"
    thai = "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e0a\u0e32\u0e27\u0e42\u0e25\u0e01"
    around = "\u6211\u5011\u5728\u5b78\u6821\u88e1"
    docs = [(1, around + item + around), (2, around * 6), (3, f"a{item}b"), (4, "word " + thai + "\u0e04\u0e23\u0e31\u0e1a"), (5, item[:4] + around)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, thai)], "item_id long, text string")
    got = {(r["doc_id"], h["item_id"]): docs[r["doc_id"] - 1][1][h["start"] : h["end"]] for r in decontam.benchmark_hits(d, b).collect() for h in r["hits"]}
    assert got == {(1, 1): item, (3, 1): item, (4, 2): thai}
