"""Packing: ids equal the tokenizers file's, pieces round-trip, bins valid and few."""

import itertools
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing, queries


def check_bins(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def plain_pieces(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = []
    for key, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        out += [(key, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_query_matches_tokenizers_and_packs_tightly(spark, data_dir):
    rows = queries.op7_best_fit_packing(spark, data_dir).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(plain_pieces(docs))
    used, least = check_bins(rows), -(-sum(r["length"] for r in rows) // 2048)
    assert least <= used <= least + max(2, 0.002 * least)


def test_edge_texts(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "<|endoftext|> x"), (5, "a" * 30_000), (6, "é ü 漢字 🙂 " * 4000), (7, "word " * 2047), (8, "word " * 2046), (2, ""), (None, "x")]
    df = spark.createDataFrame([(*t, 1, "y") for t in texts], "doc_id long, text string, length int, sequence_id string")
    rows = packing.pack(packing.token_pieces(df, keep_ids=True)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(plain_pieces(texts), key=key)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    check_bins(rows)


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("group", [40, 100_000])
def test_groups_and_levels_give_valid_bins(spark, group):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([1100, 948, rng.randint(1, 2048)])) for i in range(700)], "id long, length long")
    rows = packing.pack(df, group_pieces=group).collect()
    assert sorted(r["id"] for r in rows) == list(range(700))
    check_bins(rows)


def test_items_that_cannot_pair_end(spark):
    df = spark.createDataFrame([(i, 1100) for i in range(300)], "id long, length long")
    assert check_bins(packing.pack(df, group_pieces=50).collect()) == 300


def test_local_search_empties_bins():
    rng = random.Random(9)
    for _ in range(20):
        lengths = np.array([rng.randint(20, 900) for _ in range(150)])
        bins, room = [], 0
        for i, x in enumerate(lengths.tolist()):  # next fit: a poor start
            if x > room:
                bins.append([])
                room = 2048
            bins[-1].append(i)
            room -= x
        after = packing.empty_bins([list(b) for b in bins], lengths, 2048)
        assert sorted(i for b in after for i in b) == list(range(150))
        assert all(lengths[b].sum() <= 2048 for b in after)
        assert len(after) < 0.9 * len(bins)
        tight = packing.pack_group(lengths)
        assert len(tight) <= -(-lengths.sum() // 2048) + 1


@pytest.mark.parametrize("low, high, waste", [(30, 30, 0), (200, 200, 0), (100, 400, 2), (1, 60, 1), (1, 2048, 150)])
def test_uniform_lengths_end_at_a_local_optimum(low, high, waste):
    lengths = np.random.default_rng(1).integers(low, high + 1, 30_000)
    began = time.process_time()
    bins = packing.pack_group(lengths)
    assert time.process_time() - began < 30
    assert sorted(i for b in bins for i in b) == list(range(30_000)) and all(lengths[b].sum() <= 2048 for b in bins)
    step = int(np.gcd.reduce(lengths))
    assert len(bins) <= -(-int(lengths.sum()) // (2048 // step * step)) + waste


def test_the_search_leaves_no_step():
    rng = random.Random(4)
    for _ in range(30):
        lengths = np.array([rng.randint(300, 900) for _ in range(30)])
        bins = packing.pack_group(lengths)
        fill = [int(lengths[b].sum()) for b in bins]
        if len(bins) == -(-int(lengths.sum()) // 2048):
            continue
        few = lambda b: [(), *((i,) for i in b), *itertools.combinations(b, 2)]
        for v, w in itertools.permutations(range(len(bins)), 2):
            for out, back in itertools.product(few(bins[v])[1:], few(bins[w])):
                gain = int(lengths[list(out)].sum()) - int(lengths[list(back)].sum())
                step = len(out) + len(back) <= 3 and 0 < gain <= 2048 - fill[w] and fill[w] + gain > fill[v]
                assert not step


def test_pack_replaces_its_own_columns(spark):
    df = spark.createDataFrame([(i, 700, "x", 5) for i in range(10)], "id long, length long, sequence_id string, `offset` int")
    rows = packing.pack(df).collect()
    assert check_bins(rows) == 5


def test_ids_leave_in_bounded_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(200)], "doc_id long, text string").coalesce(1)
    whole = sorted(packing.token_pieces(df, keep_ids=True).collect())
    monkeypatch.setattr(packing, "BATCH_IDS", 100)
    assert sorted(packing.token_pieces(df, keep_ids=True).collect()) == whole and len(whole) == 200
