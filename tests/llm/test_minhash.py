"""Fingerprints against a plain version, and the estimate against true similarity."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import minhash, queries

LOW = (1 << 64) - 1


def long_hash(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value - (1 << 64) if value >> 63 else value), seed=seed)


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_minhash(text, bins=128, bits=8):
    """Shingles hashed as Spark's xxhash64 chains them; first filled bin by smallest hash of (empty, filled)."""
    filled = {}
    for s in shingles(text):
        h = 42
        for w in s:
            h = long_hash(xxhash.xxh64_intdigest(w.encode(), seed=42), h)
        b, v = h & (bins - 1), h >> (64 - 55 + 1)
        filled[b] = min(filled.get(b, LOW), v)
    if not filled:
        return []
    out = []
    for b in range(bins):
        src = b if b in filled else min(filled, key=lambda j: (long_hash(j, long_hash(b, 42)) >> 8 << 7) | j)
        out.append(filled[src] & ((1 << bits) - 1))
    return out


def hexed(fp):
    return "".join(f"{v:02x}" for v in fp)


def near(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 256) / (1 - 1 / 256))


TEXTS = [None, "", " \n", "one", "One two", "a b c d e", "a b c d e f g", "x " * 3000, " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(300)), "äé ü 漢字 🙂 word more words here to fill", "same text of some words", "same text of some words"]


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = plain_minhash(t), plain_minhash(edited), plain_minhash(nxt)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c))
    return out


@pytest.mark.parametrize("ids", [range(len(TEXTS)), range(0, 50_000_000 * len(TEXTS), 50_000_000), [-5, -2000, 7, 0, 3, 2_000_000, 9_000_000_000, 11, 12, 13, 5000, 5001, 1023]])
def test_matches_plain_version_for_dense_and_sparse_ids(spark, ids):
    rows = list(zip(ids, TEXTS))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.edited_fingerprints(df).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:])


def test_random_ids_need_no_task_that_sees_all(spark):
    """Every id is alone in its block; the blocks are numbered by ranges, in no window without a partition."""
    rng = random.Random(6)
    ids = sorted({rng.randrange(-(2**61), 2**61) for _ in range(3000)})
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(11)
    out = minhash.with_next(df, "doc_id", ["text"], {})
    assert {r["doc_id"]: r["next_text"] for r in out.collect()} == {i: f"t{(k - 1) % len(ids)}" for k, i in enumerate(ids)}
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_query_on_the_whole_table(spark, data_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, data_dir).collect()}
    want = expected(docs)
    assert {d: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for d, r in got.items()} == {d: w[:4] for d, w in want.items()}
    text, error = dict(docs), []
    order = sorted(text, reverse=True)
    for d, n in zip(order, order[1:]):
        a, half = text[d], len(text[d]) // 2
        x, y = shingles(a), shingles(a[: len(a) - half] + text[n][:half])
        error.append(abs(got[d]["near_edited"] - len(x & y) / len(x | y)))
    assert sum(error) / len(error) < 0.04  # one standard deviation of 128 bins


def test_null_and_repeated_keys(spark):
    rows = [(None, "a b c d e f"), (None, "z y x w v u"), (3, "same words again and again"), (3, "same words again and again"), (3, None)]
    got = minhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got}) == 4


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    r = minhash.edited_fingerprints(df).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 15
    assert minhash.edited_fingerprints(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, data_dir):
    plan = queries.op8_fingerprints(spark, data_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert minhash.likeness(F.col("a"), F.col("b")) is not None
