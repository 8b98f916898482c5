"""SimHash components against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from tallyspark.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, bits=2):
    """prints: list of (key, fingerprint) -> smallest key reachable, per row."""
    n = len(prints)
    at = list(range(n))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = top(i), top(j)
                at[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [least.get(top(i)) for i in range(n)]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 3])):
            edit = list(base)
            if edit:
                edit[rng.randrange(len(edit))] = "zz"
            out.append("\n ".join(edit))
    return [*out, None, "", " \t\n", "ÄB c", "äb c", "Äb  C", out[0], out[0]]


def test_fingerprint_is_the_plain_one():
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("hot", [20_000, 4])
def test_components_match_brute_force(spark, hot):
    rows = [(None if i % 37 == 5 else i // 2 * 2 if i % 11 == 0 else i, t, "x", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = simhash.simhash_components(df, hot_bucket=hot).collect()
    assert len(got) == len(rows)
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted((str(k), f, str(c)) for (k, f), c in zip(prints, plain_components(prints)))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == want


def test_dense_ball_and_hot_split(spark):
    """Many fingerprints close to each other: one bucket, split on its balanced bits."""
    rng = random.Random(3)
    prints = {(0xABCDEF << 40) ^ sum(1 << rng.randrange(40) for _ in range(rng.choice([0, 1, 2, 5]))) for _ in range(600)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    pairs = [(i, p) for i, p in enumerate(sorted(s[0] for s in signed))]
    want = plain_components([(k, p % (1 << 64)) for k, p in pairs])
    index = {p: k for k, p in pairs}
    for hot in (20_000, 30):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, hot_bucket=hot)).collect()}
        assert [index[roots.get(p, p)] for _, p in pairs] == want


def test_trie_links_across_two_sides():
    fp = np.array([0, 1, 3, 7, 255], dtype=np.uint64)
    side = np.array([0, 0, 1, 1, 1])
    to = simhash.trie_links(fp, np.zeros(5, dtype=np.int64), side, 2)
    assert len({to[0], to[1], to[2], to[3]}) == 1 and to[4] == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).count() == 0
