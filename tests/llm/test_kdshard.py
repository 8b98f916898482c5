"""K-d sharding: laws of the contract and the exact median against a plain version."""

import zlib
from collections import defaultdict

from tallyspark.llm import kdshard, queries
from tallyspark.llm.common import number_in_order, number_within


def test_query_obeys_its_law(spark, data_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_kd_tree_sharding(spark, data_dir).collect()
    assert len(rows) == len(docs)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[data].add(r["shard"])
    assert set(size) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())  # equal texts stay together
    biggest, mean = max(len(d) + 16 for d in homes), sum(size.values()) / 40
    assert max(abs(s - mean) for s in size.values()) <= 2 * biggest


def test_one_split_is_the_weighted_median(spark):
    rows = [(i, "x" * (1 + i * 7 % 50), "en", "s", 1) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    out = kdshard.shard_documents(df, 2).collect()
    left = sum(r["size"] for r in out if r["shard"] == 0)
    total = sum(r["size"] for r in out)
    heaviest = defaultdict(int)
    for r in out:
        heaviest[r["text_crc32"]] += r["size"]
    assert abs(left - total / 2) <= max(heaviest.values()) / 2


def test_ties_nulls_repeats_and_a_heavy_unit(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "a"), (3, "", "en", None)]
    rows += [(10 + i, "same text", "en", "src") for i in range(50)] + [(100 + i, f"text {i:04d}", "en", "src") for i in range(100)] + [(999, "z" * 50_000, "en", "src")]
    out = kdshard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 5).collect()
    assert len(out) == len(rows) and {r["shard"] for r in out} <= set(range(5))
    homes, slots = defaultdict(set), defaultdict(list)
    for r in out:
        homes[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_target_bytes_and_empty(spark):
    df = spark.createDataFrame([(i, "y" * 84, "en", "s") for i in range(64)], "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "lang")
    df = df.selectExpr("doc_id", "concat(text, doc_id) AS text", "lang", "source")
    assert len({r["shard"] for r in kdshard.shard_documents(df, None, target_bytes=800).collect()}) == 8
    assert kdshard.shard_documents(df.limit(0), 4).count() == 0


def test_numbering_is_gapless_over_many_salts(spark):
    rows = [(i, None if i % 3 == 0 else f"g{i % 4}", 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, grp string, slot int")
    out = number_within(df, "grp", ["id"], "slot", rows_per_task=20).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r["grp"]].append(r["slot"])
    assert len(out) == 500 and all(sorted(s) == list(range(len(s))) for s in groups.values())


def sizes_of(out, shards):
    size = [0] * shards
    for r in out:
        size[r["shard"]] += r["size"]
    return size


def test_heavy_units_leave_the_rest_equal(spark):
    """One text and one group of copies heavier than a share: each has its own shard, the rest are within 2 %."""
    rows = [(i, f"document {i:05d} " + "w " * (i % 37), "en", f"source number {i % 5}") for i in range(6000)]
    rows += [(10_000, "h" * 150_000, "en", "source number 1")] + [(20_000 + i, "a copy of a passage " * 10, "de", "source number 2") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS slot", "2 AS size", "'x' AS shard")
    size = sorted(sizes_of(kdshard.shard_documents(df, 20).collect(), 20))
    assert size[-1] == 150_016 and size[-2] == 400 * (200 + 16)
    rest = size[:-2]
    assert min(rest) > 0.98 * max(rest), rest


def test_no_shard_is_empty_when_units_suffice(spark):
    for weights in ([50_000] + [30] * 200, [5000, 4000, 3000] + [10] * 100, [100] * 41, [2**k for k in range(12)]):
        rows = [(i, f"{i:04d}" + "x" * (w - 4 if w > 4 else 0), "en", "s") for i, w in enumerate(weights)]
        out = kdshard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 10).collect()
        assert min(sizes_of(out, 10)) > 0, weights


def test_sources_of_one_beginning_are_told_apart(spark):
    rows = [(i, f"text {i:03d}", "en", f"https://long.common.beginning/{i % 4}") for i in range(400)]
    out = kdshard.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    homes = defaultdict(set)
    for r in out:
        homes[r["doc_id"] % 4].add(r["shard"])
    assert not (homes[0] | homes[1]) & (homes[2] | homes[3])  # the first split goes by source


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(f"v{i * 37 % 1000:04d}",) for i in range(1000)], "v string").repartition(9)
    assert {r["v"]: r["n"] for r in number_in_order(df, ["v"], "n").collect()} == {f"v{i:04d}": i for i in range(1000)}
    assert number_in_order(df.limit(0), ["v"], "n").count() == 0
