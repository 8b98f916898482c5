"""K-d tree sharding by bytes.

A document weighs its UTF-8 bytes plus a fixed overhead. Documents of equal
text form one unit, which is never split. Units lie in a space of metadata
(source, language, text size, smallest doc_id of the unit), each dimension
scaled to 24 bits; source and language count by their place among the
distinct ones. Units at least as heavy as an equal share of what remains get a
shard of their own first; the others share the remaining shards. From the root down, a node is split along its widest
dimension at the weighted median (for odd shard counts, the matching weighted
quantile) until a leaf holds one shard's target bytes.

All nodes of a level are split together. A median is found exactly, digit by
digit, from distributed histograms over the key (coordinate, hash of the
text); the hash parts units with equal coordinates, so ties split too. The
driver sees at most 4096 sums per node and round.

Defined results: null text weighs the overhead alone and is one unit with the
empty text. Null metadata lie at the low end of their dimension. A unit
heavier than a shard's target makes its shard larger, the others stay near
equal among themselves. With fewer units than shards some shards are empty.
Very long texts weigh their bytes. Columns other than doc_id, text, source and
lang are not read. Repeated rows are placed one by one; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import number_in_order, number_within
from tallyspark.session import materialize

OVERHEAD, SHARDS = 16, 40
BITS, DIGIT, ROUNDS = 24, 12, 4  # a key has BITS for the coordinate and BITS for the hash


def pick(values: list, node: Column) -> Column:
    """values[node]; at most one value for each node of a level."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (node + 1).cast("int"))


def units_of(rows: DataFrame, shards_of: str = "__unit") -> tuple[DataFrame, list[str]]:
    """(unit, weight, d0..d3): units with their scaled coordinates."""
    raw = rows.groupBy(shards_of).agg(
        F.sum("size").alias("weight"),
        F.min("__source").alias("__s0"),
        F.min("__lang").alias("__s1"),
        F.log2(F.max("size").cast("double")).alias("r2"),
        F.min(F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))).alias("r3"),
    )
    raw = materialize(raw, "kd-raw")
    for i in range(2):  # strings by their place among the distinct ones
        ranks = number_in_order(raw.select(f"__s{i}").distinct(), [f"__s{i}"], f"r{i}")
        raw = raw.join(ranks, f"__s{i}")
    raw = materialize(raw.drop("__s0", "__s1"), "kd-ranked")
    dims = [f"d{i}" for i in range(4)]
    ends = raw.agg(*[f(f"r{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = float((1 << BITS) - 1)

    def scaled(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi == lo:
            return F.lit(0).cast("long")
        return F.floor((F.col(f"r{i}") - lo) / (hi - lo) * top).cast("long")

    return raw.select(shards_of, "weight", *[scaled(i).alias(d) for i, d in enumerate(dims)]), dims


def heavy_units(units: DataFrame, shards: int) -> list[int]:
    """Units at least as heavy as an equal share of what remains, heaviest first: each has a shard of its own."""
    left, out = units.agg(F.sum("weight")).first()[0] or 0, []
    # The heaviest comes first; no more than shards can be heavy.
    for r in units.orderBy(F.desc("weight"), "__unit").limit(shards).collect():
        parts = shards - len(out)
        if parts < 2 or r["weight"] * parts < left:
            break
        out.append(r["__unit"])
        left -= r["weight"]
    return out


def split_tree(units: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Units with their shard. Each level's nodes are written, so that expressions stay flat."""
    low_hash = F.shiftrightunsigned(F.xxhash64("__unit"), 64 - BITS)
    node, parts = F.col("node"), [shards]  # shards below each node of the level
    units = materialize(units.withColumn("node", F.lit(0)), "kd-level")
    leaf = [0]  # the first shard of each node
    while max(parts) > 1:
        stats = {r["node"]: r for r in units.groupBy("node").agg(F.sum("weight").alias("weight"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()}
        widest = [max(range(len(dims)), key=lambda i, s=stats.get(k): (s[dims[i]] if s else 0, -i)) for k in range(len(parts))]
        goal = [(int(stats[k]["weight"]) if k in stats else 0) * (p // 2) / p for k, p in enumerate(parts)]
        coordinate = F.element_at(F.array(*[F.col(d) for d in dims]), pick(widest, node) + 1)
        key = coordinate * (1 << BITS) + low_hash
        split = [p > 1 for p in parts]
        at, below = [0] * len(parts), [0] * len(parts)  # key digits found so far, weight before them
        for r in range(ROUNDS):
            shift = 2 * BITS - DIGIT * (r + 1)
            digits = F.shiftrightunsigned(key, shift)
            inside = pick(split, node) & ((F.shiftrightunsigned(key, shift + DIGIT) == pick(at, node)) if r else F.lit(True))
            sums: dict[int, list] = {}
            for s in units.where(inside).groupBy("node", digits.alias("digit")).agg(F.sum("weight").alias("w")).collect():
                sums.setdefault(s["node"], []).append((s["digit"], int(s["w"])))
            for k in range(len(parts)):
                if not split[k]:
                    continue
                at[k] <<= DIGIT
                for digit, w in sorted(sums.get(k, [])):
                    at[k] = digit
                    if below[k] + w > goal[k]:
                        if r == ROUNDS - 1 and below[k] + w - goal[k] < goal[k] - below[k]:
                            at[k] += 1  # the unit at the median goes left if that is nearer
                        break
                    below[k] += w
                else:
                    at[k] += 1 if r == ROUNDS - 1 else 0
        right = pick(split, node) & (key >= pick(at, node))
        # Children are numbered from left to right; a leaf has one child.
        first, kids, leaves = [], [], []
        for k, p in enumerate(parts):
            first.append(len(kids))
            kids += [p] if p == 1 else [p // 2, p - p // 2]
            leaves += [leaf[k]] if p == 1 else [leaf[k], leaf[k] + p // 2]
        units = materialize(units.withColumn("node", pick(first, node) + right.cast("int")), "kd-level")
        parts, leaf = kids, leaves
    return units.withColumn("shard", pick(leaf, node))


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard).

    Give the number of shards, or the bytes that a shard should hold.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text, F.lit("unit")).alias("__unit"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "kd-rows",
    )
    units, dims = units_of(rows)
    if target_bytes:
        shards = max(1, round((units.agg(F.sum("weight")).first()[0] or 0) / target_bytes))
    heavy = heavy_units(units, shards)
    of = F.col("__unit")
    rest = split_tree(units.where(~of.isin(heavy)) if heavy else units, dims, shards - len(heavy))
    placed = rest.select(of.alias("__of"), "shard")
    if heavy:
        number = F.array_position(F.array(*[F.lit(u) for u in heavy]), of) - 1 + shards - len(heavy)
        placed = placed.unionByName(units.where(of.isin(heavy)).select(of.alias("__of"), number.cast("int").alias("shard")))
    out = rows.join(placed, rows["__unit"] == placed["__of"]).select("doc_id", "size", "text_crc32", "shard", "__row")
    return number_within(materialize(out, "kd-placed"), "shard", ["doc_id", "__row"], "slot").drop("__row")
