"""SimHash near duplicates by a binary trie self-join.

Fingerprint: 64 bits over the word shingles of the whole text; a bit is set if
it is set in more than half of the shingles' hashes. Two texts are linked if
their fingerprints differ in at most ``max_bits`` bits; linked texts form
components.

The join works on distinct fingerprints. The 64 bits are cut into
``max_bits + 1`` blocks; fingerprints within the distance agree in one block
whole, so each fingerprint goes to one bucket per block. In a bucket a binary
trie over the sorted fingerprints is joined with itself: pairs of nodes
descend together, differing branches add to the distance, and a pair is
dropped once the distance exceeds the budget. A bucket with more than
``hot_bucket`` fingerprints is first split on its most balanced bits into
pairs of trie nodes, each a task of its own, so that no task holds it whole.
Inside a task pairs go to a union-find and only a spanning forest leaves it.

Defined results: a null, empty or blank text has fingerprint zero and is
linked like any other. Rows with a null key take part; a component's id is the
smallest non-null key (null if it has none). Repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_struct
from tallyspark.session import materialize, ship_package

SHINGLE_WORDS, MAX_BITS, HOT_BUCKET = 3, 2, 20_000
#: Node pairs of the trie that descend at once; rows that a task gathers before it joins them.
FRONT, GATHER = 400_000, 50_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text. Words are split at ASCII white space, A-Z lower-cased."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", *, words: int = SHINGLE_WORDS) -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda texts: {"fp": [signed(fingerprint(t, words)) for t in texts]}

    return docs.withColumn(out, text_struct(make, "fp long")(F.col(text))["fp"])


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the max_bits + 1 blocks of the 64 bits."""
    cuts = [round(64 * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def trie_links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int) -> np.ndarray:
    """For rows (group, side, fingerprint): the index of the row each row is joined to.

    Groups with one side are joined with themselves, groups with two sides
    across. Rows whose links reach each other get the same smallest index.
    """
    order = np.lexsort((fp, side, group))
    f, g, s = fp[order], group[order], side[order]
    n = len(f)
    label = np.arange(n)
    cut = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))))
    end = np.concatenate((cut[1:], [n]))
    two = np.concatenate((g[cut[:-1]] == g[cut[1:]], [False]))  # the next range is the other side
    second = np.concatenate(([False], two[:-1]))
    other = np.where(two, np.arange(len(cut)) + 1, np.arange(len(cut)))
    use = ~second & (two | (end - cut > 1))
    front = (cut[use], end[use], cut[other[use]], end[other[use]], np.zeros(use.sum(), np.int8))
    ones: dict[int, np.ndarray] = {}  # of each bit, how many are set before an index

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = label[i], label[j]
            m = a != b
            if not m.any():
                return
            i, j, a, b = i[m], j[m], a[m], b[m]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    todo = [(63, *front)]
    while todo:
        bit, a0, a1, b0, b1, d = todo.pop()
        if len(a0) > FRONT:
            for k in range(0, len(a0), FRONT):
                todo.append((bit, *(x[k : k + FRONT] for x in (a0, a1, b0, b1, d))))
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(f[i] ^ f[j]) <= budget
            unite(i[near], j[near])
            a0, a1, b0, b1, d = (x[~single] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        if bit < 0:  # all bits agree within the budget: every row of one node meets the other's
            for x0, x1, y0, y1 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
                rows = np.concatenate((np.arange(x0, x1), np.arange(y0, y1)))
                unite(np.full(len(rows) - 1, rows[0]), rows[1:])
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((f >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        made = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        made.append(tuple(x[~same] for x in (am, a1, b0, bm, d + 1)))
        nxt = [np.concatenate([m[k] for m in made]) for k in range(5)]
        self_one = (nxt[0] == nxt[2]) & (nxt[1] == nxt[3]) & (nxt[1] - nxt[0] == 1)
        keep = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ~self_one
        todo.append((bit - 1, *(x[keep] for x in nxt)))
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(src, dst) between distinct fingerprints of column ``fp``: a spanning forest of each bucket's links."""
    parts = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for i, (a, w) in enumerate(blocks(max_bits))])
    rows = prints.select("fp", F.explode(parts).alias("b")).select("fp", "b.block", "b.value")
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Hot buckets: the bits nearest to balance make the top of the trie there.
    set_bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    hot = rows.join(sizes.where(F.col("n") > hot_bucket), ["block", "value"]).groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"), *set_bits)
    ranked = F.array_sort(F.array(*[F.struct(F.abs(2 * F.col(f"b{i}") - F.col("n")).alias("far"), F.lit(i).alias("bit")) for i in range(64)]))
    levels = F.least(F.lit(12), F.ceil(F.log2(F.col("n") / hot_bucket)).cast("int") + 2)
    hot = hot.select("block", "value", F.transform(F.slice(ranked, F.lit(1), levels), lambda x: x["bit"]).alias("bits"))
    rows = rows.join(sizes.select("block", "value"), ["block", "value"]).join(hot, ["block", "value"], "left")
    bits = F.coalesce("bits", F.array().cast("array<int>"))
    node = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + F.call_function("shiftrightunsigned", F.col("fp"), b).bitwiseAND(F.lit(1)))
    rows = rows.select("fp", "block", "value", F.size(bits).alias("q"), node.alias("node"))
    # Every mask of at most max_bits of the q top bits: the nodes that this node must meet.
    masks = F.filter(F.expr("sequence(0L, shiftleft(1L, q) - 1)"), lambda m: F.bit_count(m) <= max_bits)
    pairs = rows.withColumn("mask", F.explode(masks)).withColumn("mate", F.col("node").bitwiseXOR(F.col("mask")))
    pairs = pairs.select("fp", "block", "value", F.least("node", "mate").alias("lo"), F.greatest("node", "mate").alias("hi"), (F.col("node") > F.col("mate")).cast("int").alias("side"))
    ship_package(prints.sparkSession)
    keys = ["block", "value", "lo", "hi"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(cols):
            fp = cols[0].view(np.uint64)
            change = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[1:5]], axis=0)))
            to = trie_links(fp, np.cumsum(change), cols[5], max_bits)
            m = cols[0] != cols[0][to]
            return pa.RecordBatch.from_pydict({"src": cols[0][m], "dst": cols[0][to][m]})

        size = 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held.append(cols)
            size += len(cols[0])
            if size < GATHER:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in whole[1:5]], axis=0))
            at = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
            if at:
                yield links([c[:at] for c in whole])
            held, size = [[c[at:] for c in whole]], len(whole[0]) - at
        if held and size:
            yield links([np.concatenate(c) for c in zip(*held)])

    return dealt.mapInArrow(join, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Nodes without a link are left out.

    Labels spread to the smallest neighbour and then jump to their label's
    label; every round is written to the shared folder, so a lost executor
    costs one round.
    """
    spark = links.sparkSession
    links = materialize(links, "simhash-links")
    both = materialize(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "simhash-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")), "simhash-labels")
    while True:
        seen = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("near"))
        nxt = labels.join(seen, labels["node"] == seen["src"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = nxt.select(F.col("node").alias("at"), F.col("root").alias("above"))
        nxt = nxt.join(up, nxt["root"] == up["at"], "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        nxt = materialize(nxt, "simhash-labels")
        labels = nxt.select("node", "root")
        if nxt.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per input row: ``key``, ``text_hash``, ``fp`` (signed long), ``root`` (smallest fingerprint reached), ``component_id``."""
    prints = materialize(add_fingerprints(docs.select(F.col(key), text_hash(text).alias("text_hash"), F.col(text).alias("__text")), "__text", "fp", words=words).drop("__text"), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(near_links(distinct.select("fp"), max_bits, hot_bucket))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "simhash-classes")
    ids = classes.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, classes["root"] == ids["__root"]).select(F.col("fp").alias("__fp"), "root", "component_id")
    return prints.join(classes, prints["fp"] == classes["__fp"]).select(key, "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: the smallest key (null last), then the smallest hash of the text; all columns as they are."""
    found = simhash_components(docs, key, text, **options)
    first = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("k"), "text_hash"))
    kept = found.groupBy("root").agg(first.alias("r")).select(F.coalesce("r.k", F.lit(-1)).alias("__k"), F.col("r.no_key").alias("__no"), F.col("r.text_hash").alias("__h"))
    mark = ["__k", "__no", "__h"]
    marked = docs.withColumns({"__k": F.coalesce(key, F.lit(-1)), "__no": F.col(key).isNull(), "__h": text_hash(text)})
    # Rows with equal key and text are copies of each other: one stays.
    return marked.join(kept, mark, "left_semi").dropDuplicates(mark).drop(*mark)
