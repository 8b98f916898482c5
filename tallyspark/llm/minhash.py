"""Document fingerprints by one-permutation MinHash.

Shingles of five lower-case words are hashed once. The low bits of a hash name
its bin, the rest is its value; a bin keeps its smallest value. An empty bin
takes the value of another, chosen by hashing the empty bin with each filled
one and taking the smallest: the first filled bin in a random order of its own,
as optimal densification prescribes, the same for every document. Of each bin
the low ``VALUE_BITS`` bits are stored. Two fingerprints agree in a bin by
chance with probability 2**-VALUE_BITS, and the estimate of the Jaccard
similarity is corrected for it.

All of it is built from SQL functions. The filled bins of a text come from one
sort: a sentinel per bin is sorted in with the hashes, so the first entry of
each bin is its smallest value, or the sentinel if the bin is empty.

Defined results: a null text is the empty text. A text with fewer than five
words has its whole word sequence as the only shingle. A text without words has
the empty fingerprint; its likeness is 1 to another such text, 0 to any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import number_in_order
from tallyspark.session import materialize

WORDS, BINS, VALUE_BITS = 5, 128, 8
#: Documents are set beside their successors in blocks of so many consecutive ids.
ID_BLOCK = 1024
#: Rows of two longs up to which the blocks' links are broadcast (16 MB).
MOST_BROADCAST = 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Array of the 64-bit hashes of a text's word shingles."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.xxhash64(h))
        many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < words, whole).otherwise(many)

    return let(hashes, shingles)


def minhash(text: Column, words: int = WORDS, bins: int = BINS, value_bits: int = VALUE_BITS) -> Column:
    """The fingerprint as an array of ``bins`` numbers below 2**value_bits (empty for a text without words)."""
    shift = (bins - 1).bit_length()  # bins is a power of two
    room = 62 - shift  # a key holds the bin above the value; it is never negative
    none = (1 << room) - 1
    bin_of = lambda key: F.shiftrightunsigned(key, room)
    value_of = lambda key: key.bitwiseAND(F.lit(none))
    to_key = lambda h: F.shiftleft(h.bitwiseAND(F.lit(bins - 1).cast("long")), room).bitwiseOR(F.shiftrightunsigned(h, 64 - room + 1))
    sentinels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: F.shiftleft(b, room).bitwiseOR(F.lit(none)))

    def smallest(keys: Column) -> Column:
        return F.filter(keys, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.element_at(keys, F.greatest(i, F.lit(1))))))

    def dense(first: Column) -> Column:
        def fill(filled: Column) -> Column:
            # The bin's number in the low bits of its hash makes the smallest hash name its bin.
            pick = lambda b: F.array_min(F.transform(filled, lambda x: F.shiftleft(F.shiftrightunsigned(F.xxhash64(b, bin_of(x)), shift + 1), shift).bitwiseOR(bin_of(x)))).bitwiseAND(F.lit(bins - 1).cast("long"))
            return F.transform(first, lambda x: F.when(value_of(x) != none, x).otherwise(F.element_at(first, (pick(bin_of(x)) + 1).cast("int"))))

        return let(F.filter(first, lambda x: value_of(x) != none), lambda filled: F.when(F.size(filled) == bins, first).otherwise(fill(filled)))

    def low_bits(keys: Column) -> Column:
        return F.transform(keys, lambda x: x.bitwiseAND(F.lit((1 << value_bits) - 1).cast("long")).cast("smallint"))

    def build(hashes: Column) -> Column:
        keys = F.sort_array(F.concat(F.transform(hashes, to_key), sentinels))
        made = let(keys, lambda k: let(smallest(k), lambda first: low_bits(dense(first))))
        return F.when(F.size(hashes) == 0, F.array().cast("array<smallint>")).otherwise(made)

    return let(shingle_hashes(text, words), build)


def packed(fingerprint: Column, value_bits: int = VALUE_BITS) -> Column:
    """The fingerprint's bits as lowercase hex, bin after bin."""
    digits = value_bits // 4
    return F.lower(F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), digits, "0")), ""))


def likeness(a: Column, b: Column, value_bits: int = VALUE_BITS) -> Column:
    """Estimated Jaccard similarity, corrected for bins that agree by chance, from 0 to 1."""
    chance = 2.0**-value_bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda m: m)) / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` and ``derived`` of itself and of the next row by falling key; the first row follows the last.

    Rows meet in blocks of consecutive ids. To each block goes a copy of the
    first row of the next filled block below, so no window spans more than a
    block. Null keys come last; rows of equal keys follow by a hash.
    """
    low = -(1 << 62)
    order = F.coalesce(F.col(key).cast("long"), F.lit(low))
    rows = docs.select(key, *columns).withColumn("__id", order)
    rows = rows.withColumn("__block", F.shiftright("__id", (ID_BLOCK - 1).bit_length())).withColumn("__tie", F.xxhash64(*columns))
    tops = rows.groupBy("__block").agg(F.max("__id").alias("top"))
    # The nearest filled block below is the one with the number before; below the lowest comes the very first row again.
    tops = materialize(number_in_order(tops, ["__block"], "n"), "minhash-blocks")
    highest = tops.agg(F.max("top")).first()[0]
    before = tops.select((F.col("n") + 1).alias("after"), F.col("top").alias("near"))
    links = tops.join(before, F.col("n") == F.col("after"), "left").select(F.col("__block").alias("to"), F.coalesce("near", F.lit(highest)).alias("wanted"))
    links = materialize(links, "minhash-links")  # one row per block
    if links.count() <= MOST_BROADCAST:  # else the join deals out the texts once more
        links = F.broadcast(links)
    tails = rows.join(links, F.col("__id") == F.col("wanted")).withColumn("__block", F.col("to")).drop("to", "wanted").withColumn("__tail", F.lit(1))
    both = rows.withColumn("__tail", F.lit(0)).unionByName(tails).withColumns(derived)  # before rows are dealt
    columns = [*columns, *derived]
    by = Window.partitionBy("__block").orderBy("__tail", F.desc("__id"), "__tie")
    out = both.select(key, *columns, "__tail", *[F.lead(c).over(by).alias(prefix + c) for c in columns])
    return out.where("__tail = 0").drop("__tail")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and their likeness."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    pairs = with_next(rows, key, ["t"], {"own": minhash(F.col("t"))})
    half = F.floor(F.length("t") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.expr("substring(t, 1, length(t) - cast(length(t) / 2 AS int))"), F.col("next_t").substr(F.lit(1), half)))
    made = pairs.select(
        key,
        F.length("t").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "own",
        minhash(F.col("edited")).alias("other"),
        F.col("next_own").alias("next"),
    )
    return made.select(key, "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
