"""Importance resampling towards a target distribution, over hashed n-grams of words.

Text is lower-cased (A-Z) and every run of separators becomes one space. One
pattern then scans the words with overlapping matches between look-arounds at
the word borders: a match begins at every word and its groups are the spans by
which the n-gram grows word by word, so the CRC of each longer n-gram goes on
from the CRC of the shorter one. The bucket of an n-gram is its CRC modulo
``BUCKETS``.

A bucket's gain tells how much likelier it is in the target than in the source
texts; a document's weight is the sum of the gains of its n-grams. Gumbel noise
drawn from the document's key is added and the highest scores are drawn, which
is sampling without replacement in proportion to the weights' exponentials.

Texts are scanned once: the buckets of each document are written (two bytes an
n-gram) and read for the counts and again for the weights. What meets in one
place is a table of ``BUCKETS`` rows. Ranks come from ranges of the scores that
are numbered side by side.

Defined results: a null or empty text, or one without a word, has no n-grams
and weight 0. Repeated rows each count and are each scored; equal scores rank
by key, equal keys by a hash of the row. A null key hashes as the empty text and comes
first among ties. Without source or target texts all counts are 0; an empty
table gives no rows. A very long text is scanned whole, by one task. Columns
besides key and text are not read, so their names do not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import text_struct
from tallyspark.session import drop_staged, materialize, ship_package

BUCKETS, MAX_WORDS, SEED = 10_000, 3, 42
#: Documents of fewer words are never drawn; of the others this many in a hundred are.
MIN_WORDS, PERCENT = 20, 5

# What separates words once A-Z are in lower case: all ASCII but letters and digits.
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = bytes(32 if SEPARATOR.match(bytes([c])) else c for c in bytes(range(256)).lower())


def scanner(max_words: int = MAX_WORDS) -> Callable[[bytes], tuple[int, list[int]]]:
    """A function from UTF-8 text to its number of words and the CRCs of its n-grams, repeats included."""
    grams = regex.compile(rb"(?<![^ ])([^ ]++)" + rb"( [^ ]++)?+" * (max_words - 1) + rb"(?![^ ])")
    crc32 = zlib.crc32

    def scan(text: bytes) -> tuple[int, list[int]]:
        found, words = [], 0
        add = found.append
        for match in grams.finditer(b" ".join(text.translate(LOWER).split()), overlapped=True):
            crc = 0
            words += 1
            for more in match.groups():
                if more is None:
                    break
                crc = crc32(more, crc)
                add(crc)
        return words, found

    return scan


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_column(text: Column, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> Column:
    """A struct: n_words, and the bucket of every n-gram as little-endian unsigned integers."""

    def make():
        scan, kind = scanner(max_words), bucket_type(buckets)

        def batch(texts: list) -> dict:
            words, packed = [], []
            for t in texts:
                n, crcs = scan(t.encode("utf-8", "surrogatepass")) if t else (0, [])
                words.append(n)
                packed.append((np.array(crcs, dtype=np.uint32) % buckets).astype(kind).tobytes())
            return {"n_words": words, "buckets": packed}

        return batch

    return text_struct(make, "n_words long, buckets binary")(text)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all rows fall into each bucket: one row a bucket and task is summed by Spark."""
    ship_package(scanned.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for raw in b.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer() or b"", dtype=bucket_type(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = scanned.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down; one value a bucket."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1) * (all_source + n)) / ((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target)], dtype=np.int64)


def weight_column(raw: Column, gains: np.ndarray, shared) -> Column:
    """Sum of the gains of a row's buckets."""
    kind = bucket_type(len(gains))

    def make():
        table = shared.value
        return lambda rows: {"weight": [int(table[np.frombuffer(x, dtype=kind)].sum()) for x in rows]}

    return text_struct(make, "weight long")(raw)["weight"]


def noise(key: str, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel value that the key decides, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def rank_highest(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Add ``rank``: 1 to ``most`` by falling ``by`` (ties: the smaller key), null for all other rows.

    Rows are dealt by ranges, so ties and hot values spread over tasks; of the
    ranges only their row counts are brought together.
    """
    order = [F.desc(by), F.asc(key), F.asc("__tie")]
    tied = rows.withColumn("__tie", F.xxhash64(*rows.columns, F.monotonically_increasing_id()))
    dealt = materialize(tied.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "importance-ranges")
    before, shifts = 0, []
    for r in dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():  # one row a range
        if before < most:
            shifts.append((r["__range"], before))
        before += r["n"]
    given = F.broadcast(rows.sparkSession.createDataFrame(shifts, "__of int, __before long"))
    same = F.col("__range") == F.col("__of")
    within = Window.partitionBy("__range").orderBy(*order)
    rank = (F.col("__before") + F.row_number().over(within)).cast("long")
    near = dealt.join(given, same).select(*rows.columns, rank.alias("rank"))
    near = near.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    far = dealt.join(given, same, "left_anti").select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return near.unionByName(far)


def score_documents(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_features, weight, score and, if it is drawn, rank."""
    spark = docs.sparkSession
    scan = lambda df, t, *more: df.select(*more, bucket_column(F.col(t), buckets, max_words).alias("s")).select(*more, "s.*")
    source = materialize(scan(docs, text, key), "importance-buckets")
    gains = bucket_gains(bucket_counts(source, buckets), bucket_counts(scan(target, target_text), buckets))
    shared = spark.sparkContext.broadcast(gains)
    width = np.dtype(bucket_type(buckets)).itemsize
    weighed = source.select(key, "n_words", (F.octet_length("buckets") / width).cast("long").alias("n_features"), weight_column(F.col("buckets"), gains, shared).alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(key, seed)), "importance-scores")
    shared.unpersist()
    drop_staged(source)
    columns = [key, "n_features", "weight", "score"]
    long_enough = scored.where(F.col("n_words") >= min_words).select(*columns)
    short = scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return rank_highest(long_enough, "score", key, percent * long_enough.count() // 100).unionByName(short)


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, all columns kept. Rows that share a key come together if one of them is drawn."""
    drawn = score_documents(docs, target, key=key, **options).where(F.col("rank").isNotNull()).select(F.col(key).alias("__drawn"))
    return docs.join(drawn, docs[key].eqNullSafe(F.col("__drawn")), "left_semi")
