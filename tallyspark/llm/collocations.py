"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks,
and the pieces into words. Parsing cuts a piece into chunks: one begins
wherever a hash of ``OVERLAP`` following words is a trigger, so equal passages
are cut alike wherever they stand, and a chunk reaches ``OVERLAP`` words into
the next one. Equal chunks of a language are one entry of the dictionary, with
the number of times the parse uses it. An n-gram of at most ``OVERLAP`` + 1
words lies whole in the chunk that holds its first word before the overlap; it
is counted there and nowhere else, once per entry, weighted by the entry's uses.

Phrases are counted by growing length. One of k words can only be frequent if
both of its parts of k-1 words are, so the dictionary is scanned with a bit set
of the frequent parts' hashes. What passes is summed by hash: a batch's sorted
hashes and their counts go out as one row of packed numbers for each range of
hashes, so the shuffle moves few rows however many phrases there are. A hash of
too small a sum has no frequent phrase. The last scan counts the phrases
themselves, letting through only those whose hash is known as frequent (for the
longest: the hashes of its parts); this count is the exact one. A bit set has 16
bits a frequent hash, at most 2 to the power of ``MOST_BITS`` (32 MB); equal
hashes and false hits cost counting and change nothing. The bit sets are all
that is broadcast.

A candidate's score is its count against what its two halves would give by
chance, at the weakest of its cuts. Candidates that nearly only occur inside
a longer one are dropped, then each language's best are ranked.

Defined results: a null or empty text has no words; a null language is
``und``. Repeated rows each count. Equal scores rank by count, then by phrase.
An empty table gives no rows. A very long text is parsed whole, by one task; a
piece without a trigger is one chunk. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import drop_staged, materialize, ship_package

#: Longest phrase, words that chunks overlap by, mean words from trigger to trigger.
MAX_WORDS, OVERLAP, SPACING = 5, 4, 32
#: Least count of a candidate, and how many a language returns.
MIN_COUNT, MOST = 100, 2000
#: A candidate goes if a longer one that holds it has this many hundredths of its count.
INSIDE_PERCENT = 100
MOST_BITS = 28
#: Texts that are parsed at once.
SLICE = 500
#: Bytes of chunks whose phrases are counted together before they leave a task.
BATCH_BYTES = 8 << 20
#: Words, of all texts, for each range of hashes; a range is summed at once, 16 bytes or less a word.
RANGE_WORDS = 1 << 20
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64

# What ends a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = bytes(10 if c in BREAKS else 32 if c == 9 else c for c in bytes(range(256)).lower())
#: floor(1000 * a * n / (l * r)); the products are decimals of 38 digits, the result is at most 1000 * n / min_count.
SCORE = "(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
MIX, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The first 0 to 8 of eight bytes.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def hashes_at(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the words data[begins:ends], eight bytes at a time. Unequal words may share one."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - begins
    out = size.astype(np.uint64) * LAST
    which = slice(None)
    for i in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
        if i:
            which = np.flatnonzero(size > i)
        x = (out[which] ^ (eight[begins[which] + i] & KEEP[np.minimum(size[which] - i, 8)])) * MIX
        out[which] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes())
    return out * LAST


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values from each place on (fewer at the end: not of use)."""
    out = h.copy()
    for j in range(1, k):
        out[:-j] = out[:-j] * MIX + h[j:]
    return out


def parse(texts: list[str | None], overlap: int = OVERLAP, spacing: int = SPACING) -> Iterator[tuple[int, str, int]]:
    """(number of the text, chunk, words of its overlap) of every chunk of every text."""
    plain = [(t or "").encode().translate(BREAK) for t in texts]
    plain = [re.sub(b"  +", b" ", t) if b"  " in t else t for t in plain]
    joined_texts = b"\n".join(plain)
    data = np.frombuffer(joined_texts, np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = (data != 32) & (data != 10)
    edges = np.diff(solid)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # bytes of each word
    if not len(first):
        return
    line = np.searchsorted(np.flatnonzero(data == 10), first)
    begins = np.flatnonzero(np.diff(line, prepend=-1))  # words that begin a piece
    ends = np.append(begins[1:], len(first))
    trigger = (rolling(hashes_at(data, first, last), overlap) >> np.uint64(32)) % np.uint64(spacing) == 0
    trigger[begins] = False
    at = np.flatnonzero(trigger)
    at = at[at + overlap <= ends[np.searchsorted(begins, at, side="right") - 1]]  # the window lies in one piece
    starts = np.sort(np.append(at, begins), kind="stable")
    stops = np.append(starts[1:], len(first))  # the piece's end or the next chunk's start
    reach = np.minimum(stops + overlap, ends[np.searchsorted(begins, starts, side="right") - 1])
    text_begins = np.cumsum([0] + [len(t) + 1 for t in plain[:-1]])
    owner = np.searchsorted(text_begins, first[starts], side="right") - 1
    for t, a, b, tail in zip(owner.tolist(), first[starts].tolist(), last[reach - 1].tolist(), (reach - stops).tolist()):
        yield t, joined_texts[a:b].decode(), tail


def chunk_dictionary(docs: DataFrame, lang: str = "lang", text: str = "text", overlap: int = OVERLAP, spacing: int = SPACING) -> DataFrame:
    """(lang, chunk, tail, uses, words): each distinct chunk, how many of its words are overlap, how often it is used, and how many words it has."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                langs, uses = part.column(0).to_pylist(), {}
                for t, chunk, tail in parse(part.column(1).to_pylist(), overlap, spacing):
                    key = (langs[t], chunk, tail)
                    uses[key] = uses.get(key, 0) + 1
                rows = list(zip(*uses)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(list(uses.values()), pa.int64())], names=["lang", "chunk", "tail", "uses"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text))
    return rows.mapInArrow(run, "lang string, chunk string, tail int, uses long").groupBy("lang", "chunk", "tail").agg(F.sum("uses").alias("uses")).withColumn("words", F.size(F.split("chunk", " ")))


def count_words(dictionary: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""
    return exact_counts(dictionary, {}, [1], 1)


def place(key: np.ndarray, bits: int) -> np.ndarray:
    """Where the bit of a key stands, of 2 ** bits."""
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def bit_set(keys: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """The bits of all keys (column ``key``), and their number as a power of two."""
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    at = keys.select((F.shiftrightunsigned("key", 64 - bits) + 1).alias("at"))  # Spark's bit maps count from 1
    blocks = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
    out = np.zeros((1 << bits) >> 3, dtype=np.uint8)
    for r in blocks.collect():  # at most 2 ** bits / 32768 rows of 4 KB
        out[(r["block"] - 1) * 4096 : r["block"] * 4096] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out, bits


class Words:
    """The words of some chunks (lang, chunk, tail, uses): their bytes, hashes, and places in the chunks."""

    def __init__(self, chunks: pa.Table):
        column = lambda i, kind: pa.concat_arrays([c.cast(kind) for c in chunks.column(i).chunks] or [pa.array([], kind)])
        text, self.langs = column(1, pa.large_binary()), column(0, pa.large_string()).dictionary_encode()
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
        of_chunk = offsets[:-1] - offsets[0]
        begin = np.zeros(len(self.data) + 1, bool)
        begin[1:] = self.data == 32  # words are joined by one space
        begin[of_chunk] = True
        self.begins = np.flatnonzero(begin[: len(self.data)])
        first = np.searchsorted(self.begins, of_chunk)
        sizes = np.diff(first, append=len(self.begins))
        self.ends = np.append(self.begins[1:] - 1, len(self.data))
        self.ends[first[1:] - 1] += 1  # no space follows a chunk
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(first + sizes, sizes) - np.arange(len(self.begins))  # words from here to the end of the chunk
        self.owned = self.left > column(2, pa.int64()).to_numpy()[self.row]  # not begun in the overlap
        self.uses = column(3, pa.int64()).to_numpy()
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashed = hashes_at(self.data, self.begins, self.ends)
        self.salt = hashes(self.langs.dictionary.cast(pa.large_binary()).to_pylist())[self.lang][self.row]

    def keys(self, k: int) -> np.ndarray:
        """A key of the language and the k words from each word on (not of use where the chunk ends sooner)."""
        return (rolling(self.hashed, k) ^ self.salt) * LAST

    def known(self, k: int, table: np.ndarray, bits: int) -> np.ndarray:
        """Whether the bit of the k words from each word on is set."""
        at = place(self.keys(k), bits)
        return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def possible(self, k: int, sets: dict[int, tuple[np.ndarray, int]]) -> np.ndarray:
        """Words that begin a phrase of k words that may be frequent, by the sets of frequent keys of k or of k - 1 words."""
        ok = self.owned & (self.left >= k)
        if k in sets:
            ok &= self.known(k, *sets[k])
        elif k - 1 in sets:
            part = self.known(k - 1, *sets[k - 1])
            ok[:-1] &= part[:-1] & part[1:]
        return np.flatnonzero(ok)

    def packed(self, k: int, sets: dict[int, tuple[np.ndarray, int]], range_bits: int) -> pa.RecordBatch:
        """(range, keys, counts): the possible phrases' keys and uses, one row for each range of keys."""
        at = self.possible(k, sets)
        keys, counts = summed(self.keys(k)[at], self.uses[self.row[at]])
        edges = np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits) if range_bits else np.zeros(1, np.uint64)
        cuts = np.append(np.searchsorted(keys, edges), len(keys))
        filled = np.flatnonzero(np.diff(cuts))
        offsets = pa.py_buffer((np.append(cuts[filled], len(keys)) * 8).astype(np.int32))
        numbers = [pa.Array.from_buffers(pa.binary(), len(filled), [None, offsets, pa.py_buffer(x)]) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *numbers], names=["range", "keys", "counts"])

    def phrases(self, k: int, sets: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        """(lang, phrase, f) of the possible phrases themselves."""
        at = self.possible(k, sets)
        begins = self.begins[at]
        offsets = np.append(0, np.cumsum(self.ends[at + k - 1] - begins))
        data = self.data[np.repeat(begins - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
        text = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        number = text.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(self.langs.dictionary)) + self.lang[self.row[at]]
        number, f = summed(number, self.uses[self.row[at]])
        of_text, of_lang = np.divmod(number, max(1, len(self.langs.dictionary)))
        lang, phrase = self.langs.dictionary.take(pa.array(of_lang)), text.dictionary.take(pa.array(of_text))
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(f)], names=["lang", "phrase", "f"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts[:0]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def frequent_keys(dictionary: DataFrame, sets: dict[int, tuple[np.ndarray, int]], k: int, min_count: int, range_bits: int) -> DataFrame:
    """(key, f) of the keys of k words that f >= min_count phrases have in all; ``sets`` holds those of k - 1 words."""
    shared = dictionary.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(batches):
            yield Words(part).packed(k, shared.value, range_bits)

    def add(part: pa.Table) -> pa.Table:
        numbers = [np.concatenate([np.frombuffer(x, kind) for x in part.column(i).to_pylist()]) for i, kind in ((1, np.uint64), (2, np.int64))]
        keys, f = summed(*numbers)
        often = f >= min_count
        return pa.table({"key": keys[often].view(np.int64), "f": f[often]})

    rows = dictionary.where(F.col("words") >= k).select("lang", "chunk", "tail", "uses").mapInArrow(run, "range int, keys binary, counts binary")
    out = materialize(rows.groupBy("range").applyInArrow(add, "key long, f long"), f"collocations-keys-{k}")
    shared.unpersist()
    return out


def exact_counts(dictionary: DataFrame, sets: dict[int, tuple[np.ndarray, int]], sizes: list[int], min_count: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of so many words with f >= min_count, among those that ``sets`` let through."""
    ship_package(dictionary.sparkSession)
    shared = dictionary.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(batches):
            words = Words(part)
            for k in sizes:
                yield words.phrases(k, shared.value)

    rows = dictionary.where(F.col("words") >= min(sizes)).select("lang", "chunk", "tail", "uses").mapInArrow(run, "lang string, phrase string, f long")
    out = materialize(rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "collocations-phrases")
    shared.unpersist()
    return out


def count_phrases(dictionary: DataFrame, frequent: DataFrame, k: int, min_count: int = MIN_COUNT, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words with f >= min_count; ``frequent`` (lang, phrase) are those of k - 1 words."""
    ship_package(dictionary.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in joined(batches):
            words = Words(part)
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(k - 1)[words.left == k - 1].view(np.int64))], names=["key"])

    keys = frequent.select("lang", "phrase", F.lit(0).alias("tail"), F.lit(1).cast("long").alias("uses")).mapInArrow(run, "key long")
    return exact_counts(dictionary, {k - 1: bit_set(keys, most_bits)}, [k], min_count)


def joined(batches: Iterator[pa.RecordBatch], least_bytes: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Batches put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def first_words(n: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {n})")


def last_words(n: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', -({n}))")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, most: int = MOST, inside_percent: int = INSIDE_PERCENT, spacing: int = SPACING, most_bits: int = MOST_BITS) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    dictionary = materialize(chunk_dictionary(docs, lang, text, max_words - 1, spacing), "collocations-chunks")
    sizes = materialize(dictionary.groupBy("lang").agg(F.sum(F.col("uses") * (F.col("words") - F.col("tail"))).alias("n")), "collocations-sizes")
    range_bits = ((sizes.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS).bit_length()
    sets: dict[int, tuple[np.ndarray, int]] = {}
    for k in range(1, max_words):
        keys = frequent_keys(dictionary, {k - 1: sets[k - 1]} if k > 1 else {}, k, min_count, range_bits)
        sets[k] = bit_set(keys, most_bits)
        drop_staged(keys)
    known = exact_counts(dictionary, sets, list(range(1, max_words + 1)), min_count).withColumn("k", F.size(F.split("phrase", " ")))
    drop_staged(dictionary)
    candidates = known.where(F.col("k") > 1)
    held = [candidates.where(F.col("k") > j).select("lang", F.explode(parts_of(j)).alias("phrase"), F.col("f").alias("longer")) for j in range(2, max_words)]
    inside = held[0]
    for h in held[1:]:
        inside = inside.unionByName(h)
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.withColumns({"first": first_words("j"), "rest": last_words("k - j")})
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(sizes, "lang").withColumn("score", F.expr(SCORE))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "j")).alias("c")).select("lang", "phrase", "c.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def parts_of(j: int) -> Column:
    """The distinct runs of j words of a phrase of k words."""
    words = F.split("phrase", " ")
    runs = F.transform(F.sequence(F.lit(1), F.col("k") - (j - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(j)), " "))
    return F.array_distinct(runs)


def oracle_sql(table: str = "documents", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, most: int = MOST) -> str:
    """The same by counting every n-gram of every text."""
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, max_words + 1))
    return f"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {table})),
f AS (SELECT lang, phrase, k, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= {min_count}),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS d ON c.lang = d.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
cuts AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c ANTI JOIN inside USING (lang, phrase)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n.n, j, (1000 * cuts.f::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ') JOIN n ON n.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= {most}
"""
