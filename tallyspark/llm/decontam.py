"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as lower-case words; in scripts without spaces every
character is one. Every run of ``SEED_WORDS`` words of a
test item is weighed by how often it would appear in the corpus by chance,
from word counts over all documents. Seeds are the runs expected less than
``MAX_EXPECTED`` times, and always the rarer half of an item's runs, so an
item of common words has seeds too. Each document is searched for seeds; where
one is found, the item is aligned with the words around it (match 2, mismatch
and gap -1), and a document holds an item if the best local score reaches
``MIN_SCORE`` of the score of the whole item. Substituted, dropped and added
words cost score; they don't hide the copy as long as one seed is left.

The benchmark is the stated query set. It is read in blocks of at most about
``BLOCK_CHARS`` characters; each block is broadcast and set against all rows,
so neither the driver nor a task holds more of it than a block. Documents are
never shuffled, hence a passage that a third of all documents share is spread
as the documents are.

Defined results: null or empty texts and items hold nothing. Items of fewer
than ``MIN_WORDS`` words are too short to tell a copy from ordinary text and
match nothing. Items of equal words are all reported. Repeated rows are each
judged; an empty benchmark or table gives no rows. Very long texts are
searched whole. A column of the name of ``out`` is replaced, all others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_struct
from tallyspark.session import ship_package

SEED_WORDS, MIN_WORDS, MAX_EXPECTED, MIN_SCORE, BLOCK_CHARS = 3, 5, 0.01, 0.45, 8_000_000
# Letters of scripts that put no spaces between words (Thai to Lao, Burmese, Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A word, or one character of a script without spaces, where a copy may begin at any character.
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
HITS = "hits array<struct<item_id:long,score:double,start:long,end:long>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_counts(docs: DataFrame, text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """How often each word of a block's vocabulary stands in all documents, and all words."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums, get = np.zeros(len(known) + 1, dtype=np.int64), known.get
        for b in batches:
            for t in b.column(0).to_pylist():
                sums += np.bincount([get(w, 0) for w in words_of(t)] or [0], minlength=len(sums)) if t else 0
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"word": at, "n": sums[at]})

    made = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in made.collect():  # one row per word of the block
        out[r["word"]] = r["n"]
    return out, int(out.sum())


def codes_of(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for each run of SEED_WORDS ids; 0 if a word is unknown."""
    n = len(ids) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(SEED_WORDS):
        part = ids[k : k + n]
        out = out * base + part
        known &= part > 0
    return np.where(known, out, 0)


class Index:
    """Seeds of a block of items: sorted codes, and the (item, place) pairs of each."""

    def __init__(self, items: list[tuple[int, list[str]]], vocabulary: dict[str, int], counts: np.ndarray, total: int) -> None:
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        self.items = [(k, np.array([vocabulary[w] for w in ws], dtype=np.int64)) for k, ws in items]
        log_p = np.log((counts + 1) / (total + self.base))
        codes, places = [], []
        for i, (_, ids) in enumerate(self.items):
            code = codes_of(ids, self.base)
            chance = sum(log_p[ids[k : k + len(code)]] for k in range(SEED_WORDS))
            rare = chance + math.log(max(total, 1)) <= math.log(MAX_EXPECTED)
            rare[np.argsort(chance, kind="stable")[: -(-len(code) // 2)]] = True
            at = np.flatnonzero(rare)
            codes.append(code[at])
            places.append(np.stack([np.full(len(at), i), at], axis=1))
        code = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.places = (np.concatenate(places) if places else np.zeros((0, 2), dtype=np.int64))[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code)).astype(np.int64)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of an item against words, and where it ends (exclusive)."""
    ramp = np.arange(1, len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(words == w, 2, -1), row[1:] - 1)
        np.maximum(step, 0, out=step)
        # a gap in the item: the best value to the left, less one for each word between
        row[1:] = np.maximum.accumulate(step + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def searcher(index: Index, min_score: float):
    """A function from a text to the items it holds: (item_id, score, start, end) in code points."""
    get = index.vocabulary.get

    def search(text: str | None) -> list[dict]:
        if not text or not len(index.codes):
            return []
        lower = text.lower()
        ids = np.array([get(w, 0) for w in WORD.findall(lower)], dtype=np.int64)
        code = codes_of(ids, index.base)
        at = np.flatnonzero(code)
        if not len(at):
            return []
        slot = np.searchsorted(index.codes, code[at])
        slot[slot == len(index.codes)] = 0
        m = index.codes[slot] == code[at]
        at, slot = at[m], slot[m]
        if not len(at):
            return []
        starts: dict[int, set] = {}  # of each item, where it would begin in the document
        for p, s in zip(at.tolist(), slot.tolist()):
            for i, q in index.places[index.first[s] : index.last[s]].tolist():
                starts.setdefault(i, set()).add(p - q)
        found = []
        for i, begins in sorted(starts.items()):
            key, item = index.items[i]
            n, pad = len(item), max(8, len(item) // 4)
            windows: list[list[int]] = []
            for b in sorted(begins):
                lo, hi = max(0, b - pad), min(len(ids), b + n + pad)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                else:
                    windows.append([lo, hi])
            best = max(((*align(item, ids[lo:hi]), lo) for lo, hi in windows), key=lambda x: (x[0], -x[2]))
            if best[0] >= min_score * 2 * n:
                found.append((key, item, *best))
        if not found:
            return []
        # Lower-casing may change lengths; the words of the text as written stand in the same order unless it does.
        spans = [m.span() for m in WORD.finditer(text if len(text) == len(lower) else lower)]
        out = []
        for key, item, score, end, lo in found:
            back = align(item[::-1], ids[lo : lo + end][::-1])[1]
            out.append({"item_id": key, "score": score / (2 * len(item)), "start": spans[lo + end - back][0], "end": spans[lo + end - 1][1]})
        return out

    return search


def blocks_of(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark, a block at a time on the driver."""
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    rows = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).orderBy("k", "t").collect()
        yield [(r["k"], ws) for r in block if len(ws := words_of(r["t"])) >= MIN_WORDS]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", *, item_key: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add array column ``out``: the items each document holds, with score and span."""
    columns = []
    for items in blocks_of(benchmark, item_key, item_text, block_chars):
        if not items:
            continue
        vocabulary: dict[str, int] = {}
        for _, ws in items:
            for w in ws:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        index = Index(items, vocabulary, *word_counts(docs, text, vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            search = searcher(shared.value, min_score)
            return lambda texts: {"hits": [search(t) for t in texts]}

        columns.append(text_struct(make, HITS)(F.col(text))["hits"])
    if not columns:
        return docs.withColumn(out, F.array().cast(HITS.removeprefix("hits ")))
    return docs.withColumn(out, F.concat(*columns) if len(columns) > 1 else columns[0])
