"""Language identification by compression.

Each language has a raw-content zstandard dictionary: windows cut from a
bounded sample of its labelled texts. A text is compressed once with each
dictionary, block by block so that a long text never outgrows the dictionary's
reach, and the smallest total wins; a narrow margin to the second is rejected.

Sample: per language the ``sample_rows`` training rows that come first by a
hash of their key, and of each a window of ``sample_chars`` characters at a
place chosen by the hash. These two parameters bound what the driver and the
tasks hold: languages x sample_rows x sample_chars. With many languages the
dictionaries share ``MODEL_BYTES``.

Defined results: null text or text without a letter: ``und``, score 0,
rejected. Nothing to learn from: ``und`` for all. Equal sizes: the language
that comes first by name, score 0.5, rejected. Very long texts are read whole,
block by block. Repeated rows are each judged; an empty table gives no rows. A
column of the name of ``out`` is replaced, all others stay.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import crc_mod, text_struct

SAMPLE_ROWS, SAMPLE_CHARS, MODEL_BYTES = 96, 1024, 64 << 20
#: Bytes of a block that is compressed at once.
BLOCK = 2048
#: Share of the second-best size by which the best must be smaller.
MIN_MARGIN = 0.002
#: The score is the logistic function of the margin over this: 0.5 for a tie.
NARROW = 0.02
#: Matches from four bytes on: short words are the strongest mark of a language.
MATCHER = {"min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
#: What is compressed: lower-case letters, everything else one space.
OTHER = re.compile(r"[\W\d_]+")
#: Stands before each block. It compresses to almost nothing, so the block is never stored
#: as it is and a byte saved in the shortest text shows.
CARRIER = b"0" * 256 + b" "


def learn_dictionaries(docs: DataFrame, training: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language, from rows where ``training`` holds."""
    rows = docs.select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(key), F.length(text)).alias("h"),
        F.length(text).alias("n"),
        F.col(text).alias("t"),
        training.alias("use"),
    ).where(F.col("use") & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    # The window is cut before anything is sorted, so no whole text is moved.
    at = F.pmod(F.col("h"), F.greatest(F.col("n") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    cut = rows.select("lang", "h", F.col("t").substr(at, F.lit(sample_chars)).alias("t"))
    first = Window.partitionBy("lang").orderBy("h", "t")
    kept = cut.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_rows)
    parts: dict[str, list] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], -r["rank"])):
        parts.setdefault(r["lang"], []).append(OTHER.sub(" ", r["t"].lower()))
    room = MODEL_BYTES // max(1, len(parts))
    return {k: " ".join(v).encode("utf-8", "replace")[-room:] for k, v in parts.items()}


def classifier(dictionaries: dict[str, bytes], min_margin: float):
    """A function from a text to (language, score, margin, rejected)."""
    names = sorted(dictionaries)
    params = zstandard.ZstdCompressionParameters.from_level(3, **MATCHER, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    compressors = []
    for k in names:
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def judge(text: str | None) -> tuple[str, float, float, bool]:
        plain = OTHER.sub(" ", text.lower()) if text else ""
        # A letter is a character of Unicode's category L, here as in SQL's \p{L}; other word characters are none.
        if not names or not any(map(str.isalpha, plain)):
            return "und", 0.0, 0.0, True
        data = plain.encode("utf-8", "replace")
        blocks = [CARRIER + data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in compressors]
        best = min(sizes)
        at = sizes.index(best)
        if len(sizes) == 1:
            return names[0], 1.0, 1.0, False
        second = min(sizes[:at] + sizes[at + 1 :])
        margin = (second - best) / second
        return names[at], 1 / (1 + math.exp(-margin / NARROW)), margin, margin < min_margin

    return judge


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "language", *, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add struct column ``out``: lang_pred, score, margin, rejected. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most MODEL_BYTES

    def make():
        judge = classifier(shared.value, min_margin)

        def batch(texts):
            made = [judge(t) for t in texts]
            return {n: [m[i] for m in made] for i, n in enumerate(("lang_pred", "score", "margin", "rejected"))}

        return batch

    column = text_struct(make, "lang_pred string, score double, margin double, rejected boolean")
    return docs.withColumn(out, column(F.col(text)))


def training_rows(key: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the key as text modulo 3 is not 1."""
    return crc_mod(key, 3) != 1
