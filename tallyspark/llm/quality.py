"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document is judged by figures of its text alone: shares of kinds of
characters, of kinds of words, of repeated words, word pairs and lines, and
lengths. Labelled documents are learned from by boosting on the logistic loss:
every statistic is cut into at most ``BINS`` bins by quantiles, a tree grows
level by level by the sums of gradients and second derivatives in each bin,
and its leaves step towards the loss's minimum.

The trees are complete and lie flat in arrays by level, so a batch of rows
walks through all of them at once: ``DEPTH`` look-ups in numpy, no recursion.

Labels are learned from a bounded sample: the ``SAMPLE_ROWS`` labelled rows
that come first by a hash of their key, with their statistics (that many times
``len(NAMES)`` numbers on the driver). All documents are scored in one pass
without a shuffle.

Defined results: a null text counts as the empty text, whose statistics are
all 0; it is scored like any other. Without labels every score is 0.5. Null
labels and labels of documents that aren't there are not learned from;
repeated rows each count. An empty table gives no rows. Very long texts are
read whole. Columns of the names ``statistics`` and ``score`` are replaced,
all others stay as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import crc_mod, text_struct

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Added to a node's sum of second derivatives; least sum of them in a child.
SHRINK, LEAST = 1.0, 2.0
#: From this score on a document is predicted to have label 1.
GOOD_FROM = 0.3

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line_end": b"\n\r",
    "stop": b".,;:",
    "shout": b"!?",
    "quote": b"\"'()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
    "beyond_ascii": bytes(range(128, 256)),
}
NAMES = [
    *(f"{k}_share" for k in KINDS), "log_chars", "log_words", "word_length", "long_words", "one_letter_words",
    "distinct_words", "most_common_word", "repeated_neighbours", "distinct_pairs", "upper_words", "symbol_ended_words",
    "wordless_tokens", "log_lines", "distinct_lines", "words_a_line", "entropy",
]
KIND_OF = np.zeros((256, len(KINDS)))
for _i, _bytes in enumerate(KINDS.values()):
    KIND_OF[list(_bytes), _i] = 1
WORDLESS = bytes(c for c in range(128) if not chr(c).isalnum())
SYMBOLS = tuple(bytes([c]) for c in KINDS["symbol"] + KINDS["shout"])


def statistics(text: str | None) -> list[float]:
    """The figures of one text, in the order of ``NAMES``."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = seen / len(raw)
    some = shares[shares > 0]
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    return [
        *(seen @ KIND_OF / len(raw)).tolist(),
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(lengths.mean()) if words else 0.0,
        float((lengths > 20).sum()) / n,
        float((lengths == 1).sum()) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(pairs) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(w.endswith(SYMBOLS) for w in words) / n,
        sum(c for w, c in counts.items() if not w.strip(WORDLESS)) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        float(-(some * np.log2(some)).sum()),
    ]


def statistics_column(text: Column) -> Column:
    return text_struct(lambda: lambda texts: {"x": [statistics(t) for t in texts]}, "x array<double>")(text)["x"]


@dataclass
class Trees:
    """All trees in flat arrays: a row a tree, a column a node, level by level from the root."""

    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    limit: np.ndarray  # at most this: left; infinite where nothing is to be split
    value: np.ndarray  # (trees, 2 ** depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row, by one look-up a level for all trees."""
        trees, inner = self.feature.shape
        rows, of = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[of, node]] > self.limit[of, node])
        return self.base + self.value[of, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of all bins but the last: midway between neighbouring values near the quantiles."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    after = values[np.minimum(np.searchsorted(values, cuts, side="right"), len(values) - 1)]
    return (cuts + after)[after > cuts] / 2


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, grad: np.ndarray, hess: np.ndarray, bins: int, shrink: float = SHRINK, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of a level: the gain, feature and last left bin of its best split (ties: first feature, then bin)."""
    gain, feature, at = np.zeros(nodes), np.zeros(nodes, dtype=np.int64), np.full(nodes, -1)
    for f in range(binned.shape[1]):
        place = node * bins + binned[:, f]
        g = np.cumsum(np.bincount(place, weights=grad, minlength=nodes * bins).reshape(nodes, bins), axis=1)
        h = np.cumsum(np.bincount(place, weights=hess, minlength=nodes * bins).reshape(nodes, bins), axis=1)
        all_g, all_h = g[:, -1:], h[:, -1:]
        right_g, right_h = all_g - g, all_h - h
        made = g**2 / (h + shrink) + right_g**2 / (right_h + shrink) - all_g**2 / (all_h + shrink)
        made[(h < least) | (right_h < least)] = 0
        k = made.argmax(axis=1)
        top = made[np.arange(nodes), k]
        better = top > gain + 1e-9
        gain[better], feature[better], at[better] = top[better], f, k[better]
    return gain, feature, at


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees of rows ``x`` with labels ``y`` (0 or 1)."""
    inner = 2**depth - 1
    rate_of_1 = (y.sum() + 1) / (len(y) + 2)
    out = Trees(float(np.log(rate_of_1 / (1 - rate_of_1))), np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y):
        return out
    edges = [bin_edges(c, bins) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # within its level
        for d in range(depth):
            gain, feature, at = best_splits(binned, node, 2**d, grad, hess, bins)
            cut = np.flatnonzero(gain > 0)
            flat = 2**d - 1 + cut
            out.feature[t, flat] = feature[cut]
            out.limit[t, flat] = [edges[feature[k]][at[k]] for k in cut]
            right = (gain[node] > 0) & (binned[np.arange(len(y)), feature[node]] > at[node])
            node = 2 * node + right
        leaves = inner + 1
        out.value[t] = -rate * np.bincount(node, weights=grad, minlength=leaves) / (np.bincount(node, weights=hess, minlength=leaves) + SHRINK)
        margin += out.value[t][node]
    return out


def training_rows(key: str = "doc_id") -> Column:
    """Labels that may be learned from: crc32 of the key as text modulo 5 is not 0."""
    return crc_mod(key, 5) != 0


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled documents."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (training_rows(key) if training is None else training))
    order = F.xxhash64(F.col(key).cast("string"))
    first = usable.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"), order.alias("__h")).orderBy("__h", "__key", "__y").limit(sample_rows)
    # The sample is broadcast: its size is bounded by sample_rows.
    rows = docs.select(F.col(key).alias("__of"), F.col(text).alias("__t")).join(F.broadcast(first), F.col("__of") == F.col("__key"))
    made = rows.select("__h", "__key", "__y", statistics_column(F.col("__t")).alias("__x")).orderBy("__h", "__key", "__y", "__x").limit(sample_rows).toArrow()
    x = np.array(made["__x"].to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    return fit_trees(x, made["__y"].to_numpy(), **options)


def score_quality(docs: DataFrame, model: Trees, *, text: str = "text") -> DataFrame:
    """Add the statistics of each document's text and its score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def batch(texts: list) -> dict:
            x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))
            return {"x": list(x), "score": m.score(x)}

        return batch

    judged = text_struct(make, "x array<double>, score double")(F.col(text))
    plain = [c for c in docs.columns if c not in ("statistics", "score")]
    return docs.select(*plain, judged.alias("__q")).select(*plain, F.col("__q.x").alias("statistics"), F.col("__q.score").alias("score"))
