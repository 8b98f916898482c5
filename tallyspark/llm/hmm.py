"""Hidden Markov language model, and the add-one word model beside it.

Tokens are the words of the lower-cased text (ASCII letters only) and one end
token. Word counts cover all training texts. The hidden Markov model emits
symbols: the ``SYMBOLS`` most frequent words, ``CLASSES`` classes of all other
words (by their last three bytes) and the end. A word of a class has the
class's probability times its add-one share in the class, so every word, seen
or not, has a probability, and the model's vocabulary grows with the corpus
while what a task holds does not.

Baum-Welch: each round every partition of the training texts runs the scaled
forward-backward recursion and gives its expected counts per symbol and state;
Spark sums them per symbol, and the new parameters are made from the sums.
For training only, a text of more than ``SEGMENT`` tokens is taken as several
sequences; none is dropped. Scoring runs the forward recursion over the whole
text, exactly.

Counts of the ``COUNTED`` most frequent words are broadcast (words of more than
``LONG_WORD`` bytes are never among them); counts of all other words reach the
documents by a join.

Defined results: a null or empty text is its end token alone. Without training
texts every word is unknown and the base score is 0. Repeated rows are scored
one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import crc_mod, text_struct
from tallyspark.session import materialize, ship_package

STATES, ROUNDS, SYMBOLS, CLASSES, COUNTED, LONG_WORD = 8, 4, 50_000, 256, 200_000, 64
SEGMENT, CHUNK = 128, 200_000
#: Texts whose words are held at once; texts that are scored side by side.
SLICE_TEXTS, FORWARD_TEXTS = 2_500, 10_000
#: Pseudo-counts: of the whole vocabulary in a state, spread like the word counts; of a transition.
PRIOR, STEP_PRIOR = 200.0, 1.0
#: Words seen less often are left to the classes, whose weight then also fits words not seen at all.
SYMBOL_COUNT = 5
#: How likely a state stays, before the first round: states then settle on topics and languages first.
STAY = 0.99


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty word
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return flat.filter(filled), before[ends]


def slices(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and ends of ``SLICE_TEXTS`` texts at a time."""
    for i in range(0, len(texts), SLICE_TEXTS):
        yield split_words(texts.slice(i, SLICE_TEXTS))


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 for a text without words."""
    out = np.zeros(len(ends) - 1, dtype=np.result_type(values, np.int64))
    some = ends[1:] > ends[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, ends[:-1][some], dtype=out.dtype)
    return out


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def training_rows(key: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the key as text modulo 7 is not 2."""
    return crc_mod(key, 7) != 2


def count_words(texts: DataFrame, text: str, classes: int) -> DataFrame:
    """(word, cls, c) over all rows."""
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found, _ in slices(b.column(0)):
                words, n = found.value_counts().flatten()
                cls = [class_of(w, classes) for w in words.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([words, pa.array(cls, pa.int32()), n], names=["word", "cls", "n"])

    return texts.select(text).mapInArrow(count, "word string, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``, by falling count: all words above a bound on the count.

    The bound comes from how many words there are of each size of count, so
    that no task has to merge every other task's best words.
    """
    short = counts.where(F.octet_length("word") <= LONG_WORD)
    grade = F.floor(F.log2(F.col("c")) * 64)
    sizes = short.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 for each doubling of the count
    room, bound = most, None
    for r in sorted(sizes, key=lambda r: -r["grade"]):
        room -= r["n"]
        if room < 0:
            break
        bound = r["grade"]
    kept = short.where(grade >= bound) if bound is not None else short.where("false")
    return kept.orderBy(F.desc("c"), "word")


class Model:
    """Parameters and bounded tables; symbols are words by rank, then classes, then the end."""

    def __init__(self, ranked: pa.Array, cls: np.ndarray, counts: np.ndarray, ends: int, tokens: int, types: int, by_class: dict[int, tuple[int, int]], states: int, symbols: int, classes: int) -> None:
        self.ranked = ranked
        c, cls = counts.astype(np.float64), cls.astype(np.int64)
        self.words = n_words = min(symbols, int((c >= SYMBOL_COUNT).sum()))
        self.classes, self.states = classes, states
        self.size = n_words + classes + 1
        self.tokens, self.types = tokens, types  # N and V, the end token included
        self.ends = ends
        # Classes hold what is left without the words that are symbols.
        inside = np.array([by_class.get(k, (0, 0)) for k in range(classes)], dtype=np.float64).reshape(classes, 2)
        np.subtract.at(inside, cls[:n_words], np.stack([c[:n_words], np.ones(n_words)], axis=1))
        self.class_room = np.log10(inside.sum(axis=1) + 1)  # log10 of (tokens + types + 1) of a class
        # By rank, and last for a word that isn't ranked: symbol, share in its class, base numerator.
        self.symbol = np.append(np.where(np.arange(len(c)) < n_words, np.arange(len(c)), n_words + cls), -1).astype(np.int32)
        share = np.log10(c + 1) - self.class_room[cls]
        share[:n_words] = 0
        self.share = np.append(share, 0.0)
        self.base = np.append(np.log10(c + 1), 0.0)
        self.room = np.log10(tokens + types + 1.0)
        counts = np.concatenate([c[:n_words], inside[:, 0], [ends]]) + 1e-3
        self.unigram = counts / counts.sum()
        rng = np.random.default_rng(11)
        emit = self.unigram * np.exp(rng.normal(0, 1, (states, self.size)))
        self.emit = emit / emit.sum(axis=1, keepdims=True)
        self.step = np.full((states, states), (1 - STAY) / max(1, states - 1))
        np.fill_diagonal(self.step, STAY if states > 1 else 1.0)
        self.begin = np.full((2, states), 1 / states)  # of a text; of a later segment

    def symbols_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Rank of each word (the number of ranked words if it has none), its symbol, and the words without a rank."""
        none = len(self.ranked)
        ranks = pc.fill_null(pc.index_in(words, value_set=self.ranked), none).to_numpy()
        symbols = self.symbol[ranks]
        missing = np.flatnonzero(ranks == none)
        unranked = words.take(pa.array(missing)).cast(pa.binary()).to_pylist()
        symbols[missing] = [self.words + class_of(w, self.classes) for w in unranked]
        return ranks, symbols, unranked

    def sequences_of(self, symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The symbols of each text, the end token last."""
        return [np.append(symbols[a:b], np.int32(self.size - 1)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def expected_counts(segments: list[np.ndarray], first: list[bool], step: np.ndarray, emit: np.ndarray, begin: np.ndarray, sums: dict) -> None:
    """Scaled forward-backward over sequences side by side; adds to ``sums``.

    Sequences are ordered by falling length, so the ones that are longer than t
    are the first ``live[t]``. Recursions run in single precision, sums in double.
    """
    order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
    lengths = np.array([len(segments[i]) for i in order])
    n, t_max, k = len(order), int(lengths[0]), step.shape[0]
    start = np.array([0 if first[i] else 1 for i in order])
    symbols = np.zeros((t_max, n), dtype=np.int32)
    for j, i in enumerate(order):
        symbols[: lengths[j], j] = segments[i]
    live = np.searchsorted(-lengths, -np.arange(t_max), side="left").tolist()
    table, step32 = np.ascontiguousarray(emit.T, dtype=np.float32), step.astype(np.float32)
    back_step = np.ascontiguousarray(step32.T)
    ones = np.ones(k, dtype=np.float32)
    alpha = np.empty((t_max, n, k), dtype=np.float32)
    seen = np.empty((t_max, n, k), dtype=np.float32)  # emission over scale
    for t in range(t_max):
        m = live[t]
        a, e = alpha[t, :m], seen[t, :m]
        np.take(table, symbols[t, :m], axis=0, out=e, mode="clip")
        if t:
            np.matmul(alpha[t - 1, :m], step32, out=a)
        else:
            a[:] = begin[start]
        a *= e
        c = a @ ones
        sums["log"] += float(np.log(c, dtype=np.float64).sum())
        c = np.reciprocal(c)[:, None]
        a *= c
        e *= c
    back = np.ones((n, k), dtype=np.float32)
    for t in range(t_max - 1, -1, -1):
        m = live[t]
        on = live[t + 1] if t + 1 < t_max else 0
        if on:
            ahead = seen[t + 1, :on]
            ahead *= back[:on]
            sums["step"] += (alpha[t, :on].T @ ahead) * step
            alpha[t + 1, :on] *= back[:on]  # the posterior takes alpha's place once alpha has served
            np.matmul(ahead, back_step, out=back[:on])
    alpha[0] *= back
    for s in range(2):
        sums["begin"][s] += alpha[0, start == s].sum(axis=0, dtype=np.float64)
    inside = np.arange(n) < np.array(live)[:, None]
    flat, post = symbols[inside], alpha[inside]
    for j in range(k):
        sums["emit"][j] += np.bincount(flat, weights=post[:, j], minlength=emit.shape[1])


def train(docs: DataFrame, training: Column, *, text: str = "text", states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, classes: int = CLASSES, counted: int = COUNTED) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words (word, c) as a written table."""
    spark = docs.sparkSession
    learn = docs.where(training).select(F.col(text).alias("t"))
    counts = materialize(count_words(learn, "t", classes), "lm-counts")
    ends = learn.count()
    by_class = {r["cls"]: (int(r["n"]), r["v"]) for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ranked = frequent(counts, counted).select("word", "cls", "c").toArrow()
    tokens, types = sum(n for n, _ in by_class.values()) + ends, sum(v for _, v in by_class.values()) + (ends > 0)
    model = Model(ranked["word"].combine_chunks(), ranked["cls"].to_numpy(), ranked["c"].to_numpy(), ends, tokens, types, by_class, states, symbols, classes)
    if not ends:
        return model, counts.select("word", "c")
    shared = spark.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def batch(texts):
            return {"ids": [ids.tobytes() for words, ends in slices(texts) for ids in m.sequences_of(m.symbols_of(words)[1], ends)]}

        return batch

    coded = materialize(learn.select(text_struct(make, "ids binary", as_list=False)(F.col("t"))["ids"].alias("ids")), "lm-symbols")
    for _ in range(rounds):
        given = spark.sparkContext.broadcast((model.step, model.emit, model.begin))
        model.step, model.emit, model.begin = update(model, *expected(coded, given, model.size, states))
        given.unpersist()
    return model, counts.select("word", "c")


def expected(coded: DataFrame, given, size: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of one round: symbols (or negative numbers for transitions and beginnings), and a value per state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, emit, begin = given.value
        sums = {"log": 0.0, "step": np.zeros((states, states)), "begin": np.zeros((2, states)), "emit": np.zeros((states, size))}
        segments: list[np.ndarray] = []
        first: list[bool] = []
        held = 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids = np.frombuffer(raw, dtype=np.int32)
                for i in range(0, len(ids), SEGMENT):
                    segments.append(ids[i : i + SEGMENT])
                    first.append(i == 0)
                    held += len(segments[-1])
                    if held >= CHUNK:
                        expected_counts(segments, first, step, emit, begin, sums)
                        segments, first, held = [], [], 0
        if segments:
            expected_counts(segments, first, step, emit, begin, sums)
        seen = np.flatnonzero(sums["emit"].any(axis=0))
        rows = np.concatenate([sums["emit"][:, seen].T, sums["step"], sums["begin"]])
        at = np.concatenate([seen, -1 - np.arange(states), -1 - states - np.arange(2)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(rows[:, j]) for j in range(states)]], names=["at", *[f"s{j}" for j in range(states)]])

    columns = [f"s{j}" for j in range(states)]
    made = coded.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in columns))
    rows = made.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # size + states + 2 rows at most
    return rows["at"].to_numpy(), np.stack([rows[c].to_numpy() for c in columns], axis=1)


def update(model: Model, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New transitions, emissions and beginnings from summed expected counts."""
    k = model.states
    emit, step, begin = np.zeros((k, model.size)), np.zeros((k, k)), np.zeros((2, k))
    shown, moved, begun = at >= 0, (at < 0) & (at >= -k), at < -k
    emit[:, at[shown]] = values[shown].T
    step[-1 - at[moved]] = values[moved]
    begin[-1 - k - at[begun]] = values[begun]
    emit += PRIOR * model.unigram
    step += STEP_PRIOR
    begin += STEP_PRIOR
    return tuple(x / x.sum(axis=1, keepdims=True) for x in (step, emit, begin))


def forward(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log likelihood of each whole sequence by the scaled forward recursion."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    log = np.zeros(len(order))
    table = np.ascontiguousarray(model.emit.T)
    a = np.repeat(model.begin[:1], len(order), axis=0)
    m = len(order)
    for t in range(int(lengths[0])):
        while lengths[m - 1] <= t:
            m -= 1
        a = (a[:m] @ model.step if t else a[:m]) * table[flat[at[:m] + t]]
        c = a.sum(axis=1)
        a /= c[:, None]
        log[:m] += np.log(c)
    out = np.empty(len(order))
    out[order] = log
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def batch(texts):
            parts, sequences = [], []
            for words, ends in slices(texts):
                ranks, symbols, _ = m.symbols_of(words)
                known = ranks < len(m.ranked)
                # Words without a rank: no numerator yet, and the room of their class.
                share = m.share[ranks]
                share[~known] = -m.class_room[symbols[~known] - m.words]
                length = np.diff(ends) + 1
                missing = np.concatenate(([0], np.cumsum(~known)))[ends]
                parts.append((
                    length,
                    sums_between(known, ends) + (m.ends > 0),
                    sums_between(m.base[ranks], ends) + np.log10(m.ends + 1) - m.room * length,
                    sums_between(share, ends),
                    pa.ListArray.from_arrays(pa.array(missing, pa.int32()), words.filter(pa.array(~known))),
                ))
                sequences += m.sequences_of(symbols, ends)
            if not parts:
                return {k: [] for k in ("n_tokens", "n_known", "base", "share", "rare")}
            made = np.concatenate([forward(sequences[i : i + FORWARD_TEXTS], m) for i in range(0, len(sequences), FORWARD_TEXTS)])
            length, known, base, share = (np.concatenate(x) for x in list(zip(*parts))[:4])
            return {"n_tokens": length, "n_known": known, "base": base, "share": share + made / np.log(10), "rare": pa.concat_arrays([p[4] for p in parts])}

        return batch

    column = text_struct(make, "n_tokens long, n_known long, base double, share double, rare array<string>", as_list=False)
    first = docs.select(F.col(key), F.monotonically_increasing_id().alias("__row"), column(F.col(text)).alias("s")).select(key, "__row", "s.*")
    first = materialize(first, "lm-first")
    # Words that aren't ranked: their counts come by a join; unknown ones add nothing to either sum.
    rare = first.select("__row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy(F.col("__row").alias("__of")).agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    out = first.drop("rare").join(found, F.col("__row") == F.col("__of"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(key, "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("share") + more).alias("score"))
