"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

A document is its token ids and an end id; longer ones than a sequence are cut
into whole sequences from the end, so only the first piece may be shorter.
Pieces are dealt at random into groups of bounded size. A group is packed
best fit decreasing; then bins are emptied by local search: a document moves
from the emptiest bin to a fuller one, or is exchanged one for one, two for
one or one for two, always the exchange that fills the receiving bin most.
Every step raises the sum of squared fills. The search ends when no step is
left or when the group has no more bins than its tokens need. Bins that stay
below ``closed`` of the capacity are opened again and dealt anew with those of
other groups, until one group holds them all or dealing no longer helps.

Ids come from tiktoken with the ranks of the same byte-level vocabulary as the
``tokenizers`` file; ``tests/llm/test_packing.py`` holds them equal. With
``added_tokens``, the added tokens of that file get their own ids wherever a
text holds them, as ``tokenizers`` does (``tests/llm/test_added_tokens.py``);
without, they are ordinary text.

Defined results: a null or empty text is the end id alone (length 1). Repeated
rows are packed one by one. An empty table gives no rows. A very long text is
encoded whole. Columns other than key and text are not read; ``pack`` keeps
all columns and replaces ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import BPE_RANKS
from tallyspark.llm.secrets import load_encoder
from tallyspark.session import materialize, ship_package

CAPACITY, END_ID, GROUP_PIECES, CLOSED = 2048, 0, 30_000, 0.98
#: About how many ids a task holds before it hands them on.
BATCH_IDS = 1_000_000


def cut(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin, and n."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)] if n else [0]


def read_added_tokens(name: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file of public_tokenizers, matched as they stand."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: added tokens that aren't matched as they stand")
    return {t["content"]: t["id"] for t in tokens}


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, ranks_file: str = BPE_RANKS, added_tokens: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if asked for, the ids.

    Ids stay numpy arrays and leave a task in batches of about ``BATCH_IDS``, so
    what a task holds does not depend on how many texts come at once.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(ranks_file, read_added_tokens(added_tokens) if added_tokens else None)
        for batch in batches:
            rows, piece, start, length, crc, held, n = [], [], [], [], [], [], 0

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    flat = np.concatenate(held) if held else np.empty(0, dtype="<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length, dtype=np.int64))), pa.int32()), pa.array(flat, pa.int32())))
                return pa.RecordBatch.from_arrays(columns, names=names)

            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = np.append(encoder.encode_to_numpy(text, allowed_special="all"), end_id) if text else np.array([end_id])
                ids = ids.astype("<i4")
                at = cut(len(ids), capacity)
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    rows.append(row), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b]))
                if keep_ids:
                    held.append(ids)
                n += len(ids)
                if n >= BATCH_IDS:
                    yield made()
                    rows, piece, start, length, crc, held, n = [], [], [], [], [], [], 0
            if rows:
                yield made()

    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = StructType([docs.schema[key], *StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids).fields])
    return docs.select(key, text).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers. Free room is looked up in a bit mask of the rooms at hand."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - x
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(b)
    return bins


def ways_out(bins: list[list[int]], which: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What may leave each bin: nothing, one document or two, once for each size. Bin, size, documents (-1: none)."""
    at, size, docs = [], [], []
    by_count: dict[int, list[int]] = {}
    for b in which:
        by_count.setdefault(len(bins[b]), []).append(b)
    for n, group in by_count.items():
        of = np.array(group)
        items = np.array([bins[b] for b in group]).reshape(len(group), n)
        x = lengths[items]
        order = np.argsort(x, axis=1, kind="stable")
        items, x = np.take_along_axis(items, order, 1), np.take_along_axis(x, order, 1)
        new = np.ones(x.shape, dtype=bool)
        new[:, 1:] = x[:, 1:] > x[:, :-1]
        second = np.zeros(x.shape, dtype=bool)  # of a length; more of it make no other sum of two
        second[:, 1:] = new[:, :-1] & ~new[:, 1:]
        row, column = np.nonzero(new)
        at += [of, of[row]]
        size += [np.zeros(len(of), dtype=np.int64), x[row, column]]
        docs += [np.full((len(of), 2), -1), np.stack([items[row, column], np.full(len(row), -1)], axis=1)]
        kept = (new | second).sum(axis=1)
        for k in np.unique(kept[kept > 1]).tolist():
            rows = np.flatnonzero(kept == k)
            few = items[rows][(new | second)[rows]].reshape(len(rows), k)
            i, j = np.triu_indices(k, 1)
            at.append(np.repeat(of[rows], len(i)))
            size.append((lengths[few[:, i]] + lengths[few[:, j]]).ravel())
            docs.append(np.stack([few[:, i].ravel(), few[:, j].ravel()], axis=1))
    return np.concatenate(at), np.concatenate(size), np.concatenate(docs)


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The local search, to the point where no step is left or no fewer bins can do.

    A pass goes over all underfull bins from the emptiest. A bin takes part once
    in a pass: what left or entered it is looked at again in the next one.
    """
    if len(lengths):
        capacity -= capacity % int(np.gcd.reduce(lengths))  # what no sum of lengths can reach
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    need = -(-int(lengths.sum()) // capacity)
    steps = 1
    while len(bins) > need and steps:
        under = np.flatnonzero(fill < capacity)
        if len(under) < 2:
            break
        at, size, docs = ways_out(bins, under.tolist(), lengths)
        space = size + capacity - fill[at]  # room in the bin once they have left
        order = np.lexsort((size, space))
        at, size, space, docs = at[order], size[order], space[order], docs[order]
        single = docs[:, 1] < 0  # two for two is no step of the search
        tables = {1: (at, size, space, docs), 2: (at[single], size[single], space[single], docs[single])}
        moved = np.zeros(len(bins), dtype=bool)
        steps, left = 0, len(bins)
        for v in under[np.argsort(fill[under], kind="stable")].tolist():
            if moved[v]:
                continue
            own = steps
            moved[v] = True  # it doesn't receive
            while bins[v] and left > need and (best := best_step(bins[v], int(fill[v]), lengths, capacity, tables, moved)):
                _, gain, kind, k, out = best
                to, back = int(tables[kind][0][k]), [d for d in tables[kind][3][k].tolist() if d >= 0]
                bins[to] = [i for i in bins[to] if i not in back] + list(out)
                bins[v] = [i for i in bins[v] if i not in out] + back
                fill[to] += gain
                fill[v] -= gain
                moved[to] = True
                steps += 1
            moved[v] = steps > own
            left -= not bins[v]
        keep = [i for i in range(len(bins)) if bins[i]]
        bins, fill = [bins[i] for i in keep], fill[keep]
    return bins


def best_step(mine: list[int], filled: int, lengths: np.ndarray, capacity: int, tables: dict, moved: np.ndarray) -> tuple | None:
    """The exchange that leaves least room in the receiving bin, then has the largest gain; None if no step raises the squared fills.

    (room left, gain, table, place in it, documents that leave). The receiving
    bin must end up fuller than this one is: its space lies in a range that is
    found by bisection, and the first fitting place in it is the best.
    """
    by_size: dict[int, list[int]] = {}
    for i in mine:
        by_size.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(by_size)
    leave = {
        1: [((by_size[x][0],), x) for x in sizes],
        2: [((by_size[x][0], by_size[y][0]), x + y) for k, x in enumerate(sizes) for y in sizes[k + 1 :]] + [(tuple(by_size[x][:2]), 2 * x) for x in sizes if len(by_size[x]) > 1],
    }
    best = None
    for kind, ways in leave.items():
        if not ways:
            continue
        at, size, space, _ = tables[kind]
        out_sizes = np.array([y for _, y in ways])
        room = capacity - filled if best is None else min(capacity - filled, best[0] + 1)
        first, last = np.searchsorted(space, out_sizes, side="left"), np.searchsorted(space, out_sizes + room, side="left")
        for (out, y), i, end in zip(ways, first.tolist(), last.tolist()):
            width = 64
            while i < end:
                till = min(end, i + width)
                fits = (size[i:till] < y) & ~moved[at[i:till]]
                k = int(fits.argmax())
                if fits[k]:
                    k += i
                    found = (int(space[k]) - y, y - int(size[k]), kind, k, out)
                    if best is None or (found[0], -found[1]) < (best[0], -best[1]):
                        best = found
                    break
                i, width = till, width * 8
    return best


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return empty_bins(best_fit_decreasing(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, length: str = "length", *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, closed: float = CLOSED) -> DataFrame:
    """Add sequence_id and offset to rows with a length of at most ``capacity``."""
    ship_package(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    staged = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    done, level, n = [], 0, staged.count()
    names = [*pieces.columns, "sequence_id", "offset"]
    while True:
        groups = max(1, -(-n // group_pieces))
        dealt = staged.withColumn("__group", F.pmod(F.xxhash64("__row", F.lit(level)), F.lit(groups)).cast("int")).withColumn("__level", F.lit(level))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__row", ignore_index=True)
            lengths = pdf[length].to_numpy(dtype=np.int64)
            group = int(pdf["__group"].iloc[0])
            at, offset, open_ = (np.zeros(len(pdf), dtype=t) for t in (np.int64, np.int64, bool))
            for b, items in enumerate(pack_group(lengths, capacity)):
                ends = np.cumsum(lengths[items])
                at[items] = b
                offset[items] = ends - lengths[items]
                open_[items] = ends[-1] < closed * capacity
            pdf["sequence_id"] = (int(pdf["__level"].iloc[0]) << 56) + (group << 24) + at
            pdf["offset"], pdf["__open"] = offset, open_
            return pdf[[*names, "__row", "__open"]]

        kinds = {f.name: f.dataType.simpleString() for f in staged.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in pieces.columns), "sequence_id long, `offset` long, __row long, __open boolean"])
        packed = materialize(dealt.groupBy("__group").applyInPandas(fill, schema), f"packed-{level}")
        left = packed.where("__open").count()
        if groups == 1 or left == 0 or (level and left > n / 2):
            done.append(packed.select(names))
            break
        done.append(packed.where("NOT __open").select(names))
        staged, n, level = packed.where("__open").select(*pieces.columns, "__row"), left, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
