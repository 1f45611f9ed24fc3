"""Packs the token pieces of all documents into sequences, large pieces matched in pairs, small ones best-fit.

How full sequences get depends on nothing but how many pieces have each length,
and lengths are at most the capacity. So a first pass cuts documents into pieces
and counts lengths; the driver packs that histogram, in runs of equal sequences
instead of piece by piece (its work and memory depend on the capacity, not on the
documents); and a last pass gives every piece its place by its rank within its
length. Texts are read once and never shuffled.

The packing: pieces above a third of the capacity are matched greedily, the
largest with the largest that still fits, two of them per sequence at most. Then
smaller pieces, in falling length, go to the fullest sequence with room, and to
new ones when none has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import BROADCAST_BYTES, column_of, doc_text, slices, stored, texts_of
from plexora.llm.tokens import word_tokenizer


class Bins:
    """Runs of sequences with equal contents, by the room that is left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.by_gap: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
        self.gaps: list[int] = []
        self.slots: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, number, first sequence, pieces each, offset

    def put(self, gap: int, first: int, number: int) -> None:
        if number:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((first, number))

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences with this room."""
        runs = self.by_gap[gap]
        first, number = runs.pop()
        if number > most:
            runs.append((first + most, number - most))
            number = most
        if not runs:
            del self.by_gap[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return first, number

    def new(self, number: int) -> int:
        self.made += number
        return self.made - number


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, number, first sequence, pieces each, offset) for counts of lengths, and the number of sequences."""
    bins = Bins(capacity)
    rank = dict.fromkeys(counts, 0)
    left = {n: k for n, k in counts.items() if k}

    def place(n: int, number: int, first: int, each: int, offset: int) -> None:
        bins.slots.append((n, rank[n], number, first, each, offset))
        rank[n] += number
        left[n] -= number
        if not left[n]:
            del left[n]
            if 3 * n > capacity:
                large.pop(bisect_left(large, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1  # the largest partner that fits
        m = large[at] if at >= 0 else 0
        k = left[n] if not m else left[n] // 2 if m == n else min(left[n], left[m])
        if m == n and not k:  # one piece is left of this length: its partner is the next smaller
            at -= 1
            m = large[at] if at >= 0 else 0
            k = 1
        first = bins.new(k)
        if m == n:
            place(n, 2 * k, first, 2, 0)
        else:
            place(n, k, first, 1, 0)
            if m:
                place(m, k, first, 1, n)
        bins.put(capacity - n - m, first, k)
    for n in sorted(left, reverse=True):
        while n in left:
            at = bisect_left(bins.gaps, n)
            if at == len(bins.gaps):
                each = capacity // n
                bins.put(capacity, bins.new(-(-left[n] // each)), -(-left[n] // each))
                continue
            gap = bins.gaps[at]
            each = gap // n
            first, number = bins.take(gap, -(-left[n] // each))
            full = min(number, left[n] // each)
            if full:
                place(n, full * each, first, each, capacity - gap)
                bins.put(gap - each * n, first, full)
            if number > full:  # the last pieces fill one sequence in part
                k = left[n]
                place(n, k, first + full, k, capacity - gap)
                bins.put(gap - k * n, first + full, 1)
                bins.put(gap, first + full + 1, number - full - 1)
    return np.array(bins.slots, dtype=np.int64).reshape(-1, 6), bins.made


NAMES = ["part", "doc_id", "piece", "start", "length", "rank", "ids_crc32"]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = word_tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole):
                ids, sizes = tokenizer.flat(texts_of(batch), end_id)
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - (np.cumsum(number) - number)[row]
                least = (sizes - (number - 1) * capacity)[row]  # the first piece's length
                start = np.where(piece > 0, least + (piece - 1) * capacity, 0)
                lengths = np.where(piece > 0, capacity, least)
                ends = (4 * np.cumsum(lengths)).tolist()
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                order = np.argsort(lengths, kind="stable")
                own = lengths[order]
                rank = np.empty(len(own), dtype=np.int64)
                rank[order] = np.arange(len(own)) - np.searchsorted(own, own) + seen[own]
                seen += np.bincount(lengths, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part, dtype=np.int32)), column_of(batch, "doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(lengths), pa.array(rank), pa.array(crc, pa.int64())], NAMES
                )

    return run


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value  # sorted by length and first rank
        span = np.int64(1) << np.int64(44)
        keys = slots[:, 0] * span + slots[:, 1]
        for batch in batches:
            n = column_of(batch, "length").to_numpy()
            rank = column_of(batch, "rank").to_numpy() + column_of(batch, "before").to_numpy()
            s = slots[np.searchsorted(keys, n * span + rank, side="right") - 1]
            r = rank - s[:, 1]
            cols = [column_of(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[:, 3] + r // s[:, 4]), pa.array(s[:, 5] + r % s[:, 4] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizers file, there on every machine. A document
    is its ids and end_id; null texts are empty and so one id long. Documents longer
    than the capacity are cut, the first piece takes the rest of the division. Texts of
    any length are encoded whole. Equal rows and rows with a null doc_id are documents each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = doc_text(docs).mapInArrow(_pieces(tokenizer, end_id, capacity), "part int, doc_id long, piece int, start long, length long, rank long, ids_crc32 long")
    pieces = stored(rows, "pieces")
    per = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("k")), "lengths")
    counts = {r["length"]: r["k"] for r in per.groupBy("length").agg(F.sum("k").alias("k")).collect()}  # at most capacity rows
    slots, _ = plan(counts, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    before = per.select("length", "part", F.expr("sum(k) over (partition by length order by part) - k").alias("before"))
    if slots.nbytes > BROADCAST_BYTES:  # a few per length, whatever the number of documents
        raise ValueError(f"the plan of {len(slots)} slots is above the broadcast bound; take a smaller capacity")
    shared = spark.sparkContext.broadcast(slots)
    placed = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "rank", "before", "ids_crc32")
    return placed.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
