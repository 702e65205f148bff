"""Operator 3, packing token sequences: dominance reduction, then best fit, on the histogram of lengths.

Lengths are at most the capacity, so an instance of any size is a histogram of at most ``capacity`` counts, and that is
all the driver holds. On it, the reduction of Martello and Toth fixes bins (a long piece with one or two others) that
provably dominate every other bin with that piece; the shrunk rest is packed best-fit decreasing, all pieces of a
length together. The outcome is a table of runs: the pieces of one length with ranks from lo on fill the sequences from
``sequence`` on, ``each`` pieces a sequence from ``offset`` on. Its size depends on the capacity alone, so it is
broadcast.

Ranks among pieces of one length come from counts by (chunk of rows, length) and a running sum over the chunks; no group
of pieces meets in one task, however frequent its length.

Defined results: a null text is an empty one (its end id alone); repeated rows and null ids are documents of their own;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import decoded, id_text, release_memory, slices, small_batches, stored
from .tokens import encoder

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, place long"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Instance:
    """A histogram of lengths and the runs that its packing consists of so far."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, sequence, each, offset

    def take(self, length: int, number: int, sequence: int, each: int, offset: int) -> None:
        """The next ``number`` pieces of a length go into sequences from ``sequence`` on."""
        if number:
            self.runs.append((length, self.taken[length], sequence, each, offset))
            self.taken[length] += number
            self.left[length] -= number
            if not self.left[length]:
                self.sizes.remove(length)

    def fitting(self, room: int, without: dict[int, int]) -> int:
        """The greatest length up to ``room`` of which a piece is left besides those of ``without``; 0 if none."""
        k = bisect_left(self.sizes, room + 1) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def smallest(self, number: int, without: dict[int, int], above: int = 0) -> list[int]:
        """The ``number`` smallest pieces longer than ``above`` (fewer if there are fewer)."""
        out: list[int] = []
        for w in self.sizes[bisect_left(self.sizes, above + 1) :]:
            out += [w] * min(self.left[w] - without.get(w, 0), number - len(out))
            if len(out) == number:
                break
        return out

    def dominating(self, j: int) -> list[int] | None:
        """Pieces that, beside one of length j, make a bin that dominates all others with it; None if none is proved.

        A bin dominates another if the other's pieces can be dealt to its own so that each holds what it gets.
        """
        room = self.capacity - j
        own = {j: 1}
        low = self.smallest(3, own)
        if not low or low[0] > room:
            return []
        best = self.fitting(room, own)
        if best == room or len(low) < 2 or low[0] + low[1] > room:
            return [best]  # full, or only one fits
        if len(low) == 3 and sum(low) <= room:
            return None  # three fit: not tried
        if best >= self.greatest_pair(room, own):
            return [best]  # at most two fit, and every two together fit into this one
        own[best] = own.get(best, 0) + 1
        second = self.fitting(room - best, own)
        above = self.smallest(2, {j: 1}, second)
        if second and (len(above) < 2 or sum(above) > room):
            return [best, second]  # of any two that fit, one is at most the second, the other at most the best
        return None

    def greatest_pair(self, room: int, own: dict[int, int]) -> int:
        """The greatest sum of two pieces that fit together into ``room``."""
        top = 0
        for w in self.sizes:
            if 2 * w > room:
                break
            if self.left[w] > own.get(w, 0):
                with_it = dict(own)
                with_it[w] = with_it.get(w, 0) + 1
                if other := self.fitting(room - w, with_it):
                    top = max(top, w + other)
        return top

    def reduce(self) -> int:
        """Fix all dominating bins; the number of fixed pieces."""
        fixed, again = 0, True
        while again:
            again = False
            for j in reversed(list(self.sizes)):
                while self.left[j]:
                    others = self.dominating(j)
                    if others is None:
                        break
                    bin_of: dict[int, int] = {j: 1}
                    for w in others:
                        bin_of[w] = bin_of.get(w, 0) + 1
                    times = min(self.left[w] // k for w, k in bin_of.items())  # fewer pieces left only make it dominate more
                    offset = 0
                    for w, k in bin_of.items():
                        self.take(w, k * times, self.sequences, k, offset)
                        offset += k * w
                    self.sequences += times
                    fixed += times * (1 + len(others))
                    again = True
        return fixed

    def best_fit(self) -> None:
        """Pack what is left best-fit decreasing: each piece into the fullest open sequence that has room."""
        rooms: list[int] = []  # sorted
        open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)

        def put(room: int, first: int, number: int) -> None:
            if room and number:
                if room not in open_bins:
                    insort(rooms, room)
                    open_bins[room] = []
                open_bins[room].append((first, number))

        for w in reversed(list(self.sizes)):
            while self.left[w]:
                k = bisect_left(rooms, w)
                if k == len(rooms):
                    each = self.capacity // w
                    room, first, number = self.capacity, self.sequences, -(-self.left[w] // each)
                    self.sequences += number
                else:
                    room = rooms[k]
                    each = room // w
                    first, number = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room], rooms[k]
                offset = self.capacity - room
                whole, rest = min(number, self.left[w] // each), 0
                self.take(w, whole * each, first, each, offset)
                put(room - each * w, first, whole)
                if whole < number and self.left[w]:
                    rest = self.left[w]
                    self.take(w, rest, first + whole, rest, offset)
                    put(room - rest * w, first + whole, 1)
                used = whole + bool(rest)
                put(room, first + used, number - used)


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Instance:
    """The packing of a histogram of lengths (each from 1 to ``capacity``)."""
    instance = Instance(counts, capacity)
    instance.reduce()
    instance.best_fit()
    return instance


def piece_rows(path: str, capacity: int, end_id: int):
    """A mapper from (doc_id, text) to pieces; ``place`` is the rank among the pieces of its length in its chunk."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, code = TaskContext.get().partitionId(), encoder(path)
        seen = np.zeros(capacity + 1, np.int64)
        for ids, texts in slices(batches):
            tokens, at = code.ids([decoded(t) for t in texts])
            n = np.diff(at) + 1
            number = -(-n // capacity)
            doc = np.repeat(np.arange(len(ids)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            place, crc = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            tail = np.array([end_id], "<u4").tobytes()
            for k, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                last = s + m == n[d]
                data = tokens[at[d] + s : at[d] + s + m - last].astype("<u4").tobytes()
                crc[k] = zlib.crc32(data + tail if last else data)
                place[k] = seen[m]
                seen[m] += 1
            arrays = [pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, np.full(len(doc), task), place)]
            yield pa.RecordBatch.from_arrays(arrays, PIECE_NAMES)
        code.forget()
        release_memory()

    return build


def placed_rows(plan):
    """A mapper from (..., length, rank) to the same with sequence and offset."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank0, sequence, each, offset, length = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            w, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, w.astype(np.int64) << 44 | rank, side="right") - 1
            i = rank - rank0[k]
            arrays = [batch.column(c) for c in PIECE_NAMES[:5]]
            arrays += [pa.array(sequence[k] + i // each[k]), pa.array(offset[k] + i % each[k] * length[k])]
            yield pa.RecordBatch.from_arrays(arrays, [*PIECE_NAMES[:5], "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(id_text(docs).mapInArrow(piece_rows(tokenizer_path, capacity, end_id), PIECES), "pieces")
    by_chunk = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = np.array(sorted(pack(counts, capacity).runs), np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs[:, 1], runs[:, 2], runs[:, 3], runs[:, 4], runs[:, 0]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    shifts = by_chunk.withColumn("before", F.coalesce(before, F.lit(0))).select("chunk", "length", "before")
    ranked = pieces.join(shifts, ["chunk", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    return ranked.select(*PIECE_NAMES[:5], "rank").mapInArrow(placed_rows(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
