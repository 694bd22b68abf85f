"""Packing of documents into sequences of bounded length by exact-complement hashing.

Only the histogram of piece lengths (at most `capacity` numbers) goes to the driver. There the plan is made: which lengths
share a sequence, and how often. The longest remaining length is opened; a hash index of the sums of pairs of lengths names the
combinations of one, two or three that fill its gap exactly (a triple is a length and a pair that fills the rest), consumed while
their counts last; what no exact combination fills is packed best-fit. Pieces are then matched to the plan by (length, rank within the length), a table lookup in each task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import tokens
from panelforge.session import materialize, partitions, release, ship

SALTS = 1024  # ranks are counted by (length, salt): at most capacity x SALTS counts
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: whole texts are encoded; documents over `capacity` are cut, the first piece taking the remainder."""
    ship(docs.sparkSession)

    def cut(batches):
        code = tokens.encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            rows = []
            coded = code.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("id").to_pylist(), coded, strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                head = len(ids) % capacity or min(len(ids), capacity)
                edges = [0, *range(head, len(ids) + 1, capacity)] if len(ids) else [0]
                for number, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, number, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, PIECES)


class Plan:
    """Sequences as patterns: each a multiset of lengths and how many sequences have it."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        if any(n > capacity or n <= 0 for n in self.left):
            raise ValueError("lengths must lie between 1 and the capacity")
        self.bits = sum(1 << n for n in self.left)  # a bit a length that is there
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """Uses the pattern as often as the counts allow."""
        need = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(self.left.get(n, 0) // k for n, k in need.items())
        times = times if most is None else min(times, most)
        if times:
            self.patterns.append((lengths, times))
            for n, k in need.items():
                self.left[n] -= times * k
                if not self.left[n]:
                    del self.left[n]
                    self.bits ^= 1 << n
        return times

    def _pair(self, total: int) -> tuple[int, int] | None:
        """The pair of lengths still there with this sum, the larger part as large as can be."""
        left = self.left
        there = self.pairs.get(total, 0) & self.bits
        while there:
            b = there.bit_length() - 1
            if left[b] > 0 and left.get(total - b, 0) > (2 * b == total):
                return b, total - b
            there ^= 1 << b
        return None

    def _combination(self, gap: int, own: int) -> tuple[int, ...] | None:
        """Lengths of one, two or three pieces that fill the gap exactly beside one of `own` and are there, large pieces first."""
        left = self.left
        left[own] -= 1  # counts of 0 stay in the table while a combination is sought
        try:
            if left.get(gap, 0) > 0:
                return (gap,)
            if pair := self._pair(gap):
                return pair
            rest = self.bits & (1 << gap) - 1
            while rest:
                a = rest.bit_length() - 1
                rest ^= 1 << a
                if 3 * a < gap:  # the largest of three
                    return None
                if left[a] <= 0 or not self.pairs.get(gap - a, 0) & self.bits:
                    continue
                left[a] -= 1
                pair = self._pair(gap - a)
                left[a] += 1
                if pair:
                    return (a, *pair)
            return None
        finally:
            left[own] += 1

    def _index(self) -> dict[int, int]:
        """Sums of pairs of lengths: for each sum the larger parts, a bit a length."""
        own = self.bits
        mirrored = sum(1 << self.capacity - n for n in self.left)  # bit capacity - n for each length n
        sums = {s: own & (mirrored >> self.capacity - s) & -1 << (s + 1) // 2 for s in range(2, self.capacity)}
        return {s: parts for s, parts in sums.items() if parts}

    def _exact(self) -> None:
        self.pairs = self._index()
        for n in sorted(self.left, reverse=True):
            if n == self.capacity:
                self._take((n,))
            while self.left.get(n):
                parts = self._combination(self.capacity - n, n)
                if parts is None or not self._take((n, *parts)):
                    break

    def _best_fit(self) -> None:
        """What is left: largest first, each gap taking the largest piece that fits, pieces of one length many at a time."""
        while self.left:
            first = max(self.left)
            parts, gap = [first], self.capacity - first
            used = defaultdict(int, {first: 1})
            while gap:
                fits = [n for n, c in self.left.items() if n <= gap and c > used[n]]
                if not fits:
                    break
                n = max(fits)
                k = min(gap // n, self.left[n] - used[n])
                parts += [n] * k
                used[n] += k
                gap -= n * k
            self._take(tuple(parts))

    @property
    def sequences(self) -> int:
        return sum(c for _, c in self.patterns)

    def table(self) -> dict[int, np.ndarray]:
        """For each length its slots in rank order: (first rank, first sequence, slots a sequence, first offset)."""
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        base = 0
        for lengths, times in self.patterns:
            at = 0
            for n in dict.fromkeys(lengths):
                k = lengths.count(n)
                rows[n].append((rank[n], base, k, at))
                rank[n] += times * k
                at += n * k
            base += times
        return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row a piece.

    A null or empty text has the end id alone; without an end id it has no piece. Rows with one identifier, or with none, are
    documents of their own. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    salts = min(SALTS, 4 * partitions(spark))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "counts")
    # at most `capacity` rows whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = spark.sparkContext.broadcast(Plan(histogram, capacity).table())

    def place(batches):
        slots = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                n = int(length[part[0]])
                rows = slots[n]
                row = rows[np.searchsorted(rows[:, 0], rank[part], "right") - 1]
                inner = rank[part] - row[:, 0]
                sequence[part] = row[:, 1] + inner // row[:, 2]
                offset[part] = row[:, 3] + inner % row[:, 2] * n
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length, pa.int64()), batch.column("ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(within)).join(counts.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
