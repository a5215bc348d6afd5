"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Only the histogram of piece lengths (as many numbers as a sequence has tokens, whatever the corpus) is planned on
the driver. Longest lengths first, the gap that a piece leaves is looked up in an index of the sums of one, two and three lengths that are
still available; a combination that fills it exactly is taken as often as its counts allow. What has no exact complement is packed best-fit. The plan is a list of patterns with counts; a piece finds its sequence by
its rank among the pieces of its length, which is counted in a distributed way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, running, settled, small_batches, text_chunks, token_ids

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, tie bigint"


def _pieces(path: str, white_space: bool, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = token_ids(path, white_space), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for first, texts in text_chunks(batch, "text"):
                rows = []
                for i, own in enumerate(tokens.batch(texts), first):
                    own += end
                    for k, at in enumerate(range(0, len(own), 4 * most)):
                        part = own[at : at + 4 * most]
                        rows.append((keys[i], k, at // 4, len(part) // 4, zlib.crc32(part), ties[i]))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return run


class Complements:
    """Index of the sums of one, two and three available lengths.

    For each sum it holds the largest member of a pair, or of a triple, that has it. Counts only fall, so an entry stays right until one of its members is
    used up; then the next one is looked for, and a sum that has none left never has one again.
    """

    def __init__(self, free: np.ndarray):
        self.free = free
        self.pairs, self.triples = np.zeros((2, len(free)), dtype=np.int64)
        own = np.flatnonzero(free > 0)
        for a in own.tolist():
            b = own[(own < a) | (own == a) & (free[a] > 1)]
            self.pairs[(a + b)[a + b < len(free)]] = a
        two = np.flatnonzero(self.pairs)
        for a in own.tolist():
            self.triples[(a + two)[a + two < len(free)]] = a

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.free[gap] > 0 else None

    def pair(self, gap: int, beside: int = 0) -> tuple[int, ...] | None:
        """A pair with the sum ``gap`` that leaves one piece of the length ``beside`` over."""
        a, free = int(self.pairs[gap]), self.free
        if not a:
            return None
        fits = lambda x: (free[x] > (x == beside)) & (free[gap - x] > 1 * (2 * x == gap) + (gap - x == beside))
        if not fits(a):
            larger = np.arange(gap - 1, (gap - 1) // 2, -1)
            hit = larger[fits(larger)]
            a = int(hit[0]) if len(hit) else 0
            if not beside:
                self.pairs[gap] = a
        return (a, gap - a) if a else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        a = int(self.triples[gap])
        while a:
            if self.free[a] > 0 and (rest := self.pair(gap - a, beside=a)):
                self.triples[gap] = a
                return (a, *rest)
            smaller = np.flatnonzero(self.free[:a] > 0)
            a = int(smaller[-1]) if len(smaller) else 0
        self.triples[gap] = 0
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; together they use every piece in ``counts`` once."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    index = Complements(free)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((free[lengths] // need).min())
        free[lengths] -= need * times
        out.append((tuple(sorted(pattern, reverse=True)), times))

    for length in range(capacity, 0, -1):
        gap = capacity - length
        while free[length]:
            if not gap:
                take((length,))
                continue
            free[length] -= 1  # one is placed; its complement comes from the others
            rest = index.single(gap) or index.pair(gap) or index.triple(gap)
            free[length] += 1
            if rest is None:
                break
            take((length, *rest))
        while free[length]:
            # best fit: the largest available lengths into the gap, one after another
            pattern, left = [length], gap
            free[length] -= 1
            while left and len(fits := np.flatnonzero(free[1 : left + 1] > 0)):
                exact = index.pair(left) if len(pattern) > 1 else None
                for b in exact or (int(fits[-1]) + 1,):
                    free[b] -= 1
                    pattern.append(b)
                    left -= b
            for b in pattern:
                free[b] += 1
            take(tuple(pattern))
    return out


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """For each pattern and length in it: the ranks it takes of that length, and the places of that length in it."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        at: dict[int, list[int]] = {}
        offset = 0
        for length in pattern:
            at.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in at.items():
            first = taken.get(length, 0)
            taken[length] = first + times * len(offsets)
            rows.append((length, first, taken[length], len(offsets), offsets[0], base))
        base += times
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, white_space: bool = False, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; only one longer than ``capacity`` is cut, into full pieces and a rest. A null
    text is empty and packs as its end id alone. Repeated rows and null doc_ids are documents of their own. Ties between pieces
    of one length are ordered by a hash of the row, so reruns agree. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "text"))
    pieces = settled(rows.mapInArrow(_pieces(tokenizer, white_space, end_id, capacity), PIECES))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bits = hash_bits(sum(counts.values()))
    order = [F.col("tie"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = running(pieces, ["length"], F.shiftright("tie", 64 - bits), order, F.lit(1), "rank")
    table = spark.createDataFrame(
        _intervals(plan(counts, capacity)), "length bigint, first bigint, last bigint, per bigint, place bigint, base bigint"
    )
    # a few rows for each length: its size depends on the capacity alone
    found = ranked.join(F.broadcast(table), "length").filter("rank >= first and rank < last")
    k = F.col("rank") - F.col("first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.floor(k / F.col("per"))).alias("sequence_id"),
        # equal lengths lie side by side in a pattern
        (F.col("place") + F.pmod(k, F.col("per")) * F.col("length")).alias("offset"),
    )
