"""Token ids in shards with Elias-Fano document boundaries.

A shard holds the concatenated ids of a run of documents in doc_id order and the boundaries between them as an
Elias-Fano sequence: each boundary's low bits packed, its high part in unary in a bit vector. ``select`` over that
bit vector gives any document's offset; a sample of every 256th set bit's byte, as 32-bit numbers, bounds the scan.
A shard of n documents over u ids needs about n * (2 + log2(u / n)) bits for its boundaries.

Shards are rows of a Parquet table (one blob for each part of the format), so that Spark writes and commits them on any store
and a lost executor's shards are written again.

Format of a shard, numbers little-endian:
  ids        ids in 2 bytes each if all are below 65,536, else 4 (``width``)
  ef_low     boundaries' low ``ef_bits`` bits, packed from the lowest bit up
  ef_high    bit vector with bit (boundary >> ef_bits) + i set for boundary i, packed from the lowest bit up
  ef_select  byte position in ef_high that holds every 256th set bit, and the set bits before that byte: 2 x 4 bytes
  doc_ids    8 bytes a document, with a validity byte each in doc_known
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, shared_dir, small_batches, text_chunks, token_ids

SAMPLE = 256
#: Ids in a shard, at most, unless one document has more.
SHARD_IDS = 4_000_000

SHARD_SCHEMA = (
    "part int, seq int, n_docs bigint, n_ids bigint, width int, ids binary, ef_bits int, ef_low binary, ef_high binary, ef_select binary, "
    "doc_ids binary, doc_known binary"
)


class EliasFano:
    """A non-decreasing sequence of numbers; ``select(i)`` is its i-th."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.bits = n, bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4").reshape(-1, 2)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        at = ones[::SAMPLE] // 8
        before = np.searchsorted(ones, at * 8)
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high), np.stack([at, before], axis=1).astype("<u4").tobytes())

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, dtype=np.int64)
        a, b = first * self.bits, last * self.bits
        packed = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return packed.reshape(-1, self.bits).astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, by the sample before it and a scan of at most SAMPLE set bits."""
        at, before = (int(x) for x in self.samples[i // SAMPLE])
        while (c := int(self.high[at]).bit_count()) <= i - before:
            before += c
            at += 1
        ones = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))
        return (at * 8 + int(ones[i - before]) - i << self.bits) | int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        """All values: select over the whole bit vector at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (ones - np.arange(self.n) << self.bits) | self._lows(0, self.n)


def _shard(part: int, seq: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    ef = EliasFano.encode(ends)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    row = {
        "part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": len(flat), "width": width, "ids": flat.astype(f"<u{width}").tobytes(),
        "ef_bits": ef.bits, "ef_low": ef.low.tobytes(), "ef_high": ef.high.tobytes(), "ef_select": ef.samples.tobytes(),
        "doc_ids": np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), "doc_known": bytes(x is not None for x in doc_ids),
    }
    types = {"part": pa.int32(), "seq": pa.int32(), "width": pa.int32(), "ef_bits": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in row.items()], list(row))


def _write(path: str, white_space: bool, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, seq, end = token_ids(path, white_space), TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list = []
        ids: list[bytes] = []
        n = 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch, "text"):
                for i, own in enumerate(tokens.batch(texts), first):
                    if ids and n + len(own) // 4 + 1 > most:
                        yield _shard(part, seq, doc_ids, ids)
                        doc_ids, ids, n, seq = [], [], 0, seq + 1
                    doc_ids.append(keys[i])
                    ids.append(own + end)
                    n += len(own) // 4 + 1
        if ids:
            yield _shard(part, seq, doc_ids, ids)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, white_space: bool = True, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the shards to ``path`` in ascending doc_id order.

    Rows are dealt out by ranges of doc_id and sorted within them; null doc_ids come first, rows of one doc_id in
    order of their texts. A null text is empty and has only its end id. An empty table gives no shards. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(_write(tokenizer, white_space, end_id, shard_ids), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in batch.to_pylist():
            ends = EliasFano(s["n_docs"] + 1, s["ef_bits"], s["ef_low"], s["ef_high"], s["ef_select"]).all()
            doc_ids, ids, w = np.frombuffer(s["doc_ids"], dtype="<i8"), s["ids"], s["width"]
            # one document's ids at a time are widened to 4 bytes
            crc = [zlib.crc32(np.frombuffer(ids, dtype=f"<u{w}", count=b - a, offset=a * w).astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            known = np.frombuffer(s["doc_known"], dtype=np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s["part"]] * len(crc), pa.int32()), pa.array([s["seq"]] * len(crc), pa.int32()), pa.array(doc_ids, mask=~known),
                    pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64()),
                ],
                ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the shards."""
    small_batches(shards.sparkSession)
    sizes = shards.select("part", "seq", "n_ids")
    bases = running(sizes, [], F.col("part"), [F.col("seq")], F.col("n_ids"), "base").drop("n_ids")
    docs = shards.mapInArrow(_decode, "part int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    # the shards' blobs stay where they are read; only numbers are joined
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer: str, white_space: bool = True, end_id: int = 2, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` (by default a new one in the shared folder) and read the documents back from them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, white_space, end_id, shard_ids)
    return read_shards(spark.read.schema(SHARD_SCHEMA).parquet(path))
