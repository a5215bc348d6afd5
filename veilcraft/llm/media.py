"""Media columns over content-addressed payloads in tar shards.

A text's bytes, padded with zeros to a positive multiple of 64, are stored without loss as a grey image of 64 eight-bit
samples a line (PNG). Images are members of tar shards, named by the SHA-256 of their bytes, and each task writes a
content once. Rows carry digest, shard, offset and length. Metadata columns are filled from the image header alone, read as a
byte range; only features read whole members.

Shards are written to the folder that all executors share, under a name for every attempt of a task; rows of
an attempt that failed are never used, and neither are its shards.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hash_bits, settled, shared_dir, small_batches

WIDTH = 64
#: Bytes of a shard after which the next one is begun.
SHARD_BYTES = 64 << 20
#: Signature, header chunk and the chunk with the number of bytes before padding.
HEADER_BYTES = 8 + 25 + 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"

REFERENCES = "doc_id bigint, digest binary, shard string, offset bigint, length int"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(data: bytes) -> bytes:
    """A grey PNG of the padded bytes; the private chunk ``tLen`` has their number before padding."""
    payload = padded(data)
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"tLen", struct.pack(">Q", len(data))) + _part(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _part(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bytes before padding, from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"tLen":
        raise ValueError("not a payload image")
    return (*struct.unpack(">II", head[16:24]), struct.unpack(">Q", head[41:49])[0])


def decode_image(image: bytes) -> bytes:
    """The padded payload."""
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy in bits, the share of zeros, and an 8-bin histogram in thousandths."""
    n = len(payload)
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    share = counts / n
    mean = float(share @ np.arange(256))
    deviation = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // n
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};zeros={share[0]:.4f};bins={','.join(map(str, bins.tolist()))}"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _files(folder)
        store.create_dir(root, recursive=True)
        attempt, count = TaskContext.get().taskAttemptId(), 0
        stored: dict[bytes, tuple] = {}  # of the open shard: digest -> reference
        shard = sink = None
        size = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    image = encode_image((text.as_py() or "").encode("utf-8", "surrogatepass"))
                    digest = hashlib.sha256(image).digest()
                    if digest not in stored:
                        if sink is not None and size >= most:
                            sink.write(bytes(1024))
                            sink.close()
                            sink, stored = None, {}
                        if sink is None:
                            shard, size, count = f"{attempt}-{count}.tar", 0, count + 1
                            sink = store.open_output_stream(f"{root}/{shard}")
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(image)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        sink.write(head + image + bytes(-len(image) % 512))
                        stored[digest] = (digest, shard, size + len(head), len(image))
                        size += len(head) + len(image) + -len(image) % 512
                    rows.append((doc_id, *stored[digest]))
                types = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int32())
                # rows leave before their shard is closed, but nobody reads it before the whole table is settled
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "digest", "shard", "offset", "length"])
            if sink is not None:
                sink.write(bytes(1024))
        finally:
            if sink is not None:
                sink.close()

    return run


def write_payloads(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every whole text of ``docs`` (doc_id, text; null is empty) and return its reference:
    doc_id, digest, shard, offset, length. Tasks don't exchange texts: each stores a content once in a shard.
    """
    small_batches(docs.sparkSession)
    return settled(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_write(folder, shard_bytes), REFERENCES))


def _headers(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), name, file = _files(folder), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist()):
                if shard != name:
                    name, file = shard, store.open_input_file(f"{root}/{shard}")
                width, height, n = image_header(file.read_at(HEADER_BYTES, offset))
                rows.append((n, width * height))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*rows))], [*batch.schema.names, "n_bytes", "payload_bytes"])

    return run


def header_columns(contents: DataFrame, folder: str) -> DataFrame:
    """n_bytes and payload_bytes for each row, from ranges of HEADER_BYTES bytes of the shards."""
    schema = StructType(list(contents.schema.fields)).add("n_bytes", "long").add("payload_bytes", "long")
    return contents.mapInArrow(_headers(folder), schema)


def _features(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), name, file = _files(folder), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                if shard != name:
                    name, file = shard, store.open_input_file(f"{root}/{shard}")
                image = file.read_at(length, offset)
                if hashlib.sha256(image).digest() != digest:
                    raise ValueError(f"the bytes at {offset} of {shard} are not those stored there")
                payload = decode_image(image)
                rows.append((hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), features(payload)))
            types = (pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                [*batch.schema.names, "payload_sha256", "tail_crc32", "feature"],
            )

    return run


def feature_columns(contents: DataFrame, folder: str) -> DataFrame:
    """payload_sha256, tail_crc32 and feature for each row, from whole members, whose bytes must have the row's digest."""
    schema = StructType(list(contents.schema.fields)).add("payload_sha256", "binary").add("tail_crc32", "long").add("feature", "string")
    return contents.mapInArrow(_features(folder), schema)


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the texts of ``docs`` and return, for each row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and its reference (shard, offset, length), all read back from the shards.

    Each content is read at one place of those that hold it, and equal texts get equal values. A null or empty
    text is 64 zero bytes. Repeated rows and null doc_ids give rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    references = write_payloads(docs, folder, shard_bytes)
    salted = references.withColumn("salt", F.shiftright(F.xxhash64("doc_id"), 64 - hash_bits(references.count())))
    place = F.struct("shard", "offset", "length")
    shares = salted.groupBy("digest", "salt").agg(F.min(place).alias("place"))
    contents = shares.groupBy("digest").agg(F.min("place").alias("place")).select("digest", "place.*")
    # members of a shard are read together and in order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = contents.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    small_batches(spark)
    contents = feature_columns(header_columns(contents, folder), folder)
    named = shares.select("digest", "salt").join(contents, "digest")
    digest = lambda c: F.lower(F.hex(c))
    return salted.select("doc_id", "digest", "salt").join(named, ["digest", "salt"]).select(
        "doc_id", "n_bytes", "payload_bytes", digest("payload_sha256").alias("payload_sha256"), "tail_crc32", F.col("length").cast("long").alias("media_bytes"),
        digest("digest").alias("media_sha256"), "feature", "shard", "offset", "length",
    )
