"""Exact duplicates by composable polynomial fingerprints.

Texts are equal when they are identical once all ASCII white space is deleted. A normalised text's UTF-8 bytes
b0, b1, ... have the fingerprint sum(b_i * x^i) mod p under two primes. A text is hashed in chunks that tasks
may take in any order: a chunk at byte o contributes x^o times its own hash, so fingerprints of chunks add up
after a shift by their offsets. Texts above one chunk are dealt out chunk by chunk; no task holds
more of one than a chunk. Rows with equal fingerprints and lengths are then compared with their group's first row chunk by
chunk, and only what compares equal is a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, hash_bits, settled, small_batches

#: Two primes below 2^38: a chunk of up to 2^17 bytes sums bytes times powers below 2^63 without a reduction.
PRIMES = (274877906899, 274877906857)
BASES = (131071 * 1021, 524287 * 509)
CHUNK = 1 << 15
#: So many copies at most are compared with one copy of their group's first row in one task.
PER_TASK = 64


def polynomial(data: bytes, base: int, prime: int, powers: np.ndarray) -> int:
    return int(np.frombuffer(data, dtype=np.uint8).astype(np.uint64) @ powers[: len(data)]) % prime


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    out, v = np.empty(n, dtype=np.uint64), 1
    for i in range(n):
        out[i] = v
        v = v * base % prime
    return out


def _hash_chunks(chunk: int, primes: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [power_table(b, p, chunk) for b, p in zip(BASES, primes)]
        for batch in batches:
            offsets, data = batch.column("offset").to_pylist(), batch.column("bytes")
            out: list[list[int]] = [[], []]
            for o, b in zip(offsets, data):
                b = b.as_py()
                for k in (0, 1):
                    out[k].append(pow(BASES[k], o, primes[k]) * polynomial(b, BASES[k], primes[k], tables[k]) % primes[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["row_id", "f0", "f1"]
            )

    return run


def _chunked(rows: DataFrame, chunk: int, *keep: str) -> DataFrame:
    """A row for each chunk of column ``norm``: its offset and bytes. An empty text has one empty chunk."""
    last = F.greatest(F.floor((F.octet_length("norm") - 1) / chunk), F.lit(0)).cast("int")
    return (
        rows.select(*keep, F.encode("norm", "UTF-8").alias("_b"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
        .select(*keep, (F.col("_i").cast("long") * chunk).alias("offset"), F.substring("_b", F.col("_i") * chunk + 1, F.lit(chunk)).alias("bytes"))
    )


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, n_points (of the original text), n_bytes, text_sha256 and the two fingerprints f0, f1 of each row.

    Texts up to one chunk are hashed where they are read. Longer ones are dealt out by chunk and their
    shifted hashes added up.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.translate(text, WHITE_SPACE, "").alias("norm"))
    facts = base.select(
        "doc_id",
        "norm",
        F.length("text").cast("long").alias("n_points"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
    )
    facts = facts.withColumn("row_id", F.struct("doc_id", "n_points", "n_bytes", "text_sha256"))
    hashed = "row_id struct<doc_id:bigint,n_points:bigint,n_bytes:bigint,text_sha256:string>, f0 bigint, f1 bigint"
    if chunk > 1 << 17 or max(primes) >= 1 << 38:
        raise ValueError("chunks over 2^17 bytes or primes over 2^38 overflow 64 bits")
    whole = _chunked(facts.filter(F.col("n_bytes") <= chunk), chunk, "row_id").mapInArrow(_hash_chunks(chunk, primes), hashed)
    # repeated long rows share a row_id; their chunks add up to a multiple, which n tells
    parts = _chunked(facts.filter(F.col("n_bytes") > chunk), chunk, "row_id").repartition("row_id", "offset")
    parts = parts.mapInArrow(_hash_chunks(chunk, primes), hashed).groupBy("row_id").agg(
        *[F.sum(F.col(f).cast("decimal(38,0)")).alias(f) for f in ("f0", "f1")], F.count("*").alias("n")
    )
    copies = (F.col("n") / F.ceil(F.col("row_id.n_bytes") / chunk)).cast("long")
    parts = parts.select(
        "row_id",
        *[(F.col(f) / copies % F.lit(p)).cast("long").alias(f) for f, p in zip(("f0", "f1"), primes)],
        F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy"),
    ).drop("_copy")
    return whole.unionByName(parts).select("row_id.*", "f0", "f1")


def _groups(prints: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """A row for each key and salt: first_id, the row that stays (best) and the number of rows of the whole key."""
    best = F.struct(F.col("n_points").alias("p"), (-F.col("doc_id")).alias("d"))
    salted = prints.groupBy(*keys, "salt").agg(F.max(best).alias("best"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    whole = salted.groupBy(*keys).agg(F.max("best").alias("best"), F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    return salted.select(*keys, "salt").join(whole, keys)


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text, then the smallest doc_id, stays. A null
    text is empty, and all empty texts are one group. Rows repeated with one doc_id are copies of each other and all
    carry kept if that doc_id stays (no column tells them apart); a null doc_id counts as larger than any other.
    An empty table gives no rows. Other columns are ignored.
    """
    prints = fingerprints(docs.select(F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id"), "text"), chunk, primes)
    prints = settled(prints)
    bits = hash_bits(prints.count())
    prints = prints.withColumn("salt", F.shiftright(F.xxhash64("doc_id"), 64 - bits))
    keys = ["f0", "f1", "n_bytes"]
    # chunkwise comparison of what shares a fingerprint
    alike = prints.join(_groups(prints, keys, bits).filter("n > 1").drop("best"), [*keys, "salt"])
    alike = alike.filter(F.col("n_bytes") > 0).select("doc_id", *keys, "text_sha256", "first_id", "n").distinct()
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), WHITE_SPACE, "").alias("norm"))
    texts = texts.join(alike, "doc_id").filter(F.sha2(F.encode("norm", "UTF-8"), 256) == F.col("text_sha256"))
    groups = F.ceil(F.col("n") / PER_TASK).cast("int")
    deal = F.pmod(F.xxhash64("doc_id"), groups).cast("int")
    firsts = F.when(F.col("doc_id") == F.col("first_id"), F.sequence(F.lit(0), groups - 1)).otherwise(F.array(deal))
    # a first row goes to every share of its group; a chunk's window holds the bytes of at most PER_TASK + 1 rows or so
    pieces = _chunked(texts.withColumn("share", F.explode(firsts)), chunk, "doc_id", *keys, "first_id", "share")
    beside = Window.partitionBy(*keys, "share", "offset").orderBy(F.col("doc_id") != F.col("first_id"))
    differ = (
        pieces.withColumn("first_bytes", F.first("bytes").over(beside))
        .filter((F.col("doc_id") != F.col("first_id")) & (F.col("bytes") != F.col("first_bytes")))
        .select("doc_id", *keys)
        .distinct()
        .withColumn("other", F.lit(True))
    )
    # texts that only share the fingerprint are told apart by their digest
    prints = prints.join(differ, ["doc_id", *keys], "left").withColumn("sub", F.when(F.col("other"), F.col("text_sha256")).otherwise(""))
    keys = [*keys, "sub"]
    out = prints.join(_groups(prints, keys, bits), [*keys, "salt"])
    keep = -F.col("best.d")
    null = lambda c: F.when(c != _NO_ID, c)
    return out.select(
        null(F.col("doc_id")).alias("doc_id"),
        null(keep).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id") == keep).alias("kept"),
        "text_sha256",
    )


#: Stands for a null doc_id.
_NO_ID = 2**63 - 1
