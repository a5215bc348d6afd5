"""Importance resampling towards a target distribution over hashed words and word pairs.

Identical texts are collapsed first by grouping the full text, which is counted before it is shuffled, so a text that a third
of all rows share moves once for each task. Features of a text are found and kept once, in numpy; bucket counts take
them times the text's multiplicity. Weights come from a table of one gain for each bucket, are joined back
to the rows by the text's digest, and only then get the noise of each row. Ranks are running sums over ranges of scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, running, settled, small_batches

BUCKETS, PERCENT, WORDS, SEED = 10_000, 25, 20, 7
#: Words of more bytes are hashed each by itself.
LONG_WORD = 64
#: Bytes of texts that are looked at together; longer texts are cut between words.
BLOCK = 4_000_000

_FULL = np.uint32(0xFFFFFFFF)


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case of A-Z for each byte, whether it belongs to a word, and the steps of CRC-32."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return lower, word, step


_LOWER, _WORD, _STEP = _byte_tables()


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 states after the words of ``data`` at ``starts``, each from its own state (inverted, as the algorithm keeps it)."""
    out = states.copy()
    by_size = np.argsort(-np.minimum(sizes, LONG_WORD + 1).astype(np.int8), kind="stable")
    n_long = int((sizes > LONG_WORD).sum())
    for i in by_size[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(states[i] ^ _FULL)) ^ 0xFFFFFFFF
    active = by_size[n_long:]
    at, crc = starts[active], states[active]
    reach = np.searchsorted(-sizes[active], -np.arange(1, LONG_WORD + 2), side="right")  # words of more than j bytes
    for j, k in enumerate(reach.tolist()):
        if not k:
            break
        crc[:k] = _STEP[(crc[:k] ^ data[at[:k] + j]) & 255] ^ (crc[:k] >> np.uint32(8))
    out[active] = crc
    return out


def _buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of the texts in ``data`` (lower-cased bytes), text by text, and words of each text."""
    mask = np.zeros(len(data) + 2, dtype=bool)
    mask[1:-1] = _WORD[data]
    first, last = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] |= mask[1:-1][inner]
    last[inner - 1] |= mask[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    words = np.diff(np.searchsorted(starts, offsets))
    single = _crc(data, starts, sizes, np.full(len(starts), _FULL, dtype=np.uint32))
    spaced = _STEP[(single ^ np.uint32(32)) & 255] ^ (single >> np.uint32(8))
    both = np.zeros((len(starts), 2), dtype=np.uint32)
    both[:, 0] = single ^ _FULL
    both[1:, 1] = _crc(data, starts[1:], sizes[1:], spaced[:-1]) ^ _FULL
    keep = np.ones(both.shape, dtype=bool)
    begins = (np.cumsum(words) - words)[words > 0]
    keep[begins, 1] = False  # a text's first word ends no pair
    return (both[keep] % np.uint32(buckets)).astype("<u4"), words


def text_buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of one text's features; the text is cut after separators, and each part begins with the last word before it."""
    parts, at, word = [], 0, None
    while True:
        end = at
        gaps = np.zeros(0, dtype=np.int64)
        while end < len(data) and not len(gaps):  # more than once where a word is longer than a block
            end = min(end + BLOCK, len(data))
            gaps = np.flatnonzero(~_WORD[data[at:end]])
        cut = end if end == len(data) else at + int(gaps[-1]) + 1
        part = data[at:cut] if word is None else np.concatenate([word, [np.uint8(32)], data[at:cut]])
        found, _ = _buckets(part, np.array([0, len(part)]), buckets)
        parts.append(found if word is None else found[1:])
        inside = np.flatnonzero(_WORD[part])
        if len(inside):
            before = np.flatnonzero(~_WORD[part[: inside[-1]]])
            word = part[(int(before[-1]) + 1 if len(before) else 0) : int(inside[-1]) + 1]
        at = cut
        if at >= len(data):
            return np.concatenate(parts)


def feature_buckets(texts: list[str], buckets: int = BUCKETS) -> list[np.ndarray]:
    """The bucket of every run of one or two words of each text, repeats included."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            offsets = np.zeros(len(held) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in held], out=offsets[1:])
            found, words = _buckets(_LOWER[np.frombuffer(b"".join(held), dtype=np.uint8)], offsets, buckets)
            out.extend(np.split(found, np.cumsum(np.maximum(2 * words - 1, 0))[:-1]))
            held.clear()

    size = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if size + len(raw) > BLOCK:
            flush()
            size = 0
        if len(raw) > BLOCK:
            out.append(text_buckets(_LOWER[np.frombuffer(raw, dtype=np.uint8)], buckets))
        else:
            held.append(raw)
            size += len(raw)
    flush()
    return out


def _features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = "<u2" if buckets <= 65_536 else "<u4"
        for batch in batches:
            found = feature_buckets(batch.column("text").to_pylist(), buckets)
            blobs = pa.array([x.astype(narrow).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), blobs], ["key", "copies", "features"])

    return run


def _flat(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows one after the other, and how many each row has."""
    width = 2 if buckets <= 65_536 else 4
    blobs = [x.as_buffer() for x in batch.column("features")]
    sizes = np.array([x.size // width for x in blobs], dtype=np.int64)
    return np.concatenate([np.frombuffer(x, dtype=f"<u{width}") for x in blobs] or [np.zeros(0, dtype=np.int64)]), sizes


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            flat, sizes = _flat(batch, buckets)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            total += np.rint(np.bincount(flat, weights=np.repeat(copies, sizes), minlength=buckets)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _flat(batch, len(gains))
            sums = np.zeros(len(flat) + 1, dtype=np.int64)
            np.cumsum(gains[flat], out=sums[1:])
            ends = np.cumsum(sizes)
            weights = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes), pa.array(weights)], ["key", "n_features", "weight"])

    return run


def collapsed_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """key (SHA-256), copies and features of each distinct text of ``docs`` (text); null counts as empty."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return settled(keyed.mapInArrow(_features(buckets), "key binary, copies bigint, features binary"))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket holds, copies counted."""
    counts = features.mapInArrow(_counted(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies for each bucket, floored."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    ``percent`` of the rows with at least ``words`` words are drawn, by score, then doc_id (null last), then features and weight;
    rows that are alike in all of these share out ranks among them. Rows that aren't drawn have a null rank. A null or empty text has no
    features and weight 0; a null doc_id draws its noise as an empty one. Repeated rows are each drawn for
    themselves, with the same noise. An empty table gives no rows; an empty target has no features. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("key"))
    features = collapsed_features(docs, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(collapsed_features(target, buckets), buckets))
    weights = features.mapInArrow(_weighed(gain), "key binary, n_features bigint, weight bigint")
    # a text that very many rows share is looked up in shares
    rows = settled(rows.withColumn("salt", F.xxhash64("doc_id", F.lit("share"))))
    rows = rows.withColumn("salt", F.shiftright("salt", 64 - hash_bits(rows.count())))
    shares = rows.select("key", "salt").distinct().join(weights, "key")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = settled(rows.join(shares, ["key", "salt"]).select("doc_id", "n_features", "weight", score.alias("score")))
    able = F.col("n_features") >= 2 * words - 1
    drawn = percent * scored.filter(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = running(scored.filter(able), [], -F.floor(F.col("score") / 8), order, F.lit(1), "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
