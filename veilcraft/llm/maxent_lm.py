"""Hashed maximum-entropy language model with a class-factored softmax.

A token is predicted from hashed features of the words before it: the last one, the one before that (a skip) and
both together. Frequent words (the head) have classes of ``SLOTS`` words by rank; all others fall into tail classes by
the hash of their last two bytes. p(word) = p(class | features) * p(word | class, features) in the head; in a tail
class p(word) = (c + 1) / (N + V + 1) with the word's count and the class's tokens and distinct words in training.

All training tokens are counted, by Spark, into tables of (features, outcome). The numbers of hash values, of frequent words and of
classes grow with the number of training tokens (``sizes_for``), and so does what is counted and learnt. Training repeats preconditioned gradient steps (observed less expected counts): each step spreads the current weights,
partitions of the table return their expected counts, and the driver updates the model. Scoring
gathers single weights for batches of tokens in numpy. Counts of words outside the broadcast head of the vocabulary
come by a join on the word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, small_batches

#: Words in a class of frequent words.
SLOTS = 32
#: So many of the most frequent words are broadcast with their counts.
FREQUENT = 65_536
STEPS, PRIOR = 8, 4.0
#: The end of a document; no word holds a space.
END = b" "


class Sizes(NamedTuple):
    """Numbers of hash values of features, of frequent words that are predicted one by one (the head), and of classes of all others."""

    last: int
    skip: int
    skip_word: int
    both: int
    head: int
    tail_classes: int

    @property
    def head_classes(self) -> int:
        return self.head // SLOTS

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes

    @property
    def keys(self) -> int:
        """Outcomes that are counted under one hash of the last word."""
        return self.skip * self.classes + self.skip_word * self.head

    def bits(self) -> tuple[int, int, int]:
        """Bits of a packed word: outcome (head word, or head + tail class), and hashes as last and as skip word."""
        return (self.head + self.tail_classes - 1).bit_length(), (self.last - 1).bit_length(), (self.skip - 1).bit_length()

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {
            "class_bias": (self.classes,), "class_last": (self.last, self.classes), "class_skip": (self.skip, self.classes), "class_both": (self.both, self.classes),
            "word_bias": (self.head,), "word_last": (self.last, self.head), "word_skip": (self.skip_word, self.head),
        }


def sizes_for(train_tokens: int) -> Sizes:
    """Sizes that grow with the corpus: powers of two by roots of its tokens, so the model of a corpus a million times as large has some thirty
    times the weights."""
    octaves = max(train_tokens, 2).bit_length()
    two = lambda x: 1 << max(0, round(x))
    return Sizes(two(octaves / 6 + 5), two(octaves / 8 + 3), 8, two(octaves / 4 + 7), two(octaves / 6 + 6), two(octaves / 12 + 2))


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


class Lexicon(dict):
    """Packed numbers of words; words outside the frequent ones are added as they come, up to a bound."""

    def __init__(self, frequent: list[bytes], sizes: Sizes, most: int = 400_000):
        self.frequent, self.most, self.sizes = frequent, most, sizes
        self.outcome_bits, self.last_bits, self.skip_bits = sizes.bits()
        self._fill()

    def _fill(self) -> None:
        self.clear()
        for i, w in enumerate(self.frequent):
            self[w] = self._pack(w, i if i < self.sizes.head else self._tail(w), i + 1)

    def _tail(self, w: bytes) -> int:
        return self.sizes.head + zlib.crc32(w[-2:]) % self.sizes.tail_classes

    def _pack(self, w: bytes, outcome: int, place: int) -> int:
        last, skip = zlib.crc32(w + b"\n") % self.sizes.last, zlib.crc32(w + b"\n!") % self.sizes.skip
        return outcome | (last | (skip | place << self.skip_bits) << self.last_bits) << self.outcome_bits

    def __missing__(self, w: bytes) -> int:
        v = self[w] = self._pack(w, self._tail(w), 0)
        return v

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self._fill()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Of each word among the frequent ones, from one on; zero for others."""
        return codes >> (self.outcome_bits + self.last_bits + self.skip_bits)

    def features(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """outcome, last and skip of each token; ``starts`` are the places of documents' first tokens."""
        z = self.sizes
        first = zlib.crc32(b"\n") % z.last, zlib.crc32(b"\n!") % z.skip
        outcome = codes & (1 << self.outcome_bits) - 1
        own_last = codes >> self.outcome_bits & (1 << self.last_bits) - 1
        own_skip = codes >> (self.outcome_bits + self.last_bits) & (1 << self.skip_bits) - 1
        last, skip = np.empty_like(own_last), np.empty_like(own_skip)
        last[1:], skip[2:] = own_last[:-1], own_skip[:-2]
        last[starts] = first[0]
        skip[starts] = first[1]
        skip[starts[starts + 1 < len(codes)] + 1] = first[1]
        return outcome, last, skip


def class_of(outcome: np.ndarray, z: Sizes) -> np.ndarray:
    return np.where(outcome < z.head, outcome // SLOTS, outcome - z.head + z.head_classes)


def both(last, skip, z: Sizes):
    """Hash of the last two words together."""
    return ((last * z.skip + skip) * 40503 >> 3) % z.both


# --- counts --------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.update(tokens(text.as_py()))
            if len(seen) > 500_000:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts, the end of each document among them."""
    return docs.select("text").mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _count_features(shared, z: Sizes):
    """Rows of (key, n): key holds last, and skip and class, or beyond those a coarser skip and head word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value, z)
        words: list[bytes] = []
        starts: list[int] = []

        def out() -> pa.RecordBatch:
            outcome, last, skip = lexicon.features(lexicon.codes(words), np.array(starts))
            by_class = last * z.keys + skip * z.classes + class_of(outcome, z)
            head = outcome < z.head
            by_word = last[head] * z.keys + z.skip * z.classes + skip[head] % z.skip_word * z.head + outcome[head]
            keys, n = np.unique(np.concatenate([by_class, by_word]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for text in batch.column("text"):
                starts.append(len(words))
                words += tokens(text.as_py())
                if len(words) > 1_500_000:
                    yield out()
                    words, starts = [], []
        if words:
            yield out()

    return run


def _rows_of_last(keys: int):
    """All counts under one hash of the last word as one array: at most ``keys`` of them."""

    def run(rows):
        import pandas as pd

        out = np.zeros(keys, dtype=np.float32)
        out[rows["key"].to_numpy() % keys] = rows["n"].to_numpy()
        return pd.DataFrame({"last": [int(rows["key"].iloc[0]) // keys], "counts": [out.tobytes()]})

    return run


def feature_counts(docs: DataFrame, shared, z: Sizes) -> DataFrame:
    rows = docs.select("text").mapInArrow(_count_features(shared, z), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return rows.groupBy(F.floor(F.col("key") / z.keys)).applyInPandas(_rows_of_last(z.keys), "last int, counts binary")


# --- the model -----------------------------------------------------------------------------------


def softmax_log(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def class_scores(w: dict, last: int, z: Sizes) -> np.ndarray:
    """Logarithms of class probabilities after ``last`` for every skip."""
    skip = np.arange(z.skip)
    return softmax_log(w["class_bias"] + w["class_last"][last] + w["class_skip"] + w["class_both"][both(last, skip, z)])


def word_scores(w: dict, last: int, z: Sizes) -> np.ndarray:
    """Logarithms of head words' probabilities within their classes after ``last`` for every skip."""
    x = w["word_bias"] + w["word_last"][last] + w["word_skip"]
    return softmax_log(x.reshape(z.skip_word, z.head_classes, SLOTS)).reshape(z.skip_word, z.head)


def _gathered(z: Sizes, shared=None):
    """Counts of each feature and outcome over a partition, as one row for each array: observed ones, or those that the weights ``shared`` expect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value if shared else None
        sums = {k: np.zeros(v, dtype=np.float64) for k, v in z.shapes().items() if "bias" not in k}
        skip = np.arange(z.skip)
        for batch in batches:
            for last, counts in zip(batch.column("last").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(counts.as_py(), dtype=np.float32).astype(np.float64)
                x = counts[: z.skip * z.classes].reshape(z.skip, z.classes)
                if w:
                    x = np.exp(class_scores(w, last, z)) * x.sum(axis=1, keepdims=True)
                sums["class_last"][last] += x.sum(axis=0)
                sums["class_skip"] += x
                np.add.at(sums["class_both"], both(last, skip, z), x)
                x = counts[z.skip * z.classes :].reshape(z.skip_word, z.head)
                if w:
                    of_class = x.reshape(z.skip_word, z.head_classes, SLOTS).sum(axis=2)
                    x = np.exp(word_scores(w, last, z)) * np.repeat(of_class, SLOTS, axis=1)
                sums["word_last"][last] += x.sum(axis=0)
                sums["word_skip"] += x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([zlib.compress(x.astype(np.float32).tobytes(), 1) for x in sums.values()], pa.binary())], ["name", "sums"]
        )

    return run


def _summed(table: DataFrame, z: Sizes, shared=None) -> dict[str, np.ndarray]:
    """Sums of ``_gathered`` over all partitions: one row for each of them and each of five arrays reaches the driver, little but zeros for
    other partitions' last words."""
    got = {k: np.zeros(v, dtype=np.float32) for k, v in z.shapes().items() if "bias" not in k}
    for r in table.mapInArrow(_gathered(z, shared), "name string, sums binary").collect():
        got[r["name"]] += np.frombuffer(zlib.decompress(r["sums"]), dtype=np.float32).reshape(got[r["name"]].shape)
    return got


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of (word, n), the most frequent first.

    Words are counted by bands of their frequency, of which there are a few hundred. Bands are fetched from the most frequent on; of the one that
    would be too many, the words with the smallest hashes come. So no task sends more than its part of them.
    """
    band = F.floor(F.log2("n") * 16)
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()
    least, room, edge = 10**6, most, None
    for r in sorted(bands, key=lambda r: -r["band"]):
        if r["words"] > room:
            edge = r
            break
        least, room = r["band"], room - r["words"]
    banded = counts.withColumn("band", band)
    wanted = F.col("band") >= least
    if edge is not None:
        # a part of all hashes that holds about as many words as there is room for
        part = F.shiftrightunsigned(F.xxhash64("word"), 1) / float(2**63)
        wanted = wanted | ((F.col("band") == edge["band"]) & (part < 0.98 * room / edge["words"]))
    found = banded.filter(wanted).select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda r: (-r[1], r[0]))[:most]


def train(docs: DataFrame, steps: int = STEPS, prior: float = PRIOR, sizes: Sizes | None = None, frequent_words: int = FREQUENT):
    """(model as broadcast arrays, counts table) from all texts of ``docs``; ``sizes`` are by default those for its number of tokens."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    counts = settled(word_counts(docs))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    z = sizes or sizes_for(whole["n"] or 0)
    totals = counts.filter(F.col("word") != END).groupBy((F.crc32(F.substring("word", -2, 2)) % z.tail_classes).cast("int").alias("k"))
    totals = {r["k"]: (r["n"], r["v"]) for r in totals.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    first = _most_frequent(counts.filter(F.col("word") != END), frequent_words - 1)
    ends = counts.filter(F.col("word") == END).first()
    frequent = [END, *(w for w, _ in first)]
    n = np.array([ends["n"] if ends else 0, *(c for _, c in first)], dtype=np.int64)
    tail = np.zeros((z.tail_classes, 2))
    for k, v in totals.items():
        tail[k] = v
    for w, c in zip(frequent[1 : z.head], n[1 : z.head].tolist()):
        tail[zlib.crc32(w[-2:]) % z.tail_classes] -= (c, 1)
    facts = {"frequent": frequent, "counts": n, "train_tokens": int(whole["n"] or 0), "vocabulary": int(whole["v"]), "tail": tail.sum(axis=1) + 1, "sizes": z}
    words = sc.broadcast(frequent)
    # as many parts as cores, but each with some rows
    parts = max(1, min(sc.defaultParallelism, z.last // 16))
    table = settled(feature_counts(docs, words, z).repartition(parts, "last"))
    shapes = z.shapes()
    w = {k: np.zeros(v) for k, v in shapes.items()}
    head = np.full(z.head, -np.inf)
    head[: len(frequent[: z.head])] = np.log(n[: z.head] + 0.5)
    of_class = np.append(np.array([n[i : i + SLOTS].sum() for i in range(0, z.head, SLOTS)]), tail[:, 0])
    w["class_bias"], w["word_bias"] = np.log(of_class + 0.5), np.where(np.isfinite(head), head, -60.0)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    active = {"class": 3, "word": 2}
    # observed counts are the same at every step
    seen = _summed(table, z)
    for _ in range(steps):
        current = sc.broadcast(w)
        made = _summed(table, z, current)
        for k in made:
            w[k] += (seen[k] - made[k]) / (np.maximum(seen[k], made[k]) + prior) / active[k.split("_")[0]]
        # the driver would keep the weights of every step
        current.destroy()
    return sc.broadcast(facts | {"weights": w}), counts


def _score(shared):
    """A row for each document with what its frequent words give, and one for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shared.value
        w, z = m["weights"], m["sizes"]
        lexicon = Lexicon(m["frequent"], z)
        logs = np.log10(np.append(0, m["counts"]) + 1.0)
        known = np.append(0, m["counts"]) > 0
        tail = np.log10(m["tail"])
        by_class = np.stack([class_scores(w, a, z) for a in range(z.last)]).astype(np.float32)
        by_word = np.stack([word_scores(w, a, z) for a in range(z.last)]).astype(np.float32)
        row = TaskContext.get().partitionId() << 36

        def out(words: list[bytes], starts: list[int], ids: list, row: int) -> pa.RecordBatch:
            codes, at = lexicon.codes(words), np.array(starts)
            outcome, last, skip = lexicon.features(codes, at)
            place = lexicon.places(codes)
            k = class_of(outcome, z)
            score = by_class[last, skip, k].astype(np.float64)
            head = outcome < z.head
            score[head] += by_word[last[head], skip[head] % z.skip_word, outcome[head]]
            score /= np.log(10)
            score[~head] += logs[place[~head]] - tail[k[~head] - z.head_classes]
            rare = np.flatnonzero(place == 0)
            doc = np.searchsorted(at, rare, side="right") - 1
            others = Counter(zip(doc.tolist(), [words[i] for i in rare.tolist()]))
            n, more = len(ids), len(others)
            lengths = np.diff(np.append(at, len(words)))
            of = [row + i for i in range(n)]
            pad = lambda x, kind: pa.array([*x, *[None] * more], kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(of + [row + d for d, _ in others], pa.int64()),
                    pa.array([b" %d" % r for r in of] + [x for _, x in others], pa.binary()),
                    pa.array([0] * n + list(others.values()), pa.int64()),
                    pad(ids, pa.int64()),
                    pad(lengths.tolist(), pa.int64()),
                    pad(np.add.reduceat(known[place], at, dtype=np.int64).tolist(), pa.int64()),
                    pad(np.add.reduceat(logs[place], at).tolist(), pa.float64()),
                    pad(np.add.reduceat(score, at).tolist(), pa.float64()),
                ],
                ["row", "word", "times", "doc_id", "n_tokens", "n_known", "logs", "score"],
            )

        for batch in batches:
            words: list[bytes] = []
            starts: list[int] = []
            ids: list = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                starts.append(len(words))
                ids.append(doc_id)
                words += tokens(text.as_py())
                if len(words) > 500_000:
                    yield out(words, starts, ids, row)
                    row += len(ids)
                    words, starts, ids = [], [], []
            if ids:
                yield out(words, starts, ids, row)
                row += len(ids)

    return run


def score_documents(docs: DataFrame, model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    small_batches(docs.sparkSession)
    schema = "row bigint, word binary, times bigint, doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), schema)
    rows = rows.join(counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) * F.col("times")
    sums = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("n") > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("logs", log)).alias("logs"),
        F.sum(F.coalesce("score", log)).alias("score"),
    )
    m = model.value
    n, v = m["train_tokens"], m["vocabulary"]
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def held_out():
    """Whether the CRC-32 of the doc_id's digits leaves 2 after division by 7; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def language_scores(docs: DataFrame) -> DataFrame:
    """Train on the documents that aren't held out and score all rows of ``docs`` (doc_id, text).

    A null or empty text has one token, its end. Words that training lacks count zero: base and model give them the
    probability of an unknown word (of their tail class). Repeated rows train and are scored each. An empty table gives no rows, and a
    training part without rows gives a model of empty counts. Other columns are ignored.
    """
    model, counts = train(docs.filter(~held_out()))
    scored = score_documents(docs, model, counts)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
