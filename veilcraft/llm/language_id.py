"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to four bytes, counted over a bounded sample of its training texts and then frozen.
A byte costs what its longest known context says; where that context never saw it, the escape probability is paid (method C:
distinct successors over occurrences and distinct successors) and the context loses its oldest byte, down to eight bits for a
byte that no context knows. The language with the shortest code for the whole text is predicted, and the score is its share of
the probability of all languages.

Trees are kept as sorted arrays of windows (context and byte in one number). A block of texts is coded by its distinct windows of five
bytes, so a window is looked up once for each language however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, small_batches

#: Longest context in bytes.
ORDER = 4
#: Training texts of a language that its tree is counted from, as expected by a hash of each row.
ROWS = 2_000
#: Nodes of a language's tree; the most frequent ones stay, and with a node all that lie above it.
NODES = 200_000
#: Bytes of texts that are coded together.
BLOCK = 2_000_000
UNDETERMINED = "und"

_PAD = b"\n" * ORDER


class Tree(NamedTuple):
    """For each order: sorted windows and the bits of their last byte, sorted contexts and the bits of an escape from them."""

    windows: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def held_out() -> Column:
    """Whether the CRC-32 of the doc_id's digits leaves 0 after division by 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _segments(row: int, text: str) -> Iterator[tuple[int, bytes]]:
    """The text's bytes in runs of BLOCK, each after the bytes that are the context of its first one."""
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(data), BLOCK):
        yield row, (data[at - ORDER : at] if at else _PAD) + data[at : at + BLOCK]


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, bytes]]]:
    held: list[tuple[int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for segment in _segments(row, text):
            if held and size + len(segment[1]) > BLOCK:
                yield held
                held, size = [], 0
            held.append(segment)
            size += len(segment[1])
    if held:
        yield held


def _windows(block: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The window of ORDER + 1 bytes that ends at each byte of the segments, and how many each segment has."""
    data = np.frombuffer(b"".join(x for _, x in block), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for _, x in block])
    out = data.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= data[:-k] << np.uint64(8 * k)
    own = np.ones(len(data), dtype=bool)
    begins = np.cumsum(sizes) - sizes
    for k in range(ORDER):
        own[begins + k] = False
    return out[own], sizes - ORDER


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(texts, langs):
            if _has_letter(text):
                by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for block in _blocks(own):
                found, n = np.unique(_windows(block)[0], return_counts=True)
                for order in range(ORDER, -1, -1):
                    if order < ORDER:
                        found, place = np.unique(found & np.uint64(256 ** (order + 1) - 1), return_inverse=True)
                        n = np.bincount(place, weights=n).astype(np.int64)
                    columns = [pa.array([lang] * len(found)), pa.array(np.full(len(found), order, np.int32)), pa.array(found.astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "depth", "gram", "n"])


def tree_nodes(labelled: DataFrame, rows: int = ROWS, nodes: int = NODES) -> DataFrame:
    """lang, depth (bytes of context), gram (context and byte) and n of the nodes of each language's tree, from ``labelled`` (doc_id, text, lang)."""
    small_batches(labelled.sparkSession)
    # one number for each language comes to the driver, where their trees go as well; texts are sampled as they are read
    sizes = {r["lang"]: float(r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    dice = (F.xxhash64("doc_id", "text", F.lit("tree")).bitwiseAND(0xFFFFFF) + 0.5) / 0x1000000
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang")) if sizes else F.lit(None).cast("double")
    sample = labelled.filter(dice * size < rows).select("lang", "text")
    counts = settled(sample.mapInArrow(_counted, "lang string, depth int, gram bigint, n bigint").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n")))
    # a context is at least as frequent as what follows it, so a least frequency keeps trees whole
    sizes = counts.groupBy("lang", "n").agg(F.count("*").alias("alike"))
    down = Window.partitionBy("lang").orderBy(F.col("n").desc())
    least = sizes.withColumn("kept", F.sum("alike").over(down)).filter(F.col("kept") <= nodes).groupBy("lang").agg(F.min("n").alias("least"))
    return counts.join(least, "lang").filter("n >= least").select("lang", "depth", "gram", "n")


def trees(nodes: DataFrame) -> dict[str, Tree]:
    """Frozen trees by language; at most NODES nodes of each come to the driver."""
    table = nodes.toArrow()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    code, depth, gram, n = (lang.indices.to_numpy(), *(table.column(c).to_numpy() for c in ("depth", "gram", "n")))
    out = {}
    for i, name in sorted(enumerate(lang.dictionary.to_pylist()), key=lambda x: x[1]):
        tree = Tree([], [], [], [])
        for order in range(ORDER + 1):
            own = (code == i) & (depth == order)
            windows, seen = gram[own].astype(np.uint64), n[own].astype(float)
            by_window = np.argsort(windows)
            windows, seen = windows[by_window], seen[by_window]
            contexts, place = np.unique(windows >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(place, weights=seen), np.bincount(place).astype(float)
            tree.windows.append(windows)
            tree.bits.append(np.log2((total + distinct)[place] / seen))
            tree.contexts.append(contexts)
            tree.escapes.append(np.log2((total + distinct) / distinct))
        out[name] = tree
    return out


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted ones, and which of them are there."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), dtype=bool)


def code_lengths(tree: Tree, windows: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each window after its others."""
    bits = np.zeros(len(windows))
    left = np.arange(len(windows))
    for order in range(ORDER, -1, -1):
        keys = windows[left] & np.uint64(256 ** (order + 1) - 1)
        at, hit = _found(tree.windows[order], keys)
        bits[left[hit]] += tree.bits[order][at[hit]]
        left, contexts = left[~hit], keys[~hit] >> np.uint64(8)
        at, hit = _found(tree.contexts[order], contexts)
        bits[left[hit]] += tree.escapes[order][at[hit]]
    bits[left] += 8
    return bits


def text_bits(models: list[Tree], texts: list[str]) -> np.ndarray:
    """The code length of each whole text (rows) under each tree (columns)."""
    out = np.zeros((len(texts), len(models)))
    for block in _blocks(texts):
        windows, sizes = _windows(block)
        distinct, place = np.unique(windows, return_inverse=True)
        begins, owners = np.cumsum(sizes) - sizes, np.array([row for row, _ in block])
        for k, tree in enumerate(models):
            np.add.at(out[:, k], owners, np.add.reduceat(code_lengths(tree, distinct)[place], begins))
    return out


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = list(models)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            texts = [t if t and _has_letter(t) else "" for t in texts]
            if names:
                bits = text_bits(list(models.values()), texts)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            pred = [names[best[i]] if t and names else UNDETERMINED for i, t in enumerate(texts)]
            score = [float(share[i]) if t and names else 0.0 for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, rows: int = ROWS, nodes: int = NODES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text, lang).

    Trees are learnt from rows that aren't held out and have a text with a letter and a language; of a language with more than
    ``rows`` of them a sample by hash, and at most ``nodes`` nodes. Work grows with the number of languages. A text that is null
    or has no letter is ``und`` with score 0, and so is every text where nothing was learnt. Of languages with equally short codes the
    first by code point is predicted. Rows with a null doc_id are learnt from; repeated rows count each and are predicted each.
    An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    models = trees(tree_nodes(rows_of.filter(~held_out()).filter("text is not null and lang is not null"), rows, nodes))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    found = rows_of.select("doc_id", "text").mapInArrow(_predicted(shared), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
