"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learnt from training labels: words and word beginnings that toxic documents hold far more often than others.
Features are the densities of its words, of beginnings and of words that match once disguise is taken off, how closely hits
lie together and to second-person words, and rates of capitals, punctuation and disguised spelling. Trees and
calibration are Spark MLlib's, fitted on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs, settled, small_batches
from .labels import bounded, held_out, training_labels

#: Labelled rows that lexicon, trees and calibration are fitted on, at most, by a hash of doc_id.
SAMPLE = 20_000
#: Entries of the lexicon, at most; and what a term needs: toxic documents, part of them, log odds of documents and of occurrences.
TERMS, LEAST_DOCUMENTS, LEAST_PART, LEAST_ODDS, LEAST_RATE = 600, 3, 0.008, 1.0, 2.5
STEMS = (4, 5, 6, 7)
#: So many of six folds of the sample are for the lexicon, the others for trees and calibration.
LEXICON_FOLDS = 3
TRAIN_PARTS = 4
#: Part of the trees' probability in a score.
KEPT = 0.02
THRESHOLD = 0.7
#: Second-person words in the four languages of the corpus.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre vos tú ti usted ustedes vosotros vuestro".split())
#: Characters that stand for letters in disguised spelling.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

NAMES = (
    "word_density", "stem_density", "disguised_density", "hits", "closest", "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation",
    "disguise", "odds", "evidence", "words",
)
_INNER = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")
_EDGES = ".,;:!?\"'()[]{}%&$*#|-_"


def terms(text: str) -> Counter:
    """Words of a text without marks at their edges, in lower case, and beginnings of longer ones (with a ^), with their counts."""
    words = Counter(w.strip(_EDGES) for w in text.lower().split())
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[f"^{w[:k]}"] += n
    del out[""]
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, list[int]] = {}  # documents and occurrences by label; the empty term counts all words
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            text, label = text.as_py() or "", int(label)
            for term, n in chain(terms(text).items(), [("", len(text.split()))]):
                own = seen.setdefault(term, [0, 0, 0, 0])
                own[label] += 1
                own[2 + label] += n
        counts = list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))], ["term", "d0", "d1", "c0", "c1"])


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and the log odds of their occurrences, from rows of (text, label); equal texts count once."""
    rows = labelled.withColumn("key", F.xxhash64("text")).dropDuplicates(["key"]).drop("key")
    counts = rows.select("text", "label").mapInArrow(_terms, "term string, d0 bigint, d1 bigint, c0 bigint, c1 bigint").groupBy("term")
    counts = settled(counts.agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1")]))
    whole = counts.filter("term = ''").first()
    if whole is None or not whole["d1"] or not whole["d0"]:
        return {}
    odds = lambda x: F.log((F.col(x + "1") + 0.5) / (whole[x + "1"] + 1)) - F.log((F.col(x + "0") + 0.5) / (whole[x + "0"] + 1))
    good = counts.filter("term <> ''").withColumn("odds", odds("d")).withColumn("rate", odds("c"))
    good = good.filter((F.col("d1") >= LEAST_DOCUMENTS) & (F.col("d1") >= LEAST_PART * whole["d1"]) & (F.col("odds") >= LEAST_ODDS) & (F.col("rate") >= LEAST_RATE))
    # signs that many toxic documents hold come first
    best = good.orderBy(F.desc(F.col("d1") * F.col("odds")), "term").limit(TERMS).collect()
    return {r["term"]: float(r["rate"]) for r in best}


def nearest(spots: np.ndarray, you: np.ndarray) -> np.ndarray:
    """Distance of each spot to the nearest of ``you``; both ascend and ``you`` isn't empty."""
    k = np.searchsorted(you, spots)
    return np.minimum(np.abs(spots - you[np.maximum(k - 1, 0)]), np.abs(you[np.minimum(k, len(you) - 1)] - spots))


#: What is known of a word: its kind (a word of the lexicon, a beginning, one in disguise), log odds, whether it is a second-person word or all
#: in capitals, its capitals and letters, and its marks between letters.
WORD, STEM, DISGUISED = 1, 2, 3


class Words(dict):
    """Numbers of words as they come; ``facts`` has a row for each. Begins anew beyond a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        self.lexicon = {k: v for k, v in lexicon.items() if k[0] != "^"}
        self.stems = {k[1:]: v for k, v in lexicon.items() if k[0] == "^"}
        self.most, self.rows = most, []

    def __missing__(self, raw: str) -> int:
        w = raw.strip(_EDGES).lower()
        kind, odds = 0, self.lexicon.get(w, 0.0)
        if odds:
            kind = WORD
        elif len(w) > STEMS[0] and (odds := max((self.stems.get(w[:k], 0.0) for k in STEMS), default=0.0)):
            kind = STEM
        elif w and not w.isalpha():
            bare = re.sub(r"[\W_]", "", raw.lower().translate(DISGUISE))
            if bare != w and bare in self.lexicon:
                kind, odds = DISGUISED, self.lexicon[bare]
        self.rows.append((kind, odds, w in YOU, raw.isupper(), sum(map(str.isupper, raw)), sum(map(str.isalpha, raw)), len(_INNER.findall(raw))))
        self[raw] = len(self.rows) - 1
        return self[raw]

    def facts(self, text: str) -> np.ndarray:
        """A row of facts for each word of the text, in order."""
        parts = []
        for run in runs(text):
            if len(self.rows) > self.most:
                self.clear()
                self.rows = []
            words = run.split()
            codes = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            used, at = np.unique(codes, return_inverse=True)
            parts.append(np.array([self.rows[i] for i in used.tolist()], dtype=np.float64).reshape(-1, 7)[at])
        return np.concatenate(parts)


def features(text: str | None, words: Words) -> list[float]:
    """The features of a whole text, in the order of NAMES; those of a text without words are all zero."""
    text = text or ""
    facts = words.facts(text)
    n = len(facts)
    if not n:
        return [0.0] * len(NAMES)
    kind, odds, you, shouted, upper, letters, inner = facts.T
    spots, at_you = np.flatnonzero(kind), np.flatnonzero(you)
    gaps = np.diff(spots)
    near = float((nearest(spots, at_you) <= 5).mean()) if len(spots) and len(at_you) else 0.0
    total = float(odds.sum())
    return [
        float((kind == WORD).sum() / n), float((kind == STEM).sum() / n), float((kind == DISGUISED).sum() / n), float(np.log1p(len(spots))), float(1 / gaps.min()) if len(gaps) else 0.0, near,
        float(you.sum() / n), float(upper.sum() / max(letters.sum(), 1)), float(shouted.sum() / n), text.count("!") / n, sum(map(text.count, ".,;:?%&*#|")) / n, float(inner.sum() / n),
        total / len(spots) if len(spots) else 0.0, total / n, float(np.log1p(n)),
    ]


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared)
        for batch in batches:
            rows = [features(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "text_key", "x"])

    return run


def _positive(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def _trees(train: DataFrame):
    return GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=1).fit(train)


def calibrated_trees(train: DataFrame):
    """Scores of rows with ``features``, from ``train`` (features, label, fold) with both classes.

    Each of three parts of the rows is predicted by trees that are fitted on the others, and isotonic regression is fitted on what that gives, with equal
    predictions summed first; all rows fit the trees that score. A small part of the trees' own probability is kept, so that scores rise with it
    where the calibration is flat.
    """
    train = train.withColumn("part", F.col("fold") % 3)
    size = {(r["label"], r["part"]): r["n"] for r in train.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    # a part without both classes on either side predicts itself
    apart = all(size.get((y, k), 0) and sum(size.get((y, q), 0) for q in range(3) if q != k) for y in (0.0, 1.0) for k in range(3))
    trees = _trees(train)
    if apart:
        raw = [_trees(train.filter(F.col("part") != k)).transform(train.filter(F.col("part") == k)) for k in range(3)]
        raw = raw[0].unionByName(raw[1]).unionByName(raw[2])
    else:
        raw = trees.transform(train)
    points = raw.groupBy(F.round(_positive(), 4).alias("raw")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(settled(points))

    def score(rows: DataFrame) -> DataFrame:
        rows = steps.transform(trees.transform(rows).withColumn("raw", _positive()))
        return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - KEPT) * F.col("calibrated") + KEPT * F.col("raw"))))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and text_key of each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    At most ``sample`` labelled rows that aren't held out are learnt from: of six folds three give the lexicon, the others
    trees and calibration; folds without both classes are replaced by all of them.
    A null or empty text has features of no words and a score like any other. Repeated rows are scored
    each; null labels and doc_ids aren't learnt from. Where the labels hold one class only, every score is that class's smoothed
    rate; 0.5 without labels. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    # at most ``sample`` rows
    labelled = F.broadcast(settled(bounded(training_labels(labels, "toxic"), sample)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(6)).cast("int")
    lexicon = learn_lexicon(docs.join(labelled, "doc_id").filter(fold < LEXICON_FOLDS).select("text", "label"))
    rows = settled(docs.mapInArrow(_features(lexicon), "doc_id bigint, text_key bigint, x array<double>")).withColumn("features", array_to_vector("x"))
    # at most ``sample`` rows of some numbers, which trees read very often
    train = settled(rows.join(labelled, "doc_id").select("features", "label", fold.alias("fold")).repartition(TRAIN_PARTS))
    size = {(r["label"], r["own"]): r["n"] for r in train.groupBy("label", (F.col("fold") >= LEXICON_FOLDS).alias("own")).agg(F.count("*").alias("n")).collect()}
    of = lambda label: size.get((label, True), 0) + size.get((label, False), 0)
    if of(0.0) and of(1.0):
        own = size.get((0.0, True), 0) and size.get((1.0, True), 0)
        rows = calibrated_trees(train.filter(F.col("fold") >= LEXICON_FOLDS) if own else train)(rows)
    else:
        rows = rows.withColumn("score", F.lit((of(1.0) + 0.5) / (of(0.0) + of(1.0) + 1.0)))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_key")
