import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilcraft.llm import resampling
from veilcraft.llm.resampling import feature_buckets, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(lower)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature, n=10_000):
    return zlib.crc32(feature.encode()) % n


def brute(docs, target, percent=25):
    s = Counter(bucket(f) for _, t in docs for f in features(t))
    t = Counter(bucket(f) for x in target for f in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    rows = []
    for doc_id, text in docs:
        own = [gain[bucket(f)] for f in features(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: percent * len(able) // 100]
    return Counter((*r, None) for r in rows if r[1] < 39) + Counter((*r, None) for r in able[len(drawn) :]) + Counter((*r, i + 1) for i, r in enumerate(drawn))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abzAZ019 .\n_é😀\x80`{", max_size=200), max_size=5))
def test_buckets_are_those_of_the_words(texts):
    found = feature_buckets(texts)
    assert [Counter(x.tolist()) for x in found] == [Counter(map(bucket, features(t))) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abA1 .é", max_size=300), st.integers(3, 40))
def test_long_texts_are_cut_without_loss(text, block):
    old, resampling.BLOCK = resampling.BLOCK, block
    try:
        (found,) = feature_buckets([text])
    finally:
        resampling.BLOCK = old
    assert Counter(found.tolist()) == Counter(map(bucket, features(text)))


def test_very_long_words_and_texts():
    text = "x" * 9_000_000 + " " + "ab cd " * 1_000_000 + "y" * 100
    (found,) = feature_buckets([text])
    assert Counter(found.tolist()) == Counter(map(bucket, features(text)))


def test_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    more = [(100 + i, f"Common words {i % 7} are here and there, {'fox jumps ' * (i % 30)}") for i in range(200)]
    df = docs.select("doc_id", "text", "n", "key", "score").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    target = ["the quick brown fox jumps", None, "", "Fox jumps here"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    found = Counter(tuple(r) for r in resample(df, benchmark).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert found == brute(rows + more, target)


@pytest.mark.parametrize("share", [0, 1])
def test_empty_tables(spark, docs, empty, share):
    target = docs if share else empty
    assert resample(empty, target).collect() == []
    assert resample(docs, empty).count() == docs.count()


def test_copies_have_one_weight_and_share_out_ranks(spark):
    text = "alpha beta gamma delta " * 10
    df = spark.createDataFrame([(i, text) for i in range(400)] + [(1, "short"), (500, None)], "doc_id bigint, text string")
    rows = resample(df, df.limit(1)).collect()
    assert len({r["weight"] for r in rows if r["n_features"] == 79}) == 1
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 101))
