import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilcraft.llm import language_id
from veilcraft.llm.language_id import ORDER, Tree, code_lengths, held_out, predict_languages, text_bits, tree_nodes, trees

ENGLISH = ["the cat and the dog are there", "this is the house that they have", "and there was the thing with them", "they think that this thing is there"]
GERMAN = ["der hund und die katze sind da", "das ist das haus und der garten", "und dann war da die sache mit ihnen", "sie denken dass die sache schön ist"]


def brute_bits(training, text):
    """Bits of a text by nested dictionaries of contexts."""
    seen = defaultdict(Counter)
    for t in training:
        data = b"\n" * ORDER + t.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                seen[data[i - k : i]][data[i]] += 1
    data, bits = b"\n" * ORDER + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            after = seen.get(data[i - k : i])
            if after and data[i] in after:
                bits -= math.log2(after[data[i]] / (sum(after.values()) + len(after)))
                break
            if after:
                bits -= math.log2(len(after) / (sum(after.values()) + len(after)))
        else:
            bits += 8
    return bits


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_code_lengths_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(ENGLISH)] + [(10 + i, t, "de") for i, t in enumerate(GERMAN)]
    models = trees(tree_nodes(made(spark, rows)))
    texts = ["the garden", "die Gärten — und 漢字", "x", "", "zzzz\n\n\nthe the", *ENGLISH]
    bits = text_bits(list(models.values()), texts)
    assert list(models) == ["de", "en"]
    for i, t in enumerate(texts):
        assert bits[i] == pytest.approx([brute_bits(GERMAN, t), brute_bits(ENGLISH, t)])


def test_long_texts_in_blocks_cost_the_same(spark, monkeypatch):
    models = list(trees(tree_nodes(made(spark, [(i, t, "en") for i, t in enumerate(ENGLISH)]))).values())
    texts = ["the thing and the house über alles. " * 40, "a", "", "they" * 100]
    whole = text_bits(models, texts)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    assert text_bits(models, texts) == pytest.approx(whole)


def test_pruned_trees_stay_whole(spark):
    nodes = tree_nodes(made(spark, [(i, t, "en") for i, t in enumerate(ENGLISH * 3)]), nodes=120).collect()
    found = {(r["depth"], r["gram"]) for r in nodes}
    assert 20 < len(found) <= 120
    assert all((d - 1, g & (256**d - 1)) in found for d, g in found if d)


def test_an_empty_tree_knows_no_byte():
    none = [np.zeros(0, dtype=np.uint64)] * (ORDER + 1), [np.zeros(0)] * (ORDER + 1)
    assert code_lengths(Tree(*none, *none), np.array([1, 2], dtype=np.uint64)).tolist() == [8, 8]


def test_predictions(spark, docs):
    rows = [(100 + i, t, "en") for i, t in enumerate(ENGLISH * 4)] + [(200 + i, t, "de") for i, t in enumerate(GERMAN * 4)] + [(300, "the house is there", None), (301, "12 34 !?", "de"), (302, None, "de")]
    df = docs.filter("false").unionByName(made(spark, rows), allowMissingColumns=True)
    out = {r["doc_id"]: r for r in predict_languages(df).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["lang_pred"] == lang for i, t, lang in rows if i < 300)
    assert out[300]["lang_pred"] == "en" and 0.5 < out[300]["score"] <= 1
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (301, 302)] == [("und", 0.0)] * 2


def test_held_out_rows_teach_nothing(spark):
    df = made(spark, [(i, f"text number {'x' * i}", f"l{i % 3}") for i in range(60)])
    kept = {r["lang"] for r in tree_nodes(df.filter(held_out())).collect()}
    only = predict_languages(df.withColumn("lang", df["lang"]).filter(held_out())).collect()
    assert kept and {r["lang_pred"] for r in only} == {"und"} and all(r["held_out"] for r in only)


def test_odd_rows_and_empty_tables(spark, docs, empty):
    out = predict_languages(docs).collect()
    assert len(out) == docs.count()
    assert {r["lang_pred"] for r in out} <= {"en", "pl", "und"}
    assert predict_languages(empty).collect() == []
    # both languages have the same tree, so codes are equally short
    ties = predict_languages(made(spark, [(i, "same text", lang) for i, lang in enumerate("ab" * 20)])).collect()
    same = predict_languages(made(spark, [(None, "same text", lang) for lang in "ba"])).collect()
    assert {(r["lang_pred"], r["score"]) for r in same} == {("a", 0.5)} and len(ties) == 40


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = predict_languages(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
