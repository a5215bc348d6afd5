import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilcraft.llm.labels import training_labels
from veilcraft.llm.maxent_lm import END, SLOTS, Lexicon, Sizes, _most_frequent, both, class_scores, language_scores, score_documents, sizes_for, softmax_log, tokens, train, word_scores
from veilcraft.llm.quality import Gaussian, N, fit, probability, quality_scores, statistics
from veilcraft.llm.toxicity import DISGUISE, NAMES, STEMS, YOU, Words, nearest, toxicity_scores
from veilcraft.llm.toxicity import features as toxic_features

from .conftest import ROWS


def test_language_model_base_score(docs):
    counts, rows = Counter(), []
    for i, t, *_ in ROWS:
        out = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        own = tokens(t)
        rows.append((i, out, own))
        if not out:
            counts.update(own)
    n, v = counts.total(), len(counts)
    want = sorted((str(i), o, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, o, w in rows)
    got = language_scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


Z = Sizes(last=16, skip=4, skip_word=2, both=32, head=64, tail_classes=4)


def test_language_model_is_a_distribution():
    rnd = np.random.default_rng(1)
    w = {k: rnd.normal(size=v) for k, v in Z.shapes().items()}
    assert np.allclose(np.exp(class_scores(w, 3, Z)).sum(axis=1), 1)
    assert np.allclose(np.exp(word_scores(w, 3, Z)).reshape(2, 2, 32).sum(axis=2), 1)
    assert Z.classes == 6 and int(both(np.array(15), np.array(3), Z)) < 32


def test_features_stay_within_documents():
    lexicon = Lexicon([b" ", b"a", b"b"], Z)
    words = [b"a", b"b", b" ", b"b", b" ", b" "]
    outcome, last, skip = lexicon.features(lexicon.codes(words), np.array([0, 3, 5]))
    assert outcome.tolist() == [1, 2, 0, 2, 0, 0]
    assert last[0] == last[3] == last[5] and skip[0] == skip[1] == skip[3] == skip[4] == skip[5] and last[1] != last[2]


def test_sizes_grow_with_the_corpus():
    weights = [sum(math.prod(v) for v in sizes_for(n).shapes().values()) for n in (10**3, 10**6, 10**9, 10**12)]
    assert all(3 * a < b < 40 * a for a, b in zip(weights, weights[1:]))
    assert all(z.keys * z.last < 2**62 and sum(z.bits()) + 18 < 63 for z in map(sizes_for, (0, 10**9, 10**14)))


@pytest.mark.parametrize("most", [5, 40, 1000])
def test_most_frequent_words_of_one_band(spark, most):
    rows = [(b"w%d" % i, 7) for i in range(300)] + [(b"x", 9000)]
    got = _most_frequent(spark.createDataFrame([(bytearray(w), n) for w, n in rows], "word binary, n bigint"), most)
    assert len(got) <= most and got[0] == (b"x", 9000) and len(got) >= min(0.6 * most, 301)


def test_language_model_score_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rnd.choice(vocabulary[: rnd.choice([5, 40, 150])]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model, counts = train(docs.filter("doc_id < 40"), steps=3, sizes=Z, frequent_words=80)
    m = model.value
    w, frequent = m["weights"], m["frequent"]
    own = Counter(t for i, text in rows if i < 40 for t in tokens(text))
    head = frequent[: Z.head]
    crc = lambda x, n: zlib.crc32(x) % n
    group = lambda t: crc(t[-2:], Z.tail_classes)
    tail = [sum(c + 1 for t, c in own.items() if t not in head and group(t) == k) + 1 for k in range(Z.tail_classes)]

    def log10(text):
        out, words = 0.0, tokens(text)
        for i, t in enumerate(words):
            last = crc(words[i - 1] + b"\n" if i else b"\n", Z.last)
            skip = crc(words[i - 2] + b"\n!" if i > 1 else b"\n!", Z.skip)
            x = w["class_bias"] + w["class_last"][last] + w["class_skip"][skip] + w["class_both"][int(both(last, skip, Z))]
            if t in head:
                p = head.index(t)
                y = w["word_bias"] + w["word_last"][last] + w["word_skip"][skip % Z.skip_word]
                k = p // SLOTS
                out += softmax_log(x)[k] / math.log(10) + softmax_log(y[k * SLOTS : (k + 1) * SLOTS])[p % SLOTS] / math.log(10)
            else:
                k = group(t)
                out += softmax_log(x)[Z.head_classes + k] / math.log(10) + math.log10((own[t] + 1) / tail[k])
        return out

    assert frequent[0] == END and m["train_tokens"] == own.total() and m["vocabulary"] == len(own)
    for r in score_documents(docs, model, counts).collect():
        assert abs(r.score - log10(dict(rows)[r.doc_id])) < 1e-3 * max(1, r.n_tokens)


def test_context_helps(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{a} {a}x {a}y" for a in (rnd.choice("pqrstuvw") for _ in range(40)))) for i in range(200)]
    out = language_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("held_out").collect()
    assert out and all(r.score > r.base_score for r in out)


def test_language_model_empty(empty):
    assert language_scores(empty).count() == 0


def labelled(spark, bad):
    rnd = random.Random(2)
    words = [a + b for a in ("ba", "ko", "li", "mer", "tun") for b in ("sa", "rin", "del", "po", "go", "an")]
    rows = []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(rnd.randint(30, 90))]
        rows.append((i, bad(text, rnd) if i % 4 == 0 else " ".join(text) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "own", 1.0) for i, t, _ in rows], "doc_id bigint, text string, label string, score double")
    return docs, rows


def toxic_text(text, rnd):
    for _ in range(4):
        text[rnd.randrange(len(text))] = rnd.choice(["grobnik", "Wretch!", "vilto", "wretch"])
    return " ".join(text)


def test_toxicity_on_held_out_rows(spark):
    docs, rows = labelled(spark, toxic_text)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (99999, 1)], "doc_id bigint, toxic int")
    extra = spark.createDataFrame([(None, None, "x", 0.0), (1000, "", "x", 0.0), (1000, "", "x", 0.0)], docs.schema)
    out = toxicity_scores(docs.unionByName(extra), labels).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    want = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_near_you_reads_the_whole_text():
    near = lambda text: toxic_features(text, Words({"oaf": 3.0}))[NAMES.index("near_you")]
    late = "tu " * 1200 + "w " * 10 + "oaf " + "w " * 10 + "oaf tu"
    assert near(late) == 0.5 and near("oaf tu " + "w " * 10 + "oaf") == 0.5 and near("oaf") == near("tu") == 0.0
    rnd = random.Random(3)
    for _ in range(50):
        at, you = sorted(rnd.sample(range(300), rnd.randrange(1, 40))), sorted(rnd.sample(range(300), rnd.randrange(1, 40)))
        assert nearest(np.array(at), np.array(you)).tolist() == [min(abs(i - j) for j in you) for i in at]


@pytest.mark.parametrize("size", [0, 1, 30, 3000])
def test_toxic_features_against_brute_force(monkeypatch, size):
    from veilcraft.llm import common, toxicity

    monkeypatch.setattr(toxicity, "runs", lambda text: common.runs(text, 50))
    rnd = random.Random(size)
    lexicon = {"oaf": 3.0, "wretch": 4.0, "^mumpel": 2.0}
    text = " ".join(rnd.choice(["oaf", "Oaf!", "0af", "W.retch", "wr3tch", "mumpeln", "mumpel", "you", "TU,", "plain", "LOUD", "a1b", "x-y", "--", "...", "é"]) for _ in range(size)).replace(" e", "\n")
    words = text.split()
    bare = [w.strip(".,;:!?\"'()[]{}%&$*#|-_").lower() for w in words]
    hits, odds = [], []
    kinds = Counter()
    for i, (w, b) in enumerate(zip(words, bare)):
        stem = max((lexicon.get("^" + b[:k], 0) for k in STEMS), default=0) if len(b) > STEMS[0] else 0
        hidden = "".join(c for c in w.lower().translate(DISGUISE) if c.isalnum())
        found = lexicon.get(b) or stem or (lexicon.get(hidden, 0) if b and not b.isalpha() and hidden != b else 0)
        if found:
            kinds["word" if b in lexicon else "stem" if stem else "disguised"] += 1
            hits.append(i)
            odds.append(found)
    n, you = max(len(words), 1), [i for i, b in enumerate(bare) if b in YOU]
    got = dict(zip(NAMES, toxic_features(text, Words(lexicon, most=5))))
    want = {
        "word_density": kinds["word"] / n, "stem_density": kinds["stem"] / n, "disguised_density": kinds["disguised"] / n, "hits": math.log1p(len(hits)),
        "closest": 1 / min((b - a for a, b in zip(hits, hits[1:])), default=math.inf), "near_you": sum(min(abs(i - j) for j in you) <= 5 for i in hits) / len(hits) if hits and you else 0.0,
        "you": len(you) / n, "capitals": sum(c.isupper() for c in text) / max(sum(c.isalpha() for c in text), 1), "shouted": sum(w.isupper() for w in words) / n, "exclaimed": text.count("!") / n,
        "odds": sum(odds) / len(odds) if odds else 0.0, "evidence": sum(odds) / n, "words": math.log1p(len(words)),
    }
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) > 1e-9}


def test_quality_fit_against_numpy(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, N)) @ rnd.normal(size=(N, N))
    y = rnd.random(300) < 0.4
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, x array<double>").repartition(5)
    own = [np.cov(x[y == k].T, bias=True) for k in (False, True)]
    pooled = sum((y == k).sum() * c for k, c in zip((False, True), own)) / 300
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    for k, g in enumerate(fit(rows)):
        n = int((y == bool(k)).sum())
        part = 0.2 + N / (n + N)
        c = (1 - part) * own[k] + part * pooled + 1e-4 * np.eye(N)
        d = x - x[y == bool(k)].mean(axis=0)
        want = math.log(n / 300) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]
        assert np.allclose(g.log_density(x), want)


@pytest.mark.parametrize("scores", [toxicity_scores, quality_scores])
@pytest.mark.parametrize("labels", [[], [(i, 1, 1) for i in range(1, 11)]])
def test_one_class_or_none(spark, docs, empty, scores, labels):
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    out = scores(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    if not labels.count():
        assert {r.score for r in out} == {0.5}
    assert scores(empty, labels).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, rows = labelled(spark, lambda text, rnd: rnd.choice([lambda t: " ".join(x.upper() + "!!" for x in t), lambda t: " | ".join(t), lambda t: " ".join([t[0]] * len(t))])(text))
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id bigint, quality int")
    out = quality_scores(docs, labels).collect()
    want = {i: 1 - y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_density_by_cholesky():
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=(14, 14))
    c, mean, x = a @ a.T + np.eye(14), rnd.normal(size=14), rnd.normal(size=(5, 14))
    f = np.linalg.cholesky(c)
    g = Gaussian(-0.5, mean, np.linalg.inv(f), float(np.log(np.diag(f)).sum()))
    want = -0.5 + -0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(c), x - mean) - 0.5 * np.linalg.slogdet(c)[1]
    assert np.allclose(g.log_density(x), want)
    assert np.allclose(probability((g, g), x), 0.5)
    assert statistics(None) == statistics(" \n") == [0.0] * 14


def test_labels_are_not_read_from_the_held_out_fold(spark):
    rows = training_labels(spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int"), "toxic").collect()
    assert {r.doc_id for r in rows} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1}
