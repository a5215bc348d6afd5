import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilcraft.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(seed=1):
    """Documents with copies, near copies, copies but for white space, nulls and repeated or missing ids; every fifth is toxic."""
    rnd = random.Random(seed)
    vocabulary = [a + b for a in ("ba", "ko", "li", "mer", "tun", "sol") for b in ("sa", "rin", "del", "po", "go", "an", "te")]
    rows, toxic = [], {}
    for i in range(240):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 160))]
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for _ in range(8):
                words[rnd.randrange(len(words))] = rnd.choice(["grobnik", "wretch", "vilto"])
        rows.append((i, " ".join(words), "en", f"src{i % 3}"))
    clean = [r for r in rows if not toxic[r[0]]]
    exact = [(1000 + k, r[1].replace(" ", "  ", k), "en", r[3]) for k, r in enumerate(clean[:20])]
    near = []
    for k, r in enumerate(clean[20:40]):
        words = r[1].split()
        words[len(words) // 2] = "other"
        near.append((2000 + k, " ".join(words), "en", r[3]))
    odd = [(None, None, None, None), (3000, "", "en", None), (None, "no id  here at all", "en", "src0"), (None, "no id here at all", "en", "src0"), (3001, "twice the same", "en", "src1"), (3001, "twice the same", "en", "src1")]
    return [(*r, len(r[1] or "")) for r in rows + exact + near + odd], toxic, exact, near


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, toxic, exact, near = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, exact, near


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def stage(spark, tables, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("own")).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables[0])
    if name != "packing":
        assert out.columns == docs.columns
        return sorted((tuple(r)[:5] for r in out.collect()), key=str)
    return out.collect()


def test_toxicity_stage(spark, tables):
    _, rows, toxic, *_ = tables
    kept = stage(spark, tables, "toxicity", rows)
    ids = [r[0] for r in kept]
    assert sum(toxic.get(i, 0) for i in ids) <= 2 and all(r in kept for r in rows if not toxic.get(r[0], 0))
    assert ids.count(3001) == 2 and ids.count(None) == 3


def test_exact_stage_against_brute_force(spark, tables):
    rows = tables[1]
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    want = [min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for own in groups.values()]
    # a null and an empty text are one group
    assert sorted(stage(spark, tables, "exact_dedup", rows), key=str) == sorted(want, key=str)


def test_near_stage_against_brute_force(spark, tables):
    rows = tables[1]
    shingles = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (r[1] or "").lower().split()) else frozenset() for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = {}
    for r, k in zip(rows, root):
        groups.setdefault(k, []).append(r)
    kept = stage(spark, tables, "simhash_near_dedup", rows)
    assert len(kept) == len(groups)
    for own in groups.values():
        ids = [r[0] for r in own if r[0] is not None]
        assert sum(r in kept for r in {*own}) == 1 and (not ids or any(r[0] == min(ids) for r in own if r in kept))


def test_mixing_stage(spark, tables):
    rows = [r for r in tables[1] if r[0] is not None and r[0] < 1000]
    out = stage(spark, tables, "mixing", rows)
    words = {s: sum(len((r[1] or "").split()) for r in out if r[3] == s) / sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in ("src0", "src1", "src2")}
    assert set(out) <= set(rows) and max(out.count(r) for r in out) <= 2 and words["src0"] > words["src1"] > words["src2"]


def test_packing_stage(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rows = tables[1]
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    out = stage(spark, tables, "packing", rows)
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in out) == sorted((str(r[0]), len(x), crc(x)) for r, x in zip(rows, ids))


def test_whole_pipeline(spark, tables):
    folder, rows, toxic, exact, near = tables
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert not {i for i, _, *_ in near} & ids and not {r[0] for r in exact[1:]} & ids - {r[0] for r in exact}
    assert sum(toxic.get(i, 0) for i in ids) <= 2 and all(r.length <= 2048 for r in out)


def test_empty_tables(spark, tables):
    for name, _ in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], SCHEMA)
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, tables[0]).count() == 0
