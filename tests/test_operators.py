import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from veilcraft.functions import rules
from veilcraft.functions.rules import Rule, marked
from veilcraft.operators import analytics, mentions
from veilcraft.operators import anonymize as anonymize_module
from veilcraft.operators.anonymize import anonymize, anonymize_segments, strategy
from veilcraft.operators.fuse import DETECTORS, SEMANTIC, TYPE_RANK, fuse, resolve_overlaps
from veilcraft.operators.mentions import Taken, keys_of, merged, with_mentions
from veilcraft.operators.reinject import conflicts_and_decisions, flat, plan_status, ratio_bound, with_ratio
from veilcraft.operators.scan import dealt, scan
from veilcraft.operators.seals import SealError, delete, latest_hash, load, must_open, opened, save, sealed, signature
from veilcraft.operators.spans import before, beside, between, blocks, most, plus
from veilcraft.plans import rule_cases
from veilcraft.plans.policies import POLICIES, expand_groups

TEXTS = [
    (1, "NIP: 856 734 62 15; KRS 0000 1234 56"),
    (2, "Klient: Jan Kowalski, PESEL 44051401359, tel. 600 700 800, mail Jan.K@Example.com."),
    (3, "😀 karta 4111 1111 1111 1111, firma „TechNova”, ul. Długa 5/7, 00-123 Łódź"),
    (4, None),
    (5, ""),
    (6, "REGON 123456785 i 4111 1111 1111 1111 5; paszport AB1234567"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def test_scan(docs):
    spans = scan(docs).collect()
    texts = dict(TEXTS)
    assert all(texts[s.doc_id][s.start : s.stop] == s.raw_text for s in spans)
    of = lambda i: {(s.entity_type, s.raw_text) for s in spans if s.doc_id == i}
    assert of(1) == {("NIP", "NIP: 856 734 62 15"), ("NIP", "856 734 62 15"), ("KRS", "KRS 0000 1234 56")}
    assert {("CARD", "4111 1111 1111 1111"), ("ORG", "TechNova"), ("POSTAL_CODE", "00-123")} <= of(3)
    # a number after the label REGON is no phone, a card with more digits beside it no card, a passport no plain document
    assert {t for t, _ in of(6)} - {"PHONE"} == {"REGON", "PASSPORT_NUMBER"} and ("PHONE", "123456785") not in of(6)
    assert {s.confidence for s in spans if s.raw_text == "600 700 800"} == {0.9}


def test_anonymize(docs):
    out = {r.doc_id: r for r in anonymize(docs).collect()}
    assert out[1].text == "[NIP_1]; [KRS_1]" and out[1].findings == {"NIP": 1, "KRS": 1}
    assert out[2].text == "Klient: [OSOBA_1], [PESEL_1], tel. [PHONE_1], mail [EMAIL_1]."
    assert out[3].text.startswith("😀 karta [CARD_1], firma „[ORG_1]”, ")
    assert out[4].text is None and out[5].text == ""
    masked = {r.doc_id: r.text for r in anonymize(docs, style="mask", types={"NIP", "PESEL"}).collect()}
    assert masked[1] == "****; KRS 0000 1234 56"


def test_mentions(spark):
    text = "Piotr Malec podpisał umowę. W notatkach wskazano „Piotr”, „P. Malec”, konto piotr i telefon piotr. Przekazano też pana Malca."
    rows = spark.createDataFrame([(1, text), (2, "Jan Kowalski i Jan Nowak: „Jan”, konto jan."), (3, "Patryka Kowalskiego wskazano w umowie. Patyrk Kowalski podpisał aneks.")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in anonymize(rows, types={"PERSON"}).collect()}
    assert "Malec" not in out[1].text and "Piotr" not in out[1].text and "konto piotr" not in out[1].text and "Malca" not in out[1].text
    assert "„Jan”" in out[2].text and "konto jan" in out[2].text
    assert out[3].text.count("[OSOBA_1]") == 2 and "[OSOBA_2]" not in out[3].text


def mentioned(spark, text, *names):
    """(raw_text, rule) of the mentions of names, given as (name, support) where they first stand in the text."""
    spans = [(1, f"E{i}", "PERSON", n, text.index(n), text.index(n) + len(n), 0.9, "gliner", support) for i, (n, support) in enumerate(names)]
    schema = "doc_id int, entity_id string, entity_type string, raw_text string, start bigint, stop bigint, confidence double, source_detector string, support_count int"
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string").join(beside(spark.createDataFrame(spans, schema), ["doc_id"]), "doc_id")
    return [(m.raw_text, m.mention_rule, m.canonical_entity_id) for m in with_mentions(rows, "text").first()["_mentions"]]


def test_mention_parts(spark):
    assert mentioned(spark, "Ewa Lis. Ewę widziano.", ("Ewa Lis", 1)) == [("Ewę", "first_name_accusative_feminine", "E0")]
    assert not mentioned(spark, "Pan Lis. Pana widziano.", ("Pan Lis", 1)) and not mentioned(spark, "J. Lis. Lis.", ("J. Lis", 1))
    assert mentioned(spark, "Jan  Nowak-Lis i Nowak-Lis", ("Jan  Nowak-Lis", 1)) == [("Nowak-Lis", "surname_exact_unique", "E0")]
    keys = spark.createDataFrame([("Pawła", "Lipskiego"), ("Annę", "Lis"), ("Janem", "Lipski")], "a string, b string").select(keys_of(F.col("a"), F.col("b")).alias("k"))
    assert [tuple(r.k) for r in keys.collect()] == [("paweł", "lipski"), ("anna", "lis"), ("jan", "lipski")]
    taken = Taken([(5, 9), (0, 3), (7, 12)])
    assert taken.free(3, 5) and taken.free(12, 20) and not taken.free(2, 4) and not taken.free(11, 13) and not taken.free(0, 30)
    taken.add(3, 5)
    assert not taken.free(4, 6) and not taken.free(3, 4)


def test_support_tells_whose_forms_are_looked_for(spark):
    text = "Annę Nowak i Anna Nowak, bez Anny."
    assert mentioned(spark, text, ("Annę Nowak", 1), ("Anna Nowak", 2)) == [("Anny", "first_name_genitive_feminine", "E1")]
    assert mentioned(spark, text, ("Annę Nowak", 1), ("Anna Nowak", 1)) == []


def test_names_with_a_slip_of_the_pen(spark):
    text = "Patryk Malec, Anna Malec, Patyrk Malec; Jan Lis, Anna Lis, Jann Lis"
    found = mentioned(spark, text, ("Patryk Malec", 1), ("Anna Malec", 1), ("Jan Lis", 1), ("Anna Lis", 1))
    assert found == [("Patyrk Malec", "fuzzy_full_name_typo", "E0"), ("Jann Lis", "fuzzy_full_name_typo", "E2")]
    assert merged([{"given": "patryk", "surname": "x"}, {"given": "patyrk", "surname": "x"}, {"given": "patryk", "surname": "y"}]) == [0, 0, 2]


def test_rows_that_keys_do_not_tell_apart(spark):
    rows = [(None, "x g@h.pl"), (1, "mail a@b.pl"), (1, "to c@d.pl and e@f.pl"), (1, "mail a@b.pl"), (None, None), (None, "none")]
    docs = spark.createDataFrame(rows, "start bigint, text string").withColumns({c: F.lit("own") for c in ("stop", "entity_type", "_spans", "_edits", "findings", "raw_text")})
    out = anonymize(docs, keys=("start", "stop")).collect()
    want = [(None, "x [EMAIL_1]"), (1, "mail [EMAIL_1]"), (1, "to [EMAIL_1] and [EMAIL_2]"), (1, "mail [EMAIL_1]"), (None, None), (None, "none")]
    assert sorted(((r.start, r.text) for r in out), key=str) == sorted(want, key=str) and {r.stop for r in out} == {"own"}
    spans = scan(docs, keys=("start", "stop")).collect()
    assert len(spans) == 5 and all(r.stop == "own" and r.span_stop - r.span_start == 6 for r in spans)
    assert anonymize(docs.filter("false"), keys=("start",)).count() == 0


def test_spans_of_other_detectors(spark):
    docs = spark.createDataFrame([(1, "Firma Alfa w Łodzi"), (None, "Firma Beta"), (2, "nic")], "doc_id bigint, text string")
    schema = "doc_id bigint, entity_id string, entity_type string, raw_text string, normalized_text string, confidence double, source_detector string, start bigint, stop bigint, context_required boolean, rule_seq int"
    other = [(1, "E1", "COMPANY", "Firma Alfa", "Firma Alfa", 0.9, "gliner", 0, 10, False, 900), (None, "E2", "ORG", "Firma Beta", "Firma Beta", 0.9, "gliner", 0, 10, False, 900)]
    out = {r.doc_id: r.text for r in anonymize(docs, types={"EMAIL"}, others=[spark.createDataFrame(other, schema)]).collect()}
    assert out == {1: "[ORG_1] w Łodzi", None: "[ORG_1]", 2: "nic"}


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        (r"\b(foo|bar)-(?<entity>\d+)", "code foo-123 x", [("123", 9, 12)]),
        (r"\bfoo-(?<entity>\d+) tail", "a foo-123 tail", [("123", 6, 9)]),
        (r"(?m)^(?<entity>ab+)$", "ab\nabb", [("ab", 0, 2), ("abb", 3, 6)]),
        (r"[(\]](?<entity>\(x\))[)]", "((x)) \x01 ((x))", [("(x)", 1, 4), ("(x)", 9, 12)]),
        (r"ab", "xabab", [("ab", 1, 3), ("ab", 3, 5)]),
    ],
)
def test_place_of_the_entity(spark, pattern, text, want):
    rule = Rule("X", pattern, "identity", "always_true", 0.5)
    got = scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), rules=[rule]).collect()
    assert sorted((r.raw_text, r.start, r.stop) for r in got) == sorted(want)


@pytest.mark.parametrize("pattern", [r"(x(?<entity>a))", r"a|b(?<entity>c)", r"(?<entity>a)+", r"(a)\1(?<entity>b)", r"(?<entity>a)(?<entity>b)", "(a"])
def test_patterns_without_a_certain_place(pattern):
    with pytest.raises(ValueError):
        marked(pattern)


def test_tests_before_a_search_lose_nothing(spark):
    rnd = random.Random(4)
    parts = [p for cases in rule_cases.CASES.values() for c in cases for p in c[:3] if p]
    digits = lambda t: "".join(str(rnd.randrange(10)) if x == "#" else x for x in re.sub(r"\{\w+\}", "##########", t))
    odd = lambda t: t.replace("s", "ſ").replace("I", "İ").replace("K", "\u212a") if rnd.random() < 0.2 else t.upper() if rnd.random() < 0.2 else t
    texts = [(i, odd(" ".join(digits(rnd.choice(parts)) for _ in range(rnd.randint(1, 12))))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(4)
    bare = [r._replace(needs=(), digits=0) for r in rules.ordered()]
    fields = lambda df: sorted((r.doc_id, r.rule_seq, r.start, r.stop, r.raw_text) for r in df.collect())
    want = fields(scan(docs, rules=bare))
    assert len(want) > 400 and fields(scan(docs)) == want and all(dict(texts)[d][a:b] == raw for d, _, a, b, raw in want)


def test_segments(spark):
    rows = [(1, 0, "Klient: Jan Kowalski"), (1, 1, "tel. 600700800 §§"), (2, 5, "nic"), (2, 6, None)]
    out = anonymize_segments(spark.createDataFrame(rows, "c bigint, t bigint, text string"), "c", "t").collect()
    assert sorted((r.c, r.t, r.text or "") for r in out) == [(1, 0, "Klient: [OSOBA_1]"), (1, 1, "tel. [PHONE_1] §§"), (2, 5, "nic"), (2, 6, "")]


def test_segments_of_any_text_and_key(spark):
    edge = anonymize_module._BOUNDARY
    rows = [
        (None, 1, "null key e@f.pl"), (None, 1, None), (None, None, "e@f.pl i g@h.pl"), ("a", 1, "x\0y jan@b.pl"), ("a", 2, "second c@d.pl"), ("a", 2, "second c@d.pl"),
        ("a", None, "first of all"), ("b", 3, f"{edge}q@w.pl{edge}{edge}"), ("b", 4, ""), ("b", 5, edge), ("b", 6, "\x01\x02 r@t.pl 😀"), ("c", 1, None),
    ]
    done = anonymize_segments(spark.createDataFrame(rows, "key string, start int, text string").repartition(3), "key", "start", types=("EMAIL",)).collect()
    one, two = "[EMAIL_1]", "[EMAIL_2]"
    want = [
        (None, 1, f"null key {one}", 1), (None, 1, None, 0), (None, None, f"{one} i {two}", 2), ("a", 1, f"x\0y {one}", 3), ("a", 2, f"second {two}", 3), ("a", 2, "second [EMAIL_3]", 3),
        ("a", None, "first of all", 3), ("b", 3, f"{edge}{one}{edge}{edge}", 2), ("b", 4, "", 2), ("b", 5, edge, 2), ("b", 6, f"\x01\x02 {two} 😀", 2), ("c", 1, None, 0),
    ]
    assert sorted(((r.key, r.start, r.text, r.findings.get("EMAIL", 0)) for r in done), key=repr) == sorted(want, key=repr)
    assert anonymize_segments(spark.createDataFrame([], "key string, start int, text string"), "key", "start").collect() == []


def test_very_many_spans_in_one_text(spark):
    import time

    took = []
    for n in (2_000, 10_000, 40_000):
        text = " ".join(f"pisz na user{i}@mail.pl, słowo" for i in range(n))
        began = time.time()
        (row,) = anonymize(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), types=("EMAIL",)).collect()
        took.append(time.time() - began)
        assert row.text == " ".join(f"pisz na [EMAIL_{i + 1}], słowo" for i in range(n)) and row.findings == {"EMAIL": n}
    assert took[2] < 20 + 2 * took[0]


def test_sums_and_maxima_of_what_comes_before(spark):
    rnd = random.Random(5)
    rows = [([rnd.randrange(100) for _ in range(n)],) for n in (0, 1, 2, 127, 128, 129, 1000, 40_000)]
    df = spark.createDataFrame(rows, "v array<bigint>").select("v", before(F.col("v"), plus).alias("s"), before(F.col("v"), most).alias("m"))
    for r in df.collect():
        assert r.s == [0, *itertools.accumulate(r.v)][: len(r.v)] and r.m == [0, *itertools.accumulate(r.v, max)][: len(r.v)]


def test_blocks_and_what_lies_between(spark):
    rnd = random.Random(6)
    texts = ["", "a", "ż" * 4096, "😀a" * 2048 + "b", "".join(rnd.choice("aż😀 ") for _ in range(1_048_576 * 2 + 5000))]
    places = [(i, *sorted((rnd.randrange(len(t) + 1), rnd.randrange(len(t) + 1)))) for i, t in enumerate(texts) for _ in range(20)] + [(i, 0, len(t)) for i, t in enumerate(texts)]
    parts = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", blocks(F.col("t")).alias("b"))
    rows = spark.createDataFrame(places, "i int, a bigint, z bigint").join(parts, "i").select("i", "a", "z", F.sha2(between(F.col("b"), F.col("a"), F.col("z")), 256).alias("h")).collect()
    assert len(rows) == len(places) and all(r.h == hashlib.sha256(texts[r.i][r.a : r.z].encode()).hexdigest() for r in rows)


def test_only_tables_below_a_split_for_each_core_are_dealt(spark, tmp_path):
    rows = spark.range(200_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("text")).coalesce(1)
    rows.write.option("parquet.block.size", 1_000_000).parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    shuffled = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    assert shuffled(dealt(read()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert not shuffled(dealt(read()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strategies():
    assert strategy("reversible", "mask") == "category_placeholder" and strategy(style="mask") == "fixed_mask"
    assert strategy(policy=POLICIES["finance_documents"]) == "mask" and strategy(policy=POLICIES["legal_review"]) == "format_preserving"
    assert expand_groups(("workforce_refs",), ("NIP", "CLIENT_ID")) == ("CLIENT_ID", "EMPLOYEE_ID", "NIP")


SCHEMA = "doc_id bigint, entity_id string, entity_type string, raw_text string, normalized_text string, confidence double, source_detector string, start bigint, stop bigint, context_required boolean, rule_seq int"


def random_spans(seed):
    rnd = random.Random(seed)
    rows = []
    for doc in range(25):
        for k in range(rnd.randint(0, 9)):
            a = rnd.randint(0, 40)
            n = rnd.randint(1, 15)
            kind = rnd.choice(["PERSON", "ORG", "ADDRESS", "NIP", "PHONE", "EMAIL"])
            rows.append((doc, f"E{doc}_{k}", kind, "x" * n, "x", rnd.choice([0.5, 0.7, 0.71, 0.9]), rnd.choice([*DETECTORS, "other"]), a, a + n, rnd.random() < 0.5, k))
    return rows


def meets(a, b):
    return a["start"] < b["stop"] and b["start"] < a["stop"]


def ordered(rows):
    rank = lambda d: DETECTORS.index(d) if d in DETECTORS else 4
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) | {"p": rank(r[6])} for r in rows]
    return sorted(rows, key=lambda r: (r["start"], -r["stop"], -r["confidence"], r["p"], r["rule_seq"]))


def fused_by_hand(rows):
    rows, kept = ordered(rows), []
    semantic = [r for r in rows if r["entity_type"] in SEMANTIC]
    while semantic:
        group, grew = [semantic.pop(0)], True
        while grew:
            more = [r for r in semantic if any(meets(r, g) for g in group)]
            grew = bool(more)
            group += more
            semantic = [r for r in semantic if r not in more]
        group = [r for r in rows if r in group]
        kinds = list(dict.fromkeys(r["entity_type"] for r in group))
        of = lambda k: [r for r in group if r["entity_type"] == k]
        best = max(kinds, key=lambda k: (any(r["source_detector"] == "regex" for r in of(k)), len(of(k)), max(r["confidence"] for r in of(k)), -min(r["p"] for r in of(k)), max(r["stop"] - r["start"] for r in of(k))))
        kept.append(max(of(best), key=lambda r: (r["source_detector"] == "regex", r["confidence"], -r["p"], r["stop"] - r["start"]))["entity_id"])
    for kind in ("NIP", "PHONE", "EMAIL"):
        chosen = []
        for r in (r for r in rows if r["entity_type"] == kind):
            rival = next((c for c in chosen if meets(c, r)), None)
            if rival is None:
                chosen.append(r)
                continue
            rule = [x["source_detector"] == "regex" for x in (rival, r)]
            long = lambda x: x["stop"] - x["start"]
            if rule[0] != rule[1]:
                wins = rule[1]
            elif r["confidence"] > rival["confidence"] + 0.05 or r["confidence"] == rival["confidence"] and long(r) > long(rival):
                wins = True
            else:
                wins = abs(r["confidence"] - rival["confidence"]) < 0.01 and r["p"] < rival["p"]
            if wins:
                chosen.remove(rival)
                chosen.append(r)
        kept += [c["entity_id"] for c in chosen]
    return kept


def resolved_by_hand(rows):
    chosen = []
    rows = sorted(ordered(rows), key=lambda r: (r["start"], -r["stop"], -r["confidence"], r["rule_seq"]))
    weight = lambda r: (r["context_required"], TYPE_RANK.get(r["entity_type"], 0), r["confidence"], len(r["raw_text"]))
    for r in rows:
        rival = next((c for c in chosen if meets(c, r)), None)
        if rival is None:
            chosen.append(r)
        elif weight(r) > weight(rival):
            chosen.remove(rival)
            chosen.append(r)
    return [c["entity_id"] for c in chosen]


@pytest.mark.parametrize("seed", [1, 2])
def test_fusion_and_overlaps_against_plain_folds(spark, seed):
    rows = random_spans(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    by_doc = [[r for r in rows if r[0] == d] for d in range(25)]
    assert sorted(r.entity_id for r in fuse(df).collect()) == sorted(e for own in by_doc for e in fused_by_hand(own))
    out = resolve_overlaps(df)
    assert sorted(r.entity_id for r in out.filter("beaten_by is null").collect()) == sorted(e for own in by_doc for e in resolved_by_hand(own))
    assert out.count() == len(rows)


def test_analytics(spark):
    spans = spark.createDataFrame([(1, "NIP", "a", 0.95), (1, "NIP", "a", 0.85), (1, "PESEL", "b", 0.9), (2, "NIP", "c", 0.5)], "doc_id bigint, entity_type string, raw_text string, confidence double")
    audit = {r.entity_type: r for r in analytics.entity_audit(spans.filter("doc_id = 1")).collect()}
    assert (audit["NIP"].mean_confidence, audit["NIP"].median_confidence, audit["NIP"].entity_count) == (0.9, 0.9, 2)
    risk = {r.doc_id: r for r in analytics.reidentification_risk(spans, over=spark.range(1, 4).withColumnRenamed("id", "doc_id")).collect()}
    assert (risk[1].overall_score, risk[1].risk_level) == (0.85, "high") and (risk[3].overall_score, risk[3].risk_level) == (0.0, "low")
    segments = spark.createDataFrame([(1, "s0", "Jan  Kowalski. x"), (1, "s1", "jan kowalski"), (1, "s2", "xJan Kowalski"), (1, "s3", None)], "doc_id bigint, segment_id string, text string")
    found = analytics.leaks(segments, spark.createDataFrame([(1, "Jan Kowalski"), (1, "("), (1, None)], "doc_id bigint, raw_text string"))
    # a full stop joins on to the name, so only the normalised search finds it
    assert {(r.segment_id, r.exact, r.normalised) for r in found.collect()} == {("s0", False, True), ("s1", False, True)}
    expected = spark.createDataFrame([(1, 0, "NIP", "856-734"), (1, 1, "NIP", "856"), (1, 2, "ORG", "X")], "id bigint, seq int, entity_type string, text string")
    predicted = spark.createDataFrame([(1, 0, 9, "NIP", "856-734-62"), (1, 20, 23, "ORG", "Y")], "id bigint, start int, stop int, entity_type string, raw_text string")
    assert [tuple(r) for r in analytics.corpus_matches(expected, predicted).collect()] == [(1, "NIP", 1)]


def test_fusion_of_some_types_leaves_out_what_they_never_meet(spark):
    schema = "doc_id bigint, entity_id string, entity_type string, raw_text string, normalized_text string, confidence double, source_detector string, start bigint, stop bigint, context_required boolean, rule_seq int"
    kinds = ["PER", "ORGANIZATION", "ADDRESS", "NIP", "PHONE", None]
    rnd = random.Random(4)
    rows = [(i // 9, f"E{i}", rnd.choice(kinds), "x", "x", rnd.randrange(50, 100) / 100, rnd.choice(["regex", "gliner", "spacy"]), s, s + rnd.randrange(1, 9), False, i % 9) for i in range(360) for s in [rnd.randrange(24)]]
    spans = spark.createDataFrame(rows, schema)
    flat_row = lambda r: tuple(tuple(v) if isinstance(v, list) else v for v in r)
    every = {(r.entity_type, flat_row(r)) for r in fuse(spans).collect()}
    for types in (SEMANTIC, ("PERSON",), ("NIP",), ("COMPANY", "PHONE")):
        names = {"COMPANY": "ORG"}
        assert {flat_row(r) for r in fuse(spans, types=types).collect()} == {r for t, r in every if t in [names.get(x, x) for x in types]}


def test_reinjection(spark):
    schema = "doc_id bigint, segment_id string, container_id string, section_id string, page_index int, text string"
    base = [(1, "a", "body:p:1", None, 0, "x [NIP_1] y [NIP_2]"), (1, "b", "body:p:2", None, None, "z [KRS_1]"), (1, "c", "body:p:3", "s", 1, "only [PESEL_1] here today")]
    t = spark.createDataFrame(base, schema).withColumn("refs", F.regexp_extract_all("text", F.lit(analytics.PLACEHOLDER), F.lit(0)))
    vault = spark.createDataFrame([(1, s, p, 0, 1, "h") for s, p in (("a", "[NIP_1]"), ("a", "[NIP_2]"), ("b", "[KRS_1]"), ("c", "[PESEL_1]"))], "doc_id bigint, segment_id string, placeholder string, start int, stop int, original_value_hash string")

    def outcome(edited, fuzzy=True, entries=vault):
        c, d = conflicts_and_decisions(t, spark.createDataFrame(edited, schema), entries, fuzzy=fuzzy)
        return {(r.segment_id, r.placeholder, r.reason) for r in c.collect()}, {(r.segment_id, r.placeholder, r.decision_reason) for r in d.collect()}, plan_status(t, c, d).first().status

    conflicts, decisions, status = outcome(base)
    assert not conflicts and len(decisions) == 4 and status == "ready"
    edited = [(1, "a", "other", None, 0, "x [NIP_2] y [NIP_1]"), (1, "b", "body:p:2", None, 0, "[KRS_1] [KRS_1] [ORG_9]"), (1, "new", "body:p:7", "s", 1, "only  [PESEL_1] here today!")]
    conflicts, decisions, status = outcome(edited)
    assert conflicts == {
        ("a", None, "container_mismatch"), ("a", None, "placeholder_reordered"), ("b", "[KRS_1]", "placeholder_duplicated"), ("b", "[ORG_9]", "placeholder_drift"),
        ("b", "[ORG_9]", "placeholder_duplicated"),
    }
    assert decisions == {("c", "[PESEL_1]", "fuzzy_anchored_segment_match")}
    assert status == "fail_closed"
    conflicts, _, _ = outcome(edited[:2], fuzzy=False, entries=vault.filter("false"))
    assert ("c", None, "missing_segment") in conflicts
    conflicts, _, _ = outcome(base, entries=vault.filter("segment_id = 'a'"))
    assert conflicts == {("b", "[KRS_1]", "missing_vault_entry"), ("c", "[PESEL_1]", "missing_vault_entry")}


def test_reinjection_computes_each_join_once(spark):
    schema = "doc_id bigint, segment_id string, container_id string, section_id string, page_index int, text string"
    t = spark.createDataFrame([(1, "a", "body:p:1", None, 0, "x [NIP_1]"), (1, "b", "body:p:2", None, 0, "a longer text z [NIP_1]"), (2, "a", None, None, None, "[KRS_1]")], schema)
    t = t.withColumn("refs", F.regexp_extract_all("text", F.lit(analytics.PLACEHOLDER), F.lit(0)))
    entries = [(2, "a", "[KRS_1]", 5, 9, "y"), (2, "a", "[KRS_1]", 0, 1, "h"), (2, None, "[KRS_1]", 0, 1, "h")]
    vault = spark.createDataFrame(entries, "doc_id bigint, segment_id string, placeholder string, start int, stop int, original_value_hash string")
    edited = spark.createDataFrame([(1, "a", "body:p:1", None, 0, "x [NIP_1]"), (1, "c", "body:p:9", None, 0, "a longer text z [NIP_1]!"), (2, "a", None, None, None, "[KRS_1]")], schema)
    conflicts, decisions = conflicts_and_decisions(t, edited, vault)
    # one placeholder of two segments stands in another segment as well; an entry that repeats counts once, the first of them
    assert {tuple(r) for r in conflicts.collect()} == {(1, "a", "[NIP_1]", "segment_split"), (1, "b", "[NIP_1]", "segment_split")}
    assert [tuple(r) for r in decisions.collect()] == [(2, "a", "[KRS_1]", "exact_segment_match", 0, 1, "h")]
    # what follows reads rows that are kept: no join or shuffle is left in its plan
    for df in (conflicts, decisions):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_bound_of_the_ratio(spark):
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice("aab ż😀c") for _ in range(rnd.randrange(12)))
    pairs = [(text(), text()) for _ in range(300)] + [("same", "same"), ("", ""), ("", "x")]
    pairs += [(a, a[1:] + rnd.choice(["", "x"])) for a, _ in pairs[:100]]
    rows = spark.createDataFrame(pairs, "x string, y string")
    joined = lambda t: " ".join(t.split()).lower()
    for r in with_ratio(rows.withColumn("bound", ratio_bound(flat(F.col("x")), flat(F.col("y")))), "x", "y").collect():
        true = SequenceMatcher(None, joined(r.x), joined(r.y)).ratio()
        assert r.bound >= true - 1e-9 and r.ratio == (true if r.bound >= 0.8 else 0.0)


def test_leaks_in_joined_segments(spark):
    segments = spark.createDataFrame([(1, 0, "s0", "był Jan"), (1, 1, "s1", "Kowalski tu, NIP"), (1, 2, "s2", None)], "doc_id int, i int, segment_id string, text string")
    surfaces = spark.createDataFrame([(1, "Jan Kowalski", None), (1, "NIP", None), (1, "Jan  Kowalski", "s1")], "doc_id int, raw_text string, segment_id string")
    found = {(r.segment_id, r.raw_text) for r in analytics.leaks(segments, surfaces, order="i").collect()}
    assert found == {(None, "Jan Kowalski"), ("s1", "NIP")}


def test_chain_over_ranges(spark):
    import hashlib

    rows, before = [], None
    for i in range(40):
        text = "\n".join([f"A{i:02}", "anonymize", "m", "i", "o", f"{i:03}", before or ""])
        own = hashlib.sha256(text.encode()).hexdigest()
        rows.append((f"A{i:02}", "anonymize", "m", "i", "o", f"{i:03}", before, own))
        before = own
    schema = "audit_id string, operation string, mode string, input_hash string, output_hash string, created_at string, previous_audit_hash string, audit_chain_hash string"
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert {(r.self_ok, r.linked) for r in analytics.verified_chain(df).collect()} == {(True, True)} and latest_hash(df) == before
    assert sorted(r.audit_id for r in analytics.verified_chain(df.filter("audit_id <> 'A20'")).filter("not linked").collect()) == ["A21"]


def test_chain_is_written_in_ranges(spark, tmp_path):
    rows = [(f"A{i:03}", "anonymize", None, "i", "o", f"{i // 2:03}") for i in range(500)]
    records = spark.createDataFrame(rows, "audit_id string, operation string, mode string, input_hash string, output_hash string, created_at string").repartition(3)
    path = str(tmp_path / "chain")
    chain = analytics.write_chain(records.filter("audit_id < 'A400'"), path, size=60)
    assert {(r.self_ok, r.linked) for r in analytics.verified_chain(chain).collect()} == {(True, True)}
    more = analytics.write_chain(records.filter("audit_id >= 'A400'"), path, latest_hash(chain), size=60)
    whole = spark.read.parquet(f"{path}/*/*")
    assert whole.count() == 500 and {(r.self_ok, r.linked) for r in analytics.verified_chain(whole).collect()} == {(True, True)}
    assert more.orderBy("audit_id").first().previous_audit_hash == latest_hash(chain)
    assert whole.filter("previous_audit_hash is null").count() == 1
    assert analytics.write_chain(records.filter("false"), path).count() == 0


def test_leaks_against_all_pairs(spark):
    rnd = random.Random(9)
    words = ["Jan", "jan", "Nowak", "a.b@c.pl", "ul.", "5", "(x)", "É", "é", "foo_bar", "-", "łódź", "ŁÓDŹ", "x"]
    some = lambda n: rnd.choice(["", " ", "  ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, n))) + rnd.choice(["", ".", " "])
    segments = [(rnd.choice([1, 2, None]), f"s{i}", some(8) if rnd.random() < 0.95 else None) for i in range(200)]
    surfaces = list({(rnd.choice([1, 2, None]), some(2), rnd.choice([None, None, f"s{i}"])) for i in range(150)})

    def holds(text, surface, edge):
        # white space as Java has it: these texts have none but ASCII
        parts = surface.split()
        return bool(parts) and re.search(f"(?<!{edge})" + r"\s+".join(map(re.escape, parts)) + f"(?!{edge})", text) is not None

    norm = lambda t: re.sub(r"[^\w\s]", "", t.lower())
    want = {}
    for key, seg, text in segments:
        for of, raw, only in surfaces:
            if key == of and only in (None, seg):
                both = holds(text or "", raw, r"[\w@._-]"), holds(norm(text or ""), norm(raw), r"\w")
                if any(both):
                    want[key, seg, raw] = both
    found = analytics.leaks(spark.createDataFrame(segments, "doc_id int, segment_id string, text string"), spark.createDataFrame(surfaces, "doc_id int, raw_text string, segment_id string"))
    assert len(want) > 50 and {(r.doc_id, r.segment_id, r.raw_text): (r.exact, r.normalised) for r in found.collect()} == want


def test_stores(spark, tmp_path):
    path = str(tmp_path / "vaults")
    rows = spark.createDataFrame([("V1", None, "2999-01-01T00:00:00+00:00"), ("V2", "x", "2001-01-01T00:00:00+00:00")], "vault_id string, v string, expires_at string")
    save(rows, path, "key", "vault_id")
    assert [tuple(r) for r in load(spark, path, "key", "vault_id").collect()] == [tuple(r) for r in rows.collect()]
    assert load(spark, path, "key", "vault_id", "V1", "expires_at").count() == 1
    for key, wanted, expires in (("other", "V1", None), ("key", "V2", "expires_at")):
        with pytest.raises(SealError):
            load(spark, path, key, "vault_id", wanted, expires)
    save(rows.filter("vault_id = 'V2'").withColumn("v", F.lit("y")), path, "key", "vault_id")
    assert [r.v for r in load(spark, path, "key", "vault_id").collect()] == [None, "y"]
    delete(spark, path, "vault_id", "V2")
    delete(spark, path, "vault_id", "V2")
    assert [r.vault_id for r in load(spark, path, "key", "vault_id").collect()] == ["V1"]
    delete(spark, path, "vault_id", "V1")
    delete(spark, str(tmp_path / "none"), "vault_id", "V1")
    with pytest.raises(FileNotFoundError):
        load(spark, path, "key", "vault_id")


def test_a_store_has_few_folders_and_one_record_is_read_from_one(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(20_000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    save(rows, path, "key", "id", buckets=8)
    save(rows.filter("id < 10").withColumn("v", F.lit("new")).unionByName(spark.createDataFrame([(-1, "more")], "id bigint, v string")), path, "key", "id", buckets=99)
    assert len([x for x in (tmp_path / "many").iterdir() if x.name.startswith("_of=")]) == 8
    assert load(spark, path, "key", "id").count() == 20_001
    one = load(spark, path, "key", "id", 7)
    assert [r.v for r in one.collect()] == ["new"] and load(spark, path, "key", "id", 11).first().v == "v11"
    scan_ = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\(_of#\d+ = \d+\)\], PushedFilters", scan_)


def test_signature_is_hmac(spark):
    import hashlib
    import hmac

    row = spark.range(1).select(*[signature(F.lit('{"a":"ż"}'), k).alias(f"k{len(k)}") for k in ("key", "k" * 100)]).first()
    assert [row.k3, row.k100] == [hmac.new(k.encode(), '{"a":"ż"}'.encode(), hashlib.sha256).hexdigest() for k in ("key", "k" * 100)]


def test_seals(spark):
    rows = sealed(spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), "key", ["k", "v"])
    assert must_open(rows, "key", ["k", "v"]).count() == 2
    assert {r.problem for r in opened(rows, "other", ["k", "v"]).collect()} == {"tampered"}
    with pytest.raises(SealError):
        must_open(rows.withColumn("v", F.lit("y")), "key", ["k", "v"])
    with pytest.raises(ValueError):
        sealed(rows, "", ["k"])


def test_kernel_holds_a_few_rows_as_objects(spark):
    import tracemalloc

    import pyarrow as pa

    listed = pa.array([[{"surface": f"surface {i} {k}", "telling": False} for k in range(40)] for i in range(4000)])
    run = mentions._kernel(lambda x: [len(x)], "array<int>", 1).func
    tracemalloc.start()
    out = run(listed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [[40]] * 4000
    assert peak < 8e6
    assert run(listed.slice(0, 0)).to_pylist() == [] and run(pa.array([None, [1]])).to_pylist() == [[], [1]]


def test_each_range_of_a_chain_reads_its_own_rows(spark, tmp_path, monkeypatch):
    columns = [c for c in analytics.CHAINED[:-1]]
    records = spark.range(40).select(*[F.format_string("%05d", F.col("id")).alias(c) for c in columns])
    kind, read = type(records), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: read.append(self.count() if self.inputFiles() else None) or real(self, *a, **k))
    chain = analytics.write_chain(records, str(tmp_path / "chain"), size=10)
    assert chain.count() == 40 and len(read) > 1 and None not in read and sum(read) == 40
