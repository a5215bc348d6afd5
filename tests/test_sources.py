import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilcraft.functions.rules import Rule
from veilcraft.operators.anonymize import anonymize_segments
from veilcraft.operators.fuse import fuse
from veilcraft.operators.scan import scan
from veilcraft.sources import catalogue, files
from veilcraft.sources import reviews
from veilcraft.sources.files import artifact_path, docx_differences, docx_segments, json_leaves, labelled_corpus, listed, package_checks, package_segments, text_segments, xml_leaves
from veilcraft.sources.models import model_spans
from veilcraft.streaming.redact import redact_segments_stream, redact_stream, windowed_findings

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(paragraphs=("one", "", "two"), table=True, section=True, parts=("word/styles.xml", "word/media/a.png"), relationship="officeDocument"):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(map(p, paragraphs)) + (f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>" if table else "") + ("<w:sectPr/>" if section else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('head')}</w:hdr>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://x/{relationship}"/></Relationships>')
        for part in parts:
            z.writestr(part, "x")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package())
    rows = {r.segment_id: r.text for r in docx_segments(spark, str(tmp_path)).collect()}
    assert rows == {"body:p:0": "one", "body:p:2": "two", "table:0:r:0:c:0:p:0": "cell", "header:0:p:0": "head"}
    cases = {
        "same": (package(), []),
        "lost": (package(("one",) * 6, False, False, ("word/styles.xml",), "other"), [
            "Paragraph count changed beyond tolerance.", "DOCX table count changed unexpectedly.", "lost package part: word/document.xml w:sectPr",
            "lost package part: word/media/a.png", "lost package relationship: officeDocument",
        ]),
    }
    schema = "path string, content binary"
    before = spark.createDataFrame([(k, bytearray(package())) for k in [*cases, "gone", "broken"]], schema)
    after = spark.createDataFrame([*((k, bytearray(v)) for k, (v, _) in cases.items()), ("broken", bytearray(b"no zip"))], schema)
    got = {r.path: r for r in docx_differences(before, after).collect()}
    for k, (_, errors) in cases.items():
        assert got[k].errors == errors and got[k].passed == (not errors)
    assert got["gone"].errors == ["package missing"] and not got["broken"].passed


def test_texts_and_corpora(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("zażółć\nline")
    (tmp_path / "t" / "b.txt").write_text("")
    assert [(r.segment_id, r.stop, r.text) for r in text_segments(spark, str(tmp_path / "t")).collect()] == [("text:0", 11, "zażółć\nline")]
    corpus = {"samples": [{"id": "s", "text": "NIP 1", "entities": [{"type": "NIP", "text": "1"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1))
    samples, entities = labelled_corpus(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in samples.collect()] == [("s", "NIP 1")] and [tuple(r) for r in entities.collect()] == [("s", 0, "NIP", "1")]


def test_packages_that_cannot_be_read_do_not_stop_others(spark):
    rows = spark.createDataFrame([("a", package()), ("b", b"no package"), ("c", None), ("d", package()[:60])], "path string, content binary")
    assert {r.path for r in package_segments(rows).collect()} == {"a"}
    assert {r.path: r.reason is None for r in package_checks(rows).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_catalogue(spark, tmp_path):
    rules = catalogue.default_rules(spark)
    assert len(catalogue.load_rules(rules)) == 41 and len(catalogue.load_rules(rules, {"NIP"})) == 2
    badge = Rule("badge", r"\bBDG-\d{4}\b", "identity", "always_true", 0.9, False, 5, "badge")
    with pytest.raises(ValueError):
        catalogue.add_rule(rules, badge)
    more, rule_id = catalogue.add_rule(rules, badge, new_type=True)
    assert rule_id == 42 and catalogue.load_rules(more)[0].entity_type == "BADGE"
    assert len(catalogue.load_rules(catalogue.disable_rule(more, 4))) == 41
    with pytest.raises(ValueError):
        catalogue.disable_rule(more, 99)
    for bad in (r"(x", r"a(?<entity>b)+", r"x(?<lead>y)"):
        with pytest.raises(ValueError):
            catalogue.add_rule(more, badge._replace(pattern=bad), new_type=True)
    catalogue.export_rules(more, str(tmp_path / "rules"))
    again, n = catalogue.import_rules(rules, str(tmp_path / "rules"))
    assert n == 1 and again.count() == 42
    docs = spark.createDataFrame([(1, "karta BDG-1234")], "doc_id bigint, text string")
    assert [r.raw_text for r in scan(docs, rules=catalogue.load_rules(more, {"BADGE"})).collect()] == ["BDG-1234"]


def test_catalogue_with_types_goes_there_and_back(spark, tmp_path):
    rules, types = catalogue.default_rules(spark), catalogue.default_types(spark)
    assert types.count() == 40 and catalogue.add_type(types, "nip", "again")[1] is False
    with pytest.raises(ValueError):
        catalogue.add_type(types, "  ", "nameless")
    types, new = catalogue.add_type(types, " badge ", "badges")
    badge = Rule("BADGE", r"\bB:(?<entity>\d{4})\b", "identity", "always_true", 0.9, False, 5, "badge")
    more, rule_id = catalogue.add_rule(rules, badge, new_type=True)
    more = catalogue.disable_rules(more, [4, rule_id])
    path = str(tmp_path / "both")
    catalogue.export_catalogue(more, types, path)
    (text,) = spark.read.text(path, wholetext=True).first()
    data = json.loads(text)
    assert new and {"BADGE", "NIP"} <= {t["entity_type"] for t in data["entity_types"]} and len(data["rules"]) == 42
    assert data["rules"][-1] == {
        "rule_id": 42, "entity_type": "BADGE", "pattern_text": r"\bB:(?P<entity>\d{4})\b", "normalizer_name": "identity", "validator_name": "always_true", "confidence": 0.9,
        "context_required": False, "priority": 5, "enabled": False, "description": "badge",
    }
    again, known, n = catalogue.import_catalogue(rules, catalogue.default_types(spark), path)
    assert n == 1 and known.count() == 41 and [(r.rule_id, r.enabled, r.pattern) for r in again.filter("entity_type = 'BADGE'").collect()] == [(42, False, badge.pattern)]
    only, known, n = catalogue.import_catalogue(rules, catalogue.default_types(spark), path, replace=True)
    assert n == 42 and known.count() == 41 and len(catalogue.load_rules(only)) == 40
    docs = spark.createDataFrame([(1, "NIP: 856 734 62 15; KRS 0000 1234 56; jan@b.pl")], "doc_id bigint, text string")
    found = lambda r: sorted(x.raw_text for x in scan(docs, rules=catalogue.load_rules(r)).collect())
    assert found(only) == found(rules)
    (tmp_path / "odd.json").write_text(json.dumps({"entity_types": [], "rules": [data["rules"][-1]]}, indent=1))
    with pytest.raises(ValueError, match="unknown entity type"):
        catalogue.import_catalogue(rules, catalogue.default_types(spark), str(tmp_path / "odd.json"))


def test_new_defaults_are_merged_in(spark):
    rules = catalogue.default_rules(spark)
    mine, own_id = catalogue.add_rule(rules, Rule("NIP", r"\bN-\d{4}\b", "identity", "always_true", 0.9, False, 5, "mine"))
    mine = catalogue.disable_rules(mine, [4])
    shown = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert shown(catalogue.bootstrap(mine).select(*mine.columns)) == shown(mine)
    # a catalogue of an older release: one rule is missing, one has another pattern, one isn't shipped any more
    older = mine.filter("rule_id <> 3").withColumn("pattern", F.when(F.col("rule_id") == 5, "old").otherwise(F.col("pattern")))
    older = older.unionByName(mine.filter("rule_id = 7").withColumn("rule_id", F.lit(70)).withColumn("description", F.lit("no longer shipped")))
    merged = {r.rule_id: r for r in catalogue.bootstrap(older).collect()}
    assert merged[5].pattern == rules.filter("rule_id = 5").first().pattern and not merged[4].enabled and merged[own_id].description == "mine"
    assert 3 not in merged and 70 not in merged and merged[71].description == rules.filter("rule_id = 3").first().description and len(merged) == 42
    assert catalogue.bootstrap(rules.filter("false")).count() == 41


def test_model_candidates(spark):
    docs = spark.createDataFrame([(1, "Zenek spotkał ACME"), (2, None)], "doc_id bigint, text string")

    def load():
        return lambda texts: [[("person", 0, 5, 0.8), ("organization", 14, 18, None), ("city", 0, 1, 0.1)] for _ in texts]

    spans = model_spans(docs, load, "gliner")
    assert {(r.entity_type, r.raw_text, r.confidence) for r in spans.collect()} == {("PERSON", "Zenek", 0.8), ("ORG", "ACME", 0.65)}
    assert fuse(scan(docs, {"NIP"}).unionByName(spans)).count() == 2
    pages = model_spans(docs, lambda: lambda texts: [[("org", 14, 18, 0.1), ("org", 5, 6, 0.9)] for _ in texts], "spacy", fixed=0.75)
    assert [(r.raw_text, r.confidence) for r in pages.collect()] == [("ACME", 0.75)]


def test_reviews(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.yaml").write_text('prompt_id: "review"\nversion: "1"\ntemplate: |\n  {"w": {{ text_window | tojson }}, "n": {{n}}}\nother: 1\n')
    template = reviews.prompt_templates(spark, str(tmp_path)).first()
    assert template.prompt_id == "review"
    row = spark.range(1).select(reviews.rendered(template.template, text_window=F.lit('a"b\n'), n=F.lit(3)).alias("p")).first()
    assert json.loads(row.p) == {"w": 'a"b\n', "n": 3}
    with pytest.raises(KeyError):
        reviews.rendered("{{ other }}", text_window=F.lit(""))
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "E", "ORG", "x", 0, 1, 0.5)], "doc_id int, entity_id string, entity_type string, raw_text string, start int, stop int, confidence double")
    ask = lambda answer: lambda prompt: F.when(F.length(prompt) < 4200, F.lit(answer))
    run = lambda answer: reviews.suggestions(docs, spans, ask(answer), "{{ text_window }}{{ entities | tojson }}", ["ORG"]).collect()
    assert [(r.entity_id, r.action) for r in run('ok {"suggestions": [{"entity_id": "E", "action": "keep", "reason": "{}"}]} .')] == [("E", "keep")]
    for bad in ("nothing", "{broken}", '{"suggestions": [{"entity_id": "E", "action": "burn"}]}'):
        with pytest.raises(Exception, match="(?i)no JSON|malformed|suggestion"):
            run(bad)
    segments = docs.withColumn("segment_id", F.lit("s"))
    found = reviews.verifications(segments, lambda p: F.lit('{"suspected_leaks": ["x"], "verified_segment_ids": ["s"]}'), "{{ segments | tojson }}", ["ORG"]).first()
    assert found.suspected_leaks == ["x"] and found.verified_segment_ids == ["s"] and found.warnings is None


def test_small_parts(spark):
    row = spark.createDataFrame([('{"a": [1, {"b": null}], "c": "x"}', '<a k="1"> <b>x</b><c/></a>', "a,,b", "no")], "j string, x string, l string, n string")
    got = row.select(json_leaves("j").alias("j"), xml_leaves(F.col("x")).alias("x"), listed(F.col("l")).alias("l"), json_leaves("n").alias("n")).first()
    assert (got.j, got.x, got.l, got.n) == (3, 2, ["a", "b"], None)
    assert artifact_path("s3://b/", "vault", "V1") == "s3://b/vaults/V1.json" and artifact_path("/r", "anonymized", "A", ".docx") == "/r/anonymized/A.docx"


def test_xml_leaves_are_those_of_xpath(spark):
    texts = [
        '<a k="1"> <b>x</b><c/></a>', "<a>x<!-- c -->y<?p i?>z</a>", "<a>x<![CDATA[ y ]]>z<![CDATA[  ]]></a>", '<a xmlns="u" xmlns:p="v" p:k="1" k="2" xml:lang="pl"/>', '<a p:k="1"/>', "<a>\u00a0</a>",
        '<!DOCTYPE a [<!ENTITY e "<b>q</b>"><!ATTLIST a d CDATA "def">]><a>&e; x</a>', '<!-- c --><a k="&amp;">&#10;&#32;\r\n</a>', '<?xml version="1.1"?><a>x&#1;</a>', f"<a>{'ab ' * 20000}</a>", "", None,
    ]
    by_path = F.size(F.xpath("t", F.lit("//text()[normalize-space()]"))) + F.size(F.xpath("t", F.lit("//@*")))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", xml_leaves(F.col("t")).alias("n"), by_path.alias("want"))
    got = rows.collect()
    assert [r.n for r in got] == [r.want for r in got] and got[0].n == 2
    # XPath refused what stands before the first tag here; one pass over a text, by expat, takes it
    assert spark.createDataFrame([("\ufeff<a>x</a>",)], "t string").select(xml_leaves(F.col("t"))).first()[0] == 1


def test_stream(spark, tmp_path):
    rows = [(1, "mail a@b.com", "2024-01-01 00:01:00"), (2, "none", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    redact_stream(stream.select("doc_id", "text"), str(tmp_path / "out"), str(tmp_path / "state"), types={"EMAIL"}).awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"mail [EMAIL_1]", "none"}
    got = windowed_findings(df, "ts", types={"EMAIL"}).first()
    assert (got.texts, got.with_spans, got.spans) == (2, 1, 1)


def test_documents_that_go_on_over_micro_batches(spark, tmp_path):
    parts = [
        [("d", 0, "Klient: Jan Kowalski, a@b.pl"), ("e", 0, "mail x@y.pl"), (None, 0, "Klient: Jan Nowak, n@o.pl")],
        [("d", 1, "Kowalski pisał z c@d.pl. Klient: Anna Nowak"), ("d", 2, None)],
        [("d", 3, "Nowak i Kowalskiego widziano, e@f.pl i a@b.pl"), ("f", 0, "g@h.pl"), ("e", 1, "potem z@y.pl")],
    ]
    schema = "k string, o int, text string"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    places = [str(tmp_path / x) for x in ("out", "state", "check")]
    redact_segments_stream(stream, "k", "o", *places, types={"EMAIL", "PERSON"}).awaitTermination(300)
    got = {(r.k, r.o, r.text) for r in spark.read.parquet(f"{places[0]}/*").collect()}
    whole = spark.createDataFrame([r for rows in parts for r in rows], schema)
    want = {(r.k, r.o, r.text) for r in anonymize_segments(whole, "k", "o", types={"EMAIL", "PERSON"}).collect()}
    assert got == want and ("d", 3, "[OSOBA_2] i [OSOBA_1] widziano, [EMAIL_3] i [EMAIL_4]") in got
    assert sorted(x.name for x in (tmp_path / "state").iterdir()) == ["batch=1", "batch=2"]


def test_packages_are_taken_in_bounded_parts(spark):
    import pandas as pd

    sizes = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(sizes)
    packages = spark.range(3000).selectExpr("CAST(id AS STRING) AS path", "CAST('no package' AS BINARY) AS content").coalesce(1)
    seen = files.over_packages(packages, lambda parts: (pd.DataFrame({"n": [len(b)]}) for b in parts), "n int").collect()
    assert sum(r.n for r in seen) == 3000 and max(r.n for r in seen) <= 64
    assert int(spark.conf.get(sizes)) <= 1000
    assert files.package_checks(packages).filter("reason is null").count() == 0
