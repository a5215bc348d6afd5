"""Spans, names and edited segments made from keys of the test tables, with outcomes stated by hand or folded in SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import REL, W, over_packages

# --- spans of several detectors ------------------------------------------------------------------

_MADE = {
    "doc_id": "l_orderkey", "entity_id": "CONCAT('E', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20)))",
    "given_type": "CASE l_partkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'ADDRESS' WHEN 3 THEN 'PHONE' ELSE 'NIP' END",
    "entity_type": "CASE l_partkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'ADDRESS' WHEN 3 THEN 'PHONE' ELSE 'NIP' END",
    "raw_text": "CONCAT('raw ', CAST(l_partkey % 100 AS VARCHAR(20)))", "confidence": "round(CAST(0.5 AS DOUBLE) + l_discount * 5, 2)",
    "source_detector": "CASE l_suppkey % 4 WHEN 0 THEN 'regex' WHEN 1 THEN 'gliner' WHEN 2 THEN 'spacy' ELSE 'other' END",
    "p": "CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END", "start": "CAST(l_partkey % 24 AS BIGINT)", "stop": "CAST(l_partkey % 24 + 3 + l_suppkey % 9 AS BIGINT)",
    "context_required": "l_tax > 0.04", "section_id": "CASE WHEN l_suppkey % 5 = 0 THEN 'b' ELSE 'a' END", "page_index": "CASE WHEN l_partkey % 7 > 0 THEN 1 END", "rule_seq": "l_linenumber",
    "names": "CASE WHEN l_linenumber > 1 AND l_partkey % 6 = 0 AND l_suppkey % 3 = 0 THEN CONCAT('E', CAST(l_orderkey AS VARCHAR(20)), '_1') END",
}
#: Lines of an order that share a number are one.
_LINES = {c: f"min({c})" for c in ("l_partkey", "l_suppkey", "l_discount", "l_tax")}
MADE_SQL = (
    "m AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _MADE.items())
    + " FROM (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {k}" for k, v in _LINES.items()) + " FROM lineitem GROUP BY l_orderkey, l_linenumber))"
)


def _made(lineitem: DataFrame) -> DataFrame:
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.expr(v).alias(k) for k, v in _LINES.items()])
    return lines.selectExpr(*[f"{v.replace('VARCHAR(20)', 'STRING')} AS {k}" for k, v in _MADE.items()])


def made_spans(lineitem: DataFrame) -> DataFrame:
    """Spans of several detectors, types, sections and pages that overlap now and then; their types aren't canonical yet."""
    return _made(lineitem).drop("entity_type", "p", "names").withColumnRenamed("given_type", "entity_type").withColumn("normalized_text", F.col("raw_text"))


def named_spans(lineitem: DataFrame) -> DataFrame:
    """``made_spans``, of which some name the person of their order's first line."""
    return _made(lineitem).drop("given_type", "p").withColumnRenamed("names", "canonical_entity_id").withColumn("normalized_text", F.col("raw_text"))


_PLACES = "start, stop DESC, confidence DESC, p, rule_seq"
_MEETS = "x.a < o.stop AND o.start < x.b"

#: Overlapping spans of one type, folded in order: each meets the first chosen span that it overlaps.
FUSED_SQL = f"""
    WITH RECURSIVE {MADE_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY {_PLACES}) AS k FROM m WHERE entity_type IN ('PHONE', 'NIP')),
    f AS (
        SELECT doc_id, entity_type, k, [{{'id': entity_id, 'a': start, 'b': stop, 'c': confidence, 'd': source_detector, 'p': p, 'ds': [source_detector], 'n': 1::BIGINT}}] AS chosen FROM o WHERE k = 1
        UNION ALL
        SELECT doc_id, entity_type, k, CASE
            WHEN r = 0 THEN list_append(chosen, {{'id': entity_id, 'a': start, 'b': stop, 'c': confidence, 'd': source_detector, 'p': p, 'ds': [source_detector], 'n': 1::BIGINT}})
            WHEN CASE WHEN (old.d = 'regex') <> (source_detector = 'regex') THEN source_detector = 'regex'
                ELSE confidence > old.c + 0.05 OR confidence = old.c AND stop - start > old.b - old.a OR abs(confidence - old.c) < 0.01 AND p < old.p END
            THEN list_append(list_filter(chosen, lambda x: x.id <> old.id), {{'id': entity_id, 'a': start, 'b': stop, 'c': confidence, 'd': source_detector, 'p': p, 'ds': ds, 'n': len(ds)}})
            ELSE list_transform(chosen, lambda x: CASE WHEN x.id = old.id THEN {{'id': x.id, 'a': x.a, 'b': x.b, 'c': x.c, 'd': x.d, 'p': x.p, 'ds': ds, 'n': len(ds)}} ELSE x END) END
        FROM (SELECT *, chosen[r] AS old, list_sort(list_distinct(list_append(list_append(chosen[r].ds, source_detector), chosen[r].d))) AS ds FROM (
            SELECT f.chosen, o.*, coalesce(list_position(list_transform(f.chosen, lambda x: {_MEETS}), true), 0) AS r
            FROM f JOIN o ON f.doc_id = o.doc_id AND f.entity_type = o.entity_type AND o.k = f.k + 1)))
    SELECT doc_id, entity_type, s.id AS entity_id, s.c AS confidence, s.n::INT AS support_count, array_to_string(s.ds, ',') AS detectors
    FROM (SELECT doc_id, entity_type, unnest(chosen) AS s FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id, entity_type))"""

_RANK_SQL = "CASE entity_type WHEN 'ADDRESS' THEN 3 WHEN 'PHONE' THEN 1 ELSE 2 END"
#: All spans of a document, folded in order: of two that overlap in one section and page the weightier stays.
RESOLVED_SQL = f"""
    WITH RECURSIVE {MADE_SQL},
    w AS (SELECT *, {_RANK_SQL} AS rank, coalesce(page_index, -1) AS page FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, confidence DESC, stop, rule_seq, entity_id) AS k FROM w),
    f AS (
        SELECT doc_id, k, [{{'id': entity_id, 'a': start, 'b': stop, 'w': {{'x': context_required, 'r': rank, 'c': confidence, 'n': length(raw_text)}}, 's': section_id, 'p': page}}] AS chosen,
            []::STRUCT(id VARCHAR, winner VARCHAR)[] AS lost FROM o WHERE k = 1
        UNION ALL
        SELECT doc_id, k, CASE WHEN r = 0 THEN list_append(chosen, new) WHEN new.w > old.w THEN list_append(list_filter(chosen, lambda x: x.id <> old.id), new) ELSE chosen END,
            CASE WHEN r = 0 THEN lost WHEN new.w > old.w THEN list_append(lost, {{'id': old.id, 'winner': new.id}}) ELSE list_append(lost, {{'id': new.id, 'winner': old.id}}) END
        FROM (SELECT *, chosen[r] AS old FROM (
            SELECT o.doc_id, o.k, f.chosen, f.lost,
                {{'id': o.entity_id, 'a': o.start, 'b': o.stop, 'w': {{'x': o.context_required, 'r': o.rank, 'c': o.confidence, 'n': length(o.raw_text)}}, 's': o.section_id, 'p': o.page}} AS new,
                coalesce(list_position(list_transform(f.chosen, lambda x: {_MEETS} AND x.s = o.section_id AND x.p = o.page), true), 0) AS r
            FROM f JOIN o ON f.doc_id = o.doc_id AND o.k = f.k + 1))),
    e AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id))
    SELECT doc_id, s.id AS entity_id, NULL::VARCHAR AS beaten_by FROM (SELECT doc_id, unnest(chosen) AS s FROM e)
    UNION ALL SELECT doc_id, s.id, s.winner FROM (SELECT doc_id, unnest(lost) AS s FROM e)"""

#: Persons count by their places, spans that name one as that one does (the next number where it is gone), others by type.
ORDINALS_SQL = f"""
    WITH {MADE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, rule_seq, entity_id, confidence DESC) AS place FROM m),
    s AS (SELECT doc_id, entity_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM o WHERE entity_type = 'PERSON' AND names IS NULL),
    c AS (SELECT doc_id, count(*) AS seeds FROM s GROUP BY doc_id)
    SELECT doc_id, entity_id, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY place) AS ordinal FROM o WHERE entity_type <> 'PERSON' AND confidence >= 0.6
    UNION ALL SELECT doc_id, o.entity_id, coalesce(s.n, coalesce(seeds, 0) + 1) FROM o LEFT JOIN c USING (doc_id)
        LEFT JOIN s ON s.doc_id = o.doc_id AND s.entity_id = coalesce(o.names, o.entity_id) WHERE entity_type = 'PERSON' AND confidence >= 0.6"""

# --- names and their mentions --------------------------------------------------------------------

#: Texts piece by piece: (surface, what it is, keys of the person): a seed, a mention by a rule with the place of its seed, or None.
NAMES: list[list[tuple]] = [
    [
        ("Klient: ",), ("Piotr Malec", "seed", "piotr", "malec"), (" podpisał. Potem „",), ("Piotr", "first_name_exact_unique", 1), ("”, ",), ("Piotra", "first_name_genitive_simple", 1), (", ",),
        ("Piotrowi", "first_name_dative_simple", 1), (", ",), ("Piotrem", "first_name_instrumental_simple", 1), (", ",), ("Malec", "surname_exact_unique", 1), (", ",),
        ("Malca", "surname_genitive_ec", 1), (", ",), ("P. Malec", "person_initial_surname_unique", 1), (", ",), ("pan Malec", "honorific_pan_surname_unique", 1), (", ",),
        ("Pan Malec", "honorific_pan_surname_unique_title", 1), (", konto ",), ("piotr", "contextual_account_phone_first_name", 1), (", Telefon ",), ("PIOTR", "contextual_account_phone_first_name", 1),
        (", piotr, Piotrowski",),
    ],
    [
        ("Klientka: ",), ("Ewa Wójcik", "seed", "ewa", "wójcik"), (", ",), ("Ewy", "first_name_genitive_feminine", 1), (", ",), ("Ewie", "first_name_dative_feminine", 1), (", ",),
        ("Ewę", "first_name_accusative_feminine", 1), (", ",), ("Wójcik", "surname_exact_unique", 1), (", Wójcika",),
    ],
    [
        ("Klient: ",), ("Paweł Lipski", "seed", "paweł", "lipski"), (", ",), ("Pawła", "first_name_genitive_el", 1), (", ",), ("Pawłowi", "first_name_dative_el", 1), (", ",),
        ("Pawłem", "first_name_instrumental_el", 1), (", ",), ("Lipskiego", "surname_genitive_ski", 1), (", ",), ("Lipskiemu", "surname_dative_ski", 1), (", ",), ("Lipskim", "surname_instrumental_ski", 1),
        (", ",), ("Lipskego", "surname_genitive_ski_short", 1), (", ",), ("panu Lipskiemu", "honorific_panu_surname_dative_ski", 1), (", ",), ("Panu Lipskiemu", "honorific_panu_surname_dative_ski_title", 1),
        (".",),
    ],
    [
        ("Klient: ",), ("Jan Kowalski", "seed", "jan", "kowalski"), (" oraz ",), ("Jan Nowak", "seed", "jan", "nowak"), ("; Jan, konto jan, ",), ("Kowalski", "surname_exact_unique", 1), (", ",),
        ("Nowak", "surname_exact_unique", 3), (".",),
    ],
    [
        ("Klient: ",), ("Adam Malec", "seed", "adam", "malec"), (" Pracownik: ",), ("Ewa Malec", "seed", "ewa", "malec"), (", ",), ("Adama", "first_name_genitive_simple", 1), (", ",),
        ("Ewy", "first_name_genitive_feminine", 3), (", Malec, Malca, ",), ("A. Malec", "person_initial_surname_unique", 1), (".",),
    ],
    [
        ("Klient: ",), ("Patryka Kowalskiego", "seed", "patryk", "kowalski"), (", potem ",), ("Patyrk Kowalski", "fuzzy_full_name_typo", 1), (", ",), ("Kowalskiego", "surname_exact_unique", 1), (", ",),
        ("Patryka", "first_name_exact_unique", 1), (", Patyrk Nowak.",),
    ],
    [
        ("Klient: ",), ("Lipski Jan", "seed", "lipski", "jan"), (", potem ",), ("Lipski Jan", "full_name_repeat", 1), (", ",), ("Lipski  Jan", "full_name_repeat", 1), (", Janowski, ",),
        ("Jan", "surname_exact_unique", 1), (".",),
    ],
    [
        ("Klient: ",), ("Marek Lipski", "seed", "marek", "lipski"), (", potem ",), ("Marka Lipskiego", "seed", "marek", "lipski"), (", ",), ("Marek", "first_name_exact_unique", 1), (", ",),
        ("Lipskim", "surname_instrumental_ski", 1), (".",),
    ],
    [("Umowa bez osób. Piotra, Malca.",)],
]


def _name_rows() -> str:
    rows = []
    for s, pieces in enumerate(NAMES):
        seeds = [i for i, p in enumerate(pieces) if p[1:2] == ("seed",)]
        for i, p in enumerate(pieces):
            kind, of = (p[1], i if p[1] == "seed" else p[2]) if len(p) > 1 else (None, None)
            text = lambda x: "NULL" if x is None else f"'{x}'"
            keys = pieces[of][2:] if of is not None else (None, None)
            rows.append(f"({s}, {i}, '{p[0]}', {text(kind)}, {'NULL' if of is None else of}, {'NULL' if of is None else seeds.index(of) + 1}, {text(keys[0])}, {text(keys[1])})")
    return ", ".join(rows)


_NAMES_SQL = f"""
    WITH p(s, i, surface, kind, seed, ordinal, first_key, surname_key) AS (VALUES {_name_rows()}),
    d AS (SELECT c_custkey AS doc_id, p.*, (c_custkey % 40 + 1 + coalesce(sum(length(surface)) OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
        'person-cluster-' || substr(sha1('person_cluster|' || first_key || '|' || surname_key), 1, 12) AS cluster FROM customer JOIN p ON c_custkey % {len(NAMES)} = s)"""
MENTIONS_SQL = f"""{_NAMES_SQL}
    SELECT m.doc_id, m.surface AS raw_text, m.start, m.start + length(m.surface) AS stop, m.kind AS mention_rule, m.cluster AS mention_cluster_id, 0.95::DOUBLE AS confidence,
        'ENT_' || substr(sha1('PERSON|' || z.surface || '|' || z.start || '|' || (z.start + length(z.surface))), 1, 12) AS canonical_entity_id,
        'ENT_' || substr(sha1('PERSON|' || m.cluster || '|' || m.surface || '|' || m.start || '|' || (m.start + length(m.surface))), 1, 12) AS entity_id
    FROM d m JOIN d z ON m.doc_id = z.doc_id AND m.seed = z.i WHERE m.kind <> 'seed'"""
REDACTED_SQL = f"""{_NAMES_SQL}
    SELECT doc_id, repeat('x', (doc_id % 40)::INT) || ' ' || string_agg(CASE WHEN kind IS NULL THEN surface ELSE '[OSOBA_' || ordinal || ']' END, '' ORDER BY i) AS text FROM d GROUP BY doc_id"""
COVERAGE_SQL = f"""{_NAMES_SQL}
    SELECT c_nationkey, count(DISTINCT doc_id) AS segments, count(DISTINCT doc_id) FILTER (kind IS NOT NULL) AS segments_with_detections,
        count(DISTINCT doc_id) FILTER (kind IS NOT NULL) AS segments_with_replacements, count(*) FILTER (kind = 'seed') AS seed_entities, count(*) FILTER (kind <> 'seed') AS expanded_mentions
    FROM d JOIN customer ON c_custkey = doc_id GROUP BY c_nationkey"""


def named_texts(customer: DataFrame) -> DataFrame:
    """c_nationkey, doc_id and text: for each customer one of the texts of NAMES behind some letters."""
    texts = F.array(*[F.lit("".join(p[0] for p in pieces)) for pieces in NAMES])
    key = F.col("c_custkey")
    front = F.concat(F.repeat(F.lit("x"), (key % 40).cast("int")), F.lit(" "))
    return customer.select("c_nationkey", key.alias("doc_id"), F.concat(front, F.get(texts, (key % len(NAMES)).cast("int"))).alias("text"))


# --- edited segments -----------------------------------------------------------------------------

#: What comes back of two segments: a ("value [NIP_1] and [KRS_1] end", container body:p:1) and b ("other [PESEL_1] here", body:p:2), each in section one on page 0.
#: Each line: edited segments (id, text, container, section, page) and outcomes (segment, placeholder or None, outcome).
_A, _B = ("a", "value [NIP_1] and [KRS_1] end", "body:p:1", "one", 0), ("b", "other [PESEL_1] here", "body:p:2", "one", 0)
_A_KEPT = [("a", "[NIP_1]", "exact_segment_match"), ("a", "[KRS_1]", "exact_segment_match")]
_B_KEPT = [("b", "[PESEL_1]", "exact_segment_match")]
EDITS: list[tuple[list, list]] = [
    ([_A, _B], _A_KEPT + _B_KEPT),
    ([("a", _A[1], "table:0:p:1", "one", 0), _B], [("a", None, "container_mismatch"), *_B_KEPT]),
    ([("a", _A[1], "body:p:1", "one", 4), _B], [("a", None, "page_index_mismatch"), *_B_KEPT]),
    ([("a", _A[1], "body:p:1", "two", 0), _B], [("a", None, "section_mismatch"), *_B_KEPT]),
    ([("a", "value [KRS_1] and [NIP_1] end", "body:p:1", "one", 0), _B], [("a", None, "placeholder_reordered"), *_B_KEPT]),
    ([("a", "value [NIP_1] and [KRS_1] [NIP_1] end", "body:p:1", "one", 0), _B], [("a", None, "placeholder_reordered"), ("a", "[NIP_1]", "placeholder_duplicated"), *_B_KEPT]),
    ([("a", "value and [KRS_1] end", "body:p:1", "one", 0), _B], [("a", "[NIP_1]", "placeholder_deleted"), *_B_KEPT]),
    ([("a", "value [NIP_1] and [KRS_1] [ORG_9] end", "body:p:1", "one", 0), _B], [("a", "[ORG_9]", "placeholder_drift"), ("a", "[ORG_9]", "placeholder_duplicated"), *_B_KEPT]),
    ([("a", "value [NIP_1] and [KRS_1] [PESEL_1] end", "body:p:1", "one", 0), _B], [("a", "[PESEL_1]", "segment_merge"), ("a", "[PESEL_1]", "placeholder_duplicated"), ("b", "[PESEL_1]", "segment_split")]),
    ([_A], [*_A_KEPT, ("b", None, "missing_segment")]),
    ([("a", "value [NIP_1] and [KRS_1] [PESEL_1] end", "body:p:1", "one", 0)], [("a", "[PESEL_1]", "segment_merge"), ("a", "[PESEL_1]", "placeholder_duplicated"), ("b", None, "segment_merge")]),
    (
        [("a", "value [NIP_1] and [KRS_1] [PESEL_1] end", "body:p:1", "one", 0), ("c", "[PESEL_1]", "table:0:p:1", "one", 0)],
        [("a", "[PESEL_1]", "segment_merge"), ("a", "[PESEL_1]", "placeholder_duplicated"), ("b", None, "segment_split")],
    ),
    ([_A, ("new", "Other  [PESEL_1] here", "body:p:9", "one", 0)], [*_A_KEPT, ("b", "[PESEL_1]", "fuzzy_anchored_segment_match")]),
    ([_A, ("new", "[PESEL_1] is all that was kept of what stood there", "body:p:9", "one", 0)], [*_A_KEPT, ("b", None, "low_confidence_match"), ("b", None, "segment_merge")]),
    (
        [_A, ("new", "other [PESEL_1] here!", "body:p:9", "one", 0), ("old", "other [PESEL_1] here?", "body:p:8", "one", 0)],
        [*_A_KEPT, ("b", None, "ambiguous_segment_match"), ("b", None, "segment_split")],
    ),
    ([_A, ("b", "other here", "body:p:2", "one", 0)], [*_A_KEPT, ("b", "[PESEL_1]", "placeholder_deleted")]),
]
#: In every fifth order the vault lacks [KRS_1].
_LACKING = 5


def _edit_rows() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({n}, '{s}', {quoted(p)}, '{o}')" for n, (_, outcomes) in enumerate(EDITS) for s, p, o in outcomes)


_OUTCOMES_SQL = f"""
    WITH e(n, segment_id, placeholder, outcome) AS (VALUES {_edit_rows()}),
    r AS (SELECT o_orderkey AS doc_id, segment_id, placeholder, CASE WHEN o_orderkey % {_LACKING} = 0 AND placeholder = '[KRS_1]' AND outcome LIKE '%_match' THEN 'missing_vault_entry' ELSE outcome END AS outcome
        FROM orders JOIN e ON o_orderkey % {len(EDITS)} = n)"""
REINJECT_SQL = f"{_OUTCOMES_SQL} SELECT * FROM r"
_MATCHED = "outcome IN ('exact_segment_match', 'fuzzy_anchored_segment_match')"
CONFLICTS_SQL = f"{_OUTCOMES_SQL} SELECT doc_id, segment_id, placeholder, outcome AS reason FROM r WHERE NOT {_MATCHED}"
STATUS_SQL = f"""{_OUTCOMES_SQL}
    SELECT doc_id, CASE WHEN count(*) FILTER (NOT {_MATCHED}) > 0 THEN 'fail_closed' ELSE 'ready' END AS status, count(DISTINCT segment_id) FILTER ({_MATCHED}) AS matched_segments,
        count(DISTINCT segment_id) FILTER (NOT {_MATCHED}) AS rejected_segments, count(placeholder) FILTER (NOT {_MATCHED}) AS rejected_placeholders FROM r GROUP BY doc_id"""


def edited_orders(spark: SparkSession, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, edited segments, vault) of a document for each order, by the order's key."""
    schema = "n int, segment_id string, text string, container_id string, section_id string, page_index int"
    # dealt out first: a file of few row groups would be read by as few tasks
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % len(EDITS)).cast("int").alias("n")).repartition("doc_id")
    # tables of some tens of rows
    base = spark.createDataFrame([(n, *s) for n in range(len(EDITS)) for s in (_A, _B)], schema)
    back = spark.createDataFrame([(n, *s) for n, (edited, _) in enumerate(EDITS) for s in edited], schema)
    templates = docs.join(F.broadcast(base), "n").withColumn("refs", F.regexp_extract_all("text", F.lit(r"\[[A-Z_]+_\d+\]"), F.lit(0))).drop("n")
    vault = templates.select("doc_id", "segment_id", F.explode("refs").alias("placeholder"), F.lit(6).alias("start"), F.lit(13).alias("stop"), F.lit("h").alias("original_value_hash"))
    vault = vault.filter(~((F.col("doc_id") % _LACKING == 0) & (F.col("placeholder") == "[KRS_1]")))
    return templates, docs.join(F.broadcast(back), "n").drop("n"), vault


# --- packages ------------------------------------------------------------------------------------


def packages(texts: DataFrame) -> DataFrame:
    """path and content: a DOCX package for each row (path, text), with a paragraph for each line; texts hold no control characters."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.path, b.text):
                lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("_rels/.rels", f'<Relationships xmlns="{REL[1:-1]}"><Relationship Id="r1" Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>')
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{lines}<w:sectPr/></w:body></w:document>')
                rows.append((path, held.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return over_packages(texts.select("path", "text"), run, "path string, content binary")
