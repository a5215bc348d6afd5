"""Queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import NORMALIZERS
from ..functions.rules import CATALOGUE, Rule, ordered
from ..functions.validate import VALIDATORS
from ..operators import analytics
from ..operators.anonymize import anonymize, anonymize_segments, detect, numbered, replacements
from ..operators.fuse import SEMANTIC, accepted, canonical, fuse, island_numbers, resolve_overlaps, reviewable, type_rank
from ..operators.reinject import conflicts_and_decisions, plan_status
from ..operators.scan import scan
from ..operators.seals import delete, load, opened, save, sealed
from ..operators.spans import beside
from ..sources import reviews
from ..sources.catalogue import add_types, bootstrap, default_rules, default_types, disable_rules, export_catalogue, import_catalogue, import_rules, load_rules
from ..sources.files import docx_differences, leaf_differences, package_segments
from . import made, rule_cases
from .lineage import settled, shared_dir
from .policies import POLICIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- spans in documents --------------------------------------------------------------------------

_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_LUHN = """list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN 2 * d[i]::INT > 9 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END ELSE d[i]::INT END for i in range(1, length(d) + 1)]) % 10 = 0"""


def _spans_sql(pattern: str, kind: str, normal: str, where: str, tail: str = "''") -> str:
    """Spans of one rule; ``tail`` is what a Unicode word boundary adds to a match where an ASCII one doesn't."""
    return f"""
    SELECT doc_id, '{kind}' AS entity_type, raw_text, n AS normalized_text, start, start + length(raw_text) AS stop,
        'ENT_' || substr(sha1('{kind}|' || n || '|' || start || '|' || (start + length(raw_text))), 1, 12) AS entity_id FROM (
        SELECT *, {normal} AS n FROM (SELECT * REPLACE (raw_text || {tail} AS raw_text) FROM (
            SELECT doc_id, text, ms[i] AS raw_text,
                (list_sum([length(x) for x in bs[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0))::BIGINT AS start
            FROM (SELECT doc_id, text, ms, bs, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS bs FROM documents
                WHERE regexp_matches(text, '{pattern}'))))))
    WHERE {where}"""


_EMAIL_SQL = _spans_sql(_EMAIL, "EMAIL", "lower(raw_text)", "true")
_IP_SQL = _spans_sql(_IP, "IP_ADDRESS", "raw_text", "list_bool_and([x::INT <= 255 for x in string_split(raw_text, '.')])")
_CARD_SQL = _spans_sql(
    _CARD, "CARD", r"regexp_replace(raw_text, '\D', '', 'g')",
    rf"""(SELECT length(d) BETWEEN 13 AND 19 AND {_LUHN} FROM (SELECT n AS d))
        AND NOT regexp_matches(rtrim(substr(text, 1, start), E' \t\r\n-'), '\d$')
        AND NOT regexp_matches(ltrim(substr(text, start + length(raw_text) + 1), E' \t\r\n-'), '^\d')""",
    r"""CASE WHEN regexp_matches(substr(text, start + length(raw_text) + 1, 2), '^[ -][^\x00-\x7F]') AND regexp_matches(substr(text, start + length(raw_text) + 2, 1), '\p{L}')
        THEN substr(text, start + length(raw_text) + 1, 1) ELSE '' END""",
)
_SPANS = ("doc_id", "entity_type", "raw_text", "normalized_text", "start", "stop", "entity_id")


def _scan_query(kind: str) -> Callable:
    return lambda spark, d: scan(table(spark, d, "documents"), {kind}).select(*_SPANS)


query(_EMAIL_SQL, "scan_email")(_scan_query("EMAIL"))
query(_IP_SQL, "scan_ip")(_scan_query("IP_ADDRESS"))
query(_CARD_SQL, "scan_card")(_scan_query("CARD"))
_PLAIN = ("EMAIL", "IP_ADDRESS", "CARD")
_PLAIN_SQL = f"{_EMAIL_SQL} UNION ALL {_IP_SQL} UNION ALL {_CARD_SQL}"


def _plain_spans(spark: SparkSession, d: str) -> DataFrame:
    return scan(table(spark, d, "documents"), _PLAIN)


@query()
def scan_all(spark, d):
    """All rules over all documents."""
    return scan(table(spark, d, "documents"))


@query(f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_PLAIN_SQL}) GROUP BY entity_type")
def findings_by_type(spark, d):
    return _plain_spans(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT lang, entity_type, count(*) AS n FROM ({_PLAIN_SQL}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, entity_type)")
def findings_by_lang_type(spark, d):
    langs = table(spark, d, "documents").select("doc_id", "lang")
    return _plain_spans(spark, d).join(langs, "doc_id").rollup("lang", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT s.doc_id, s.entity_type FROM ({_PLAIN_SQL}) s WHERE s.entity_type IN ('EMAIL', 'CARD')")
def allowed_types(spark, d):
    return scan(table(spark, d, "documents"), {"EMAIL", "CARD"}).select("doc_id", "entity_type").distinct()


@query(
    f"SELECT entity_type, count(*) AS entity_count, round(avg(c), 4) AS mean_confidence, round(median(c), 4) AS median_confidence, round(min(c), 4) AS min_confidence, "
    f"round(max(c), 4) AS max_confidence FROM (SELECT entity_type, CASE entity_type WHEN 'EMAIL' THEN 0.99::DOUBLE ELSE 0.97::DOUBLE END AS c FROM ({_PLAIN_SQL})) GROUP BY entity_type"
)
def entity_audit(spark, d):
    return analytics.entity_audit(_plain_spans(spark, d))


_RISK_SQL = f"""
    WITH s AS ({_PLAIN_SQL}), t AS (
        SELECT source, entity_type, count(*) AS n, count(DISTINCT raw_text) AS v FROM s JOIN documents USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN n <= 3 THEN 0.7 WHEN v / n < 0.3 THEN 0.5 WHEN v / n < 0.6 THEN 0.3 ELSE 0.1 END::DOUBLE AS risk FROM t),
    g AS (SELECT source, round(avg(risk), 9) AS score, sum(n)::BIGINT AS total_entities, count(*) AS unique_types FROM r GROUP BY source)
    SELECT d.source, round(coalesce(score, 0), 3) AS overall_score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
        coalesce(total_entities, 0) AS total_entities, coalesce(unique_types, 0) AS unique_types
    FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN g USING (source)"""


@query(_RISK_SQL)
def reid_risk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return analytics.reidentification_risk(_plain_spans(spark, d).join(docs, "doc_id"), ("source",), docs)


_NO_OVERLAP_SQL = f"""
    WITH s AS ({_PLAIN_SQL}),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start) AS k FROM s),
    r AS (SELECT d.doc_id, d.text, list({{'a': start, 'b': stop, 'r': <EDIT>}} ORDER BY start) AS es FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id, d.text)
    SELECT doc_id, CASE WHEN es[1].a IS NULL THEN text ELSE
        list_aggregate([substr(text, (CASE WHEN i = 1 THEN 0 ELSE es[i - 1].b END + 1)::BIGINT, (es[i].a - CASE WHEN i = 1 THEN 0 ELSE es[i - 1].b END)::BIGINT) || es[i].r
            for i in range(1, len(es) + 1)], 'string_agg', '') || substr(text, es[-1].b + 1) END AS text FROM r"""
_PLACEHOLDER_SQL = "'[' || entity_type || '_' || k || ']'"
_STARS = "repeat('*', length(raw_text))"


def _redaction(style: str | None, mode: str = "irreversible", policy: str = "external_irreversible") -> Callable:
    def run(spark, d):
        return anonymize(table(spark, d, "documents"), mode, style, _PLAIN, policy=POLICIES[policy]).select("doc_id", "text")

    return run


query(_NO_OVERLAP_SQL.replace("<EDIT>", "'[' || entity_type || '_' || k || ']'"), "redact_category")(_redaction(None))
query(_NO_OVERLAP_SQL.replace("<EDIT>", "'****'"), "redact_fixed_mask")(_redaction("mask"))
query(_NO_OVERLAP_SQL.replace("<EDIT>", f"CASE WHEN entity_type = 'EMAIL' THEN {_STARS} ELSE regexp_replace(raw_text, '[\\p{{L}}\\p{{N}}]', '*', 'g') END"), "redact_format_preserving")(_redaction("format_preserving"))
query(_NO_OVERLAP_SQL.replace("<EDIT>", f"CASE WHEN entity_type = 'EMAIL' THEN {_STARS} ELSE regexp_replace(raw_text, '[A-Za-z0-9]', '*', 'g') END"), "redact_char_mask")(_redaction(None, policy="finance_documents"))
query(_NO_OVERLAP_SQL.replace("<EDIT>", "'[' || entity_type || '_' || k || ']'"), "redact_reversible")(_redaction("mask", "reversible"))


@query()
def anonymize_documents(spark, d):
    """The whole pipeline over all documents."""
    return anonymize(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "text", F.to_json("findings").alias("findings"))


@query()
def anonymize_conversations(spark, d):
    """Turns of one conversation rewritten together."""
    out = anonymize_segments(table(spark, d, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", "text", F.to_json("findings").alias("findings"))


@query("""
    WITH t AS (SELECT CASE WHEN (conv_id + turn) % 10 <> 0 THEN conv_id END AS conv_id, turn FROM conversations),
    n AS (SELECT *, CASE WHEN conv_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS n FROM t)
    SELECT conv_id, turn, 'Tura ' || turn || chr(10) || 'segment§end' || chr(10) || ' [EMAIL_' || n || '] i [IP_ADDRESS_' || n || '] §' AS text,
        CASE WHEN conv_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY conv_id) END AS mails FROM n""")
def segments_rewritten(spark, d):
    """Made texts for all turns, rewritten by conversation; every tenth turn has no conversation, and texts hold the boundary between segments."""
    turns = table(spark, d, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.concat(F.lit("Tura "), turn, F.lit("\nsegment§end\n u"), conv, F.lit("x"), turn, F.lit("@mail.pl i 10.0."), turn, F.lit(".7 §"))
    made_ = turns.select(F.when((F.col("conv_id") + F.col("turn")) % 10 != 0, F.col("conv_id")).alias("conv_id"), "turn", text.alias("text"))
    out = anonymize_segments(made_, "conv_id", "turn", types=("EMAIL", "IP_ADDRESS"))
    return out.select("conv_id", "turn", "text", F.col("findings")["EMAIL"].alias("mails"))


@query(f"""
    WITH d AS (SELECT * FROM documents UNION ALL SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS doc_id) FROM documents), r AS ({_NO_OVERLAP_SQL.replace('<EDIT>', _PLACEHOLDER_SQL)})
    SELECT d.doc_id, r.text FROM d JOIN documents o ON d.text IS NOT DISTINCT FROM o.text AND (d.doc_id = o.doc_id OR d.doc_id IS NULL AND o.doc_id % 10 = 0) JOIN r ON r.doc_id = o.doc_id
    QUALIFY row_number() OVER (PARTITION BY d.doc_id, md5(coalesce(d.text, '')), o.doc_id) <= CASE WHEN d.doc_id IS NULL THEN 1 WHEN d.doc_id % 10 = 0 THEN 1 ELSE 2 END""")
def redact_repeated(spark, d):
    """All documents twice, the second time with null for every tenth doc_id."""
    docs = table(spark, d, "documents")
    again = docs.withColumn("doc_id", F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("doc_id")))
    return anonymize(docs.unionByName(again), types=_PLAIN).select("doc_id", "text")


@query(f"SELECT doc_id, entity_type, count(*) AS n FROM ({_PLAIN_SQL}) GROUP BY ALL")
def document_findings(spark, d):
    return anonymize(table(spark, d, "documents"), types=_PLAIN).select("doc_id", F.explode("findings").alias("entity_type", "n"))


@query(f"SELECT doc_id, entity_id, start, stop, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start) || ']' AS replacement_text, raw_text AS source_text FROM ({_PLAIN_SQL})")
def replacement_plan(spark, d):
    """Placeholders with the values that they stand for."""
    return replacements(table(spark, d, "documents"), "reversible", types=_PLAIN).select("doc_id", "entity_id", "start", "stop", "replacement_text", "source_text")


_LEAK_SQL = f"""
    WITH s AS (SELECT DISTINCT doc_id, raw_text FROM ({_EMAIL_SQL})),
    t AS (SELECT doc_id, raw_text, replace(text, raw_text, '[EMAIL_1]') AS hidden, text FROM s JOIN documents USING (doc_id))
    SELECT doc_id, 'original' AS segment_id, raw_text, true AS exact, true AS normalised FROM t"""


@query(_LEAK_SQL)
def leak_scan(spark, d):
    """E-mail addresses in original texts (all found) and in rewritten ones (none)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    spans = settled(scan(docs, {"EMAIL"}))
    hidden = anonymize(docs, types={"EMAIL"}).select("doc_id", "text", F.lit("rewritten").alias("segment_id"))
    texts = docs.withColumn("segment_id", F.lit("original")).unionByName(hidden)
    return analytics.leaks(texts, spans.select("doc_id", "raw_text"))


@query("""
    SELECT c_custkey AS doc_id, c_custkey % 5 IN (0, 3) AS exact, c_custkey % 5 IN (0, 1) AS normalised FROM customer WHERE c_custkey % 5 IN (0, 1, 3)""")
def leaks_by_letters(spark, d):
    """Names as they are, in other case, within other words, after a mark that only the exact search stops at, and cut in two."""
    name, k = F.col("c_name"), F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit("it is "), name, F.lit(" here"))).when(k == 1, F.concat(F.lit("IT IS "), F.upper(name), F.lit("!")))
    text = text.when(k == 2, F.concat(F.lit("it is x"), name, F.lit("y"))).when(k == 3, F.concat(F.lit("name:"), name, F.lit(" here"))).otherwise(F.replace(name, F.lit("#"), F.lit(" - ")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", text.alias("text"))
    found = analytics.leaks(rows.withColumn("segment_id", F.lit("s")), rows.select("doc_id", F.col("c_name").alias("raw_text")))
    return found.select("doc_id", "exact", "normalised")


@query("""
    SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 's0' END AS segment_id, c_name AS raw_text FROM customer WHERE c_custkey % 3 <> 1""")
def leaks_across_segments(spark, d):
    """Names like Customer#000000001 in one segment, hidden, or broken into two segments at the mark, where only the joined text holds them."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.regexp_replace("c_name", "#", " ").alias("name"), "c_name")
    k = F.col("doc_id") % 3
    texts = F.when(k == 0, F.array(F.concat(F.lit("it is "), "name", F.lit(" here")), F.lit("x"))).when(k == 1, F.array(F.lit("[OSOBA_1]"), F.lit("x")))
    texts = texts.otherwise(F.array(F.concat(F.lit("it is "), F.split_part("name", F.lit(" "), F.lit(1))), F.concat(F.split_part("name", F.lit(" "), F.lit(2)), F.lit(" here"))))
    segments = rows.select("doc_id", F.posexplode(texts).alias("i", "text")).select("doc_id", "i", F.concat(F.lit("s"), F.col("i").cast("string")).alias("segment_id"), "text")
    found = analytics.leaks(segments, rows.select("doc_id", F.col("name").alias("raw_text")), order="i").filter("exact")
    return found.select("doc_id", "segment_id", F.regexp_replace("raw_text", " ", "#").alias("raw_text"))


@query(f"WITH {made.MADE_SQL} SELECT doc_id, a.entity_id AS left_id, b.entity_id AS right_id FROM m a JOIN m b USING (doc_id) WHERE a.entity_id < b.entity_id AND a.start < b.stop AND b.start < a.stop")
def overlap_pairs(spark, d):
    return analytics.overlapping_pairs(made.made_spans(table(spark, d, "lineitem")))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha1(coalesce(text, '')) AS sha1 FROM documents")
def fingerprints(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(t, "UTF-8"), 256).alias("sha256"), F.sha1(F.encode(t, "UTF-8")).alias("sha1"))


# --- values made from keys -----------------------------------------------------------------------

#: name -> (value as SQL that both engines read, whether it is valid as DuckDB SQL over v and its digits d)
_DIGITS_OF = r"regexp_replace(v, '[^0-9]', '', 'g')"


def _weighted_sql(weights: tuple[int, ...], at: str = "d") -> str:
    return " + ".join(f"{w} * {at}[{i}]::INT" for i, w in enumerate(weights, 1))


_KEYED: dict[str, tuple[str, str]] = {
    "pesel": (
        "lpad(CAST(o_orderkey * 7919 + 1020300000 + o_custkey * 100000 AS VARCHAR(20)), 11, '0')",
        f"""length(d) = 11 AND d <> repeat(d[1], 11) AND (10 - ({_weighted_sql((1, 3, 7, 9, 1, 3, 7, 9, 1, 3))}) % 10) % 10 = d[11]::INT AND d[3:4]::INT % 20 BETWEEN 1 AND 12
            AND try_cast((CASE d[3:4]::INT // 20 WHEN 0 THEN '19' WHEN 1 THEN '20' WHEN 2 THEN '21' WHEN 3 THEN '22' ELSE '18' END || d[1:2] || '-'
                || lpad((d[3:4]::INT % 20)::VARCHAR, 2, '0') || '-' || d[5:6]) AS DATE) IS NOT NULL""",
    ),
    "nip": ("CAST(o_orderkey * 7919 + 5210000000 AS VARCHAR(20))", f"length(d) = 10 AND ({_weighted_sql((6, 5, 7, 2, 3, 4, 5, 6, 7))}) % 11 = d[10]::INT"),
    "regon": (
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey * 101 + 123000000 AS VARCHAR(20)) ELSE CAST(o_orderkey * 7919 + 12345678000000 AS VARCHAR(20)) END",
        f"CASE length(d) WHEN 9 THEN ({_weighted_sql((8, 9, 2, 3, 4, 5, 6, 7))}) % 11 % 10 = d[9]::INT WHEN 14 THEN ({_weighted_sql((2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8))}) % 11 % 10 = d[14]::INT ELSE false END",
    ),
    "card_number": ("CAST(o_orderkey * 7919 + 4111111111110000 AS VARCHAR(20))", f"length(d) BETWEEN 13 AND 19 AND {_LUHN}"),
    "iban": (
        "CONCAT('PL', lpad(CAST(o_orderkey % 98 AS VARCHAR(20)), 2, '0'), ' 1090 1014 0000 0712 ', lpad(CAST(o_orderkey * 31 AS VARCHAR(20)), 8, '0'))",
        r"""length(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g')) BETWEEN 15 AND 34 AND
            regexp_replace(substr(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'), 5) || '2521' || substr(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'), 3, 2), '[^0-9]', '', 'g')::HUGEINT % 97 = 1""",
    ),
    "phone": ("CASE o_orderkey % 3 WHEN 0 THEN CONCAT('+48 ', CAST(o_orderkey + 600000000 AS VARCHAR(20))) WHEN 1 THEN CONCAT('0048-', CAST(o_orderkey * 9973 AS VARCHAR(20))) ELSE CAST(o_orderkey * 99991 AS VARCHAR(20)) END", "length(d) = 9 OR length(d) = 11 AND d LIKE '48%' OR length(d) = 13 AND d LIKE '0048%'"),
    "phone_fragment": ("CONCAT(CASE o_orderkey % 4 WHEN 0 THEN '48 ' WHEN 1 THEN '0048 ' WHEN 2 THEN '12' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 1000 AS VARCHAR(20)) ELSE CAST(o_orderkey * 1013 + 100000 AS VARCHAR(20)) END)", "CASE WHEN d LIKE '0048%' THEN length(d) BETWEEN 10 AND 13 WHEN d LIKE '48%' THEN length(d) BETWEEN 8 AND 11 ELSE length(d) BETWEEN 6 AND 9 END"),
    "krs": ("CONCAT('KRS ', CAST(o_orderkey * 99991 AS VARCHAR(20)))", "length(d) = 10"),
    "labeled_bank_account": ("CASE o_orderkey % 4 WHEN 0 THEN repeat('7', 26) WHEN 1 THEN CONCAT('10 9010 1400 0007 1219 ', lpad(CAST(o_orderkey * 31 AS VARCHAR(20)), 8, '0')) WHEN 2 THEN CONCAT('1090-', lpad(CAST(o_orderkey AS VARCHAR(20)), 22, '0')) ELSE repeat('12', 14) END", "length(d) = 26 AND d <> repeat(d[1], 26)"),
    "labeled_bank_account_fragment": ("repeat(CAST(o_orderkey % 1000 AS VARCHAR(20)), 8)", "length(d) BETWEEN 20 AND 26 AND d <> repeat(d[1], length(d)::INT)"),
    "ip_address": ("CONCAT(CAST(o_orderkey % 300 AS VARCHAR(20)), '.', CAST(o_custkey % 280 AS VARCHAR(20)), '.0.', CAST(o_orderkey % 7 AS VARCHAR(20)))", "list_bool_and([x::INT <= 255 for x in string_split(v, '.')])"),
    "vehicle_registration": ("CONCAT(CASE o_orderkey % 4 WHEN 0 THEN 'WX ' WHEN 1 THEN 'kr' WHEN 2 THEN 'ABCDEFG' ELSE 'żółw' END, CASE WHEN o_orderkey % 5 = 0 THEN 'abcd' ELSE CAST(o_orderkey AS VARCHAR(20)) END)", "regexp_full_match(regexp_replace(upper(v), '[^A-Z0-9]', '', 'g'), '[A-Z]{1,3}[A-Z0-9]{4,6}') AND regexp_matches(v, '[0-9]')"),
    "device_identifier": ("CONCAT(CASE o_orderkey % 3 WHEN 0 THEN 'host-' WHEN 1 THEN '-' ELSE '' END, CAST(o_orderkey AS VARCHAR(20)))", "length(v) BETWEEN 3 AND 64 AND regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9._-]*') AND regexp_matches(v, '[A-Za-z]')"),
    "postal_code": ("CONCAT(lpad(CAST(o_orderkey % 150 AS VARCHAR(20)), 2, '0'), '-', CAST(o_custkey AS VARCHAR(20)))", "regexp_full_match(v, '[0-9]{2}-[0-9]{3}')"),
    "date_of_birth": ("CONCAT(lpad(CAST(o_orderkey % 33 AS VARCHAR(20)), 2, '0'), '.', lpad(CAST(o_custkey % 14 AS VARCHAR(20)), 2, '0'), '.', CAST(1900 + o_orderkey % 120 AS VARCHAR(20)))", "try_cast((v[7:10] || '-' || v[4:5] || '-' || v[1:2]) AS DATE) IS NOT NULL"),
    "document_number": ("CASE o_orderkey % 3 WHEN 0 THEN CONCAT('ab-', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN CONCAT('abcdef', CAST(o_orderkey % 100 AS VARCHAR(20))) ELSE 'abcdefgh' END", "length(replace(v, '-', '')) BETWEEN 6 AND 24 AND o_orderkey % 3 < 2"),
    "case_number": ("CONCAT('sygn. akt I C ', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN '/24' ELSE '-24' END)", "v LIKE '%/24'"),
    "contract_number": ("CONCAT(CASE o_orderkey % 3 WHEN 0 THEN 'umowa nr ' WHEN 1 THEN 'contract no. ' ELSE 'cnt-' END, CAST(o_orderkey AS VARCHAR(20)))", "v NOT LIKE 'contract%' AND length(d) >= 3"),
    "swift_bic": ("CONCAT(CASE WHEN o_orderkey % 2 = 0 THEN 'SWIFT: ' ELSE '' END, 'BPKOPLP', CAST(o_orderkey % 10 AS VARCHAR(20)), CASE WHEN o_orderkey % 3 = 0 THEN 'XXX' WHEN o_orderkey % 3 = 1 THEN 'XX' ELSE '' END)", "v NOT LIKE '%9XX' AND v NOT SIMILAR TO '.*[0-9]XX'"),
    "generic_reference": ("CASE o_orderkey % 4 WHEN 0 THEN CONCAT('fv/', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN 'fv/abc' WHEN 2 THEN CONCAT('a-', CAST(o_orderkey % 10 AS VARCHAR(20))) ELSE repeat('x1', 17) END", "o_orderkey % 4 = 0 AND length(v) - 1 BETWEEN 4 AND 32"),
    "vat_id": ("CONCAT('VAT: ', CASE o_orderkey % 3 WHEN 0 THEN 'PL' WHEN 1 THEN 'DE' ELSE '' END, CAST(o_orderkey * 7919 + 5210000000 AS VARCHAR(20)))", f"CASE WHEN v LIKE 'VAT: PL%' THEN length(d) = 10 AND ({_weighted_sql((6, 5, 7, 2, 3, 4, 5, 6, 7))}) % 11 = d[10]::INT ELSE true END"),
    "always_true": ("CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR(20)) END", "true"),
    "bank_account": (
        "CASE o_orderkey % 3 WHEN 0 THEN CONCAT('PL', lpad(CAST(o_orderkey % 98 AS VARCHAR(20)), 2, '0'), ' 1090 1014 0000 0712 ', lpad(CAST(o_orderkey % 100 AS VARCHAR(20)), 8, '0')) WHEN 1 THEN CONCAT(lpad(CAST(o_orderkey % 98 AS VARCHAR(20)), 2, '0'), '109010140000071200000019') ELSE CONCAT(CAST(o_orderkey % 10 AS VARCHAR(20)), '1 1090 1014 0000 0712 1981') END",
        "o_orderkey % 3 < 2 AND length(d) = 26 AND (substr(d, 3) || '2521' || substr(d, 1, 2))::HUGEINT % 97 = 1",
    ),
    "tax_id": (
        "CASE o_orderkey % 5 WHEN 0 THEN CONCAT('TIN: PL', CAST(o_orderkey * 7919 + 5210000000 AS VARCHAR(20))) WHEN 1 THEN CONCAT('Tax ID DE', CAST(o_orderkey + 100000 AS VARCHAR(20))) WHEN 2 THEN CONCAT('TIN ', CAST(o_orderkey + 1000000000 AS VARCHAR(20))) WHEN 3 THEN 'TIN abcdefgh' ELSE CONCAT('TAX ', CAST(o_orderkey + 100000 AS VARCHAR(20))) END",
        f"CASE o_orderkey % 5 WHEN 0 THEN ({_weighted_sql((6, 5, 7, 2, 3, 4, 5, 6, 7))}) % 11 = d[10]::INT WHEN 1 THEN true WHEN 2 THEN true ELSE false END",
    ),
    "address": (
        "CASE o_orderkey % 5 WHEN 0 THEN CONCAT('ul. Długa ', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN 'ulica bez numeru' WHEN 2 THEN CONCAT('00-', lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 3, '0'), ' Łódź') WHEN 3 THEN CONCAT('Długa ', CAST(o_orderkey AS VARCHAR(20))) ELSE CONCAT('00-', CAST(o_orderkey % 1000 + 1000 AS VARCHAR(20)), ' Łódź') END",
        "o_orderkey % 5 IN (0, 2)",
    ),
    "person_full_name": (
        "CASE o_orderkey % 8 WHEN 0 THEN 'Jan Kowalski' WHEN 1 THEN 'pan Xyz Nowak' WHEN 2 THEN 'Xyz Abc' WHEN 3 THEN 'J. Malinowska-Lis' WHEN 4 THEN 'Umowa Jan' WHEN 5 THEN 'Jan kowalski' WHEN 6 THEN 'Adam Ewa Jan Piotr Paweł' ELSE CONCAT('Jan ', CAST(o_orderkey AS VARCHAR(20))) END",
        "o_orderkey % 8 IN (0, 1, 3)",
    ),
    "email": ("CONCAT(CASE o_orderkey % 3 WHEN 0 THEN 'a.b' WHEN 1 THEN 'a b' ELSE '' END, '@mail', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_custkey % 2 = 0 THEN '.com' ELSE '.c' END)", "regexp_full_match(v, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}')"),
}


def _keyed_query(name: str, value: str) -> Callable:
    spark_value = value.replace("VARCHAR(20)", "STRING")

    def run(spark, d):
        rows = table(spark, d, "orders").select("o_orderkey", F.expr(spark_value).alias("v"))
        return rows.select("o_orderkey", "v", VALIDATORS[name](F.col("v")).alias("valid"))

    return run


for _name, (_value, _sql) in _KEYED.items():
    query(f"SELECT o_orderkey, v, coalesce({_sql}, false) AS valid FROM (SELECT *, {_DIGITS_OF} AS d FROM (SELECT o_orderkey, {_value} AS v FROM orders))", f"valid_{_name}")(_keyed_query(_name, _value))

_NORMAL_SQL = {
    "digits": r"regexp_replace(t, '\D', '', 'g')", "upper_alnum": "regexp_replace(upper(t), '[^A-Z0-9]', '', 'g')", "email": "lower(trim(t))",
    "case_identifier": "upper(trim(t))", "identity": "t", "swift_bic": r"coalesce(regexp_extract(upper(t), '\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b', 1), '')",
    "date_context": r"regexp_replace(trim(t), '^(?i:ur\.?|data urodzenia[: ]|dob[: ])\s*', '')",
}
#: Texts of letters, digits, marks and blanks made of columns.
_NORMAL_TEXT = "CONCAT(CASE o_orderkey % 3 WHEN 0 THEN ' ur. ' WHEN 1 THEN 'dob: ' ELSE ' Abc-' END, o_orderpriority, ' ', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ' BPKOPLPW ' ELSE '' END)"


def _normal_query(name: str) -> Callable:
    text = _NORMAL_TEXT.replace("VARCHAR(20)", "STRING")
    return lambda spark, d: table(spark, d, "orders").select("o_orderkey", NORMALIZERS[name](F.expr(text)).alias("normal"))


for _name, _sql in _NORMAL_SQL.items():
    query(f"SELECT o_orderkey, {_sql} AS normal FROM (SELECT o_orderkey, {_NORMAL_TEXT} AS t FROM orders)", f"norm_{_name}")(_normal_query(_name))


# --- each rule over made texts -------------------------------------------------------------------


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    for columns in rule_cases.levels():
        rows = rows.selectExpr(*[c.replace("VARCHAR(20)", "STRING") for c in columns])
    return rows


def _case_query(rule: Rule, cases: list) -> Callable:
    made_of = rule_cases.columns(cases)

    def run(spark, d):
        texts = _numbers(spark, d).select("o_orderkey", F.concat(*[F.expr(made_of[c].replace("VARCHAR(20)", "STRING")) for c in ("before", "span", "after")]).alias("text"))
        return scan(texts, rules=[rule], keys=("o_orderkey",)).select("o_orderkey", "entity_type", "raw_text", "normalized_text", "start", "stop")

    return run


def _case_sql(rule: Rule, cases: list) -> str:
    c = rule_cases.columns(cases)
    return f"""
        SELECT o_orderkey, '{rule.entity_type}' AS entity_type, t AS raw_text, {_NORMAL_SQL[rule.normalizer]} AS normalized_text, length(b)::BIGINT AS start, (length(b) + length(t))::BIGINT AS stop
        FROM (SELECT *, {c['before']} AS b, {c['span']} AS t, {c['found']} AS found FROM {rule_cases.numbers_sql()}) WHERE found"""


# the catalogue's rules as they are listed, then the others
for (_name, _cases), _rule in zip(rule_cases.CASES.items(), [*CATALOGUE, *ordered()[len(CATALOGUE) :]], strict=True):
    query(_case_sql(_rule, _cases), f"rule_{_name}")(_case_query(_rule, _cases))


@query(f"""
    WITH t AS (SELECT *, nip_check <> 10 AS ok FROM {rule_cases.numbers_sql()})
    SELECT o_orderkey, 'NIP: ' || nip_parts AS raw_text, 0::BIGINT AS start, CASE WHEN ok THEN 0.992 ELSE 0.99 END::DOUBLE AS confidence FROM t
    UNION ALL SELECT o_orderkey, nip_parts, 5, 0.99 FROM t WHERE ok""")
def first_rule_wins(spark, d):
    """Two rules find one labelled number: where both take it as valid the first one's span stays."""
    texts = _numbers(spark, d).select("o_orderkey", F.concat(F.lit("NIP: "), "nip_parts").alias("text"))
    return scan(texts, {"NIP"}, keys=("o_orderkey",)).select("o_orderkey", "raw_text", "start", "confidence")


@query(f"""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'CARD' WHEN 2 THEN 'PASSPORT_NUMBER' ELSE 'ID_CARD_NUMBER' END AS entity_type, 1::BIGINT AS n FROM orders
    UNION ALL SELECT o_orderkey, 'DOCUMENT_NUMBER', 1 FROM orders WHERE o_orderkey % 4 = 3""")
def suppressions(spark, d):
    """Pairs of numbers of which one is suppressed: after REGON, beside more digits, or of another document."""
    pieces = ["CONCAT('tel 600', d6, '; REGON 700', d6)", "CONCAT('karta ', card, '; 5- ', card)", "CONCAT('paszport AB', d6)", "CONCAT('dowód ABC', d6)"]
    text = rule_cases.by_case(pieces).replace("VARCHAR(20)", "STRING")
    spans = scan(_numbers(spark, d).select("o_orderkey", F.expr(text).alias("text")), {"PHONE", "CARD", "DOCUMENT_NUMBER", "PASSPORT_NUMBER", "ID_CARD_NUMBER"}, keys=("o_orderkey",))
    own = {0: "PHONE", 1: "CARD", 2: "DOCUMENT_NUMBER", 3: "DOCUMENT_NUMBER"}
    case = F.get(F.array(*[F.lit(own[i]) for i in range(4)]), (F.col("o_orderkey") % 4).cast("int"))
    keep = (F.col("entity_type") == case) | F.col("entity_type").isin("PASSPORT_NUMBER", "ID_CARD_NUMBER")
    return spans.filter(keep).groupBy("o_orderkey", "entity_type").agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, n_name AS raw_text, (length(c_name) + 4)::BIGINT AS start, 0.8::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 1""")
def rule_catalogue(spark, d):
    """A rule for each nation is imported from an export, every third is disabled, and the others are scanned for in made texts."""
    import uuid

    nations = table(spark, d, "nation")
    rules = nations.select(
        (F.col("n_nationkey") + 100).cast("int").alias("rule_id"), F.lit("NATION").alias("entity_type"), F.concat(F.lit(r"\bof (?<entity>"), "n_name", F.lit(r")(?= it)")).alias("pattern"),
        F.lit("identity").alias("normalizer"), F.lit("always_true").alias("validator"), F.lit(0.8).alias("confidence"), F.lit(False).alias("context"), F.lit(50).alias("priority"),
        F.col("n_name").alias("description"), F.array().cast("array<string>").alias("needs"), F.lit(0).alias("digits"), F.lit(True).alias("enabled"), F.lit(False).alias("managed"),
    )
    folder = f"{shared_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    rules.write.json(folder)
    catalogue, _ = import_rules(default_rules(spark), folder)
    own = catalogue.filter("entity_type = 'NATION'")
    # a table of one row for each nation
    off = [r["rule_id"] for r in own.join(nations, own.description == nations.n_name).filter("n_nationkey % 3 = 1").select("rule_id").collect()]
    texts = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("c_name", F.lit(" of "), "n_name", F.lit(" it is")).alias("text"))
    return scan(texts, rules=load_rules(disable_rules(catalogue, off), {"NATION"}), keys=("c_custkey",)).select("c_custkey", "raw_text", "start", "confidence")


@query("SELECT 'NATION_' || n_regionkey AS entity_type, n_name AS description, 'of ' || n_name AS pattern, n_nationkey % 3 <> 1 AS enabled FROM nation")
def catalogue_round_trip(spark, d):
    """A rule for each nation and a type for each region, exported with the defaults, imported into new defaults, and merged with those again."""
    import uuid

    nations = table(spark, d, "nation")
    kind = F.concat(F.lit("NATION_"), F.col("n_regionkey").cast("string"))
    types = add_types(default_types(spark), nations.select(kind.alias("entity_type"), F.lit("nations of a region").alias("description")))
    own = nations.select(
        (F.col("n_nationkey") + 1000).cast("int").alias("rule_id"), kind.alias("entity_type"), F.concat(F.lit("of "), "n_name").alias("pattern"), F.lit("identity").alias("normalizer"),
        F.lit("always_true").alias("validator"), F.lit(0.8).alias("confidence"), F.lit(False).alias("context"), F.lit(50).alias("priority"), F.col("n_name").alias("description"),
        F.array().cast("array<string>").alias("needs"), F.lit(0).alias("digits"), (F.col("n_nationkey") % 3 != 1).alias("enabled"), F.lit(False).alias("managed"),
    )
    path = f"{shared_dir(spark).rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    export_catalogue(default_rules(spark).unionByName(own), types, path)
    rules, known, _ = import_catalogue(default_rules(spark), default_types(spark), path)
    return bootstrap(rules).join(known.select("entity_type"), "entity_type").filter("not managed").select("entity_type", "description", "pattern", "enabled")


# --- spans made from keys: fusion, overlaps, ordinals --------------------------------------------


_ISLAND_SQL = (
    f"WITH {made.MADE_SQL}, o AS (SELECT *, CASE WHEN start < max(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens, "
    "row_number() OVER w AS place FROM m <FILTER> WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop DESC, confidence DESC, p, rule_seq)), "
    "i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM o)"
)


def _made(spark: SparkSession, d: str) -> DataFrame:
    return made.made_spans(table(spark, d, "lineitem"))


@query(_ISLAND_SQL.replace("<FILTER>", "") + " SELECT doc_id, entity_id, island::BIGINT AS island FROM i")
def island_clusters(spark, d):
    return island_numbers(_made(spark, d))


_SEMANTIC_SQL = (
    _ISLAND_SQL.replace("<FILTER>", "WHERE entity_type IN ('PERSON', 'ORG', 'ADDRESS')")
    + """, t AS (SELECT doc_id, island, entity_type, bool_or(source_detector = 'regex') AS a, count(*) AS b, max(confidence) AS c, -min(p) AS e, max(stop - start) AS f, -min(place) AS g
            FROM i GROUP BY ALL),
        b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY a DESC, b DESC, c DESC, e DESC, f DESC, g DESC) = 1)
        SELECT i.doc_id, entity_id, i.entity_type, b.b::INT AS support_count, (SELECT count(*) > 1 FROM t WHERE t.doc_id = i.doc_id AND t.island = i.island) AS semantic_conflict, confidence, source_detector
        FROM i JOIN b USING (doc_id, island, entity_type)
        QUALIFY row_number() OVER (PARTITION BY i.doc_id, island ORDER BY source_detector = 'regex' DESC, confidence DESC, p, stop - start DESC, place) = 1"""
)


@query(f"SELECT doc_id, entity_id, entity_type, support_count, semantic_conflict FROM ({_SEMANTIC_SQL})")
def semantic_fusion(spark, d):
    return fuse(_made(spark, d), types=SEMANTIC).select("doc_id", "entity_id", "entity_type", "support_count", "semantic_conflict")


@query(made.FUSED_SQL)
def fused_spans(spark, d):
    rows = fuse(_made(spark, d)).filter(~F.col("entity_type").isin(*SEMANTIC))
    return rows.select("doc_id", "entity_id", "entity_type", "confidence", "support_count", F.array_join("supporting_detectors", ",").alias("detectors"))


@query(made.RESOLVED_SQL)
def resolved_overlaps(spark, d):
    rows = beside(_made(spark, d), ["doc_id"]).select("doc_id", F.explode(canonical(F.col("_spans"))).alias("s")).select("doc_id", "s.*")
    return resolve_overlaps(rows).select("doc_id", "entity_id", "beaten_by")


@query(
    f"SELECT doc_id, entity_id, CASE WHEN source_detector <> 'regex' THEN NOT semantic_conflict AND confidence >= CASE WHEN support_count >= 2 THEN 0.80 ELSE 0.85 END ELSE confidence >= 0.8 END AS accepted, "
    f"semantic_conflict OR confidence >= 0.6 AS reviewed FROM ({_SEMANTIC_SQL})"
)
def accept_review(spark, d):
    rows = fuse(_made(spark, d), types=SEMANTIC)
    return rows.select("doc_id", "entity_id", accepted(0.8).alias("accepted"), reviewable(0.6).alias("reviewed"))


@query(made.ORDINALS_SQL)
def ordinals(spark, d):
    rows = beside(made.named_spans(table(spark, d, "lineitem")), ["doc_id"])
    return rows.select("doc_id", F.explode(numbered(canonical(F.col("_spans")))).alias("n")).select("doc_id", "n.span.entity_id", "n.ordinal")


@query(f"WITH {made.MADE_SQL} SELECT entity_type, max(CASE entity_type WHEN 'ADDRESS' THEN 3 WHEN 'PHONE' THEN 1 ELSE 2 END)::INT AS type_rank, count(*) AS n FROM m GROUP BY entity_type")
def type_ranks(spark, d):
    rows = made.named_spans(table(spark, d, "lineitem"))
    return rows.groupBy("entity_type").agg(F.max(type_rank(F.col("entity_type"))).alias("type_rank"), F.count("*").alias("n"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return made.named_texts(table(spark, d, "customer"))


@query(made.MENTIONS_SQL)
def person_mentions(spark, d):
    """Names in made texts: seeds, then their forms."""
    rows = detect(_named(spark, d), {"PERSON"}).filter("source_detector = 'mention_memory'")
    return rows.select("doc_id", "raw_text", "start", "stop", "mention_rule", "mention_cluster_id", "confidence", "canonical_entity_id", "entity_id")


@query("""
    SELECT c_custkey AS doc_id, 'Anny' AS raw_text, 46 AS start, 50 AS stop, 'first_name_genitive_feminine' AS mention_rule, 'G2' AS canonical_entity_id
    FROM customer WHERE c_custkey % 2 = 0""")
def mentions_by_support(spark, d):
    """Two detectors' candidates beside the rules': where both find the later name, its forms are looked for, else those of the earlier one, which it has not."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Widziano Annę Nowak. Potem Anna Nowak wyszła. Anny nie było.").alias("text"))

    def candidates(rows: DataFrame, detector: str, entity: str, raw: str, start: int) -> DataFrame:
        values = {
            "entity_id": entity, "entity_type": "PER", "raw_text": raw, "normalized_text": raw, "confidence": 0.9, "source_detector": detector, "start": start, "stop": start + len(raw),
            "context_required": False, "rule_seq": 900,
        }
        return rows.select("doc_id", *[F.lit(v).alias(k) for k, v in values.items()])

    gliner = candidates(docs, "gliner", "G1", "Annę Nowak", 9).unionByName(candidates(docs, "gliner", "G2", "Anna Nowak", 27))
    spacy = candidates(docs.filter("doc_id % 2 = 0"), "spacy", "S2", "Anna Nowak", 27)
    rows = detect(docs, {"EMAIL"}, others=[gliner, spacy]).filter("source_detector = 'mention_memory'")
    return rows.select("doc_id", "raw_text", "start", "stop", "mention_rule", "canonical_entity_id")


@query(made.REDACTED_SQL)
def redact_persons(spark, d):
    return anonymize(_named(spark, d), types={"PERSON"}).select("doc_id", "text")


# --- labelled corpus, coverage, catalogue --------------------------------------------------------


@query(
    """WITH e AS (SELECT doc_id, CASE quality WHEN 1 THEN 'GOOD' ELSE 'BAD' END AS t FROM labels), p AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'BAD' WHEN 0 THEN 'GOOD' ELSE 'NONE' END AS t FROM labels),
    c AS (SELECT t, count(*) AS expected, 0 AS predicted, 0 AS matched FROM e GROUP BY t UNION ALL SELECT t, 0, count(*), 0 FROM p GROUP BY t
        UNION ALL SELECT e.t, 0, 0, count(*) FROM e JOIN p USING (doc_id) WHERE e.t = p.t GROUP BY e.t),
    r AS (SELECT t AS entity_type, sum(expected)::BIGINT AS expected, sum(predicted)::BIGINT AS predicted, sum(matched)::BIGINT AS matched FROM c GROUP BY ROLLUP (t))
    SELECT *, round(CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE matched / expected END, 4) AS recall, round(CASE WHEN predicted = 0 THEN 1.0::DOUBLE ELSE matched / predicted END, 4) AS precision FROM r"""
)
def corpus_metrics(spark, d):
    labels = table(spark, d, "labels").selectExpr("doc_id", "CASE quality WHEN 1 THEN 'GOOD' ELSE 'BAD' END AS e", "CASE toxic WHEN 1 THEN 'BAD' WHEN 0 THEN 'GOOD' ELSE 'NONE' END AS p")
    count = lambda df, c: df.groupBy(F.col(c).alias("entity_type")).agg(F.count("*").alias("n"))
    return analytics.corpus_metrics(count(labels, "e"), count(labels, "p"), count(labels.filter("e = p"), "e"))


@query(made.COVERAGE_SQL)
def coverage_summary(spark, d):
    segments = _named(spark, d)
    spans = settled(detect(segments, {"PERSON"}, keys=("c_nationkey", "doc_id")))
    return analytics.coverage(segments, spans, spans, "c_nationkey", "doc_id")


def _reinjected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    templates, edited, vault = made.edited_orders(spark, table(spark, d, "orders"))
    return templates, *conflicts_and_decisions(templates, edited, vault)


@query(made.CONFLICTS_SQL)
def reinject_conflicts(spark, d):
    return _reinjected(spark, d)[1]


@query(made.REINJECT_SQL)
def reinject_fuzzy(spark, d):
    """What becomes of every placeholder of edited segments: every kind of conflict, missing segments, and exact and fuzzy matches."""
    _, conflicts, decisions = _reinjected(spark, d)
    return conflicts.withColumnRenamed("reason", "outcome").unionByName(decisions.select("doc_id", "segment_id", "placeholder", F.col("decision_reason").alias("outcome")))


@query(made.STATUS_SQL)
def reinject_status(spark, d):
    templates, conflicts, decisions = _reinjected(spark, d)
    return plan_status(templates, conflicts, decisions)


@query(
    f"WITH t AS ({_NO_OVERLAP_SQL.replace('<EDIT>', _PLACEHOLDER_SQL)}) SELECT doc_id, p AS placeholder, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[A-Z_]+_\\d+\\]')) AS p FROM t) GROUP BY ALL"
)
def placeholder_index(spark, d):
    return analytics.placeholder_index(_redaction(None)(spark, d))


@query(
    """WITH r AS (SELECT o_orderkey, 'AUD_' || o_orderkey AS audit_id, 'anonymize' AS operation, o_orderstatus AS mode, sha256(o_orderkey::VARCHAR) AS i, sha256(o_custkey::VARCHAR) AS o, lpad(o_orderkey::VARCHAR, 12, '0') AS c FROM orders)
    SELECT audit_id, o_orderkey % 10 <> 3 AS self_ok, o_orderkey = (SELECT min(o_orderkey) FROM r) AS linked FROM r"""
)
def audit_chain(spark, d):
    """Records whose own hash is right but for every tenth, and that don't name the record before (but the first, which has none)."""
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey", "concat('AUD_', o_orderkey) AS audit_id", "'anonymize' AS operation", "o_orderstatus AS mode", "sha2(CAST(o_orderkey AS STRING), 256) AS input_hash",
        "sha2(CAST(o_custkey AS STRING), 256) AS output_hash", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS created_at", "CAST(NULL AS STRING) AS previous_audit_hash",
    )
    fields = ("audit_id", "operation", "mode", "input_hash", "output_hash", "created_at", "previous_audit_hash")
    own = F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in fields]), 256)
    return analytics.verified_chain(rows.withColumn("audit_chain_hash", F.when(F.col("o_orderkey") % 10 == 3, F.lit("forged")).otherwise(own)))


_ORDER_RECORDS = (
    "concat('AUD_', o_orderkey) AS audit_id", "'anonymize' AS operation", "o_orderstatus AS mode", "sha2(CAST(o_orderkey AS STRING), 256) AS input_hash",
    "sha2(CAST(o_custkey AS STRING), 256) AS output_hash", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS created_at",
)


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus, lag(o_custkey % 7 = 3) OVER (ORDER BY o_orderkey) AS lost, o_custkey % 7 = 3 AS gone FROM orders)
    SELECT 'AUD_' || o_orderkey AS audit_id, o_orderstatus <> 'F' AS self_ok, NOT coalesce(lost, false) AS linked FROM o WHERE NOT gone""")
def audit_chain_written(spark, d):
    """A chain of all orders as it is written, then checked after records were removed and the mode of others changed."""
    import uuid

    records = table(spark, d, "orders").selectExpr(*_ORDER_RECORDS)
    chain = analytics.write_chain(records, f"{shared_dir(spark).rstrip('/')}/chain-{uuid.uuid4().hex}")
    gone = table(spark, d, "orders").filter("o_custkey % 7 = 3").selectExpr("concat('AUD_', o_orderkey) AS audit_id")
    left = chain.join(gone, "audit_id", "left_anti").withColumn("mode", F.when(F.col("mode") == "F", "changed").otherwise(F.col("mode")))
    return analytics.verified_chain(left)


@query("""
    SELECT o_orderkey AS vault_id, CASE WHEN o_orderstatus = 'F' THEN 'replaced' ELSE o_custkey::VARCHAR END AS value FROM orders
    WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)""")
def vault_store(spark, d):
    """A record for each order, saved, some of them saved again, and one deleted; all that the store then opens."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/vault-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("vault_id"), F.col("o_custkey").cast("string").alias("value"), "o_orderstatus")
    save(rows.drop("o_orderstatus"), path, "a key", "vault_id")
    save(rows.filter("o_orderstatus = 'F'").select("vault_id", F.lit("replaced").alias("value")), path, "a key", "vault_id")
    first = rows.agg(F.min("vault_id")).first()[0]
    if first is not None:
        delete(spark, path, "vault_id", first)
    return load(spark, path, "a key", "vault_id")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'tampered' WHEN 2 THEN 'expired' END AS problem FROM customer")
def vault_check(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 == 2, "2001-01-01T00:00:00+00:00").otherwise("2999-01-01T00:00:00+00:00").alias("expires_at"))
    rows = sealed(rows, "a key", ["c_custkey", "c_name", "expires_at"])
    seal = F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("seal"))
    rows = rows.withColumn("seal", seal).withColumn("c_name", F.when(F.col("c_custkey") % 4 == 1, F.lit("another")).otherwise(F.col("c_name")))
    return opened(rows, "a key", ["c_custkey", "c_name", "expires_at"], expires="expires_at").select("c_custkey", "problem")


@query("SELECT o_orderkey, o_orderkey % 5 NOT IN (0, 1) AS valid FROM orders")
def report_round_trip(spark, d):
    """Reports as JSON texts, some cut short and some with a field that the schema doesn't know."""
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", "o_orderstatus", "o_totalprice")).alias("report"))
    k = F.col("o_orderkey") % 5
    cut = F.when(k == 0, F.left("report", F.lit(12))).when(k == 1, F.regexp_replace("report", r"\}$", ',"more":1}')).otherwise(F.col("report"))
    schema = "o_custkey bigint, o_orderstatus string, o_totalprice double"
    return analytics.round_trips(rows.withColumn("report", cut), schema=schema).select("o_orderkey", "valid")


@query("""
    SELECT c_custkey, 'E' || c_custkey AS entity_id, CASE c_custkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' WHEN 2 THEN 'extend_left' WHEN 3 THEN 'extend_right' ELSE 'relabel' END AS action,
        CASE WHEN c_custkey % 5 = 4 THEN 'ORG' END AS replacement_entity_type FROM customer WHERE c_custkey % 7 <> 0""")
def review_suggestions(spark, d):
    """A reviewer that reads the entity's id in the prompt and answers with chatter around a JSON object; texts without spans aren't shown to it."""
    docs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('say "'), "c_name", F.lit('"')).alias("text"))
    spans = docs.filter("c_custkey % 7 <> 0").select(
        "c_custkey", F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("PERSON").alias("entity_type"), F.lit("x").alias("raw_text"), F.lit(0).alias("start"), F.lit(1).alias("stop"),
        F.lit(0.7).alias("confidence"),
    )

    def ask(prompt: Column) -> Column:
        seen = F.from_json(prompt, "text string, types array<string>, entities array<struct<entity_id:string>>")
        entity = seen["entities"][0]["entity_id"]
        action = F.get(F.array(*map(F.lit, reviews.ACTIONS)), F.substr(entity, F.lit(2)).cast("int") % 5)
        kind = F.when(action == "relabel", F.concat(F.lit(', "replacement_entity_type": "'), seen["types"][1], F.lit('"'))).otherwise("")
        return F.concat(F.lit('Sure! {"suggestions": [{"entity_id": "'), entity, F.lit('", "reason": "r", "action": "'), action, F.lit('"'), kind, F.lit("}]} Bye."))

    template = '{"text": {{ text_window | tojson }}, "types": {{ allowed_entity_types | tojson }}, "entities": {{ entities | tojson }}}'
    return reviews.suggestions(docs, spans, ask, template, ["PERSON", "ORG"], keys=("c_custkey",)).select("c_custkey", "entity_id", "action", "replacement_entity_type")


@query("SELECT o_orderkey, 3::BIGINT AS before, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS after FROM orders")
def xml_leaf_counts(spark, d):
    xml = F.concat(F.lit('<o k="'), F.col("o_orderkey").cast("string"), F.lit('"> <s>'), "o_orderstatus", F.lit("</s><p>"), "o_orderpriority", F.lit("</p></o>"))
    # dealt out first: a file of few row groups would be parsed by as few tasks
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").repartition("o_orderkey").select("o_orderkey", xml.alias("text"))
    after = rows.withColumn("text", F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace("text", "<p>.*</p>", "<p> </p>")).otherwise(F.col("text")))
    return leaf_differences(rows, after, "xml", "o_orderkey").select("o_orderkey", "before", "after")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'JSON scalar segment count changed.' END AS warning FROM orders")
def json_leaf_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("both"), F.struct("o_totalprice").alias("in"))).alias("text"))
    after = rows.withColumn("text", F.when(F.col("o_orderkey") % 4 == 0, F.regexp_replace("text", r"\[.*\]", "[]")).otherwise(F.col("text")))
    return leaf_differences(rows, after, "json", "o_orderkey").select("o_orderkey", "warning")


_LINES_SQL = r"SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', '', 'g'), chr(10)) AS lines FROM documents"


def _packages(spark: SparkSession, d: str) -> DataFrame:
    """All documents as DOCX packages, a paragraph for each line, without control characters."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x09\x0B-\x1F\x7F-\x9F]", "")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))


@query(f"""
    SELECT doc_id, 'body:p:' || (i - 1) AS segment_id, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM ({_LINES_SQL})) WHERE lines[i] <> ''""")
def package_segments_read(spark, d):
    """Documents written as DOCX packages and read back as segments."""
    return package_segments(made.packages(_packages(spark, d))).select(F.col("path").cast("bigint").alias("doc_id"), "segment_id", "text")


@query(f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN CASE WHEN len(lines) < 4 THEN NULL ELSE 'Paragraph count changed beyond tolerance.' END WHEN 2 THEN 'package missing' WHEN 3 THEN 'unreadable' END AS problem
    FROM ({_LINES_SQL})""")
def packages_compared(spark, d):
    """Packages against themselves, without their last three lines, missing, and cut short."""
    texts = _packages(spark, d)
    k = F.col("path").cast("bigint") % 4
    lines = F.split("text", "\n", -1)
    shorter = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 3, F.lit(1))), "\n")
    # a text of one to three lines keeps one paragraph, so it loses two at most
    after = made.packages(texts.filter(k != 2).withColumn("text", F.when(k == 1, shorter).otherwise(F.col("text"))))
    after = after.withColumn("content", F.when(F.col("path").cast("bigint") % 4 == 3, F.substring("content", 1, 40)).otherwise(F.col("content")))
    found = docx_differences(made.packages(texts), after)
    problem = F.when(F.col("passed"), None).when(F.col("path").cast("bigint") % 4 == 3, "unreadable").otherwise(F.array_join("errors", "; "))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), problem.alias("problem"))


@query("""
    SELECT id, entity_type, CASE entity_type WHEN 'EMAIL' THEN least(id % 4, 3) ELSE 1 END::BIGINT AS matched
    FROM (SELECT c_custkey AS id, unnest(['EMAIL', 'NIP']) AS entity_type FROM customer) WHERE entity_type = 'NIP' OR id % 4 > 0""")
def corpus_matches_repeated(spark, d):
    """Samples that are to hold one address three times and hold it none to three times: each find is counted once."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    kinds = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in (("EMAIL", "a@b.pl"), ("EMAIL", "A@B.PL"), ("NIP", "856-734"), ("EMAIL", "a@b.pl"))])
    expected = rows.select("id", F.posexplode(kinds).alias("seq", "e")).select("id", "seq", F.col("e.t").alias("entity_type"), F.col("e.v").alias("text"))
    mails = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).filter("i < id % 4").select("id", (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 6).alias("stop"), F.lit("EMAIL").alias("entity_type"), F.lit("a@b.pl").alias("raw_text"))
    other = rows.select("id", F.lit(50).alias("start"), F.lit(63).alias("stop"), F.lit("NIP").alias("entity_type"), F.lit("856-734-62-15").alias("raw_text"))
    return analytics.corpus_matches(expected, mails.unionByName(other))


_BENCHMARK = "WITH e AS (SELECT 'EMAIL' AS t, c_custkey % 4 AS k FROM customer UNION ALL SELECT 'IP_ADDRESS', c_custkey % 4 FROM customer)"


@query(f"""{_BENCHMARK}, r AS (SELECT t AS entity_type, count(*)::BIGINT AS expected, count(*) FILTER (t = 'EMAIL' OR k <> 3)::BIGINT AS predicted, count(*) FILTER (t = 'EMAIL' OR k <> 3)::BIGINT AS matched
        FROM e GROUP BY ROLLUP (t))
    SELECT *, round(matched / expected, 4) AS recall, round(matched / predicted, 4) AS precision, CASE WHEN entity_type IS NULL THEN false END AS passed FROM r""")
def corpus_benchmark(spark, d):
    """Labelled texts with an e-mail and an IP address each; every fourth address is none, so recall misses the target."""
    key = F.col("c_custkey")
    address = F.concat(F.lit("10.0."), (key % 256).cast("string"), F.when(key % 4 == 3, F.lit(".999")).otherwise(F.lit(".7")))
    mail = F.concat(F.lit("a"), key.cast("string"), F.lit("@mail.pl"))
    rows = table(spark, d, "customer").select(key.alias("id"), mail.alias("m"), address.alias("a"))
    samples = rows.select("id", F.concat(F.lit("pisz "), "m", F.lit(" z "), "a", F.lit(" ")).alias("text"))
    pairs = F.array(F.struct(F.lit("EMAIL").alias("t"), F.col("m").alias("v")), F.struct(F.lit("IP_ADDRESS").alias("t"), F.col("a").alias("v")))
    expected = rows.select("id", F.posexplode(pairs).alias("seq", "e")).select("id", "seq", F.col("e.t").alias("entity_type"), F.col("e.v").alias("text"))
    return analytics.corpus_benchmark(samples, expected, types=("EMAIL", "IP_ADDRESS"))[0]


@query(
    f"WITH t AS ({_NO_OVERLAP_SQL.replace('<EDIT>', _PLACEHOLDER_SQL)}), p AS (SELECT DISTINCT lang, doc_id, unnest(regexp_extract_all(text, '\\[[A-Z_]+_\\d+\\]')) AS placeholder FROM t JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)) "
    "SELECT lang, placeholder, array_to_string(list(doc_id ORDER BY doc_id), ',') AS segments FROM p GROUP BY ALL"
)
def placeholder_segments(spark, d):
    """Which documents of each language hold a placeholder."""
    langs = table(spark, d, "documents").select("doc_id", "lang")
    found = analytics.placeholder_segments(_redaction(None)(spark, d).join(langs, "doc_id"), "lang", "doc_id")
    return found.select("lang", "placeholder", F.array_join(F.transform("segments", lambda s: s.cast("string")), ",").alias("segments"))
