"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .conversation_trie import prefix_trie
from .exact_dedup import exact_duplicates
from .language_id import predict_languages
from .maxent_lm import language_scores
from .media import media_columns
from .mixing import mix_documents
from .packing import pack_documents
from .quality import quality_scores
from .resampling import resample
from .simhash import near_duplicates
from .token_store import token_store
from .toxicity import toxicity_scores
from .url_filter import ORACLE_SQL as URL_ORACLE
from .url_filter import judge_urls


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the number that ends a page's url is the doc_id of the document on it
    outcomes = read(spark, sf_dir, "labels").selectExpr("doc_id AS page_no", "quality AS good")
    return judge_urls(read(spark, sf_dir, "pages"), outcomes)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_maxent_lm": op4_maxent_lm,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_token_store": op8_token_store,
    "op9_quality": op9_quality,
    "op10_media": op10_media,
    "op11_language_id": op11_language_id,
    "op12_resampling": op12_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": URL_ORACLE,
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
                first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    # DuckDB has no CRC-32, so its 256 steps are made here and followed over the bytes of each distinct feature
    "op12_resampling": r"""
        WITH RECURSIVE bits AS (
            SELECT range AS i, range AS c, 0 AS k FROM range(256)
            UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
        steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
        texts AS (
            SELECT true AS source, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
        w AS (
            SELECT source, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS (
            SELECT source, id, len(words) AS n_words, list_concat(words,
                list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1])) AS features FROM w),
        e AS (SELECT source, id, unnest(features) AS feature FROM f),
        b AS (
            SELECT feature, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(feature)),
                    lambda i: ('0x' || substr(hex(encode(feature)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda c, x: xor(c // 256, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT feature FROM e), steps),
        n AS (SELECT bucket, sum(source::INT)::DOUBLE AS s, sum(1 - source::INT)::DOUBLE AS t FROM e JOIN b USING (feature) GROUP BY bucket),
        g AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n),
        m AS (SELECT id, floor(avg(gain))::BIGINT AS weight FROM e JOIN b USING (feature) JOIN g USING (bucket) WHERE source GROUP BY id),
        d AS (
            SELECT id AS doc_id, n_words, len(features) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM f LEFT JOIN m USING (id) WHERE source),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM d WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM r
        UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM d WHERE n_words < 20
    """,
    "op13_conversation_trie": r"""
        WITH RECURSIVE bits AS (
            SELECT range AS i, range AS c, 0 AS k FROM range(256)
            UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
        steps AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)),
                lambda c, x: xor(c // 256, step[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS taken
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps),
        t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
        r AS (
            SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.first AND pos < taken
            UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= taken),
        x AS (
            SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, len(regexp_extract_all(text, '[^ 	-]+')) AS words
            FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT conv_id, 0, [], 0 FROM c),
        n AS (SELECT path, depth, min(conv_id) AS id, count(*) AS n_convs, max(words) AS words FROM x GROUP BY path, depth),
        m AS (SELECT conv_id, depth, id FROM x JOIN n USING (path, depth)),
        u AS (SELECT n.id, n.depth, m.id AS parent FROM n LEFT JOIN m ON m.conv_id = n.id AND m.depth = n.depth - 1),
        k AS (SELECT parent AS id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY ALL),
        s AS (
            SELECT m.id, m.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
            FROM n LEFT JOIN k USING (id, depth) JOIN m ON m.conv_id = n.id AND m.depth <= n.depth GROUP BY ALL),
        e AS (
            SELECT id, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
            FROM m JOIN (SELECT conv_id, max(depth) AS depth FROM x GROUP BY conv_id) USING (conv_id, depth) GROUP BY ALL)
        SELECT n.id AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
            coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM n JOIN u USING (id, depth) JOIN s USING (id, depth) LEFT JOIN k USING (id, depth) LEFT JOIN e USING (id, depth)
    """,
}
