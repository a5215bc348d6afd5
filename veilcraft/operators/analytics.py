"""Statistics of spans, re-identification risk, leaks in rewritten texts, benchmark metrics and coverage."""

from __future__ import annotations

import functools
import hashlib
import operator
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settled, shared_dir
from .seals import latest_hash
from .spans import let


def entity_audit(spans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """entity_type, entity_count and mean, median, least and greatest confidence, rounded to four digits."""
    c = F.col("confidence")
    stats = {"mean_confidence": F.avg(c), "median_confidence": F.median(c), "min_confidence": F.min(c), "max_confidence": F.max(c)}
    return spans.groupBy(*keys, "entity_type").agg(F.count("*").alias("entity_count"), *[F.round(v, 4).alias(k) for k, v in stats.items()])


def risk_by_type(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, entity_type, entity_count, distinct_values and type_risk: rare values tell most about a person."""
    rows = spans.groupBy(*keys, "entity_type").agg(F.count("*").alias("entity_count"), F.countDistinct("raw_text").alias("distinct_values"))
    share = F.col("distinct_values") / F.col("entity_count")
    risk = F.when(F.col("entity_count") == 1, 1.0).when(F.col("entity_count") <= 3, 0.7).when(share < 0.3, 0.5).when(share < 0.6, 0.3).otherwise(0.1)
    return rows.withColumn("type_risk", risk)


def reidentification_risk(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), over: DataFrame | None = None) -> DataFrame:
    """keys, overall_score (the mean over types, to three digits), risk_level, total_entities and unique_types.

    Rows of ``over`` (keys) without spans have score 0 and level low.
    """
    rows = risk_by_type(spans, keys).groupBy(*keys).agg(
        F.least(F.round(F.avg("type_risk"), 9), F.lit(1.0)).alias("score"), F.sum("entity_count").alias("total_entities"), F.count("*").alias("unique_types")
    )
    if over is not None:
        rows = over.select(*keys).distinct().join(rows, list(keys), "left").fillna(0, ["score", "total_entities", "unique_types"])
    level = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    return rows.select(*keys, F.round("score", 3).alias("overall_score"), level.alias("risk_level"), "total_entities", "unique_types")


def normalized(c: Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")


def _pattern(surface: Column, edge: str) -> Column:
    """The surface with nothing of the class ``edge`` on either side; white space in it matches any run. Null without words."""
    words = F.regexp_replace(F.btrim(F.regexp_replace(surface, r"(?U)\s+", " ")), r"([\\.\[\]{}()*+\-?^$|#&~])", r"\\$1")
    return F.when(words != "", F.concat(F.lit(f"(?U)(?<!{edge})"), F.replace(words, F.lit(" "), F.lit(r"\s+")), F.lit(f"(?!{edge})")))


def surface_index(surfaces: DataFrame, keys: tuple[str, ...], segment: str) -> DataFrame:
    """keys and ``_index``: the surfaces of each document (keys, raw_text, optionally segment), each with the word that a text must hold to
    hold it: the first run of word characters of the surface as it is, and the first word of the normalised one."""
    of = (F.col(segment) if segment in surfaces.columns else F.lit(None)).cast("string")
    loose = normalized(F.col("raw_text"))
    empty_as_null = lambda c: F.when(c != "", c)
    one = F.struct(
        "raw_text", of.alias("of"), empty_as_null(F.regexp_extract("raw_text", r"(?U)(\w+)", 1)).alias("run"), empty_as_null(F.regexp_extract(loose, r"(?U)(\S+)", 1)).alias("word"),
        _pattern(F.col("raw_text"), r"[\w@._-]").alias("exact"), _pattern(loose, r"\w").alias("loose"),
    )
    return surfaces.filter("raw_text is not null").groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.collect_set(one).alias("_index"))


def leaks(segments: DataFrame, surfaces: DataFrame, keys: tuple[str, ...] = ("doc_id",), segment: str = "segment_id", text: str = "text", order: str | None = None) -> DataFrame:
    """keys, segment, raw_text, exact, normalised: surfaces (keys, raw_text, optionally segment) that segments of their document still hold.

    A surface with a segment is looked for there only. With ``order``, surfaces without one are looked for in the document's segments joined by line
    feeds as well; what only the joined text holds has a null segment. A document's surfaces stand beside its texts, so no text is
    copied for a surface: the text's words are looked up among the first words of surfaces, and only hits are tested by a pattern. Null keys are
    a key like others; null texts hold nothing.
    """
    index = surface_index(surfaces, keys, segment)
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    beside = lambda rows: rows.join(index, same).drop(*[f"_of_{k}" for k in keys])
    each = beside(segments.select(*keys, F.col(segment).cast("string").alias(segment), F.coalesce(text, F.lit("")).alias("_text")))
    found = _held(each, F.filter("_index", lambda s: s["of"].isNull() | (s["of"] == F.col(segment))), keys, segment)
    if order is None:
        return found
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"])
    joined = segments.groupBy(*keys).agg(F.array_join(parts, "\n").alias("_text"), F.lit(None).cast("string").alias(segment))
    whole = _held(beside(joined), F.filter("_index", lambda s: s["of"].isNull()), keys, segment)
    alone = found.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("raw_text").alias("_raw")).agg(F.max("exact").alias("_e"), F.max("normalised").alias("_n"))
    new = (F.col("exact") & ~F.coalesce("_e", F.lit(False))) | (F.col("normalised") & ~F.coalesce("_n", F.lit(False)))
    return found.unionByName(whole.join(alone, same & (F.col("raw_text") == F.col("_raw")), "left").filter(new).select(found.columns))


def _held(rows: DataFrame, wanted: Column, keys: tuple[str, ...], segment: str) -> DataFrame:
    """A row for each of the surfaces ``wanted`` that ``_text`` holds, one way or the other."""
    rows = rows.select(*keys, segment, "_text", wanted.alias("_wanted"))
    firsts = lambda field: F.filter(F.array_distinct(F.transform("_wanted", lambda s: s[field])), lambda x: x.isNotNull())
    rows = rows.withColumn("_loose", normalized(F.col("_text")))
    runs = F.array_intersect(F.regexp_extract_all("_text", F.lit(r"(?U)(\w+)"), F.lit(1)), firsts("run"))
    words = F.array_intersect(F.split("_loose", r"(?U)\s+"), firsts("word"))
    rows = rows.withColumns({"_runs": runs, "_words": words})
    hit = lambda s: s["run"].isNull() | F.array_contains(F.col("_runs"), s["run"]) | F.array_contains(F.col("_words"), s["word"])
    holds = lambda text, pattern: F.coalesce(F.regexp_like(F.col(text), pattern), F.lit(False))
    tested = F.transform(F.filter("_wanted", hit), lambda s: F.struct(s["raw_text"].alias("raw_text"), holds("_text", s["exact"]).alias("exact"), holds("_loose", s["loose"]).alias("normalised")))
    rows = rows.select(*keys, segment, F.explode(tested).alias("_s")).select(*keys, segment, "_s.*")
    return rows.filter("exact or normalised").distinct()


def leak_summary(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, findings and normalized_findings: sorted surfaces that leaked in any segment."""
    each = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("raw_text"))))
    return found.groupBy(*keys).agg(each("exact").alias("findings"), each("normalised").alias("normalized_findings"))


def normal(surface: Column) -> Column:
    """Lower case, letters, digits, low lines and white space alone, without white space around."""
    return F.regexp_replace(F.regexp_replace(F.lower(surface), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)^\s+|\s+$", "")


def _met(want: Column, have: Column) -> Column:
    """The types of the wanted surfaces that are met one-to-one: each, in order, by the first of its type left that holds it or lies in it.

    ``want`` and ``have`` are arrays of structs (kind, text), texts normalised.
    """
    nothing = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("met"))

    def step(acc: Column, w: Column) -> Column:
        fits = lambda h, i: (h["kind"] == w["kind"]) & ~F.array_contains(acc["used"], i) & (h["text"].contains(w["text"]) | w["text"].contains(h["text"]))
        found = F.struct(F.concat(acc["used"], F.array(F.lit(0))).alias("used"), F.concat(acc["met"], F.array(w["kind"])).alias("met"))
        at = lambda i: F.when(i > 0, found.withField("used", F.concat(acc["used"], F.array((i - 1).cast("int"))))).otherwise(acc)
        return let(F.coalesce(F.array_position(F.transform(have, fits), F.lit(True)), F.lit(0)), at)

    return F.aggregate(want, nothing, step, lambda acc: acc["met"])


def corpus_matches(expected: DataFrame, spans: DataFrame, key: str = "id") -> DataFrame:
    """key, entity_type, matched: labelled entities (key, seq, entity_type, text) that spans of the same sample meet.

    A sample's entities and spans meet in one row. A null text is an empty one, which any span of its type meets.
    """
    one = F.struct(F.col("entity_type").alias("kind"), normal(F.coalesce("text", F.lit(""))).alias("text"))
    other = F.struct(F.col("entity_type").alias("kind"), normal(F.coalesce("raw_text", F.lit(""))).alias("text"))
    bare = lambda c: F.transform(c, lambda x: x["x"])
    want = expected.groupBy(key).agg(bare(F.array_sort(F.collect_list(F.struct("seq", one.alias("x"))))).alias("_want"))
    have = spans.groupBy(F.col(key).alias("_of")).agg(bare(F.array_sort(F.collect_list(F.struct("start", "stop", other.alias("x"))))).alias("_have"))
    rows = want.join(have, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<struct<kind:string,text:string>>")))
    met = rows.select(key, _met(F.col("_want"), F.col("_have")).alias("_met"))
    counts = F.transform(F.array_distinct("_met"), lambda k: F.struct(k.alias("entity_type"), F.size(F.filter("_met", lambda x: x == k)).cast("bigint").alias("matched")))
    return met.select(key, F.inline(counts))


def corpus_metrics(expected: DataFrame, predicted: DataFrame, matched: DataFrame) -> DataFrame:
    """entity_type (null: all), expected, predicted, matched, recall and precision; types of either side, with zeros filled in.

    Each input has entity_type and n. Without anything expected recall is 1, without anything predicted precision is 1.
    """
    named = [df.groupBy("entity_type").agg(F.sum("n").alias(c)) for df, c in ((expected, "expected"), (predicted, "predicted"), (matched, "matched"))]
    rows = named[0].join(named[1], "entity_type", "full_outer").join(named[2], "entity_type", "full_outer").fillna(0)
    rows = rows.rollup("entity_type").agg(*[F.sum(c).alias(c) for c in ("expected", "predicted", "matched")])
    ratio = lambda c: F.round(F.when(F.col(c) == 0, 1.0).otherwise(F.col("matched") / F.col(c)), 4)
    return rows.withColumns({"recall": ratio("expected"), "precision": ratio("predicted")})


def coverage(segments: DataFrame, spans: DataFrame, replaced: DataFrame, key: str = "doc_id", segment: str = "segment_id") -> DataFrame:
    """key, segments, segments_with_detections, segments_with_replacements, seed_entities and expanded_mentions."""
    of = lambda df, name: df.groupBy(key).agg(F.countDistinct(segment).alias(name))
    person = F.col("entity_type") == "PERSON"
    mention = F.col("source_detector") == "mention_memory"
    people = spans.groupBy(key).agg(F.count_if(person & ~mention).alias("seed_entities"), F.count_if(mention).alias("expanded_mentions"))
    out = of(segments, "segments").join(of(spans, "segments_with_detections"), key, "left").join(of(replaced, "segments_with_replacements"), key, "left")
    return out.join(people, key, "left").fillna(0)


def overlapping_pairs(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of spans of a document that overlap: keys, left_id, right_id (left_id < right_id).

    Only spans of one island, a run of spans that overlap directly or through others, are compared with one another.
    """
    in_order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.filter("start < stop").withColumn("_opens", F.when(F.col("start") < reach, 0).otherwise(1))
    placed = placed.withColumn("_island", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    a = placed.select(*keys, "_island", F.col("entity_id").alias("left_id"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    b = placed.select(*keys, "_island", F.col("entity_id").alias("right_id"), F.col("start").alias("_c"), F.col("stop").alias("_d"))
    return a.join(b, [*keys, "_island"]).filter("left_id < right_id and _a < _d and _c < _b").select(*keys, "left_id", "right_id")


def placeholder_segments(segments: DataFrame, key: str = "doc_id", segment: str = "segment_id", text: str = "text") -> DataFrame:
    """key, placeholder and segments: which segments of a document hold each placeholder, in order."""
    rows = segments.select(key, segment, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))).alias("placeholder"))
    return rows.groupBy(key, "placeholder").agg(F.array_sort(F.collect_list(segment)).alias("segments"))


def placeholder_index(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, placeholder and n: placeholders in texts and how often they stand there."""
    rows = texts.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))).alias("placeholder"))
    return rows.groupBy(*keys, "placeholder").agg(F.count("*").alias("n"))


#: Fixed value: what placeholders look like.
PLACEHOLDER = r"\[[A-Z_]+_\d+\]"


#: Fields of an audit record that its chain hash is made of, joined by line feeds.
CHAINED = ("audit_id", "operation", "mode", "input_hash", "output_hash", "created_at", "previous_audit_hash")


def _linked(previous: str | None):
    """Rows in order of time and id with the hash of the row before and their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = previous
        for batch in batches:
            links, hashes = [], []
            for fields in zip(*[batch.column(c).to_pylist() for c in CHAINED[:-1]]):
                links.append(before)
                before = hashlib.sha256("\n".join(f or "" for f in (*fields, before)).encode()).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in CHAINED[:-1]], pa.array(links, pa.string()), pa.array(hashes, pa.string())], [*CHAINED, "audit_chain_hash"])

    return run


def write_chain(records: DataFrame, path: str, previous: str | None = None, size: int = 100_000) -> DataFrame:
    """Append ``records`` (the fields of CHAINED but the last) to the chain at ``path``, in order of created_at, then audit_id; what was written.

    A record's hash covers the hash of the record before, so a chain can only be made from its beginning. Records are dealt out by ranges of some
    ``size`` rows, and one task a range links its own, given the last hash of the range before: neither a task nor the driver holds more than a
    range, whatever the length. ``previous`` is the hash that the first record follows (``latest_hash`` of a chain that is there already). An empty
    table writes nothing.
    """
    spark = records.sparkSession
    rows = records.select(*[F.col(c).cast("string").alias(c) for c in CHAINED[:-1]])
    ranges = max(1, -(-rows.count() // size))
    # a folder for each range, so that linking one reads its own rows only
    dealt = f"{shared_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    rows.repartitionByRange(ranges, "created_at", "audit_id").withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(dealt)
    folder = f"{path.rstrip('/')}/from={uuid.uuid4().hex}"
    schema = ", ".join(f"{c} string" for c in (*CHAINED, "audit_chain_hash"))
    fields = ", ".join(f"{c} string" for c in CHAINED[:-1])
    known = spark.read.schema(f"{fields}, _range int").parquet(dealt)
    numbers = [r["_range"] for r in known.select("_range").distinct().orderBy("_range").collect()]  # as many as ranges
    for k in numbers:
        own = spark.read.schema(fields).parquet(f"{dealt}/_range={k}").coalesce(1).sortWithinPartitions("created_at", "audit_id")
        own.mapInArrow(_linked(previous), schema).write.parquet(f"{folder}/range={k}")
        previous = latest_hash(spark.read.parquet(f"{folder}/range={k}"))
    return spark.read.schema(schema).parquet(*[f"{folder}/range={k}" for k in numbers]) if numbers else spark.createDataFrame([], schema)


def verified_chain(records: DataFrame) -> DataFrame:
    """audit_id, self_ok and linked: whether a record's chain hash is that of its content, and whether it names the hash of the record before.

    Content is audit_id, operation, mode, input_hash, output_hash, created_at and previous_audit_hash, joined by line feeds. Records are
    dealt out by ranges of time; each range's first record follows the last one of the range before, and only those meet in one task.
    """
    own = F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in CHAINED]), 256)
    rows = records.select("audit_id", "created_at", "previous_audit_hash", "audit_chain_hash", (own == F.col("audit_chain_hash")).alias("self_ok"))
    ranges = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(rows.repartitionByRange(ranges, "created_at", "audit_id").withColumn("_range", F.spark_partition_id()))
    order = F.struct("created_at", "audit_id")
    ends = rows.groupBy("_range").agg(F.max_by("audit_chain_hash", order).alias("_last"))
    # one row for each range
    ends = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_earlier"))
    inside = Window.partitionBy("_range").orderBy("created_at", "audit_id")
    rows = rows.withColumns({"_before": F.lag("audit_chain_hash").over(inside), "_n": F.row_number().over(inside)}).join(F.broadcast(ends), "_range")
    before = F.when(F.col("_n") == 1, F.col("_earlier")).otherwise(F.col("_before"))
    return rows.select("audit_id", "self_ok", F.col("previous_audit_hash").eqNullSafe(before).alias("linked"))


def round_trips(reports: DataFrame, text: str = "report", schema: str | None = None) -> DataFrame:
    """``reports`` with ``valid``: whether a report's JSON text can be read by ``schema`` and written again without loss."""
    read = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    again = F.from_json(F.to_json(read), schema)
    whole = F.forall(F.map_keys(F.from_json(F.col(text), "map<string,string>")), lambda k: F.array_contains(F.map_keys(F.from_json(F.to_json(read, {"ignoreNullFields": "false"}), "map<string,string>")), k))
    return reports.withColumn("valid", F.coalesce(read.isNotNull() & (read == again) & whole, F.lit(False)))


def corpus_benchmark(samples: DataFrame, expected: DataFrame, target: float = 0.99, **options) -> tuple[DataFrame, DataFrame]:
    """(metrics, leaks) of the rules over labelled samples (id, text) with ``expected`` entities (id, seq, entity_type, text).

    Metrics are those of ``corpus_metrics`` with ``passed`` in the row of all types: recall of ``target`` or more, and no leak. Leaks (id, entity_type,
    raw_text) are expected surfaces that the rewritten sample still holds.
    """
    from .anonymize import anonymize, detect

    spans = settled(detect(samples, keys=("id",), **options))
    hidden = anonymize(samples, keys=("id",), **options).select("id", "text", F.lit("whole").alias("segment_id"))
    wanted = expected.select("id", "entity_type", F.col("text").alias("raw_text"))
    found = settled(leaks(hidden, wanted, ("id",)).select("id", "raw_text").join(wanted.distinct(), ["id", "raw_text"]).select("id", "entity_type", "raw_text"))
    count = lambda df: df.groupBy("entity_type").agg(F.count("*").alias("n"))
    matched = corpus_matches(expected, spans).groupBy("entity_type").agg(F.sum("matched").alias("n"))
    metrics = corpus_metrics(count(expected), count(spans), matched)
    clean = found.agg((F.count("*") == 0).alias("_clean"))
    # one row
    metrics = metrics.join(F.broadcast(clean), F.lit(True)).withColumn("passed", F.when(F.col("entity_type").isNull(), F.col("_clean") & (F.col("recall") >= target)))
    return metrics.drop("_clean"), found
