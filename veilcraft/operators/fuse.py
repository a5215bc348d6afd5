"""Fusion of candidate spans and resolution of overlaps, as folds over a document's array of spans.

Both work on islands: runs of spans that overlap one another, directly or through others. Islands of one span stay as they are; in larger ones
spans meet in a fixed order, as the outcome depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import FIELDS, SPANS, before, beside, by, changed, in_rows, let, most, plus

# Types whose spans compete across types, names of types that mean another, and detectors from the most trusted on.
SEMANTIC = ("PERSON", "ORG", "ADDRESS")
CANONICAL = {
    "PER": "PERSON", "PERSNAME": "PERSON", "ORGANIZATION": "ORG", "ORGNAME": "ORG", "COMPANY": "ORG", "ADDR": "ADDRESS", "POSTAL_ADDRESS": "ADDRESS",
}
DETECTORS = ("regex", "presidio", "gliner", "spacy")
#: What type counts for more where spans overlap.
TYPE_RANK = {
    "ADDRESS": 3, "ORG": 2, "PERSON": 2, "EMAIL": 2, "NIP": 2, "REGON": 2, "KRS": 2, "VAT_ID": 2, "POSTAL_CODE": 1, "PHONE": 1,
}


def _lookup(c: Column, table: dict, otherwise: Column) -> Column:
    out = None
    for value in dict.fromkeys(table.values()):
        test = c.isin(*[k for k, v in table.items() if v == value])
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(otherwise)


def detector_priority(c: Column) -> Column:
    return _lookup(c, {d: i for i, d in enumerate(DETECTORS)}, F.lit(len(DETECTORS)))


def type_rank(c: Column) -> Column:
    return _lookup(c, TYPE_RANK, F.lit(0))


def begin(s: Column) -> Column:
    return F.coalesce(s["start"], F.lit(0).cast("bigint"))


def end(s: Column) -> Column:
    return F.coalesce(s["stop"], F.lit(0).cast("bigint"))


def length(s: Column) -> Column:
    return end(s) - begin(s)


def meet(a: Column, b: Column) -> Column:
    """Whether two spans overlap; one without a place meets nothing."""
    return F.coalesce((a["start"] < b["stop"]) & (b["start"] < a["stop"]), F.lit(False))


def _place(s: Column) -> Column:
    """Where a span begins; one without a place comes before all others."""
    return F.coalesce(s["start"], F.lit(-1).cast("bigint"))


def in_order(spans: Column) -> Column:
    return by(spans, _place, lambda s: -end(s), lambda s: -s["confidence"], lambda s: detector_priority(s["source_detector"]), lambda s: s["rule_seq"])


def canonical(spans: Column) -> Column:
    """Spans with canonical types and what fusion keeps about its sources; what is known already stays."""
    return F.transform(
        spans,
        lambda s: changed(
            s, entity_type=_lookup(s["entity_type"], CANONICAL, s["entity_type"]), original_entity_type=F.coalesce(s["original_entity_type"], s["entity_type"]),
            support_count=F.coalesce(s["support_count"], F.lit(1)), supporting_detectors=F.coalesce(s["supporting_detectors"], F.array(s["source_detector"])),
            semantic_conflict=F.coalesce(s["semantic_conflict"], F.lit(False)),
            conflicting_entity_types=F.coalesce(s["conflicting_entity_types"], F.array().cast("array<string>")),
        ),
    )


def _opens(spans: Column) -> Column:
    """For each of ``spans``, which are in order, whether it begins an island; one without a place is an island by itself."""
    reach = before(F.transform(spans, lambda s: F.when(s["start"].isNull(), 0).otherwise(end(s)).cast("bigint")), most)
    return let(reach, lambda r: F.transform(spans, lambda s, i: ~F.coalesce(s["start"] < F.get(r, i), F.lit(False))))


def island_of(spans: Column) -> Column:
    """For each of ``spans``, which are in order, the number of its island, from 1 on."""
    return let(F.transform(_opens(spans), lambda o: o.cast("bigint")), lambda o: let(before(o, plus), lambda n: F.transform(n, lambda x, i: x + F.get(o, i))))


def _each_island(spans: Column, fold: Callable[[Column], Column], alone: Callable[[Column], Column] = lambda island: island) -> Column:
    """What ``fold`` makes of each island of several spans, and ``alone`` of those of one, in order."""

    def over(all_spans: Column) -> Column:
        firsts = F.filter(F.transform(_opens(all_spans), lambda o, i: F.when(o, i)), lambda i: i.isNotNull())

        def folded(at: Column) -> Column:
            island = lambda i: F.slice(all_spans, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i))
            each = lambda i: let(island(i), lambda own: F.when(F.size(own) > 1, fold(own)).otherwise(alone(own)))
            return F.flatten(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda _, i: each(i)))

        return let(F.concat(firsts, F.array(F.size(all_spans))), folded)

    return let(spans, over)


def _best_of(island: Column) -> Column:
    """One span of an island of semantic candidates: the best of the best type, with its support and what it beat.

    Types compare by whether a rule found them, candidates, confidence, detector and length; spans of the type by the same but number.
    """
    rule = lambda s: s["source_detector"] == "regex"
    rank = lambda s: detector_priority(s["source_detector"])
    numbered = F.transform(island, lambda s, i: F.struct(rule(s).alias("rule"), s["confidence"].alias("c"), (-rank(s)).alias("d"), length(s).alias("n"), (-i).alias("i"), s.alias("s")))

    def winner(rows: Column) -> Column:
        types = F.array_distinct(F.transform(rows, lambda r: r["s"]["entity_type"]))

        def of_type(kind: Column) -> Column:
            return let(
                F.filter(rows, lambda r: r["s"]["entity_type"] == kind),
                lambda own: F.struct(
                    F.exists(own, lambda r: r["rule"]).alias("rule"), F.size(own).alias("size"), F.array_max(F.transform(own, lambda r: r["c"])).alias("c"),
                    F.array_max(F.transform(own, lambda r: r["d"])).alias("d"), F.array_max(F.transform(own, lambda r: r["n"])).alias("n"),
                    F.array_max(F.transform(own, lambda r: r["i"])).alias("i"), own.alias("own"),
                ),
            )

        def best(kind: Column) -> Column:
            one = F.array_max(kind["own"])["s"]
            beaten = F.array_sort(F.array_except(types, F.array(one["entity_type"])))
            detectors = F.array_sort(F.array_distinct(F.transform(kind["own"], lambda r: r["s"]["source_detector"])))
            return changed(one, support_count=kind["size"], supporting_detectors=detectors, conflicting_entity_types=beaten, semantic_conflict=F.size(beaten) > 0)

        return let(F.array_max(F.transform(types, of_type)), best)

    return F.array(let(numbered, winner))


def better(current: Column, challenger: Column) -> Column:
    """Whether the challenger replaces the current span of its type."""
    by_rule = lambda s: s["source_detector"] == "regex"
    a, b = current["confidence"], challenger["confidence"]
    surer = (b > a + 0.05) | ((a == b) & (length(challenger) > length(current)))
    trusted = (F.abs(b - a) < 0.01) & (detector_priority(challenger["source_detector"]) < detector_priority(current["source_detector"]))
    return F.when(by_rule(current) != by_rule(challenger), by_rule(challenger)).otherwise(surer | trusted)


def _fold(island: Column, rivals: Callable[[Column, Column], Column], settle: Callable[[Column, Column, Column], Column], nothing: Column, chosen: Callable[[Column], Column], more: Callable[[Column, Column], Column]) -> Column:
    """Spans of an island in order: each meets the first chosen span that rivals it, and joins the chosen where there is none."""

    def step(acc: Column, s: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(chosen(acc), lambda c: rivals(c, s)), F.lit(True)), F.lit(0))
        return let(at, lambda k: F.when(k == 0, more(acc, s)).otherwise(settle(acc, k, s)))

    return F.aggregate(island, nothing, step)


def _fold_type(island: Column) -> Column:
    """What is left of overlapping spans of one type; a winner knows the detectors of what it met."""

    def settle(chosen: Column, k: Column, s: Column) -> Column:
        old = F.get(chosen, (k - 1).cast("int"))
        names = F.array_sort(F.array_distinct(F.concat(old["supporting_detectors"], s["supporting_detectors"], F.array(old["source_detector"], s["source_detector"]))))
        known = lambda x, n: changed(x, supporting_detectors=n, support_count=F.size(n))
        others = F.filter(chosen, lambda c, i: i != k - 1)
        return let(
            names,
            lambda n: F.when(better(old, s), F.concat(others, F.array(known(s, n)))).otherwise(F.transform(chosen, lambda c, i: F.when(i == k - 1, known(c, n)).otherwise(c))),
        )

    return _fold(island, meet, settle, F.array().cast(SPANS), lambda acc: acc, lambda acc, s: F.concat(acc, F.array(s)))


def fused(candidates: Column, only_semantic: bool = False) -> Column:
    """Candidates of all detectors merged: one span of each island of semantic ones, and of others the better of overlapping equals; ``only_semantic`` where no others are."""

    def merged(spans: Column) -> Column:
        if only_semantic:
            return _each_island(spans, _best_of)
        semantic = F.filter(spans, lambda s: s["entity_type"].isin(*SEMANTIC))
        plain = F.filter(spans, lambda s: ~s["entity_type"].isin(*SEMANTIC))
        kinds = F.array_distinct(F.transform(plain, lambda s: s["entity_type"]))
        of = lambda kind: _each_island(F.filter(plain, lambda s: s["entity_type"] == kind), _fold_type)
        return F.concat(_each_island(semantic, _best_of), F.flatten(F.transform(kinds, of)))

    return F.when(F.size(candidates) > 1, let(in_order(canonical(candidates)), merged)).otherwise(canonical(candidates))


#: A resolved span: the span, and the entity_id of the span that took its place.
RESOLVED = f"array<struct<span:{SPANS[6:-1]},beaten_by:string>>"


def _weight(s: Column) -> Column:
    return F.struct(F.coalesce(s["context_required"], F.lit(False)), type_rank(s["entity_type"]), s["confidence"], F.length(s["raw_text"]))


def _fold_overlaps(island: Column) -> Column:
    """All spans of an island: of two that overlap in one section and page the one of more weight stays, and ties go to the earlier one."""
    nothing = F.struct(F.array().cast(SPANS).alias("chosen"), F.array().cast(RESOLVED).alias("lost"))
    here = lambda a, b: meet(a, b) & a["section_id"].eqNullSafe(b["section_id"]) & a["page_index"].eqNullSafe(b["page_index"])
    loses = lambda x, to: F.array(F.struct(x.alias("span"), to["entity_id"].alias("beaten_by"))).cast(RESOLVED)

    def settle(acc: Column, k: Column, s: Column) -> Column:
        old = F.get(acc["chosen"], (k - 1).cast("int"))
        others = F.filter(acc["chosen"], lambda c, i: i != k - 1)
        swapped = F.struct(F.concat(others, F.array(s)).alias("chosen"), F.concat(acc["lost"], loses(old, s)).alias("lost"))
        stays = F.struct(acc["chosen"].alias("chosen"), F.concat(acc["lost"], loses(s, old)).alias("lost"))
        return F.when(_weight(s) > _weight(old), swapped).otherwise(stays)

    more = lambda acc, s: F.struct(F.concat(acc["chosen"], F.array(s)).alias("chosen"), acc["lost"].alias("lost"))
    folded = _fold(island, here, settle, nothing, lambda acc: acc["chosen"], more)
    return let(folded, lambda x: F.concat(_unbeaten(x["chosen"]), x["lost"]))


def _unbeaten(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(None).cast("string").alias("beaten_by"))).cast(RESOLVED)


def resolved(spans: Column) -> Column:
    """``spans`` with ``beaten_by``, null for those that stay: an array of structs (span, beaten_by).

    A context makes a span weigh more, then its type, confidence and length; ties go to the earlier one. A span meets only the
    first of the chosen spans that it overlaps.
    """
    first = by(spans, lambda s: s["start"], lambda s: s["stop"], lambda s: s["rule_seq"], lambda s: s["entity_id"])
    order = by(first, _place, lambda s: -end(s), lambda s: -s["confidence"])
    return F.when(F.size(spans) > 1, _each_island(order, _fold_overlaps, _unbeaten)).otherwise(_unbeaten(spans))


# --- rows ----------------------------------------------------------------------------------------


def fuse(candidates: DataFrame, keys: Iterable[str] = ("doc_id",), types: Iterable[str] | None = None) -> DataFrame:
    """Rows of ``fused`` for candidates in rows: keys and all columns of a span.

    With ``types`` only those are fused, and only what they compete with is shuffled: semantic types with one another, each other type with itself.
    """
    kept = None if types is None else {CANONICAL.get(t, t) for t in types}
    if kept is not None:
        rivals = kept | set(SEMANTIC) if kept & set(SEMANTIC) else kept
        candidates = candidates.filter(_lookup(F.col("entity_type"), CANONICAL, F.col("entity_type")).isin(*rivals))
    rows = in_rows(beside(candidates, keys).withColumn("_spans", fused(F.col("_spans"), only_semantic=kept is not None and kept <= set(SEMANTIC))), keys, F.col("_spans"))
    return rows if kept is None else rows.filter(F.col("entity_type").isin(*kept))


def resolve_overlaps(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Rows of ``resolved`` for spans in rows: keys, all columns of a span, and beaten_by."""
    rows = beside(spans, keys).withColumn("_resolved", resolved(F.col("_spans")))
    rows = rows.select(*keys, F.explode_outer("_resolved").alias("_r")).filter("_r is not null")
    return rows.select(*keys, *[F.col(f"_r.span.{c}").alias(c) for c in FIELDS], "_r.beaten_by")


def island_numbers(spans: DataFrame, keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """keys, entity_id and island: the number of the run of overlapping spans within the keys."""
    rows = beside(spans, keys).withColumn("_spans", in_order(F.col("_spans"))).withColumn("_islands", island_of(F.col("_spans")))
    pairs = F.arrays_zip(F.col("_islands").alias("i"), F.transform("_spans", lambda s: s["entity_id"]).alias("e"))
    return rows.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.col("_p.i").cast("long").alias("island"), F.col("_p.e").alias("entity_id"))


# --- thresholds ----------------------------------------------------------------------------------


def accepted(accept: float, s: Column | None = None) -> Column:
    """Whether a span is sure enough; semantic ones of other detectors than rules need more, less so if detectors agree."""
    f = (lambda c: s[c]) if s is not None else F.col
    strict = f("entity_type").isin(*SEMANTIC) & (f("source_detector") != "regex")
    needed = F.greatest(F.lit(accept), F.lit(0.85)) - F.when(f("support_count") >= 2, F.lit(0.05)).otherwise(F.lit(0.0))
    return F.when(strict, ~f("semantic_conflict") & (f("confidence") >= needed)).otherwise(f("confidence") >= accept)


def reviewable(review: float, s: Column | None = None) -> Column:
    """Whether a span is sure enough to be replaced at all."""
    f = (lambda c: s[c]) if s is not None else F.col
    sure = f("confidence") >= review
    return F.when(f("entity_type").isin(*SEMANTIC), sure | f("semantic_conflict")).otherwise(sure)
