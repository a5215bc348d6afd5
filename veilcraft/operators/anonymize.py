"""Replacement plans and rewritten texts: from scan to splice a row stays where it is, with its spans beside its text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, ordered
from ..plans.policies import POLICIES, Policy
from .fuse import CANONICAL, accepted, fused, resolved, reviewable
from .mentions import with_mentions
from .scan import dealt, with_spans
from .spans import SPAN, before, beside, between, blocks, by, in_rows, let, most, none, plus, reused, span

#: Types that share a label in placeholders.
ADDRESS_LIKE = ("ADDRESS", "CITY", "STREET", "POSTAL_CODE", "HOUSE_NUMBER", "APARTMENT_NUMBER", "COUNTRY", "PLACE_OF_BIRTH")
STYLES = ("category_placeholder", "mask", "fixed_mask", "format_preserving")


def label(entity_type: Column) -> Column:
    return F.when(entity_type == "PERSON", "OSOBA").when(entity_type.isin(*ADDRESS_LIKE), "ADRES").otherwise(entity_type)


def strategy(mode: str = "irreversible", style: str | None = None, policy: Policy = POLICIES["external_irreversible"]) -> str:
    """Which of STYLES renders replacements, by processing mode, a style asked for, and the policy's style."""
    if mode == "reversible":
        return "category_placeholder"
    if style is not None:
        return {"mask": "fixed_mask", "format_preserving": "format_preserving"}.get(style, "category_placeholder")
    return policy.style if policy.style in ("mask", "format_preserving") else "category_placeholder"


def rendered(style: str, s: Column, ordinal: Column) -> Column:
    """What replaces the span ``s``."""
    kind, raw = s["entity_type"], s["raw_text"]
    stars = F.repeat(F.lit("*"), F.length(raw))
    if style == "mask":
        return F.when(kind.isin("EMAIL", "PHONE"), stars).otherwise(F.regexp_replace(raw, "[A-Za-z0-9]", "*"))
    if style == "fixed_mask":
        return F.lit("****")
    if style == "format_preserving":
        return F.when(kind.isin("EMAIL", "PHONE"), stars).otherwise(F.regexp_replace(raw, r"[\p{L}\p{N}]", "*"))
    return F.concat(F.lit("["), label(kind), F.lit("_"), ordinal.cast("string"), F.lit("]"))


def numbered(spans: Column, review: float = 0.6, by_label: bool = False, counted: Column | None = None) -> Column:
    """The spans that are to be replaced, in order of place, each with its ordinal: an array of structs (span, ordinal).

    Persons are numbered in order of their places, mentions as the person that they name; one whose person is gone shares the next
    number. Other types count the spans of the type that pass review (with ``by_label``, those of the placeholder's label), from where ``counted``, a
    map by type, says that others have got to.
    """
    so_far = lambda kind: F.lit(0) if counted is None else F.coalesce(F.try_element_at(counted, kind), F.lit(0))
    person = lambda s: s["entity_type"] == "PERSON"
    seed = lambda s: person(s) & s["canonical_entity_id"].isNull()
    group = lambda s: label(s["entity_type"]) if by_label else s["entity_type"]
    order = by(spans, lambda s: s["start"], lambda s: s["stop"], lambda s: s["rule_seq"], lambda s: s["entity_id"], lambda s: -s["confidence"])

    def with_numbers(x: Column) -> Column:
        own, seeds = x["own"], x["seeds"]
        kept = F.filter(own, lambda s: reviewable(review, s) & ~person(s))
        groups = F.array_distinct(F.transform(kept, group))
        numbered_ = lambda s, n: F.struct(s.alias("span"), n.cast("bigint").alias("ordinal"))
        others = F.flatten(F.transform(groups, lambda g: F.transform(F.filter(kept, lambda s: group(s) == g), lambda s, i: numbered_(s, i + 1 + so_far(g)))))
        at = lambda s: F.coalesce(F.array_position(seeds, F.coalesce(s["canonical_entity_id"], s["entity_id"])), F.lit(0))
        people = F.transform(F.filter(own, lambda s: reviewable(review, s) & person(s)), lambda s: numbered_(s, let(at(s), lambda n: F.when(n == 0, F.size(seeds) + 1).otherwise(n))))
        # mentions of other types than PERSON count with the person that they name
        follows = F.transform(others, lambda o: let(at(o["span"]), lambda n: F.when(o["span"]["canonical_entity_id"].isNull(), o).otherwise(numbered_(o["span"], F.when(n == 0, F.size(seeds) + 1).otherwise(n)))))
        return F.concat(people, follows)

    return let(let(order, lambda o: F.struct(o.alias("own"), F.transform(F.filter(o, seed), lambda s: s["entity_id"]).alias("seeds"))), with_numbers)


def unbeaten(spans: Column) -> Column:
    """The spans that no overlapping one has beaten."""
    return F.transform(F.filter(resolved(spans), lambda r: r["beaten_by"].isNull()), lambda r: r["span"])


#: A replacement: where it goes, what stands there then, and the span that it hides.
EDIT = f"struct<start:bigint,stop:bigint,replacement_text:string,entity_type:string,ordinal:bigint,warning:string,span:{SPAN}>"


def planned(spans: Column, mode: str = "irreversible", style: str | None = None, policy: Policy = POLICIES["external_irreversible"], counted: Column | None = None) -> Column:
    """Replacements for fused spans as an array of EDIT in order of place: overlaps resolved, weak spans left out, the rest rendered.

    ``warning`` tells of spans below the accept threshold, which are replaced nevertheless.
    """
    how = strategy(mode, style, policy)
    stay = unbeaten(spans)

    def edit(x: Column) -> Column:
        s = x["span"]
        unsure = F.concat(F.lit("Entity "), s["entity_id"], F.lit(" below accept threshold included conservatively."))
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), rendered(how, s, x["ordinal"]).alias("replacement_text"), s["entity_type"].alias("entity_type"), x["ordinal"].alias("ordinal"),
            F.when(~accepted(policy.accept, s), unsure).alias("warning"), s.alias("span"),
        ).cast(EDIT)

    return F.array_sort(F.transform(numbered(stay, policy.review, counted=counted), edit))


def pieces(text: Column, edits: Column) -> Column:
    """``text`` with ``edits`` put in, as an array of strings: what stands before an edit, its replacement, and so on to the end.

    Edits are structs (start, stop, replacement_text) in order of place; what an earlier one covers isn't put out again. The text is walked once,
    in blocks, so neither the number of edits nor the text's length makes an edit cost more.
    """
    stops = F.transform(edits, lambda e: e["stop"])
    behind = F.coalesce(F.array_max(stops), F.lit(0)).cast("bigint")

    def put(x: Column) -> Column:
        begins, parts = x["begins"], x["parts"]
        each = F.transform(edits, lambda e, i: F.array(between(parts, F.get(begins, i), e["start"]), e["replacement_text"]))
        return F.concat(F.flatten(each), F.array(between(parts, behind, F.length(text).cast("bigint"))))

    return let(F.struct(before(stops, most).alias("begins"), blocks(text).alias("parts")), put)


def spliced(text: Column, edits: Column) -> Column:
    """``text`` with ``edits`` put in, as one string."""
    return F.when(F.size(edits) > 0, F.array_join(pieces(text, edits), "")).otherwise(text)


def findings(edits: Column) -> Column:
    """How many spans of each type are replaced, in order of type."""
    kinds = F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["entity_type"])))
    count = lambda t: F.size(F.filter(edits, lambda e: e["entity_type"] == t)).cast("long")
    return F.map_from_arrays(kinds, F.transform(kinds, count))


def with_detections(
    docs: DataFrame, types: Iterable[str] | None = None, rules: list[Rule] | None = None, others: Iterable[DataFrame] = (), keys: tuple[str, ...] = ("doc_id",), text: str = "text",
    known: Column | None = None,
) -> DataFrame:
    """``docs`` with ``_spans``: fused spans of rules, ``others`` (candidates of further detectors) and ``known`` (an array beside the text), and
    mentions of the persons found."""
    rules = rules if rules is not None else ordered(types)
    others = list(others)
    rows = with_spans(docs, rules, text)
    if known is not None:
        rows = rows.withColumn("_spans", F.concat("_spans", known))
    for i, spans in enumerate(others):
        more = beside(spans, keys).select(*[F.col(k).alias(f"_of{k}") for k in keys], F.col("_spans").alias(f"_more{i}"))
        same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
        rows = rows.join(more, same, "left").drop(*[f"_of{k}" for k in keys])
        rows = rows.withColumn("_spans", F.concat("_spans", F.coalesce(f"_more{i}", none()))).drop(f"_more{i}")
    rows = rows.withColumn("_spans", reused(("fused",), lambda: fused(F.col("_spans"))))
    if known is None and not others and all(CANONICAL.get(r.entity_type, r.entity_type) != "PERSON" for r in rules):
        return rows  # no one to follow
    return with_mentions(rows, text).withColumn("_spans", F.concat("_spans", "_mentions")).drop("_mentions")


def detect(docs: DataFrame, types: Iterable[str] | None = None, rules: list[Rule] | None = None, others: Iterable[DataFrame] = (), keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each span of ``with_detections``: keys and all columns of a span."""
    rows = _keyed(docs, keys, text)
    return in_rows(with_detections(rows, types, rules, others, keys, "_text"), keys, F.col("_spans"))


def _keyed(docs: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    return dealt(docs.select(*keys, F.col(text).alias("_text")))


def replacements(docs: DataFrame, mode: str = "irreversible", style: str | None = None, policy: Policy = POLICIES["external_irreversible"], keys: tuple[str, ...] = ("doc_id",), text: str = "text", **found) -> DataFrame:
    """A row for each replacement: keys, start, stop, entity_type, entity_id, replacement_text, replacement_kind, ordinal, warning, and in
    reversible mode source_text (else null)."""
    rows = with_detections(_keyed(docs, keys, text), keys=keys, text="_text", **found)
    rows = rows.select(*keys, F.explode_outer(_plan(mode, style, policy)).alias("_e")).filter("_e is not null")
    source = F.col("_e.span.raw_text") if mode == "reversible" else F.lit(None).cast("string")
    return rows.select(
        *keys, "_e.start", "_e.stop", "_e.entity_type", "_e.span.entity_id", "_e.replacement_text", F.lit(strategy(mode, style, policy)).alias("replacement_kind"), "_e.ordinal",
        "_e.warning", source.alias("source_text"),
    )


def anonymize(
    docs: DataFrame, mode: str = "irreversible", style: str | None = None, types: Iterable[str] | None = None, rules: list[Rule] | None = None,
    others: Iterable[DataFrame] = (), policy: Policy = POLICIES["external_irreversible"], keys: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """keys, text with all replacements put in, and findings (a map of counts by type) for every row of ``docs``.

    A row is rewritten by itself: keys may be null, repeat, or be named like columns of spans (``others`` are looked up by keys, null ones
    too, and a key that repeats has them in each of its rows). Null texts stay null, with no findings. An empty table gives no rows.
    """
    rows = with_detections(_keyed(docs, keys, text), types, rules, others, keys, "_text")
    rows = rows.withColumn("_edits", _plan(mode, style, policy))
    done = reused(("spliced",), lambda: spliced(F.col("_text"), F.col("_edits")))
    return rows.select(*keys, done.alias(text), _counts().alias("findings"))


def _plan(mode: str = "irreversible", style: str | None = None, policy: Policy = POLICIES["external_irreversible"]) -> Column:
    return reused(("edits", mode, style, policy), lambda: planned(F.col("_spans"), mode, style, policy))


def _counts() -> Column:
    return reused(("findings",), lambda: findings(F.col("_edits")))


#: Stands between the segments of a document while it is searched; it ends in a letter, so no number reaches across. Texts may hold it as well.
_BOUNDARY = "\nsegment§end\n"


_OPTIONS = {"types", "rules", "others", "mode", "style", "policy"}


def _chosen(options: dict, *names: str) -> dict:
    if unknown := options.keys() - _OPTIONS:
        raise TypeError(f"unknown option {min(unknown)}")
    return {k: v for k, v in options.items() if k in names}


def _documents(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """_key and _parts, the segments (o, t) of each document in order; segments without a key are a document each."""
    rows = segments.select(F.col(key).alias("_key"), F.struct(F.col(order).alias("o"), F.col(text).alias("t")).alias("_part"))
    whole = rows.filter("_key is not null").groupBy("_key").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return whole.unionByName(rows.filter("_key is null").select("_key", F.array("_part").alias("_parts")))


_CUT = "struct<start:bigint,stop:bigint,replacement_text:string>"


def _with_cut_texts(rows: DataFrame) -> DataFrame:
    """``rows`` (_text, the joined _texts; _edits) with ``_done``: the rewritten text of each of ``_texts``, cut where their ends have moved to."""
    sizes = F.transform("_texts", lambda t: F.length(t).cast("bigint"))

    def bounds(n: Column) -> Column:
        ends = before(F.transform(n, lambda x: x + len(_BOUNDARY)), plus)  # where segments begin
        return let(ends, lambda at: F.transform(F.slice(at, F.lit(2), F.size(at)), lambda x: F.struct(x - len(_BOUNDARY), x, F.lit(None).cast("string")).cast(_CUT)))

    def segments_of(whole: Column) -> Column:
        marks = F.concat(F.filter(F.transform(whole, lambda p, i: F.when(p.isNull(), i)), lambda i: i.isNotNull()), F.array(F.size(whole)))
        # pieces of a segment lie between two marks
        return let(marks, lambda m: F.transform(m, lambda to, i: let(F.coalesce(F.get(m, i - 1) + 1, F.lit(0)), lambda at: F.array_join(F.slice(whole, at + 1, to - at), ""))))

    # the boundaries are edits as well, whose replacement is null
    cuts = F.array_sort(F.concat(F.transform("_edits", lambda e: F.struct(e["start"], e["stop"], e["replacement_text"]).cast(_CUT)), F.col("_bounds")))
    rows = rows.withColumn("_bounds", reused(("bounds",), lambda: let(sizes, bounds))).withColumn("_cuts", cuts)
    rows = rows.withColumn("_pieces", reused(("pieces",), lambda: pieces(F.col("_text"), F.col("_cuts"))))
    return rows.withColumn("_done", reused(("segments",), lambda: segments_of(F.col("_pieces")))).drop("_bounds", "_cuts", "_pieces")


def _segment_rows(rows: DataFrame, key: str, order: str, text: str, *more: str) -> DataFrame:
    """A row for each of ``_parts`` with its text of ``_done``; null texts stay null."""
    each = F.transform("_done", lambda t, i: F.struct(F.get("_parts", i).alias("p"), t.alias("t")))
    rows = rows.select("_key", *more, F.explode(each).alias("_s"))
    return rows.select(F.col("_key").alias(key), F.col("_s.p.o").alias(order), F.when(F.col("_s.p.t").isNotNull(), F.col("_s.t")).alias(text), *more)


def anonymize_segments(segments: DataFrame, key: str, order: str, text: str = "text", **options) -> DataFrame:
    """Segments of one document (``key``) rewritten together, so that a person keeps one number throughout: key, order, text and findings
    (of the document) for every row of ``segments``.

    Segments are joined in order of ``order`` (null first), then text, and the rewritten document is cut where their ends have moved to. What a text
    holds doesn't matter for that, not even the boundary itself. A span that reaches over an end is replaced in the segment where it
    begins. A null text stays null. Segments without a key belong to no document, and each is rewritten by itself. A document is held by one
    task. An empty table gives no rows. ``options`` are those of ``anonymize``.
    """
    rows = _documents(segments, key, order, text).withColumn("_texts", F.transform("_parts", lambda p: F.coalesce(p["t"], F.lit(""))))
    rows = with_detections(rows.withColumn("_text", F.array_join("_texts", _BOUNDARY)), keys=("_key",), text="_text", **_chosen(options, "types", "rules", "others"))
    rows = _with_cut_texts(rows.withColumn("_edits", _plan(**_chosen(options, "mode", "style", "policy"))))
    return _segment_rows(rows.withColumn("findings", _counts()), key, order, text, "findings")


#: What is known of a document's earlier segments: how far each type's numbers have got, and its persons in order of their numbers.
KNOWN = "_counted map<string,bigint>, _persons array<struct<raw_text:string,confidence:double,source_detector:string,support_count:int,supporting_detectors:array<string>>>"


def _known_spans(persons: Column) -> Column:
    """Spans of known persons, whose names stand in front of a document's new segments, each followed by a boundary."""
    sizes = F.transform(persons, lambda p: (F.length(p["raw_text"]) + len(_BOUNDARY)).cast("bigint"))

    def made(p: Column, start: Column, i: Column) -> Column:
        return span(
            entity_id=F.concat(F.lit("KNOWN_"), i.cast("string")), entity_type=F.lit("PERSON"), raw_text=p["raw_text"], normalized_text=p["raw_text"], confidence=p["confidence"],
            source_detector=p["source_detector"], start=start, stop=start + F.length(p["raw_text"]), context_required=F.lit(False), rule_seq=F.lit(0), support_count=p["support_count"],
            supporting_detectors=p["supporting_detectors"],
        )

    return let(before(sizes, plus), lambda at: F.transform(persons, lambda p, i: made(p, F.get(at, i), i)))


def continue_segments(segments: DataFrame, known: DataFrame, key: str, order: str, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(key, order, text of every row of ``segments``; what is known after them), where ``known`` (key and the columns of KNOWN) is what earlier
    segments of the same documents left.

    Numbers go on where they had got to, and names found earlier are found in the new segments: a document that comes in parts, in order, has
    the placeholders of the whole as far as names come before their mentions. A document's names are held by one task. ``known`` has every key
    once; segments without a key leave nothing behind.
    """
    rows = _documents(segments, key, order, text)
    old = known.select(F.col(key).alias("_of"), "_counted", "_persons")
    rows = rows.join(old, F.col("_key") == F.col("_of"), "left").drop("_of")
    rows = rows.withColumn("_counted", F.coalesce("_counted", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))
    rows = rows.withColumn("_persons", F.coalesce("_persons", F.array().cast(KNOWN.split("_persons ")[1])))
    new = F.transform("_parts", lambda p: F.coalesce(p["t"], F.lit("")))
    rows = rows.withColumn("_texts", F.concat(F.transform("_persons", lambda p: p["raw_text"]), new)).withColumn("_text", F.array_join("_texts", _BOUNDARY))
    rows = rows.withColumn("_known", reused(("known",), lambda: _known_spans(F.col("_persons"))))
    rows = with_detections(rows, keys=("_key",), text="_text", known=F.col("_known"), **_chosen(options, "types", "rules", "others"))
    chosen = _chosen(options, "mode", "style", "policy")
    rows = rows.withColumn("_edits", reused(("edits on", *sorted(chosen.items())), lambda: planned(F.col("_spans"), **chosen, counted=F.col("_counted"))))
    rows = rows.withColumn("_stay", reused(("stay",), lambda: unbeaten(F.col("_spans"))))
    seed = lambda s: (s["entity_type"] == "PERSON") & s["canonical_entity_id"].isNull()
    fields = ("raw_text", "confidence", "source_detector", "support_count", "supporting_detectors")
    persons = by(F.filter("_stay", seed), lambda s: s["start"], lambda s: s["stop"], lambda s: s["rule_seq"], lambda s: s["entity_id"], lambda s: -s["confidence"])
    persons = F.transform(persons, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    kinds = F.array_distinct(F.concat(F.map_keys("_counted"), F.transform(F.filter("_edits", lambda e: e["entity_type"] != "PERSON"), lambda e: e["entity_type"])))
    latest = lambda k: F.greatest(F.try_element_at("_counted", k), F.array_max(F.transform(F.filter("_edits", lambda e: e["entity_type"] == k), lambda e: e["ordinal"])))
    left = rows.filter("_key is not null").select(F.col("_key").alias(key), F.map_from_arrays(kinds, F.transform(kinds, latest)).alias("_counted"), persons.alias("_persons"))
    names = F.size("_persons")
    done = _with_cut_texts(rows).withColumn("_done", F.slice("_done", names + 1, F.size("_done") - names))
    others = known.join(left.select(F.col(key).alias("_of")), F.col(key) == F.col("_of"), "left_anti").select(key, "_counted", "_persons")
    return _segment_rows(done, key, order, text), left.unionByName(others)
