"""Plans for putting original values back into edited texts.

A document was exported as segments whose texts hold placeholders (templates); its edited segments come back. Every placeholder that
an edited segment kept in place is matched with its vault entry; anything that changed is a conflict, and one conflict fails the
whole plan. Conflict rules are joins and array expressions; only similarity of texts is computed in Python.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.lineage import settled
from .analytics import PLACEHOLDER

# Least similarity of a moved segment, and by how much it must beat the next one.
LEAST_RATIO, CLEAR_LEAD = 0.80, 0.08


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(0))


def locality(container: Column) -> Column:
    """A container's id without the paragraph number at its end."""
    return F.regexp_replace(F.coalesce(container, F.lit("")), r":p:\d+$", "")


def flat(text: Column) -> Column:
    """Lower case with single spaces, none of them at the ends."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def ratio_bound(a: Column, b: Column) -> Column:
    """What the similarity of two flat texts can be at most: by their lengths, and where that is enough by how often they share each character."""
    both = F.length(a) + F.length(b)
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: F.length(c) == 1)
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    by_length = F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)
    return F.when((by_length < LEAST_RATIO) | (both == 0), by_length).otherwise(2.0 * shared / both)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two flat texts by their longest common runs; 0 for nulls."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")


def with_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``ratio``, which is 0 where a bound tells that it can't reach LEAST_RATIO: such texts aren't compared."""
    rows = pairs.withColumns({"_a": flat(F.col(a)), "_b": flat(F.col(b))})
    can = ratio_bound(F.col("_a"), F.col("_b")) >= LEAST_RATIO
    rows = rows.withColumn("_a", F.when(can, F.col("_a")))
    return rows.withColumn("ratio", _ratio("_a", "_b")).drop("_a", "_b")


def _conflict(reason: str, placeholder: Column | None = None) -> Column:
    return F.struct((placeholder if placeholder is not None else F.lit(None).cast("string")).alias("placeholder"), F.lit(reason).alias("reason"))


_NONE = "array<struct<placeholder:string,reason:string>>"


def _when(test: Column, *conflicts: Column) -> Column:
    return F.when(test, F.array(*conflicts)).otherwise(F.array().cast(_NONE))


def conflicts_and_decisions(templates: DataFrame, edited: DataFrame, vault: DataFrame, doc: str = "doc_id", fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(conflicts: doc, segment_id, placeholder, reason; decisions: doc, segment_id, placeholder, decision_reason, start, stop, original_value_hash).

    ``templates`` (doc, segment_id, container_id, section_id, page_index, text, refs), ``edited`` (the same without refs),
    ``vault`` (doc, segment_id, placeholder, start, stop, original_value_hash). Segment ids are unique within a document.
    """
    e = edited.select(
        doc, F.col("segment_id").alias("e_id"), F.col("container_id").alias("e_container"), F.col("section_id").alias("e_section"), F.col("page_index").alias("e_page"),
        F.col("text").alias("e_text"), placeholders(F.col("text")).alias("e_refs"),
    )
    e = settled(e)
    t = templates.select(doc, "segment_id", "container_id", "section_id", "page_index", F.col("text").alias("t_text"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    same = settled(t.join(e.withColumn("segment_id", F.col("e_id")), [doc, "segment_id"], "left"))
    no_problem = F.lit(None).cast("string").alias("problem")
    found = same.filter("e_id is not null").select("*", F.lit(True).alias("exact"), no_problem)
    lost = same.filter("e_id is null").select(t.columns)
    if fuzzy:
        near = lost.withColumn("near", locality(F.col("container_id"))).join(
            e.withColumn("near", locality(F.col("e_container"))).withColumnRenamed("e_refs", "refs2"), [doc, "near"]
        )
        near = with_ratio(near.filter(F.col("refs") == F.col("refs2")), "t_text", "e_text")
        by_ratio = Window.partitionBy(doc, "segment_id").orderBy(F.desc("ratio"), "e_id")
        near = near.withColumn("place", F.row_number().over(by_ratio)).withColumn("next", F.lead("ratio").over(by_ratio)).filter("place = 1")
        low = F.col("ratio") < LEAST_RATIO
        tied = (F.col("next") >= LEAST_RATIO) & (F.col("ratio") - F.col("next") <= CLEAR_LEAD)
        near = near.withColumn("problem", F.when(low, "low_confidence_match").when(tied, "ambiguous_segment_match")).withColumnRenamed("refs2", "e_refs")
        own = [c for c in e.columns if c != doc]
        moved = near.select(doc, "segment_id", *[F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in own], F.when(F.col("problem").isNull(), False).alias("exact"), "problem")
        lost = lost.join(moved, [doc, "segment_id"], "left")
    else:
        lost = lost.select("*", *[F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns if c != doc], F.lit(None).cast("boolean").alias("exact"), no_problem)
    # the placeholders of a document's edited segments (at) and templates (owner): where each now stands and which segment it is from
    empty, no_id = F.array().cast("array<string>"), F.lit(None).cast("string")
    uses = e.select(doc, F.struct(F.col("e_id").alias("at"), no_id.alias("owner"), F.col("e_refs").alias("refs")).alias("u")).filter(F.size("u.refs") > 0)
    uses = uses.unionByName(same.filter(F.size("refs") > 0).select(doc, F.struct(no_id.alias("at"), F.col("segment_id").alias("owner"), "refs").alias("u")))
    uses = uses.groupBy(doc).agg(F.collect_list("u").alias("uses"))
    of_place = lambda p, c: F.transform(F.filter("uses", lambda u: u[c].isNotNull() & F.array_contains(u["refs"], p)), lambda u: u[c])
    get = lambda p: F.coalesce(F.array_distinct(of_place(p, "at")), empty)
    rows = found.unionByName(lost).join(uses, doc, "left")
    or_null = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0"), None).otherwise(c.cast("string"))
    container = F.when(F.col("exact"), F.col("e_container").eqNullSafe(F.col("container_id"))).otherwise(locality(F.col("e_container")) == locality(F.col("container_id")))
    section = F.when(F.col("exact"), F.coalesce("e_section", F.lit("")) == F.coalesce("section_id", F.lit(""))).otherwise(locality(F.col("e_section")) == locality(F.col("section_id")))
    times = lambda xs, p: F.size(F.filter(xs, lambda x: x == p))
    refs, now = F.col("refs"), F.col("e_refs")
    spread = F.filter(refs, lambda p: F.exists("uses", lambda u: (u["at"] != F.col("e_id")) & F.array_contains(u["refs"], p)))
    doubled = F.array_sort(F.array_distinct(F.filter(now, lambda p: times(now, p) > times(refs, p))))
    absent = F.filter(refs, lambda p: ~F.array_contains(now, p))
    extra = F.array_sort(F.array_distinct(F.filter(now, lambda p: ~F.array_contains(refs, p))))
    elsewhere = lambda p: F.exists(get(p), lambda s: s != F.col("segment_id"))
    foreign = lambda p: F.coalesce(F.array_max(of_place(p, "owner")) != F.col("segment_id"), F.lit(False))
    per = lambda xs, make: F.transform(xs, make)
    of = lambda p, reason: F.struct(p.alias("placeholder"), reason.alias("reason"))
    changed = F.concat(
        _when((F.array_sort(F.array_distinct(now)) == F.array_sort(F.array_distinct(refs))), _conflict("placeholder_reordered")),
        per(doubled, lambda p: of(p, F.lit("placeholder_duplicated"))),
        F.filter(
            per(absent, lambda p: of(p, F.when(F.size(get(p)) == 0, "placeholder_deleted").when(elsewhere(p), "segment_split"))), lambda x: x["reason"].isNotNull()
        ),
        per(extra, lambda p: of(p, F.when(foreign(p), "segment_merge").otherwise("placeholder_drift"))),
    )
    all_ = F.concat(
        _when(~container, _conflict("container_mismatch")),
        _when(~or_null(F.col("e_page")).eqNullSafe(or_null(F.col("page_index"))), _conflict("page_index_mismatch")),
        _when(~section, _conflict("section_mismatch")),
        per(spread, lambda p: of(p, F.lit("segment_split"))),
        F.when(now != refs, changed).otherwise(F.array().cast(_NONE)),
    )
    at = F.array_distinct(F.flatten(F.transform("refs", get)))
    why = F.when(F.size(at) == 0, "missing_segment").when(F.size(at) > 1, "segment_split").otherwise("segment_merge")
    of_lost = F.concat(_when(F.col("problem").isNotNull(), of(F.lit(None).cast("string"), F.col("problem"))), F.array(of(F.lit(None).cast("string"), why)))
    # exact is true where the id was found, false where a text took its place, and null for lost segments
    problems = F.when(F.col("exact").isNull(), of_lost.cast(_NONE)).otherwise(all_.cast(_NONE))
    rows = settled(rows.select(doc, "segment_id", "exact", "refs", problems.alias("problems")))
    wanted = rows.filter(F.size("problems") == 0).select(doc, "segment_id", "exact", F.explode("refs").alias("placeholder"))
    # of entries that repeat one is taken; a window sorts them as the join needs them, where dropDuplicates would sort them twice more
    key = [doc, "segment_id", "placeholder"]
    again = F.lag(F.lit(True)).over(Window.partitionBy(*key).orderBy("start", "stop", "original_value_hash"))
    entries = vault.withColumn("_again", again).filter("_again is null").drop("_again").withColumn("_known", F.lit(True))
    wanted = settled(wanted.join(entries, key, "left"))
    missing = wanted.filter("_known is null").select(doc, "segment_id", "placeholder", F.lit("missing_vault_entry").alias("reason"))
    decision = F.when(F.col("exact"), "exact_segment_match").otherwise("fuzzy_anchored_segment_match")
    decisions = wanted.filter("_known").select(doc, "segment_id", "placeholder", decision.alias("decision_reason"), "start", "stop", "original_value_hash")
    return rows.select(doc, "segment_id", F.inline("problems")).unionByName(missing), decisions


def plan_status(templates: DataFrame, conflicts: DataFrame, decisions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, status (ready or fail_closed), matched_segments, rejected_segments and rejected_placeholders."""
    bad = conflicts.groupBy(doc).agg(F.countDistinct("segment_id").alias("rejected_segments"), F.count("placeholder").alias("rejected_placeholders"), F.count("*").alias("_n"))
    good = decisions.groupBy(doc).agg(F.countDistinct("segment_id").alias("matched_segments"))
    rows = templates.select(doc).distinct().join(bad, doc, "left").join(good, doc, "left").fillna(0)
    return rows.select(doc, F.when(F.col("_n") > 0, "fail_closed").otherwise("ready").alias("status"), "matched_segments", "rejected_segments", "rejected_placeholders")
