"""Spans as arrays beside their text.

A document's spans are one array column, so no step from scan to rewritten text joins on keys or shuffles texts. Functions of this
package that take and give ``Column`` work on such arrays; those that take and give DataFrames have a row for each span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a span. ``start`` and ``stop`` count code points, half-open.
FIELDS = {
    "start": "bigint", "stop": "bigint", "entity_type": "string", "rule_seq": "int", "entity_id": "string", "raw_text": "string", "normalized_text": "string",
    "confidence": "double", "source_detector": "string", "context_required": "boolean", "section_id": "string", "page_index": "int", "support_count": "int",
    "supporting_detectors": "array<string>", "original_entity_type": "string", "semantic_conflict": "boolean", "conflicting_entity_types": "array<string>",
    "canonical_entity_id": "string", "mention_cluster_id": "string", "mention_rule": "string",
}
SPAN = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
SPANS = f"array<{SPAN}>"
#: Columns of a span whose fusion hasn't been looked at yet.
PLAIN = ("entity_id", "entity_type", "raw_text", "normalized_text", "confidence", "source_detector", "start", "stop", "context_required", "rule_seq")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def span(**fields: Column) -> Column:
    """A span with the given fields; the others are null."""
    bare = F.expr("named_struct(" + ", ".join(f"'{k}', CAST(NULL AS {t})" for k, t in FIELDS.items()) + ")")
    return changed(bare, **fields)


def changed(s: Column, **fields: Column) -> Column:
    """The span ``s`` with other values in some fields."""
    for name, value in fields.items():
        s = s.withField(name, value.cast(FIELDS[name]))
    return s


_REUSED: WeakKeyDictionary = WeakKeyDictionary()
#: Expressions that are kept; the oldest goes first.
_KEPT = 64


def reused(key: tuple, build: Callable[[], Column]) -> Column:
    """What ``build`` returns, built once for each key and Spark context: an expression over columns by name, which every query and micro-batch can share.

    Large expressions take seconds to build, as each of their nodes is a call to the JVM, and no data are involved.
    """
    kept = _REUSED.setdefault(SparkContext._active_spark_context, {})
    if key not in kept:
        kept[key] = build()
        if len(kept) > _KEPT:
            del kept[next(iter(kept))]
    return kept[key]


#: Values of a group of ``before``.
_GROUP = 128


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (array of bigint) what ``op``, a sum or maximum from 0 on, makes of those before it.

    A fold that gathered its results would copy them at each step. So values are put in groups, and a value is worked out from its
    group's start and the few values between.
    """
    zero = F.lit(0).cast("bigint")
    first = lambda v, i: F.aggregate(F.slice(v, F.lit(1), i), zero, op)

    def grouped(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / _GROUP), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(v, g * _GROUP + 1, F.lit(_GROUP)))

    def placed(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, zero, op))
        return let(totals, lambda t: F.flatten(F.transform(groups, lambda g, i: let(first(t, i), lambda start: F.transform(g, lambda _, j: op(start, first(g, j)))))))

    return let(let(values, grouped), placed)


def plus(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


#: Characters of a block of ``blocks``, and of the larger ones that are cut first.
_BLOCK, _BLOCKS = 4096, 4096 * 256


def blocks(text: Column) -> Column:
    """``text`` in blocks of _BLOCK characters, so that a place in it is found without counting from its start."""
    last = lambda t, n: F.greatest(F.floor((F.length(t) - 1) / n), F.lit(0)).cast("int")
    cut = lambda t, n: F.transform(F.sequence(F.lit(0), last(t, n)), lambda i: F.substr(t, i * n + 1, F.lit(n)))
    return F.flatten(F.transform(cut(text, _BLOCKS), lambda b: cut(b, _BLOCK)))


def between(parts: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` of the text that ``parts`` are the blocks of."""
    per = lambda p: F.floor(p / _BLOCK).cast("int")
    inside = lambda p: (p % _BLOCK).cast("int")
    first, last = per(start), per(stop)
    one = F.substr(F.get(parts, first), inside(start) + 1, (stop - start).cast("int"))
    many = F.concat(F.substr(F.get(parts, first), inside(start) + 1), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.left(F.coalesce(F.get(parts, last), F.lit("")), inside(stop)))
    return F.when(stop <= start, F.lit("")).when(first == last, one).otherwise(many)


def none() -> Column:
    return F.array().cast(SPANS)


def by(spans: Column, *order: Callable[[Column], Column]) -> Column:
    """``spans`` in the order of the given values, then of their places in the array."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[o(s).alias(f"k{n}") for n, o in enumerate(order)], i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def beside(spans: DataFrame, keys: Iterable[str]) -> DataFrame:
    """keys and ``_spans``: the spans of each key as an array in order of place and rule; columns that are missing are null."""
    have = set(spans.columns)
    one = F.struct(*[(F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])
    return spans.select(*keys, one.alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_spans"))


def in_rows(docs: DataFrame, keys: Iterable[str], spans: Column, columns: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """A row for each span of ``spans``: keys and columns; a column that is named like a key is called ``span_`` and its name."""
    keys = list(keys)
    # not explode: from that the optimizer infers a filter that computes the spans once more
    rows = docs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.explode_outer(spans).alias("_s")).filter("_s is not null")
    named = [F.col(f"_s.{c}").alias(f"span_{c}" if c in keys else c) for c in columns]
    return rows.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], *named)
