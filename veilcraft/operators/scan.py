"""Rule scan: texts to candidate spans, in one projection and without a shuffle."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import NORMALIZERS
from ..functions.rules import FLAGS, Rule, marked, ordered
from ..functions.validate import VALIDATORS
from .spans import PLAIN, before, between, blocks, in_rows, let, none, plus, reused, span

#: Marks put around matches and between their parts; a text's own are replaced by another control character before it is searched.
_EDGE, _PART, _OWN = "\x01", "\x02", "\x03"
#: Characters before a phone number that are looked at.
_BEFORE = 16
_GAP = " \t\r\n-"


def entity_id(entity_type: Column, normalized: Column, start: Column, stop: Column) -> Column:
    return F.concat(F.lit("ENT_"), F.substring(F.sha1(F.concat_ws("|", entity_type, normalized, start.cast("string"), stop.cast("string"))), 1, 12))


def _walked(found: Column, sides: bool = True) -> Column:
    """The matches of one rule in a text: ``found`` has the rule's place (seq) and the text parted at its matches.

    Every second piece is a match, and that has three parts. What stands beside a match, without white space and hyphens, is kept as well:
    suppressions of cards look at it, so without ``sides`` it is null. A match is never white space alone, so that lies in the pieces next to it.
    """
    pieces = found["pieces"]
    bare = lambda piece: F.replace(piece, F.lit(_PART), F.lit(""))
    beside = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

    def match(at: Column, i: Column) -> Callable[[Column], Column]:
        def one(parts: Column) -> Column:
            lead, raw = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            start = at + F.length(lead)
            left = F.right(F.rtrim(F.concat(bare(beside(i - 2)), beside(i - 1), lead), F.lit(_GAP)), F.lit(1)) if sides else F.lit(None).cast("string")
            right = F.left(F.ltrim(F.concat(beside(i + 1), bare(beside(i + 2))), F.lit(_GAP)), F.lit(1)) if sides else F.lit(None).cast("string")
            return F.struct(
                found["seq"].alias("seq"), start.alias("start"), (start + F.length(raw)).alias("stop"), raw.alias("raw"),
                left.alias("left"), right.alias("right"),
            )

        return one

    def matches(at: Column) -> Column:
        each = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, let(F.split(p, _PART, -1), match(F.get(at, i), i))))
        return F.filter(each, lambda m: m.isNotNull())

    return let(before(F.transform(pieces, lambda p: F.length(bare(p)).cast("bigint")), plus), matches)


def _by_rule(seq: Column, rules: list[Rule], field: str, value) -> Column:
    """``value`` of the field of the rule at ``seq``; rules with equal fields share a branch."""
    out = None
    for key in dict.fromkeys(getattr(r, field) for r in rules):
        test = seq.isin(*[i for i, r in enumerate(rules) if getattr(r, field) == key])
        out = F.when(test, value(key)) if out is None else out.when(test, value(key))
    return out


def _spans(matches: Column, rules: list[Rule], parts: Column) -> Column:
    """Valid spans that nothing suppresses, in order of place, type and rule, each place once for a type; ``parts`` are the text's blocks."""
    listed = lambda field: F.split(F.lit("|".join(str(getattr(r, field)) for r in rules)), r"\|")
    of = lambda field, seq, kind: F.get(listed(field), seq).cast(kind)

    def named(m: Column) -> Column:
        normal = _by_rule(m["seq"], rules, "normalizer", lambda n: NORMALIZERS[n](m["raw"]))
        return F.struct(of("entity_type", m["seq"], "string").alias("kind"), normal.alias("normal"), m.alias("m"))

    def kept(x: Column) -> Column:
        m, kind = x["m"], x["kind"]
        suppressed = (
            F.when(kind == "CARD", m["left"].rlike(r"(?U)\A\d") | m["right"].rlike(r"(?U)\A\d"))
            .when(kind == "PHONE", F.lower(between(parts, F.greatest(m["start"] - _BEFORE, F.lit(0)), m["start"])).contains("regon"))
            .when(kind == "DOCUMENT_NUMBER", F.lower(m["raw"]).rlike("paszport|passport|prawo jazdy"))
            .otherwise(False)
        )
        return (x["normal"] != "") & _by_rule(m["seq"], rules, "validator", lambda v: VALIDATORS[v](m["raw"])) & ~suppressed

    def made(x: Column) -> Column:
        m = x["m"]
        return span(
            start=m["start"], stop=m["stop"], entity_type=x["kind"], rule_seq=m["seq"], entity_id=entity_id(x["kind"], x["normal"], m["start"], m["stop"]), raw_text=m["raw"],
            normalized_text=x["normal"], confidence=of("confidence", m["seq"], "double"), source_detector=F.lit("regex"), context_required=of("context", m["seq"], "boolean"),
        )

    def once(spans: Column) -> Column:
        same = lambda a, b: (a["start"] == b["start"]) & (a["stop"] == b["stop"]) & (a["entity_type"] == b["entity_type"])
        return F.filter(spans, lambda s, i: (i == 0) | ~F.coalesce(same(s, F.get(spans, i - 1)), F.lit(False)))

    return let(F.array_sort(F.transform(F.filter(F.transform(matches, named), kept), made)), once)


def with_spans(docs: DataFrame, rules: list[Rule], text: str = "text", out: str = "_spans") -> DataFrame:
    """``docs`` with the array ``out`` of candidate spans in order of place, type and rule; null texts have none.

    Of spans of one type at one place the first rule's stays. A few facts about a text (its lower case, how many digits it has) tell which rules
    need to search it; a search puts marks around matches and their parts, at which the text is then parted.
    """
    if not rules:
        return docs.withColumn(out, none())
    t = F.col(text)
    plain = F.when(t.contains(_EDGE) | t.contains(_PART), F.translate(t, _EDGE + _PART, _OWN * 2)).otherwise(t)
    # letters that Java takes for i, k or s in other case, and digits that aren't ASCII: such texts are searched by all rules
    odd = t.rlike(r"[ſıİ\u212a]|[\p{Nd}&&[^0-9]]")
    facts = {"_plain": plain, "_low": F.lower(t), "_digits": F.length(F.regexp_replace(t, "[^0-9]+", "")), "_odd": odd}
    found = reused(("spans", text, tuple(rules)), lambda: _searched(t, rules))
    # where marks stood in the text itself, spans are cut out of it again
    own = reused(("restored", text, out), lambda: F.when(F.col("_plain") != t, _restored(out, t)).otherwise(F.col(out)))
    return docs.withColumns(facts).withColumn(out, found).withColumn(out, own).drop(*facts)


def _searched(text: Column, rules: list[Rule]) -> Column:
    """The spans of ``text``, next to which columns hold what tells which rules need to search it."""
    marks = f"{_EDGE}${{lead}}{_PART}${{entity}}{_PART}${{rest}}{_EDGE}"

    def parted(rule: Rule, seq: int) -> Column:
        tests = [F.col("_digits") >= rule.digits] * (rule.digits > 0)
        if rule.needs:
            tests.append(functools.reduce(operator.or_, [F.col("_low").contains(n) for n in rule.needs]))
        pieces = F.split(F.regexp_replace("_plain", FLAGS + marked(rule.pattern), marks), _EDGE, -1)
        if tests:
            pieces = F.when(F.col("_odd") | functools.reduce(operator.and_, tests), pieces)
        return F.struct(F.lit(seq).alias("seq"), pieces.alias("pieces"))

    searched = F.filter(F.array(*[parted(r, i) for i, r in enumerate(rules)]), lambda x: F.size(x["pieces"]) > 1)
    found = let(blocks(F.col("_plain")), lambda b: _spans(F.flatten(F.transform(searched, lambda x: _walked(x, any(r.entity_type == "CARD" for r in rules)))), rules, b))
    return F.when(text.isNotNull(), found).otherwise(none())


def _restored(out: str, text: Column) -> Column:
    return let(blocks(text), lambda b: F.transform(out, lambda s: s.withField("raw_text", between(b, s["start"], s["stop"]))))


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` spread over all cores where they are less than one split for each core; larger tables stay where they are read.

    So what is shuffled never exceeds cores times ``spark.sql.files.maxPartitionBytes``, as Catalyst estimates a table's size.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(2 * cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else docs


def scan(docs: DataFrame, types: Iterable[str] | None = None, rules: list[Rule] | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidate spans of every row: keys, entity_id, entity_type, raw_text, normalized_text, confidence, source_detector, start, stop,
    context_required, rule_seq.

    ``types`` prunes rules before the plan is built. Rows without text have no spans; rows that repeat have their spans each. A column of a span that
    is named like a key is called ``span_`` and its name.
    """
    rules = rules if rules is not None else ordered(types)
    if not rules:
        raise ValueError("no rule is left")
    rows = with_spans(dealt(docs.select(*keys, F.col(text).alias("_text"))), rules, "_text")
    return in_rows(rows, keys, F.col("_spans"), PLAIN)
