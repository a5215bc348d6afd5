"""The rule catalogue as two tables, rules and entity types: listing, adding, disabling, merging in new defaults, and exchange as JSON.

A catalogue has some hundreds of rows; where rules come to the driver it is to become expressions of a plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import NORMALIZERS
from ..functions.rules import CATALOGUE, FLAGS, Rule, marked
from ..functions.validate import VALIDATORS

SCHEMA = (
    "rule_id int, entity_type string, pattern string, normalizer string, validator string, confidence double, context boolean, priority int, "
    "description string, needs array<string>, digits int, enabled boolean, managed boolean"
)


def _row(rule_id: int, rule: Rule, managed: bool) -> tuple:
    return (rule_id, *rule._replace(needs=list(rule.needs)), True, managed)


def _rule(row) -> Rule:
    return Rule(*[tuple(row[f] or ()) if f == "needs" else row[f] for f in Rule._fields])


def default_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules with ids that stay."""
    return spark.createDataFrame([_row(i, r, True) for i, r in enumerate(CATALOGUE, 1)], SCHEMA)


TYPES = "entity_type string, description string"
# The types that a new catalogue knows.
DEFAULT_TYPES = (
    "EMAIL", "PHONE", "PESEL", "NIP", "REGON", "KRS", "IBAN", "CARD", "POSTAL_CODE", "DATE_OF_BIRTH", "DOCUMENT_NUMBER", "CASE_NUMBER", "CONTRACT_NUMBER", "ADDRESS", "BANK_ACCOUNT",
    "SWIFT_BIC", "INVOICE_NUMBER", "ORDER_NUMBER", "POLICY_NUMBER", "CLAIM_NUMBER", "CLIENT_ID", "EMPLOYEE_ID", "PASSPORT_NUMBER", "ID_CARD_NUMBER", "DRIVER_LICENSE_NUMBER", "VAT_ID",
    "TAX_ID", "IP_ADDRESS", "VEHICLE_REGISTRATION", "DEVICE_ID", "COMPANY_NAME", "FULL_NAME", "FIRST_NAME", "LAST_NAME", "CITY", "STREET", "HOUSE_NUMBER", "APARTMENT_NUMBER", "COUNTRY",
    "PLACE_OF_BIRTH",
)


def default_types(spark: SparkSession) -> DataFrame:
    """The entity types of a new catalogue; what they are called is their description."""
    return spark.createDataFrame([(t, t.replace("_", " ").lower()) for t in DEFAULT_TYPES], TYPES)


def add_types(types: DataFrame, new: DataFrame) -> DataFrame:
    """``types`` and those of ``new`` (entity_type, description) that it lacks, names in upper case; of several rows of one type the first by description comes."""
    name = F.upper(F.btrim("entity_type"))
    rows = new.select(name.alias("entity_type"), F.btrim("description").alias("description")).filter("entity_type <> ''")
    rows = rows.groupBy("entity_type").agg(F.min("description").alias("description"))
    return types.unionByName(rows.join(types.select("entity_type"), "entity_type", "left_anti"))


def add_type(types: DataFrame, entity_type: str, description: str) -> tuple[DataFrame, bool]:
    """``types`` and one more, and whether it is new; ValueError for an empty name."""
    name = entity_type.strip().upper()
    if not name:
        raise ValueError("an entity type needs a name")
    if not types.filter(F.col("entity_type") == name).isEmpty():
        return types, False
    return add_types(types, types.sparkSession.createDataFrame([(name, description)], TYPES)), True


def entity_types(rules: DataFrame) -> DataFrame:
    """The types that rules are of."""
    return rules.select("entity_type").distinct()


def bootstrap(rules: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``rules`` with the shipped ``defaults`` merged in by description: managed rules of a description take the shipped fields, descriptions
    that are missing come with new ids, and managed rules that aren't shipped any more go. Users' rules stay as they are.

    A managed rule keeps its id and whether it is enabled, so what a user disabled stays so. Merging twice changes nothing.
    """
    defaults = default_rules(rules.sparkSession) if defaults is None else defaults
    fresh = [c for c in defaults.columns if c not in ("rule_id", "enabled", "managed")]
    # several shipped rules may share a description: they are told apart by their place among them
    place = F.row_number().over(Window.partitionBy("description").orderBy("rule_id"))
    old = rules.filter("managed").select("description", place.alias("_n"), F.col("rule_id").alias("_id"), F.col("enabled").alias("_enabled"))
    merged = defaults.withColumn("_n", place).join(old, ["description", "_n"], "left")
    top = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("_top"))
    # one row; and a catalogue's new rows are few enough to be numbered together
    later = F.row_number().over(Window.partitionBy(F.col("_id").isNull()).orderBy("rule_id"))
    ids = merged.crossJoin(F.broadcast(top)).withColumn("rule_id", F.coalesce("_id", F.col("_top") + later).cast("int"))
    managed = ids.select("rule_id", *fresh, F.coalesce("_enabled", F.col("enabled")).alias("enabled"), F.lit(True).alias("managed"))
    return rules.filter("not managed").unionByName(managed)


def _checked(spark: SparkSession, rules: Iterable[Rule], types: set[str] | None) -> list[Rule]:
    """Rules with their types in upper case; ValueError for an unknown type, normaliser or validator, a confidence outside 0 and 1, a
    pattern that is no regular expression, and one whose span has no certain place."""
    out = []
    for rule in rules:
        rule = rule._replace(entity_type=rule.entity_type.strip().upper(), digits=rule.digits or 0)
        if types is not None and rule.entity_type not in types:
            raise ValueError(f"unknown entity type {rule.entity_type}")
        if rule.normalizer not in NORMALIZERS or rule.validator not in VALIDATORS:
            raise ValueError("unknown normalizer or validator")
        if not 0 <= rule.confidence <= 1:
            raise ValueError("confidence lies outside 0 and 1")
        out.append(rule)
    try:
        spark.range(1).select(*[F.concat(F.lit(""), F.col("id").cast("string")).rlike(FLAGS + marked(r.pattern)).alias(f"c{i}") for i, r in enumerate(out)]).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError("a pattern is no regular expression") from e
    return out


def _added(rules: DataFrame, new: list[Rule]) -> tuple[DataFrame, int]:
    first = (rules.agg(F.max("rule_id")).first()[0] or 0) + 1
    rows = [_row(first + i, r, False) for i, r in enumerate(new)]
    return rules.unionByName(rules.sparkSession.createDataFrame(rows, SCHEMA)), first


def add_rule(rules: DataFrame, rule: Rule, new_type: bool = False) -> tuple[DataFrame, int]:
    """``rules`` and one more, and its id; its type must be known unless ``new_type``."""
    known = None if new_type else {r["entity_type"] for r in entity_types(rules).collect()}
    [rule] = _checked(rules.sparkSession, [rule], known)
    if not rules.filter((F.col("entity_type") == rule.entity_type) & (F.col("pattern") == rule.pattern)).isEmpty():
        raise ValueError("the rule is there already")
    return _added(rules, [rule])


def disable_rules(rules: DataFrame, rule_ids: Iterable[int]) -> DataFrame:
    """``rules`` with those of the given ids disabled; ValueError for an id that isn't there."""
    rule_ids = set(rule_ids)
    if missing := rule_ids - {r["rule_id"] for r in rules.select("rule_id").collect()}:
        raise ValueError(f"no rule has the id {min(missing)}")
    return rules.withColumn("enabled", F.col("enabled") & ~F.col("rule_id").isin(*rule_ids)) if rule_ids else rules


def disable_rule(rules: DataFrame, rule_id: int) -> DataFrame:
    return disable_rules(rules, [rule_id])


def load_rules(rules: DataFrame, types: set[str] | None = None) -> list[Rule]:
    """Enabled rules (of ``types``) in order of priority and id, for ``scan``."""
    rows = rules.filter("enabled")
    if types is not None:
        rows = rows.filter(F.col("entity_type").isin(*types))
    return [_rule(r) for r in rows.orderBy("priority", "rule_id").collect()]


def export_rules(rules: DataFrame, path: str) -> None:
    rules.coalesce(1).write.mode("overwrite").json(path)


#: What the fields of a rule are called in an exchanged catalogue.
_EXCHANGED = {
    "rule_id": "rule_id", "entity_type": "entity_type", "pattern": "pattern_text", "normalizer": "normalizer_name", "validator": "validator_name", "confidence": "confidence",
    "context": "context_required", "priority": "priority", "enabled": "enabled", "description": "description",
}
_ENVELOPE = (
    f"entity_types array<struct<entity_type:string,description:string>>, rules array<struct<rule_id:int,entity_type:string,pattern_text:string,normalizer_name:string,"
    "validator_name:string,confidence:double,context_required:boolean,priority:int,enabled:boolean,description:string>>"
)


def _named_groups(pattern: Column, exchanged: bool) -> Column:
    """Named groups as exchanged catalogues write them, or as patterns here do."""
    return F.replace(pattern, F.lit("(?<entity>"), F.lit("(?P<entity>")) if exchanged else F.replace(pattern, F.lit("(?P<"), F.lit("(?<"))


def export_catalogue(rules: DataFrame, types: DataFrame, path: str) -> None:
    """Write one JSON object with both tables, in order of ids and names."""
    one = F.struct(*[(_named_groups(F.col(c), True) if c == "pattern" else F.col(c)).alias(n) for c, n in _EXCHANGED.items()])
    all_rules = rules.agg(F.array_sort(F.collect_list(one)).alias("rules"))
    all_types = types.agg(F.array_sort(F.collect_list(F.struct("entity_type", "description"))).alias("entity_types"))
    # one row beside one row
    all_types.crossJoin(F.broadcast(all_rules)).coalesce(1).write.mode("overwrite").json(path)


def import_catalogue(rules: DataFrame, types: DataFrame, path: str, replace: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """``rules`` and ``types`` with those of an exported catalogue added, and how many rules came. With ``replace`` only what was exported is left.

    Types are added first, and every rule's type must then be known; all rules are checked before any is added. Rules that are there already
    (type and pattern) stay as they are. New rules get new ids, keep whether they are enabled, and are the user's own.
    """
    spark = rules.sparkSession
    given = spark.read.schema(_ENVELOPE).option("multiLine", True).json(path)
    types = add_types(types.filter("false") if replace else types, given.select(F.inline("entity_types")))
    base = rules.filter("false") if replace else rules
    rows = given.select(F.inline("rules")).withColumn("pattern_text", _named_groups(F.col("pattern_text"), False))
    rows = rows.select(*[F.col(n).alias(c) for c, n in _EXCHANGED.items()]).withColumn("entity_type", F.upper(F.btrim("entity_type")))
    lacking = rows.join(base.select("entity_type", "pattern"), ["entity_type", "pattern"], "left_anti").orderBy(F.col("rule_id").asc_nulls_last(), "entity_type", "pattern").collect()
    known = {r["entity_type"] for r in types.collect()}
    known_rules = {(r.entity_type, r.pattern): r for r in CATALOGUE}
    first = {}
    for r in lacking:
        first.setdefault((r["entity_type"], r["pattern"]), r)
    new = []
    for kind, r in first.items():
        # what tells that a search can be spared is known of default rules only
        rule = Rule(r["entity_type"], r["pattern"], r["normalizer"], r["validator"], r["confidence"], bool(r["context"]), r["priority"], r["description"] or "")
        new.append(rule._replace(needs=known_rules[kind].needs, digits=known_rules[kind].digits) if kind in known_rules else rule)
    added = _added(base, _checked(spark, new, known))[0] if new else base
    off = [(r["entity_type"], r["pattern"]) for r in first.values() if r["enabled"] is False]
    if off:
        gone = spark.createDataFrame(off, "entity_type string, pattern string").withColumn("_off", F.lit(True))
        added = added.join(F.broadcast(gone), ["entity_type", "pattern"], "left").withColumn("enabled", F.col("enabled") & F.col("_off").isNull()).select(*rules.columns)
    return added, types, len(new)


def import_rules(rules: DataFrame, path: str, replace: bool = False) -> tuple[DataFrame, int]:
    """``rules`` with those of an export that it lacks (with ``replace``, its own unmanaged ones go first), and how many came.

    All rules are checked before any is added. Of rules of one type and pattern the one with the smallest id comes.
    """
    base = rules.filter("managed") if replace else rules
    given = rules.sparkSession.read.schema(SCHEMA).json(path)
    lacking = given.join(base.select("entity_type", "pattern"), ["entity_type", "pattern"], "left_anti")
    # a catalogue has some hundreds of rules
    rows = {(r["entity_type"], r["pattern"]): r for r in sorted(lacking.collect(), key=lambda r: -r["rule_id"])}
    new = _checked(rules.sparkSession, [_rule(r) for r in sorted(rows.values(), key=lambda r: r["rule_id"])], None)
    return (_added(base, new)[0] if new else base), len(new)
