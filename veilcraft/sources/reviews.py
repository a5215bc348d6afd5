"""Reviews by a text model: prompts rendered from templates, windows of texts, and suggestions read from answers; any failure ends the job."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a suggestion may ask for, and how much of a text a reviewer sees.
ACTIONS = ("keep", "drop", "extend_left", "extend_right", "relabel")
WINDOW = 4000
_ANSWER = "suggestions array<struct<entity_id:string,action:string,replacement_entity_type:string,reason:string>>"
_LEAKS = "suspected_leaks array<string>, warnings array<string>, verified_segment_ids array<string>"


class Reviewer(Protocol):
    """A model that answers prompts: ``answers`` maps a column of prompts to a column of answers, by a pandas or Arrow function or by SQL."""

    provider_id: str
    model_id: str

    def answers(self, prompts: Column) -> Column: ...


def prompt_templates(spark: SparkSession, folder: str) -> DataFrame:
    """prompt_id and template of the YAML files under ``folder``: a line ``prompt_id: "..."`` and a block ``template: |``."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.yaml")
    named = F.regexp_extract("value", r'(?m)^prompt_id:\s*"?([^"\n]+?)"?\s*$', 1)
    block = F.regexp_extract("value", r"(?m)^template:\s*\|\s*\n((?:[ \t]+.*\n?|\n)+)", 1)
    return rows.select(named.alias("prompt_id"), F.btrim(F.regexp_replace(block, r"(?m)^[ \t]{2}", "")).alias("template")).filter("prompt_id <> ''")


def rendered(template: str, **values: Column) -> Column:
    """``template`` with ``{{ name | tojson }}`` as the value's JSON and ``{{ name }}`` as the value itself; unknown names raise KeyError."""
    parts = re.split(r"\{\{\s*(\w+)\s*(\|\s*tojson\s*)?\}\}", template)
    out = [F.lit(parts[0])]
    for name, json, after in zip(parts[1::3], parts[2::3], parts[3::3]):
        v = values[name]
        # to_json takes no plain values, so those go in a struct and come out of its braces
        whole = F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
        out += [F.substr(whole, F.lit(6), F.length(whole) - 6) if json else v.cast("string"), F.lit(after)]
    return F.concat(*out)


def json_object(answer: Column) -> Column:
    """What stands from the first opening brace to the last closing one; without them the job ends."""
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(F.coalesce(found, F.lit("")) == "", F.raise_error(F.lit("the answer holds no JSON object"))).otherwise(found)


def _read(answer: Column, schema: str) -> Column:
    return F.from_json(json_object(answer), schema, {"mode": "FAILFAST"})


def suggestions(texts: DataFrame, spans: DataFrame, ask: Callable[[Column], Column], template: str, allowed: list[str], keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, entity_id, action, replacement_entity_type and reason: what a reviewer suggests for the spans of each text.

    Only texts with spans are shown, the first WINDOW characters of each. An answer without a JSON object, that can't be read, or with an
    action that isn't known ends the job.
    """
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "entity_id", "entity_type", "raw_text", "confidence"))).alias("_entities"))
    rows = texts.select(*keys, text).join(listed, list(keys))
    prompt = rendered(template, text_window=F.left(F.col(text), F.lit(WINDOW)), allowed_entity_types=F.array(*map(F.lit, allowed)), entities=F.col("_entities"))
    found = rows.select(*keys, F.inline(_read(ask(prompt), _ANSWER)["suggestions"]))
    known = F.col("action").isin(*ACTIONS) & F.col("entity_id").isNotNull()
    return found.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("no known suggestion: "), F.coalesce("action", F.lit("null"))))))


def verifications(segments: DataFrame, ask: Callable[[Column], Column], template: str, allowed: list[str], key: str = "doc_id", order: str = "segment_id", text: str = "text") -> DataFrame:
    """key, suspected_leaks, warnings and verified_segment_ids: what a reviewer finds in all segments of each rewritten document."""
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("segment_id"), F.col(text).alias("text")))).alias("_segments"))
    prompt = rendered(template, segments=F.col("_segments"), allowed_entity_types=F.array(*map(F.lit, allowed)))
    return rows.select(key, _read(ask(prompt), _LEAKS).alias("_a")).select(key, "_a.*")
