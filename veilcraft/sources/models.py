"""Hooks for model detectors and reviewers: candidates from any function that reads texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What labels of named-entity models mean, the confidence of predictions without one, and the least one.
LABELS = {"person": "PERSON", "organization": "ORG", "city": "CITY", "address": "ADDRESS"}
MISSING_SCORE, THRESHOLD = 0.65, 0.45
#: Words of page headers that aren't entities.
GENERIC = ("page", "strona")
_FOUND = "entity_type string, raw_text string, normalized_text string, confidence double, start bigint, stop bigint"


class Predictor(Protocol):
    """Loaded once for each worker; gives (label, start, stop, score or None) for each text."""

    def __call__(self, texts: list[str]) -> list[Iterable[tuple[str, int, int, float | None]]]: ...


def model_spans(docs: DataFrame, load: Callable[[], Predictor], detector: str, labels: dict[str, str] = LABELS, threshold: float = THRESHOLD, fixed: float | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Candidate spans of a model, with the columns that fusion reads; errors of the model end the job.

    With ``fixed`` every span has that confidence, and spans without a letter or digit or that are one of GENERIC are left out.
    """
    schema = StructType([*[docs.schema[k] for k in keys], *StructType.fromDDL(_FOUND).fields])

    def run(batches):
        predict = load()
        for b in batches:
            rows = []
            for own, t, found in zip(b[list(keys)].itertuples(index=False), b[text], predict(b[text].tolist())):
                for label, start, stop, score in found:
                    score = fixed if fixed is not None else MISSING_SCORE if score is None else float(score)
                    generic = fixed is not None and (t[start:stop].strip().casefold() in GENERIC or not any(map(str.isalnum, t[start:stop])))
                    if score >= threshold and not generic:
                        rows.append((*own, labels.get(label.lower(), label.upper()), t[start:stop], t[start:stop].strip(), score, start, stop))
            yield pd.DataFrame(rows, columns=schema.names)

    rows = docs.filter(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, schema)
    return rows.withColumns({"source_detector": F.lit(detector), "context_required": F.lit(False), "rule_seq": F.lit(900), "entity_id": F.concat(F.lit("ENT_"), F.substring(F.sha1(F.concat_ws("|", "entity_type", "normalized_text", F.col("start").cast("string"), F.col("stop").cast("string"))), 1, 12))})
