"""Streams of texts: redaction row by row, and counts of findings in windows of event time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import ordered
from ..operators.anonymize import KNOWN, anonymize, continue_segments
from ..operators.scan import with_spans
from ..plans.lineage import settled


def redact_stream(texts: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",), **options) -> StreamingQuery:
    """Write every micro-batch of ``texts`` anonymised as Parquet, in a folder of its batch number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = anonymize(batch, keys=keys, **options)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redact_segments_stream(segments: DataFrame, key: str, order: str, path: str, state: str, checkpoint: str, text: str = "text", **options) -> StreamingQuery:
    """Write every micro-batch of ``segments`` anonymised as Parquet, where a document (``key``) goes on over micro-batches with its numbers and names.

    What is known of documents is a table under ``state`` (shared storage), one version for each micro-batch: a batch reads the version before its
    own, so one that runs again gives the same rows. Versions before that are deleted.
    """
    schema = f"{key} {dict(segments.dtypes)[key]}, {KNOWN}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(schema).parquet(f"{state}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        done, left = continue_segments(settled(batch), known, key, order, text, **options)
        left.write.mode("overwrite").parquet(f"{state}/batch={number}")
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={number - 2}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return segments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_findings(texts: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes", types: Iterable[str] | None = None, text: str = "text") -> DataFrame:
    """Texts of each window of event time, those with valid spans of ``types``, and how many spans they have; a stream or a table."""
    rows = with_spans(texts, ordered(types), text)
    rows = rows.withWatermark(time, late) if texts.isStreaming else rows
    n = F.size("_spans")
    return rows.groupBy(F.window(time, width)).agg(F.count("*").alias("texts"), F.count_if(n > 0).alias("with_spans"), F.sum(n).alias("spans"))
