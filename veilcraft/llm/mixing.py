"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many tokens. Slot i's point, the fractional part of i times the golden
ratio, falls into one source's share of the cumulative weights; so every stretch of the mix holds the sources in nearly
their proportions. A slot's rank among its source's slots names the block that fills it: each source's documents lie in an
order shuffled by a hash, their tokens are cut into blocks of the slot's size, and the cut goes on into a second pass where
a source is repeated. Ranks and places are counted in a distributed way, so a source may hold any part of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, WHITE_SPACE_RUN, hash_bits, running, settled

GOLDEN = (5**0.5 - 1) / 2
BLOCK = 1024
#: Slots whose counts by source are summed before ranks are formed.
STRETCH = 1 << 14


class Share(NamedTuple):
    """A source's part of a mix; ``quota`` is its target in whole tokens."""

    source: str | None
    size: int
    target: float
    quota: int


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE_SPACE_RUN))).cast("long")


def shares(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), part: float = 1.5, most: float = 2) -> list[Share]:
    """Targets of sources in order of code points, null last: ``weights`` repeat over them and share ``part`` times all sizes.

    A target stops at ``most`` times its source's size, and what is over is shared again by weight among the
    others, until none is above. A source without tokens has the target 0.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: most * sizes[s] for s in order}
    target: dict = {}
    open_, left = list(order), part * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = float(limit[s])
        left -= sum(limit[s] for s in above)
        open_ = [s for s in open_ if s not in target]
    return [Share(s, sizes[s], target[s], min(round(target[s]), int(limit[s]))) for s in order]


def _points(ends: list[float]):
    """source of each slot, by its point's place among the cumulative weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            source = np.minimum(np.searchsorted(ends, slot * GOLDEN % 1.0, side="right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(source.astype(np.int32))], ["slot", "source_no"])

    return run


def schedule(spark, mix: list[Share], block: int = BLOCK) -> DataFrame:
    """slot, source_no (place in ``mix``), rank and tokens: which block of which source fills each slot, and how much of it.

    Every source has the blocks of its quota, the last one shorter. Points that come out a few short of a quota are made
    up for by slots at the end; points above it are left out. Without tokens the schedule is empty.
    """
    need = [-(-s.quota // block) for s in mix]
    rows = [(i, n, s.quota) for i, (n, s) in enumerate(zip(need, mix)) if n]
    quotas = spark.createDataFrame(rows, "source_no int, need bigint, quota bigint")
    total = sum(need)
    ends = np.cumsum([s.target for s in mix]) / max(sum(s.target for s in mix), 1e-9)
    slots = spark.range(0, total).withColumnRenamed("id", "slot").mapInArrow(_points(ends.tolist()), "slot bigint, source_no int")
    ranked = running(slots, ["source_no"], F.floor(F.col("slot") / STRETCH), [F.col("slot")], F.lit(1), "rank")
    # one row for each source
    ranked = ranked.join(F.broadcast(quotas), "source_no").filter("rank < need").select("slot", "source_no", "rank", "quota")
    have = ranked.groupBy("source_no").agg(F.count("*").alias("have"))
    short = quotas.join(have, "source_no", "left").filter("coalesce(have, 0) < need")
    rest = short.select(
        (F.lit(total).cast("long") + F.col("source_no")).alias("slot"), "source_no", F.explode(F.sequence(F.coalesce("have", F.lit(0)).cast("long"), F.col("need") - 1)).alias("rank"), "quota"
    )
    tokens = F.least(F.lit(block).cast("long"), F.col("quota") - F.col("rank") * block)
    return ranked.unionByName(rest).withColumn("tokens", tokens).drop("quota")


def mix_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), part: float = 1.5, most: int = 2, block: int = BLOCK, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs`` (doc_id, text, source): the words the mix takes of it.

    Sizes are counts of words. Each source's words taken are its target rounded to whole words, and no document is taken more than
    ``most`` times. Documents without words and null texts take 0; a null source is a source of its own. Repeated rows are
    documents of their own, and reruns agree. An empty table gives no rows. Columns named in ``keep`` are carried along.
    """
    spark = docs.sparkSession
    rows = settled(docs.select(F.col("doc_id").cast("long"), "source", *keep, word_count().alias("size")))
    # one row for each source
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    mix = shares({r["source"]: r["size"] for r in found}, weights, part, most)
    bits = hash_bits(sum(r["n"] for r in found))
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(mix)], "source_no int, source string, source_size bigint, target double, quota bigint")
    rows = rows.join(F.broadcast(table), rows.source.eqNullSafe(table.source)).drop("source")
    order = F.xxhash64("doc_id", F.lit("order of the mix"))
    rows = running(rows.withColumn("_order", order), ["source_no"], F.shiftright("_order", 64 - bits), [F.col(c) for c in ("_order", "doc_id", "size", *keep)], F.col("size"), "start")
    rows = settled(rows.drop("_order"))
    # the parts of documents in each block that some slot takes: a document lies once in each pass over its source
    full = rows.filter("size > 0").select("source_no", "start", "size", "source_size", "quota", F.explode(F.array(*map(F.lit, range(most)))).alias("_pass"))
    full = full.withColumn("_from", F.col("start") + F.col("_pass") * F.col("source_size")).withColumn("_to", F.col("_from") + F.col("size"))
    full = full.filter("_from < quota")
    first, last = F.floor(F.col("_from") / block), F.floor((F.least("_to", "quota") - 1) / block)
    parts = full.select("source_no", "start", "_from", "_to", F.explode(F.sequence(first, last)).alias("rank"))
    joined = parts.join(schedule(spark, mix, block), ["source_no", "rank"])
    begin = F.col("rank") * block
    took = F.least("_to", begin + F.col("tokens")) - F.greatest("_from", begin)
    taken = joined.groupBy("source_no", "start").agg(F.sum(took).alias("taken"))
    # rows without words share their place with the next row; they take nothing
    out = rows.join(taken, ["source_no", "start"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole number of times; rows without words stay once.

    Rows that repeat with one doc_id and text each appear the mean number of times that they are taken.
    """
    columns = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    times = mix_documents(keyed, keep=("_key",), **options)
    share = F.when(F.sum("size") == 0, F.lit(1)).otherwise(F.round(F.sum("taken") / F.sum("size")))
    times = times.groupBy("_key").agg(share.cast("int").alias("_times")).filter("_times > 0")
    return keyed.join(times, "_key").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*columns)
