"""A corpus pipeline: toxic documents go, then exact and near duplicates; the rest is mixed and packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages but the last return the
columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcraft.llm.common import WHITE_SPACE, read, settled, shared_dir
from veilcraft.llm.exact_dedup import exact_duplicates
from veilcraft.llm.mixing import mixed
from veilcraft.llm.packing import pack_documents
from veilcraft.llm.queries import tokenizer_file
from veilcraft.llm.simhash import near_duplicates
from veilcraft.llm.toxicity import toxicity_scores


#: Near copies: five-word shingles of similarity 0.8 or more, looked for among fingerprints of 128 bits of which so many may differ.
NEAR = {"words": 5, "width": 2, "radius": 32, "similarity": 0.8, "tile": 4096}


def _kept(docs: DataFrame, rejected: DataFrame, key: Column, longest: bool | None = None) -> DataFrame:
    """``docs`` without the rows whose doc_id and key (a number made of the text) are in ``rejected`` (doc_id, key).

    Unless ``longest`` is None, one row stays of those that repeat with one doc_id and key: the longest text if it is true, then the first by
    its hash. Repeated doc_ids are counted first, so texts are looked at once more only where there are any. Both joins are the same at all sizes:
    nothing is broadcast by a count of rows, and a task gets the rejected rows of its own keys only.
    """
    columns = docs.columns
    gone = settled(rejected.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & F.col("_key").eqNullSafe(F.col("_gone_key"))
    without = lambda rows: rows.withColumn("_key", key).join(gone, same, "left_anti")
    if longest is None:
        return without(docs).select(*columns)
    ids = settled(docs.groupBy(F.col("doc_id").alias("_of")).count().filter("count > 1").select("_of"))
    if ids.isEmpty():
        return without(docs).select(*columns)
    twice = F.col("doc_id").eqNullSafe(F.col("_of"))
    order = F.struct((-F.length("text") if longest else F.lit(0)).alias("n"), F.xxhash64("text").alias("h"))
    # minima are formed before rows are dealt out, so very many repeats don't meet in one task
    first = without(docs.join(ids, twice).drop("_of")).groupBy("doc_id", "_key").agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return without(docs.join(ids, twice, "left_anti")).select(*columns).unionByName(first.select("_row.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Repeated rows fare alike; null and empty texts are scored like any other; an empty table stays empty."""
    scores = toxicity_scores(docs, read(spark, sf_dir, "labels"))
    return _kept(docs, scores.filter("predicted = 1").withColumnRenamed("text_key", "key"), F.xxhash64("text"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts: the longest, then that with the smallest doc_id (null last), then the first by the text's hash.

    Null and empty texts are one group. An empty table stays empty.
    """
    copies = exact_duplicates(docs).filter("not kept").withColumn("key", F.xxhash64("text_sha256"))
    normalised = F.sha2(F.encode(F.translate(F.coalesce("text", F.lit("")), WHITE_SPACE, ""), "UTF-8"), 256)
    return _kept(docs, copies, F.xxhash64(normalised), longest=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last), then the first by the text's hash, of each group of near duplicates (NEAR).

    Null, empty and blank texts are one group. An empty table stays empty.
    """
    groups = near_duplicates(docs, **NEAR)
    gone = groups.filter(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))))
    return _kept(docs, gone.withColumnRenamed("text_key", "key"), F.xxhash64("text"), longest=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole number; those without words stay once. An empty table stays empty."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens. Repeated rows are packed each; null texts pack as their end id."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trees, tokenizers and fingerprints can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}-{name}")
            out = spark.read.parquet(f"{folder}/{k}-{name}")
        docs = out
    return docs
