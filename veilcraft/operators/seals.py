"""Sealed records: HMAC-SHA-256 signatures over canonical JSON, and stores of vaults and audits that open only what is signed and in time.

A store is a Parquet table of a fixed number of buckets by the hash of the record's id. Saving and deleting rewrite the buckets concerned, so
a deleted record's bytes are gone, and a record is read from its own bucket.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import settled


class SealError(ValueError):
    """A record that isn't signed, was changed, or is out of date."""


def canonical_json(columns: Iterable[str]) -> Column:
    """The columns as one JSON object with sorted names and without blanks; nulls are part of it."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def signature(payload: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text under ``key``, in hexadecimal digits; null for null."""
    if not key:
        raise ValueError("a key is needed")
    import hashlib

    data = key.encode()
    data = (hashlib.sha256(data).digest() if len(data) > 64 else data).ljust(64, b"\0")
    pad = lambda with_: F.lit(bytes(b ^ with_ for b in data))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def sealed(records: DataFrame, key: str, columns: Iterable[str], name: str = "seal") -> DataFrame:
    """``records`` with the signature of ``columns``."""
    return records.withColumn(name, signature(canonical_json(columns), key))


def opened(records: DataFrame, key: str, columns: Iterable[str], name: str = "seal", expires: str | None = None) -> DataFrame:
    """``records`` with ``problem``: null, ``unsigned``, ``tampered`` or ``expired`` (by the column ``expires``, an ISO time)."""
    late = F.try_to_timestamp(F.col(expires)) < F.current_timestamp() if expires else F.lit(False)
    problem = F.when(F.coalesce(name, F.lit("")) == "", "unsigned").when(F.col(name) != signature(canonical_json(columns), key), "tampered").when(late, "expired")
    return records.withColumn("problem", problem)


def must_open(records: DataFrame, key: str, columns: Iterable[str], name: str = "seal", expires: str | None = None) -> DataFrame:
    """``records`` if all of them open; else SealError with the first problem."""
    rows = opened(records, key, columns, name, expires)
    if bad := rows.filter("problem is not null").first():
        raise SealError(f"a record is {bad['problem']}")
    return rows.drop("problem")


#: Buckets of a new store.
BUCKETS = 64


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whichever Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int] | tuple[None, None]:
    """The store's rows and its number of buckets; None where there is no store or no record in it."""
    place, files = _hadoop(spark, path)
    if not files.exists(place) or not any(x.isDirectory() and x.getPath().getName().startswith("_of=") for x in files.listStatus(place)):
        return None, None
    rows = spark.read.parquet(path)
    return rows, rows.select("_buckets").first()[0]


def _bucket(record_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(buckets)).cast("int")


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` are in."""
    rows.repartition("_of").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_of").parquet(path)


def save(records: DataFrame, path: str, key: str, record_id: str, buckets: int = BUCKETS) -> None:
    """Seal all columns of ``records`` and write them; a record whose ``record_id`` is there already is replaced.

    ``buckets`` is for a store that isn't there yet: it keeps the number it was made with. Of several records of one id any one is written.
    """
    spark = records.sparkSession
    there, known = _stored(spark, path)
    n = known or buckets
    new = sealed(records, key, records.columns).dropDuplicates([record_id]).withColumns({"_buckets": F.lit(n), "_of": _bucket(F.col(record_id), n)})
    if there is not None:
        new = settled(new)
        touched = [r["_of"] for r in new.select("_of").distinct().collect()]  # no more than there are buckets
        others = there.filter(F.col("_of").isin(*touched)).join(new.select(record_id), record_id, "left_anti") if touched else there.filter("false")
        new = settled(new.unionByName(others.select(new.columns)))
    _rewrite(new, path)


def load(spark: SparkSession, path: str, key: str, record_id: str, wanted: object = None, expires: str | None = None) -> DataFrame:
    """Records of a store (the one of an id, or all of them in order of ids), which must all open. One record is read from its bucket alone."""
    rows, n = _stored(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no store at {path}")
    if wanted is not None:
        one = F.lit(wanted).cast(rows.schema[record_id].dataType)
        rows = rows.filter((F.col("_of") == _bucket(one, n)) & (F.col(record_id) == one))
    rows = rows.drop("_of", "_buckets")
    return must_open(rows, key, [c for c in rows.columns if c != "seal"], expires=expires).drop("seal").orderBy(record_id)


def delete(spark: SparkSession, path: str, record_id: str, wanted: object) -> None:
    """Delete a record by rewriting its bucket without it; one that isn't there is no error."""
    rows, n = _stored(spark, path)
    if rows is None:
        return
    one = F.lit(wanted).cast(rows.schema[record_id].dataType)
    k = spark.range(1).select(_bucket(one, n)).first()[0]
    bucket = rows.filter(F.col("_of") == k)
    left = settled(bucket.filter(~F.col(record_id).eqNullSafe(one)))
    if left.isEmpty():
        place, files = _hadoop(spark, f"{path.rstrip('/')}/_of={k}")
        files.delete(place, True)
    else:
        _rewrite(left, path)


def latest_hash(audits: DataFrame) -> str | None:
    """The chain hash of the audit record made last, null without records."""
    return audits.agg(F.max_by("audit_chain_hash", F.struct("created_at", "audit_id"))).first()[0]
