"""What the operators of this subpackage share: tables, checkpoints, distributed ranks, token ids."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse, if that is no local folder or there
    is one machine only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{warehouse}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so later steps and lost executors don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds: texts have no bound of their own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def hash_bits(n: int) -> int:
    """So many bits of a hash deal n rows into about sqrt(n) buckets of about sqrt(n) rows."""
    return max(1, min(24, (max(n, 1).bit_length() + 1) // 2))


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the same keys.

    Rows are ordered by ``bucket``, then ``order``. Only the rows of one bucket meet in a task: sums of
    buckets are summed first, and each bucket then counts on from its own start. So a key that holds a
    third of all rows is spread over as many tasks as it has buckets. Keys may be null.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, same)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_start", "_b", *[f"_k{i}" for i in range(len(keys))])
    )


def runs(text: str, most: int = 1_000_000) -> Iterator[str]:
    """``text`` in runs of about ``most`` characters that are cut at spaces or line feeds, so its words need not be held at once."""
    at = 0
    while len(text) - at > most:
        cut = min((x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


# --- token ids -----------------------------------------------------------------------------------

#: White space as the tokenizers' patterns know it (the Unicode property).
_WS = "\t-\r \x85\xa0  -     　"
_UNITS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_ODD_WS = re.compile(r"[\x85\xa0  -     　]")
#: A comma or full stop after what is no letter or digit (nor white space).
_JOINED_STOP = re.compile(r"[.,](?<![^\W_][.,])")
_JOINED_STOP_BARE = re.compile(f"[.,](?<![^\\W_][.,])(?<![{_WS}][.,])")


#: Parts the units of a text; texts that hold it are encoded as they are.
_CUT = "\x01"


class TokenIds:
    """Ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit bytes.

    Texts are cut only where the tokenizer's own pattern always parts them: in front of white space that follows other
    characters, and between a letter or digit and a comma or full stop. So the ids of the units are those of the whole text
    (tests compare them). Arrow finds the distinct units of a batch, the tokenizers library encodes each while a bounded memo
    holds it, and numpy puts the ids of texts together. ``white_space`` tells whether the tokenizer keeps white space and
    case (byte-level) or drops them.
    """

    def __init__(self, path: str, white_space: bool, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units = _spaced_units if white_space else _bare_units
        self.memo = memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was young before; units used again come back

    def _encode(self, units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _ids(self, units: list[str]) -> list[bytes]:
        ids = list(map(self.young.get, units))
        missing = [i for i, x in enumerate(ids) if x is None]
        for i in missing:
            if (own := self.old.get(units[i])) is not None:
                ids[i] = self.young[units[i]] = own
        missing = [i for i in missing if ids[i] is None]
        new = [units[i] for i in missing]
        for i, unit, own in zip(missing, new, self._encode(new)):
            ids[i] = self.young[unit] = own
        if len(self.young) > self.memo // 2:
            self.old, self.young = self.young, {}
        return ids

    def batch(self, texts: list[str]) -> list[bytes]:
        units = self.units(texts)
        found = units.flatten().dictionary_encode()
        ids = self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        # a text has less than 2^31 bytes, and so have its ids in number
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        at = found.indices.to_numpy()
        sizes, begins = size[at], (np.cumsum(size, dtype=np.int32) - size)[at]
        ends = np.zeros(len(sizes) + 1, dtype=np.int32)
        np.cumsum(sizes, out=ends[1:])
        begins -= ends[:-1]
        place = np.repeat(begins, sizes)
        place += np.arange(ends[-1], dtype=np.int32)
        out = flat[place]
        offsets = ends[units.offsets.to_numpy() - units.offsets[0].as_py()].tolist()
        result = [out[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
        for i, t in enumerate(texts):
            if _CUT in t:
                result[i] = self._encode([t])[0]
        return result


def _spaced_units(texts: list[str]) -> pa.ListArray:
    """Units of texts whose white space counts."""
    cut = []
    for t in texts:
        if _CUT in t:
            cut.append("")
        elif (
            "  " in t or "\n\n" in t or " \n" in t or "\n " in t or "\t" in t or "\r" in t or "\x0b" in t or "\x0c" in t
            or not t.isascii() and _ODD_WS.search(t) or _JOINED_STOP.search(t)
        ):
            cut.append(_CUT.join(_UNITS.findall(t)))
        else:
            cut.append(t.replace(" ", "\x01 ").replace("\n", "\x01\n").replace(",", "\x01,").replace(".", "\x01."))
    return pc.split_pattern(pa.array(cut, pa.large_string()), _CUT)


def _bare_units(texts: list[str]) -> pa.ListArray:
    """Units of texts whose white space and case don't count."""
    cut = []
    for t in texts:
        # the capital I with a dot becomes a letter and a mark in lower case
        if _CUT in t:
            t = ""
        elif not (_JOINED_STOP_BARE.search(t) or not t.isascii() and "İ" in t):
            t = t.replace(",", " ,").replace(".", " .")
        cut.append(t)
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(cut, pa.large_string())))


_TOKENIZERS: dict = {}


def token_ids(path: str, white_space: bool) -> TokenIds:
    """One for each worker process."""
    if (path, white_space) not in _TOKENIZERS:
        _TOKENIZERS[path, white_space] = TokenIds(path, white_space)
    return _TOKENIZERS[path, white_space]


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``most`` characters at most: (first row, texts); null counts as empty."""
    texts: list[str] = []
    first = size = 0
    values = batch.column(column)
    for i in range(batch.num_rows):
        t = values[i].as_py() or ""
        if texts and size + len(t) > most:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts
