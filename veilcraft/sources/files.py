"""Files to segments: texts, DOCX packages and labelled JSON corpora, and how two DOCX packages differ."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: XML name spaces, parts whose loss counts, relationships that must stay, and by how many paragraphs a body may differ.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TRACKED = ("word/styles.xml", "word/numbering.xml")
TRACKED_PREFIXES = ("word/header", "word/footer", "word/media/")
REQUIRED_RELATIONSHIPS = ("officeDocument", "core-properties", "extended-properties")
PARAGRAPH_TOLERANCE = 2

SEGMENTS = "path string, segment_id string, container_id string, section_id string, start long, stop long, text string"


def text_segments(spark: SparkSession, path: str) -> DataFrame:
    """One segment for each text file that isn't empty."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).filter("value <> ''")
    one = F.lit("text:0")
    return rows.select("path", one.alias("segment_id"), one.alias("container_id"), one.alias("section_id"), F.lit(0).cast("long").alias("start"), F.length("value").cast("long").alias("stop"), F.col("value").alias("text"))


def _paragraphs(parent) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in parent.findall(f"{W}p")]


def docx_texts(data: bytes) -> list[tuple[str, str]]:
    """(segment_id, text) of body, table, header and footer paragraphs that aren't empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        edges = {kind: [ElementTree.fromstring(z.read(n)) for n in sorted(z.namelist()) if n.startswith(f"word/{kind}") and n.endswith(".xml")] for kind in ("header", "footer")}
    out = [] if body is None else [(f"body:p:{i}", t) for i, t in enumerate(_paragraphs(body))]
    for k, table in enumerate(body.findall(f"{W}tbl") if body is not None else []):
        for r, row in enumerate(table.findall(f"{W}tr")):
            for c, cell in enumerate(row.findall(f"{W}tc")):
                out += [(f"table:{k}:r:{r}:c:{c}:p:{i}", t) for i, t in enumerate(_paragraphs(cell))]
    for kind, parts in edges.items():
        out += [(f"{kind}:{k}:p:{i}", t) for k, part in enumerate(parts) for i, t in enumerate(_paragraphs(part))]
    return [(i, t) for i, t in out if t]


def docx_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of DOCX packages under ``path``."""
    return package_segments(spark.read.format("binaryFile").load(path).select("path", "content"))


#: Packages whose contents are Python objects at once, and how much an Arrow batch of them holds at most.
_PACKAGES, _BATCH = 64, "16m"


def in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``batches`` of packages in parts of a bounded number of rows."""
    for b in batches:
        for i in range(0, len(b), _PACKAGES):
            yield b.iloc[i : i + _PACKAGES]


def over_packages(packages: DataFrame, run, schema: str) -> DataFrame:
    """``packages`` through ``run``, a function of parts of batches; a worker never holds more of them than fits such a batch."""
    conf = packages.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH)
    return packages.mapInPandas(lambda batches: run(in_parts(batches)), schema)


def package_segments(packages: DataFrame) -> DataFrame:
    """Segments of DOCX packages (path, content); one without content or that is no package has none."""

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.path, b.content):
                try:
                    rows += [(p, i, i, i, 0, len(t), t) for i, t in docx_texts(bytes(data or b""))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return over_packages(packages.select(F.col("path").cast("string").alias("path"), "content"), run, SEGMENTS)


def package_checks(packages: DataFrame) -> DataFrame:
    """path and reason of each DOCX package (path, content): null where its segments can be read, else why not, without failing the others."""

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.path, b.content):
                try:
                    docx_texts(bytes(data or b""))
                    rows.append((p, None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows.append((p, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "reason"])

    return over_packages(packages.select(F.col("path").cast("string").alias("path"), "content"), run, "path string, reason string")


def docx_snapshot(data: bytes) -> dict:
    """What a comparison of packages looks at."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist() if n in ("word/document.xml", "_rels/.rels") or n.startswith(("word/header", "word/footer")) and n.endswith(".xml")}
        names = sorted(z.namelist())
    root = ElementTree.fromstring(parts["word/document.xml"]) if parts.get("word/document.xml") else None
    body = root.find(f"{W}body") if root is not None else None
    count = lambda prefix: sum(sum(1 for _ in ElementTree.fromstring(x).iter(f"{W}p")) for n, x in parts.items() if n.startswith(prefix) and x)
    kinds = {(r.get("Type") or "").rsplit("/", 1)[-1] for r in ElementTree.fromstring(parts["_rels/.rels"]).findall(f"{REL}Relationship")} if parts.get("_rels/.rels") else set()
    return {
        "names": names, "tracked": [n for n in names if n in TRACKED or n.startswith(TRACKED_PREFIXES)], "relationships": sorted(kinds),
        "paragraphs": len(body.findall(f"{W}p")) if body is not None else 0, "tables": len(body.findall(f"{W}tbl")) if body is not None else 0,
        "headers": count("word/header"), "footers": count("word/footer"), "sections": root is not None and next(root.iter(f"{W}sectPr"), None) is not None,
    }


_SNAPSHOT = "names array<string>, tracked array<string>, relationships array<string>, paragraphs int, tables int, headers int, footers int, sections boolean, problem string"


def docx_differences(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """key, passed and errors: what the packages of ``after`` lost against those of ``before`` (each with key and content)."""

    def run(batches):
        names = [key, *(c.split()[0] for c in _SNAPSHOT.split(", "))]
        for b in batches:
            rows = []
            for k, data in zip(b[key], b.content):
                try:
                    rows.append({key: k, **docx_snapshot(bytes(data)), "problem": None})
                except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                    nothing = {"names": [], "tracked": [], "relationships": [], "paragraphs": 0, "tables": 0, "headers": 0, "footers": 0, "sections": False}
                    rows.append({key: k, **nothing, "problem": str(e)})
            yield pd.DataFrame(rows, columns=names)

    shots = [over_packages(df.select(key, "content"), run, f"{key} string, {_SNAPSHOT}").select(key, F.struct("*").alias(n)) for df, n in ((before, "a"), (after, "b"))]
    rows = shots[0].join(shots[1], key, "left")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    tests = [
        (b("names").isNull() & b("problem").isNull(), F.lit("package missing")),
        (F.coalesce(a("problem"), b("problem")).isNotNull(), F.coalesce(a("problem"), b("problem"))),
        (F.abs(a("paragraphs") - b("paragraphs")) > PARAGRAPH_TOLERANCE, F.lit("Paragraph count changed beyond tolerance.")),
        (a("tables") != b("tables"), F.lit("DOCX table count changed unexpectedly.")),
        (a("headers") != b("headers"), F.lit("Header paragraph count changed.")),
        (a("footers") != b("footers"), F.lit("Footer paragraph count changed.")),
        (a("sections") & ~b("sections"), F.lit("lost package part: word/document.xml w:sectPr")),
    ]
    found = F.filter(F.array(*[F.when(t, m) for t, m in tests]), lambda m: m.isNotNull())
    none = F.array().cast("array<string>")
    lost = F.transform(F.coalesce(F.array_except(a("tracked"), b("names")), none), lambda n: F.concat(F.lit("lost package part: "), n))
    required = F.array_intersect(a("relationships"), F.array(*map(F.lit, REQUIRED_RELATIONSHIPS)))
    gone = F.transform(F.coalesce(F.array_sort(F.array_except(required, b("relationships"))), none), lambda n: F.concat(F.lit("lost package relationship: "), n))
    errors = F.concat(found, lost, gone)
    return rows.select(key, (F.size(errors) == 0).alias("passed"), errors.alias("errors"))


def labelled_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples: id, text; entities: id, seq, entity_type, text) of a JSON corpus of labelled samples."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")
    entities = rows.select("id", F.posexplode("entities").alias("seq", "e"))
    return rows.select("id", "text"), entities.select("id", "seq", F.col("e.type").alias("entity_type"), F.col("e.text").alias("text"))


#: Folders of artifacts by kind, and the files' endings where they are always the same.
ARTIFACTS = {
    "original": ("originals", ""), "anonymized": ("anonymized", ""), "reinjected": ("reinjected", ""), "restored": ("restored", ""), "report": ("reports", ".json"),
    "injector_export": ("reports", ".injector.json"), "reinjection_report": ("reinjection_reports", ".json"), "restore_report": ("restore_reports", ".json"),
    "vault": ("vaults", ".json"), "temp": ("temp", ""),
}


def artifact_path(root: str, kind: str, artifact_id: str, ending: str = "") -> str:
    """Where an artifact lies under ``root``."""
    folder, own = ARTIFACTS[kind]
    return f"{root.rstrip('/')}/{folder}/{artifact_id}{own or ending}"


def _leaves(value) -> int:
    if isinstance(value, dict):
        return sum(map(_leaves, value.values()))
    return sum(map(_leaves, value)) if isinstance(value, list) else 1


@F.pandas_udf(LongType())
def json_leaves(texts: pd.Series) -> pd.Series:
    """How many scalars a JSON text holds; null for one that can't be read."""

    def one(t):
        try:
            return _leaves(json.loads(t))
        except (TypeError, ValueError):
            return None

    return texts.map(one).astype("Int64")


def _xml_leaves(text: str) -> int:
    """Attributes and runs of characters that aren't blank, between tags, comments and instructions; declarations of name spaces are no attributes."""
    found, run = 0, []

    def ends(*_):
        nonlocal found
        if run:
            found += bool("".join(run).strip(" \t\r\n"))
            run.clear()

    def begins(_, attributes: dict):
        nonlocal found
        ends()
        found += sum(a != "xmlns" and not a.startswith("xmlns:") for a in attributes)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begins, ends, run.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = ends
    parser.Parse(text, True)
    return found


@F.pandas_udf(LongType())
def _xml_counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _xml_leaves(t) if t else None).astype("Int64")


def xml_leaves(text: Column) -> Column:
    """How many texts that aren't blank and attributes an XML text holds, in one pass over it; null for none and for an empty one.

    XML 1.1 has characters that expat refuses, so such texts are left to XPath, which costs some ten times as much.
    """
    newer = F.coalesce(text.rlike(r"""\A<\?xml\s+version\s*=\s*["']1\.1["']"""), F.lit(False))
    by_path = F.size(F.xpath(text, F.lit("//text()[normalize-space()]"))) + F.size(F.xpath(text, F.lit("//@*")))
    return F.when(newer, by_path.cast("bigint")).otherwise(_xml_counts(F.when(~newer, text)))


def leaf_differences(before: DataFrame, after: DataFrame, kind: str, key: str = "path", text: str = "text") -> DataFrame:
    """key, leaves of either side, and warning: null, or that their numbers differ; ``kind`` is json or xml. A null side can't be read."""
    count = json_leaves if kind == "json" else xml_leaves
    a, b = before.select(key, count(F.col(text)).alias("before")), after.select(key, count(F.col(text)).alias("after"))
    message = "JSON scalar segment count changed." if kind == "json" else "XML text and attribute segment count changed."
    return a.join(b, key, "left").withColumn("warning", F.when(~F.col("before").eqNullSafe(F.col("after")), message))


def listed(names: Column) -> Column:
    """The entries of a list parted by commas, without empty ones."""
    return F.filter(F.split(F.coalesce(names, F.lit("")), ","), lambda n: n != "")
