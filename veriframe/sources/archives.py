"""Package archives and workbooks: files are read by Spark, each opened in the task that holds it.

One file is one row of ``binaryFile`` (at most 2 GB); what a task holds is bounded by its file.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file that are given on at a time.
ROWS_TOGETHER = 256
_CHUNK = 1 << 20
_BAD_XML = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_BARE_AMPERSAND = re.compile(r"&(?!(?:[a-zA-Z][\w.-]*|#\d+|#x[0-9a-fA-F]+);)")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def parse_xml(text: str) -> tuple[ElementTree.Element | None, str]:
    """(root, mode): strict, repaired (control characters and bare ampersands mended) or failed."""
    for mode, form in (("strict", text), ("repaired", _BARE_AMPERSAND.sub("&amp;", _BAD_XML.sub("", text)))):
        try:
            return ElementTree.fromstring(form), mode
        except ElementTree.ParseError:
            continue
    return None, "failed"


def _per_file(df: DataFrame, schema: str, rows_of) -> DataFrame:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(field.split() for field in schema.split(", ")), strict=True)
    arrow = pa.schema([(n, kinds[t]) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = iter(rows_of(path, content.as_py()))
                while part := list(islice(rows, ROWS_TOGETHER)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], schema=arrow)

    return df.select("path", "content").mapInArrow(run, schema)


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    return entries_of(files(spark, path, pattern))


def entries_of(packages: DataFrame) -> DataFrame:
    """(package, name, size, sha256, text, problem): entries of archives(path, content); a bad archive is one row with its
    problem, an entry outside the archive's root is refused, text is there for markup only. Entries are read and given on
    one after the other, other than markup in pieces, so that an archive may hold more than a task's memory."""

    def rows_of(package: str, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    if i.filename.startswith("/") or ".." in i.filename.split("/"):
                        yield package, i.filename, i.file_size, None, None, "UNSAFE_PATH"
                        continue
                    markup = i.filename.lower().endswith((".xml", ".html", ".htm", ".json"))
                    digest, size, kept = hashlib.sha256(), 0, []
                    with z.open(i) as member:
                        while data := member.read(_CHUNK):
                            digest.update(data)
                            size += len(data)
                            if markup:
                                kept.append(data)
                    yield package, i.filename, size, digest.hexdigest(), b"".join(kept).decode("utf-8", "replace") if markup else None, None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zipfile.zlib.error) as e:
            yield package, None, None, None, None, f"BAD_ARCHIVE: {type(e).__name__}"

    return _per_file(packages, "package string, name string, size long, sha256 string, text string, problem string", rows_of)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


_NODES = "array<struct<kind:string,node_id:string,parent_id:string,title:string,resource:string,type:string,ordinal:int>>"


def manifest_rows(entries: DataFrame) -> DataFrame:
    """(package, mode, kind, node_id, parent_id, title, resource, type, ordinal) of manifests: ITEM rows are the
    hierarchy as an adjacency table, RESOURCE rows declare what items point to, FILE and DEPENDENCY rows hang on
    resources."""

    @F.pandas_udf(f"mode string, rows {_NODES}")
    def read(texts):
        import pandas as pd

        out = []
        for text in texts:
            root, mode = parse_xml(text or "")
            rows: list[dict] = []
            names = ("kind", "node_id", "parent_id", "title", "resource", "type", "ordinal")

            def add(*values, rows=rows):
                rows.append(dict(zip(names, values, strict=True)))

            todo = [(e, None) for e in (root.iter() if root is not None else ()) if _local(e.tag) == "organization"]
            while todo:
                element, parent = todo.pop()
                for k, child in enumerate(c for c in element if _local(c.tag) == "item"):
                    title = next(((c.text or "").strip() for c in child if _local(c.tag) == "title"), "")
                    add("ITEM", child.get("identifier"), parent, title, child.get("identifierref"), None, k)
                    todo.append((child, child.get("identifier")))
            for e in root.iter() if root is not None else ():
                if _local(e.tag) == "resource":
                    add("RESOURCE", e.get("identifier"), None, e.get("href"), None, e.get("type"), len(rows))
                    for c in e:
                        if _local(c.tag) == "file":
                            add("FILE", c.get("href"), e.get("identifier"), None, None, None, len(rows))
                        elif _local(c.tag) == "dependency":
                            add("DEPENDENCY", c.get("identifierref"), e.get("identifier"), None, None, None, len(rows))
            out.append((mode, rows))
        return pd.DataFrame(out, columns=["mode", "rows"])

    found = entries.where(F.lower(F.element_at(F.split("name", "/"), -1)) == "imsmanifest.xml").select("package", read("text").alias("m"))
    return found.select("package", "m.mode", F.explode_outer("m.rows").alias("r")).select("package", "mode", "r.*")


def orphans(manifest: DataFrame) -> DataFrame:
    """Resources that no item and no dependency names."""
    named = manifest.where("kind = 'ITEM'").select("package", F.col("resource").alias("node_id")).union(manifest.where("kind = 'DEPENDENCY'").select("package", "node_id"))
    return manifest.where("kind = 'RESOURCE'").join(named, ["package", "node_id"], "left_anti").select("package", "node_id", "type")


def missing_files(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Declared files that the archive lacks, and whether their base name is there under another path."""
    declared = manifest.where("kind = 'FILE'").select("package", F.col("node_id").alias("name"))
    lost = declared.join(entries, ["package", "name"], "left_anti").withColumn("base", F.element_at(F.split("name", "/"), -1))
    there = entries.select("package", F.element_at(F.split("name", "/"), -1).alias("base")).distinct().withColumn("elsewhere", F.lit(True))
    return lost.join(there, ["package", "base"], "left").select("package", "name", F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"))


def workbook_cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    return cells_of(files(spark, path, pattern))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cells(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str | None]]:
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
        target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
            for _, c in ElementTree.iterparse(part):  # a row at a time
                if _local(c.tag) == "row":
                    c.clear()
                if _local(c.tag) != "c":
                    continue
                parts = {_local(x.tag): x for x in c}
                value = parts["v"].text if "v" in parts else None
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif c.get("t") == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if value is not None or "f" in parts:
                    yield sheet.get("name"), int(re.sub(r"\D", "", c.get("r"))) - 1, _column(c.get("r")), value


def cells_of(workbooks: DataFrame) -> DataFrame:
    """(workbook, sheet, row, col, value, problem) of workbooks(path, content): non-empty cells, rows and columns from 0.
    A formula without a stored value has a null value; a workbook that can't be read, or not to its end, has a
    row with its problem."""

    def rows_of(workbook: str, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for cell in _cells(z):
                    yield workbook, *cell, None
        except (zipfile.BadZipFile, zipfile.zlib.error, RuntimeError, NotImplementedError, ElementTree.ParseError, KeyError, IndexError, ValueError, TypeError, AttributeError) as e:
            yield workbook, None, None, None, None, f"BAD_WORKBOOK: {type(e).__name__}"

    return _per_file(workbooks, "workbook string, sheet string, row int, col int, value string, problem string", rows_of)


def table_of(cells: DataFrame, columns: dict[str, tuple[str, ...]], header_row: int = 0) -> DataFrame:
    """Rows of a sheet under their headings: for each wanted column the names it goes by. A heading that stands
    twice names no column, so its values stay null."""
    head = cells.where(F.col("row") == header_row).select("workbook", "sheet", "col", F.lower(F.trim("value")).alias("heading"))
    known = F.create_map(*(F.lit(x) for name, aliases in columns.items() for alias in (name, *aliases) for x in (alias.lower(), name)))
    named = head.withColumn("name", known[F.col("heading")]).where("name is not null")
    single = named.groupBy("workbook", "sheet", "name").agg(F.count("*").alias("n"), F.min("col").alias("col")).where("n = 1").drop("n")
    body = cells.where(F.col("row") > header_row).join(single, ["workbook", "sheet", "col"])
    return body.groupBy("workbook", "sheet", "row").pivot("name", list(columns)).agg(F.first("value"))
