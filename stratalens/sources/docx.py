"""DOCX folders: discovery, paragraphs and tables, each file read once on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import parsed_name
from stratalens.operators.chunking import described_tables, extracted
from stratalens.schemas import TABLES

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_document(name: Column) -> Column:
    """A .docx suffix in either case on a name that is no lock file."""
    return F.lower(name).rlike(r"(?s).\.docx$") & ~name.startswith("~$")


#: The suffix in either case, as a glob, and the columns of files as Spark reads them.
SUFFIX, FILES = "*.[dD][oO][cC][xX]", "path string, modificationTime timestamp, length bigint, content binary"


def _literal(name: str) -> str:
    """A glob that matches the name only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _folder(spark: SparkSession, directory: str):
    """The folder's full path and file system; fails if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"Directory does not exist: {directory}")
    return fs.makeQualified(p).toString(), fs


def _own(files: DataFrame, folder: str) -> DataFrame:
    """(path, file_name, content) of the DOCX files that lie in the folder itself; those of its subfolders are passed over unopened."""
    names = len(re.sub("^[^:/]*:/*", "", folder).strip("/").split("/")) + 1
    depth = F.size(F.split(F.regexp_replace(F.col("_metadata.file_path"), "^[^:/]*:/*", ""), "/"))
    rows = files.where(depth == names).select("path", base_name(F.col("path")).alias("file_name"), "content")
    return rows.where(is_document(F.col("file_name")) & ~F.col("file_name").rlike("^[_.]"))


def listed(spark: SparkSession, directory: str, name: str | None = None) -> DataFrame:
    """(path, file_name, content) of the folder's DOCX files, not of its subfolders, or of the one of that name.

    Spark lists the folder and packs files into tasks by size; a file is opened only where its content is asked for.  Names starting with
    ``_`` or ``.``, which Spark passes over, are added without content: none is a valid document name, so they need none to be refused.
    """
    folder, fs = _folder(spark, directory)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIX if name is None else _literal(name))
    out = _own(reader.load(_literal(folder)), folder)
    hidden = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{_literal(folder)}/[_.]{SUFFIX}")) or []
    names = [(s.getPath().toString(), s.getPath().getName(), None) for s in hidden if s.isFile() and name in (None, s.getPath().getName())]
    rows = spark.createDataFrame(names, "path string, file_name string, content binary")
    return out.unionByName(rows.where(is_document(F.col("file_name")))) if names else out


def arriving(spark: SparkSession, directory: str, at_once: int) -> DataFrame:
    """The stream of (path, file_name, content) of the folder's DOCX files, ``at_once`` in a batch; each path comes once.

    Names are checked before: a name that is refused would stop the stream at its batch for good.
    """
    folder, _ = _folder(spark, directory)
    names = listed(spark, directory).select(parsed_name(F.col("file_name")).alias("n")).select("n.*")
    names.write.format("noop").mode("overwrite").save()
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIX).option("maxFilesPerTrigger", at_once)
    return _own(reader.load(_literal(folder)), folder)


def discover(spark: SparkSession, directory: str) -> DataFrame:
    """(path, file_name) of the folder's DOCX files, not of its subfolders, in order of path; no file is opened."""
    return listed(spark, directory).select("path", "file_name").orderBy("path")


def loaded(files: DataFrame) -> DataFrame:
    """(path, file_name, content) of a choice of discovered files: only these are opened, on the executors.

    The choice passes the driver; whole folders and single documents are read from ``listed``, which does not.
    """
    spark, found = files.sparkSession, [(r.path, r.file_name, None) for r in files.select("path", "file_name").collect()]
    # Spark passes over names that start like this; none is a valid document name, so they need no content to be refused
    hidden = [x for x in found if x[1].startswith(("_", "."))]
    out = spark.createDataFrame(hidden, "path string, file_name string, content binary")
    if paths := [x[0] for x in found if x not in hidden]:
        out = out.unionByName(spark.read.format("binaryFile").load(paths).select("path", base_name(F.col("path")).alias("file_name"), "content"))
    return out


# What stands for a run's children; a break of another type than a line's has no text.
MARKS = {f"{W}tab": "\t", f"{W}ptab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}


def _text(node: ElementTree.Element) -> str:
    """Text of a paragraph's own runs and hyperlinks, with tabs and line breaks; not of text boxes, or of insertions under review."""
    out = []
    for child in node:
        for run in [child] if child.tag == f"{W}r" else child.findall(f"{W}r") if child.tag == f"{W}hyperlink" else ():
            for x in run:
                if x.tag == f"{W}t":
                    out.append(x.text or "")
                elif x.get(f"{W}type", "textWrapping") == "textWrapping":
                    out.append(MARKS.get(x.tag, ""))
    return "".join(out)


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """Cell texts of a table row: a cell that spans columns counts for each of them, and one that continues the cell above repeats its text."""
    out = []
    for cell in row.findall(f"{W}tc"):
        span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
        wide = int(span.get(f"{W}val", "1")) if span is not None else 1
        if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(out) < len(above):
            out += [above[len(out)]] * wide
        else:
            out += ["\n".join(_text(p) for p in cell.findall(f"{W}p"))] * wide
    return out


def _rows(table: ElementTree.Element) -> list[list[str]]:
    out: list[list[str]] = []
    for row in table.findall(f"{W}tr"):
        out.append(_cells(row, out[-1] if out else []))
    return out


def parse(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs and tables of a DOCX file's body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    if body is None:
        return [], []
    return [_text(p) for p in body.findall(f"{W}p")], [_rows(t) for t in body.findall(f"{W}tbl")]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [parse(c) if c is not None else ([], []) for c in b["content"]]
        yield pd.DataFrame({"file_name": b["file_name"], "paragraphs": pd.Series([f[0] for f in found], dtype=object), "tables": pd.Series([f[1] for f in found], dtype=object)})


def read(files: DataFrame) -> DataFrame:
    """Documents of discovered files: names, extracted paragraphs and described tables, one pass over each."""
    files = files if "content" in files.columns else loaded(files)
    raw = files.select("file_name", "content").mapInPandas(_parsed, f"file_name string, paragraphs array<string>, tables {TABLES}")
    named = raw.select("file_name", parsed_name(F.col("file_name")).alias("n"), "paragraphs", "tables").select("file_name", "n.*", "paragraphs", "tables")
    return described_tables(extracted(named))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One document; a missing file or another suffix fails."""
    if not re.search(r"\.docx$", path, re.IGNORECASE):
        raise ValueError(f"Expected a .docx file, got: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"File does not exist: {path}")
    rows = spark.read.format("binaryFile").load(path)
    return read(rows.select("path", base_name(F.col("path")).alias("file_name"), "content"))


def to_docx(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    """A minimal DOCX file, for tests and exports."""
    from xml.sax.saxutils import escape

    def para(text: str) -> str:
        runs = "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\t"))
        return f"<w:p><w:r>{runs}</w:r></w:p>"

    rows = lambda t: "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in t)
    body = "".join(map(para, paragraphs)) + "".join(f"<w:tbl>{rows(t)}</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
