"""Document files: text, Markdown, HTML, DOCX, PDF and source code; folders, and what has changed in them."""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, length long, sha256 string, text string"


class _Text(HTMLParser):
    SKIP = ("script", "style", "noscript", "template")
    BREAK = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table")

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipping += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.parts.append("#" * int(tag[1]) + " ")

    def handle_endtag(self, tag: str) -> None:
        self.skipping = max(0, self.skipping - (tag in self.SKIP))
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)


def html_text(raw: bytes) -> str:
    p = _Text()
    p.feed(raw.decode("utf-8", "replace"))
    lines = [" ".join(x.split()) for x in "".join(p.parts).split("\n")]
    return "\n\n".join(x for x in lines if x)


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file, headings as Markdown."""
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        m = re.match(r"Heading(\d)", style.get(f"{w}val", "") if style is not None else "")
        out.append("#" * int(m[1]) + " " + text if m else text)
    return "\n\n".join(x for x in out if x.strip())


def pdf_text(raw: bytes) -> str:
    """Pages of a PDF, parted by form feeds; needs the optional library pypdf."""
    import pypdf

    return "\f".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages)


READERS = {"html": html_text, "htm": html_text, "docx": docx_text, "pdf": pdf_text}


def file_text(path: str, raw: bytes) -> tuple[str, str | None]:
    """The kind of a file and its text; none where it cannot be read."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "txt"
    try:
        return kind, READERS[kind](raw) if kind in READERS else raw.decode("utf-8")
    except (UnicodeDecodeError, zipfile.BadZipFile, ImportError, KeyError):
        return kind, None


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind, length, sha256, text) of all files below a folder, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds, texts = zip(*(file_text(p, c) for p, c in zip(b["path"], b["content"]))) if len(b) else ((), ())
            yield pd.DataFrame({"path": b["path"], "kind": list(kinds), "length": b["length"], "sha256": b["sha256"], "text": list(texts)})

    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("text"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two listings with sha256: new, changed, gone."""
    both = now.select("path", F.col("sha256").alias("n")).join(before.select("path", F.col("sha256").alias("o")), "path", "full_outer")
    kind = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("o") != F.col("n"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def python_facts(source: str) -> list[tuple[str, str, str, str]]:
    """(kind, subject, predicate, object) of Python source: what it defines, inherits, imports and calls."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = owner
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                out.append((kind, owner or "module", "contains", name))
                if doc := ast.get_docstring(child):
                    out.append(("doc", name, "documented_as", doc.split("\n")[0]))
                for base in getattr(child, "bases", []):
                    out.append(("relation", name, "inherits", ast.unparse(base)))
            elif isinstance(child, ast.Import | ast.ImportFrom):
                for a in child.names:
                    out.append(("relation", owner or "module", "imports", f"{getattr(child, 'module', None) or ''}.{a.name}".strip(".")))
            elif isinstance(child, ast.Call) and owner:
                out.append(("relation", owner, "calls", ast.unparse(child.func)))
            visit(child, name)

    visit(tree, "")
    return out


def explode_code(files: DataFrame) -> DataFrame:
    """(path, kind, subject, predicate, object) of the Python files among documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f) for p, t in zip(b["path"], b["text"]) for f in python_facts(t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "subject", "predicate", "object"])

    return files.where("kind = 'py'").select("path", "text").mapInPandas(run, "path string, kind string, subject string, predicate string, object string")
