"""Text of office files as Markdown, by the standard library: they are zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.documents import html_text

_DOC = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", r"\|").replace("\n", " ") for c in cells) + " |"


def _table(rows: list[list[str]]) -> str:
    """Rows as a pipe table; the first is its header."""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join([_row(rows[0]), "|" + "---|" * width, *map(_row, rows[1:])])


def _document(z: zipfile.ZipFile) -> str:
    def text(p) -> str:
        return "".join(t.text or "" if t.tag == f"{_DOC}t" else "\t" for t in p.iter() if t.tag in (f"{_DOC}t", f"{_DOC}tab"))

    parts = []
    for block in X.fromstring(z.read("word/document.xml")).find(f"{_DOC}body"):
        if block.tag == f"{_DOC}tbl":
            rows = [[" ".join(text(p) for p in c.iter(f"{_DOC}p")) for c in r.iter(f"{_DOC}tc")] for r in block.iter(f"{_DOC}tr")]
            if rows:
                parts.append(_table(rows))
        elif block.tag == f"{_DOC}p" and (said := text(block).strip()):
            style = next((s.get(f"{_DOC}val", "") for s in block.iter(f"{_DOC}pStyle")), "")
            level = re.fullmatch(r"Heading([1-6])", style)
            parts.append("#" * int(level[1]) + " " + said if level else f"# {said}" if style == "Title" else said)
    return "\n\n".join(parts)


def _slides(z: zipfile.ZipFile) -> str:
    names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    parts = []
    for number, name in names:
        said = ["".join(t.text or "" for t in p.iter(f"{_DRAW}t")).strip() for p in X.fromstring(z.read(name)).iter(f"{_DRAW}p")]
        said = [s for s in said if s]
        parts += [f"## {said[0] if said else f'Slide {number}'}", *said[1:]]
    return "\n\n".join(parts)


def _column(ref: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return max(out - 1, 0)


def _sheets(z: zipfile.ZipFile) -> str:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in X.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    titles = [s.get("name", "") for s in X.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    parts = []
    for k, (number, name) in enumerate(names):
        rows = []
        for row in X.fromstring(z.read(name)).iter(f"{_SHEET}row"):
            cells: list[str] = []
            for c in row.iter(f"{_SHEET}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                v = c.find(f"{_SHEET}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells[at] = inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
            rows.append(cells)
        rows = [r for r in rows if any(r)]
        parts.append(f"## {titles[k] if k < len(titles) else f'Sheet {number}'}")
        if rows:
            parts.append(_table(rows))
    return "\n\n".join(parts)


_READERS = {"docx": _document, "pptx": _slides, "xlsx": _sheets}


def file_text(name: str, content: bytes | None) -> str | None:
    """Markdown of a file by its ending; None for what can't be read, as of a broken file or an unknown ending."""
    if content is None:
        return None
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        if kind in _READERS:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return _READERS[kind](z)
        if kind in ("md", "txt"):
            return content.decode("utf-8")
        if kind in ("html", "htm"):
            return html_text(content.decode("utf-8", "replace"))
        if kind == "csv":
            import csv

            rows = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if r]
            return _table(rows) if rows else ""
    except (zipfile.BadZipFile, KeyError, X.ParseError, UnicodeDecodeError, ValueError, IndexError):
        return None
    return None


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content), as ``binaryFile`` reads them; null where a file can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [file_text(p, None if c is None else bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]})

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, "path string, text string")


def metadata_section(fields: dict[str, str | None]) -> str:
    """A fenced section of a file's own metadata; a fence in a value can't end it.  Empty fields are left out."""
    lines = [f"{k}: {v}".replace("```", "'''").replace("\n", " ") for k, v in fields.items() if v]
    return "\n".join(["```", *lines, "```"]) if lines else ""
