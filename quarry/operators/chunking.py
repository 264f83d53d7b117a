"""Markdown sections, content-defined chunks, table row groups and section keys.

These carry state from line to line or byte to byte, so they run in Arrow
batches of whole texts; keys and ordinals are windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_ROW = re.compile(r"\s*\|.*\|\s*$")
_RULE = re.compile(r"\s*\|(?:\s*:?-+:?\s*\|)+\s*$")

#: 256 random 64-bit numbers, one per byte value, from the hash of a label of our own.
_GEAR = np.array([int.from_bytes(hashlib.sha256(f"quarry gear {i}".encode()).digest()[:8], "big") for i in range(256)], np.uint64)


def sections_of(text: str | None, root: str) -> list[tuple[list[str], str]]:
    """(path, text) of each section that has text; headings in fences are text, an open fence takes the rest."""
    if not text:
        return []
    path: list[tuple[int, str]] = []
    out: list[tuple[list[str], list[str]]] = [([root], [])]
    fence = ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
        elif mark:
            fence = mark[1]
        elif head := _HEADING.match(line):
            level = len(head[1])
            path = [p for p in path if p[0] < level] + [(level, head[2])]
            out.append(([root, *(t for _, t in path)], []))
            continue
        out[-1][1].append(line)
    return [(p, body) for p, lines in out if (body := "\n".join(lines).strip())]


def sections(inputs: DataFrame, key: str = "input_id", root: str = "source_id", text: str = "text") -> DataFrame:
    """(key, ord, section_path, text) of every section; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, p, t) for k, r, x in pdf.itertuples(index=False) for n, (p, t) in enumerate(sections_of(x, r or ""))]
            yield pd.DataFrame(rows, columns=["key", "ord", "section_path", "text"])

    kind = inputs.schema[key].dataType.simpleString()
    out = inputs.select(key, root, text).mapInPandas(run, f"key {kind}, ord int, section_path array<string>, text string")
    return out.withColumnRenamed("key", key)


def rolling(data: bytes) -> np.ndarray:
    """The gear hash of the 64 bytes up to and with each byte.

    It is a sum of shifted random numbers, one per byte, so windows of 1, 2,
    4, ... bytes are put together from two of half their size.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16, 32):
        h[width:] += h[:-width] << np.uint64(width)
    return h


def boundaries(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks.

    A chunk ends where the high bits of the rolling hash are zero, two more of
    them before the average size and two fewer after it, not before ``least``
    and at the latest at ``most``.  The hash looks back 64 bytes, so it is the
    same wherever the chunk began.
    """
    if not 64 <= least <= average <= most:
        raise ValueError("sizes must be 64 <= least <= average <= most")
    size = len(data)
    if size <= least:
        return [size] if size else []
    bits = round(log2(average))
    h = rolling(data)
    zero = lambda n: (np.flatnonzero(h >> np.uint64(64 - n) == 0) + 1).tolist()
    hard, soft = zero(bits + 2), zero(max(1, bits - 2))
    ends, start = [], 0
    while size - start > least:
        stop = min(size, start + most)
        n = bisect_left(hard, start + least + 1)
        if n < len(hard) and hard[n] < start + average and hard[n] <= stop:
            end = hard[n]
        else:
            n = bisect_left(soft, max(start + least + 1, start + average))
            end = soft[n] if n < len(soft) and soft[n] <= stop else stop
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def tables_of(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each pipe table: a row, a rule, and rows."""
    lines, out, i = text.split("\n"), [], 0
    while i + 1 < len(lines):
        if _ROW.match(lines[i]) and _RULE.match(lines[i + 1]):
            j = i + 2
            while j < len(lines) and _ROW.match(lines[j]):
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def row_groups(lines: list[str], budget: int) -> list[str]:
    """A table's rows packed into groups within ``budget`` characters, each under the header and rule; a longer row stands alone."""
    head = lines[:2]
    room = budget - sum(len(x) + 1 for x in head)
    out, group, used = [], [], 0
    for row in lines[2:]:
        if group and used + len(row) + 1 > room:
            out.append("\n".join([*head, *group]))
            group, used = [], 0
        group.append(row)
        used += len(row) + 1
    if group or not out:
        out.append("\n".join([*head, *group]))
    return out


def prose_chunks(text: str, least: int, average: int, most: int, protected: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) in characters; cuts stand at character starts and never inside a protected region."""
    regions = list(protected)
    if any(a >= b for a, b in regions) or any(x[1] > y[0] for x, y in zip(regions, regions[1:])):
        raise ValueError("regions must be sorted, not empty and disjoint")
    data = text.encode("utf-8", "surrogatepass")
    if len(data) == len(text):
        at: list[int] | range = range(len(text) + 1)
    else:
        # Bytes that begin a character, in the order of characters.
        starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        at = [*np.flatnonzero(starts).tolist(), len(data)]
    cuts = {bisect_left(at, e) for e in boundaries(data, least, average, most)} | {p for r in regions for p in r}
    cuts = sorted(c for c in cuts if 0 < c < len(text) and not any(a < c < b for a, b in regions))
    edges = [0, *cuts, len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def chunks_of(text: str, least: int, average: int, most: int) -> list[tuple[str, str]]:
    """(kind, text): prose in content-defined chunks, byte for byte, and tables in row groups that repeat the header."""
    lines, out, last = text.split("\n"), [], 0

    def prose(a: int, b: int) -> None:
        body = "\n".join(lines[a:b]) + ("\n" if b < len(lines) else "")
        if body.strip():
            out.extend(("prose", body[s:e]) for s, e in prose_chunks(body, least, average, most))

    for a, b in tables_of(text):
        prose(last, a)
        out.extend(("table", g) for g in row_groups(lines[a:b], average))
        last = b
    prose(last, len(lines))
    return out


def chunks(df: DataFrame, key: str, text: str = "text", least: int = 256, average: int = 1024, most: int = 4096) -> DataFrame:
    """(key, ordinal, kind, chunk) for every text; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, kind, c) for k, t in pdf.itertuples(index=False) if t for n, (kind, c) in enumerate(chunks_of(t, least, average, most))]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "kind", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"key {kind}, ordinal int, kind string, chunk string").withColumnRenamed("key", key)


def section_keys(sections: DataFrame, document: str = "input_id", order: str = "section_id") -> DataFrame:
    """Adds ``occurrence`` and ``stable_key``: path joined by slashes, ``@n`` for the n-th repetition of a path in its document."""
    path = F.array_join("section_path", "/")
    nth = F.row_number().over(Window.partitionBy(document, path).orderBy(order)) - 1
    out = sections.withColumn("occurrence", nth.cast("long"))
    return out.withColumn("stable_key", F.concat(path, F.when(F.col("occurrence") > 0, F.concat(F.lit("@"), F.col("occurrence").cast("string"))).otherwise(F.lit("")), F.lit("#0")))


def ingest_ops(spans: DataFrame, live: DataFrame) -> DataFrame:
    """What a re-ingest does to each span: assert where nothing is live, nothing where the id is the same, else supersede.

    Spans that the new text no longer has are left alone.
    """
    keys = ["namespace", "source_id", "stable_key"]
    old = live.select(*keys, F.col("record_id").alias("old_id"))
    joined = spans.join(old, keys, "left")
    kind = F.when(F.col("old_id").isNull(), "assert").when(F.col("old_id") != F.col("record_id"), "supersede")
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull())
