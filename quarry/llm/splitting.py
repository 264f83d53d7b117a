"""Splitting oversized texts at topic boundaries, with overlap.

A text is a row of units (sentences, lines, table rows).  For every gap
between two units the words of the block before it are compared with those of
the block after it; a gap that is less similar than the peaks on its two sides
is a valley, and its depth marks a topic boundary.  Within the window in which
the next cut must fall, the deepest valley is taken; paragraph ends count as
deeper than line ends, and these than sentence ends.  Every piece after the
first begins with the last bytes of the piece before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units on either side of a gap that are compared; the part of a window in which a cut is looked for first.
BLOCK, EARLIEST = 4, 0.5
#: What a paragraph, a line and a sentence end add to the depth of a gap.
PARAGRAPH, LINE, SENTENCE = 0.6, 0.25, 0.1

_END = re.compile(r"\n[ \t\r]*\n\s*|\n+|(?<=[.!?…])[\"”»')\]]*[ \t]+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]{2,}")


def _units(text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight of the gap after) in characters; a unit keeps the white space that ends it."""
    out, start = [], 0
    for m in _END.finditer(text):
        end = m.end()
        if end <= start or end >= len(text):
            continue
        gap = m[0]
        out.append((start, end, PARAGRAPH if gap.count("\n") > 1 else LINE if "\n" in gap else SENTENCE))
        start = end
    return [*out, (start, len(text), 0.0)]


def depths(words: list[list[str]], block: int = BLOCK) -> list[float]:
    """For the gap after each unit but the last, the depth of its valley of block similarity."""
    n = len(words)
    if n < 2:
        return []
    left, right = Counter(words[0]), Counter()
    for unit in words[1 : 1 + block]:
        right.update(unit)
    dot = sum(c * right[w] for w, c in left.items())
    ll, rr = sum(c * c for c in left.values()), sum(c * c for c in right.values())
    sims = []
    for g in range(n - 1):
        sims.append(dot / sqrt(ll * rr) if ll and rr else 0.0)
        # The unit after the gap leaves the right block for the left; each change moves the sums by its own words.
        changes = [(right, w, -1) for w in words[g + 1]] + [(left, w, 1) for w in words[g + 1]]
        if g + 1 + block < n:
            changes += [(right, w, 1) for w in words[g + 1 + block]]
        if g + 1 - block >= 0:
            changes += [(left, w, -1) for w in words[g + 1 - block]]
        for side, w, d in changes:
            c = side[w]
            other = right if side is left else left
            dot += d * other[w]
            if side is left:
                ll += 2 * c * d + 1
            else:
                rr += 2 * c * d + 1
            side[w] = c + d
    # Depth: how far the peaks to the left and to the right rise above the gap.
    up, peak = [0.0] * len(sims), 0.0
    for i, s in enumerate(sims):
        peak = s if i == 0 or s < sims[i - 1] and peak < s else max(peak, s) if i and sims[i - 1] >= s else s
        up[i] = peak - s
    down, peak = [0.0] * len(sims), 0.0
    for i in range(len(sims) - 1, -1, -1):
        s = sims[i]
        peak = max(peak, s) if i + 1 < len(sims) and sims[i + 1] >= s else s
        down[i] = peak - s
    return [a + b for a, b in zip(up, down)]


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own, end) in characters of the pieces of ``text``: [start, own) repeats the piece before.

    All pieces are at most ``limit`` UTF-8 bytes with their overlap, which is
    ``overlap`` bytes, or up to three more where a character stands there.  An
    overlap that leaves no room is halved to the limit.  A unit longer than
    the window is cut at white space, and an unbroken string between two
    characters.  A text within the limit is one piece, an empty text too.
    """
    data = len(text.encode("utf-8", "surrogatepass"))
    if data <= limit:
        return [(0, 0, len(text))]
    if limit < 8:
        raise ValueError("the limit must be at least 8 bytes")
    overlap = max(0, min(overlap, limit // 2 - 4))
    # Byte offset of each character's start.
    if data == len(text):
        at: list[int] | range = range(len(text) + 1)
    else:
        at, total = [0], 0
        for c in text:
            o = ord(c)
            total += 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4
            at.append(total)
    from bisect import bisect_left, bisect_right

    units = _units(text)
    words = [[w.lower() for w in _WORD.findall(text, a, b)] for a, b, _ in units]
    gaps = [(units[i][1], d + units[i][2]) for i, d in enumerate(depths(words))]
    places = [p for p, _ in gaps]
    out, own = [], 0
    while True:
        start = own if not out or not overlap else max(out[-1][1], bisect_right(at, at[own] - overlap) - 1)
        last = bisect_right(at, at[start] + limit) - 1
        if last >= len(text):
            out.append((start, own, len(text)))
            return out
        room = at[last] - at[own]
        low = bisect_left(at, at[own] + int(room * EARLIEST))
        inside = range(bisect_left(places, max(low, own + 1)), bisect_right(places, last))
        if inside:
            cut = places[max(inside, key=lambda i: (gaps[i][1], i))]
        else:
            early = bisect_right(places, last) - 1
            if early >= 0 and at[places[early]] > at[own] + room // 4:
                cut = places[early]
            else:
                space = max(text.rfind(" ", low, last), text.rfind("\n", low, last), text.rfind("\t", low, last))
                cut = space + 1 if space >= low and space + 1 > own else last
        out.append((start, own, cut))
        own = cut


def limited(sections: DataFrame, inputs: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id, input_id, section_path, text, max_bytes, overlap_bytes) of every section and input above its limit.

    The content type is that of the input, in lower case and without what
    follows a semicolon; null and unlisted types take ``*``.  Copies of a row
    count once; were an input to come with several types, the first by
    alphabet holds for its sections.  Null texts are no items.
    """
    # The limits are a fixed table of a row per kind and type.
    named = limits.select("item_kind", F.lower("content_type").alias("type"), "max_bytes", "overlap_bytes").dropDuplicates(["item_kind", "type"])
    rest = named.where(F.col("type") == "*").select("item_kind", F.col("max_bytes").alias("m"), F.col("overlap_bytes").alias("o"))
    least = named.groupBy("item_kind").agg(F.min("max_bytes").alias("least"))
    kind = F.lower(F.trim(F.split("content_type", ";")[0]))
    typed = inputs.where(F.col("input_id").isNotNull()).groupBy("input_id").agg(F.min(kind).alias("type"))
    path, size = F.lit(None).cast("array<string>"), F.octet_length("text")

    def above(items: DataFrame) -> DataFrame:
        # Whatever its type, a text of at most the least limit of its kind is not oversized; it goes no further than the scan.
        return items.join(F.broadcast(least), "item_kind").where(size > F.col("least")).drop("least")

    s = above(sections.select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "input_id", "section_path", "text")).join(typed, "input_id", "left")
    i = above(inputs.select(F.lit("input").alias("item_kind"), F.col("input_id").alias("item_id"), "input_id", path.alias("section_path"), "text", kind.alias("type")))
    over = (
        s.unionByName(i)
        .join(F.broadcast(named.where(F.col("type") != "*")), ["item_kind", "type"], "left")
        .join(F.broadcast(rest), "item_kind")
        .withColumns({"max_bytes": F.coalesce("max_bytes", "m"), "overlap_bytes": F.coalesce("overlap_bytes", "o")})
        .where(size > F.col("max_bytes"))
        # Copies are told by two hashes, so texts are no keys.
        .withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})
    )
    return over.dropDuplicates(["item_kind", "item_id", "h1", "h2"]).select("item_kind", "item_id", "input_id", "section_path", "text", "max_bytes", "overlap_bytes")


def split(items: DataFrame, with_text: bool = True) -> DataFrame:
    """A row per piece of every oversized item: piece_no from 0, start, own and end in characters, piece.

    Items within their limit pass by without Python.  ``with_text`` False leaves out
    the text of the pieces, and input_id and section_path with it.
    """
    big = items.where(F.octet_length("text") > F.col("max_bytes"))
    kept = ["item_kind", "item_id", *(["input_id", "section_path"] if with_text else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, where = [], []
            for n, (text, limit, overlap) in enumerate(zip(pdf["text"], pdf["max_bytes"], pdf["overlap_bytes"])):
                for k, (a, own, b) in enumerate(spans(text, int(limit), int(overlap))):
                    where.append(n)
                    rows.append((k, a, own, b, text[a:b]) if with_text else (k, a, own, b))
            names = ["piece_no", "start", "own", "end", *(["piece"] if with_text else [])]
            out = pdf[kept].iloc[where].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=names)], axis=1)

    schema = "item_kind string, item_id long, " + ("input_id long, section_path array<string>, " if with_text else "")
    schema += "piece_no int, start int, own int, end int" + (", piece string" if with_text else "")
    return big.select(*kept, "text", "max_bytes", "overlap_bytes").mapInPandas(run, schema)


def oversized(sections: DataFrame, inputs: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id) of the items that came apart."""
    pieces = split(limited(sections, inputs, limits), with_text=False)
    return pieces.where("piece_no = 1").select("item_kind", "item_id").distinct()
