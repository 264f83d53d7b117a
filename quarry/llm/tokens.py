"""Encoding of a corpus by a public byte-level BPE tokenizer.

Every executor builds the encoder once per Python worker from a rank file on
its own disk.  The encoder sees ordinary text only, so the string of a special
token is encoded like any other.  A long text is cut before a space that
follows and precedes a non-space: the tokenizer's pre-splitting pattern takes
a space only at the start of a piece, so no piece crosses such a cut and the
ids are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts above this many characters are cut at safe boundaries first.
LONG = 100_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoder(ranks: str = RANKS):
    """The encoder of a rank file (base64 token and rank per line)."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(ranks.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, long: int = LONG) -> list[str]:
    """``text`` cut before single spaces between non-spaces, each piece about ``long`` characters.

    Without such a boundary (one unbroken string) the text stays whole.
    """
    if len(text) <= long:
        return [text]
    out, start = [], 0
    while len(text) - start > long:
        at = _SAFE.search(text, start + long)
        if at is None:
            break
        out.append(text[start : at.start()])
        start = at.start()
    return [*out, text[start:]]


def encode_text(text: str | None, ranks: str = RANKS) -> list[int]:
    """The ids of one text; null and empty give none.

    Half of a surrogate pair can't be written in UTF-8 and counts as U+FFFD.
    """
    if not text:
        return []
    enc = encoder(ranks)
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def decode_ids(ids, ranks: str = RANKS) -> bytes:
    """The raw UTF-8 bytes of a list of ids; a cut character stays cut."""
    return encoder(ranks).decode_bytes(list(ids))


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row of ``df``; no row is dropped.

    One narrow pass without a shuffle: only the two columns reach Python, in
    Arrow batches, and the ids go back as one flat buffer with offsets.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [encode_text(t, ranks) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(each) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in each], out=offsets[1:])
            flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """``df`` without its text, with ``n_tokens``; null and empty texts have 0."""
    from pyspark.sql import types as T

    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode_text(t, ranks)) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return df.select(*names, text).mapInArrow(run, schema)
