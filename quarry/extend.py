"""Extension points: what a user may bring, and the plainest version of each.

Models are never bundled.  Whatever calls one gets whole Arrow batches, so it
is loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rerank import conforms


class Operator(Protocol):
    """A search operator: rows (op_kind, id, score, rank) of a tenant's frame, and what a run costs."""

    kind: str
    cost_ms: int

    def run(self, rows: DataFrame, query: str, k: int) -> DataFrame: ...

    def probe(self, rows: DataFrame, node) -> DataFrame:
        """The rows that pass a filter, best score first; what the conformance gate tries."""
        ...


class Registry:
    """Operators by kind; one that breaks a rule of the conformance gate is refused, and no kind is taken twice."""

    def __init__(self, spark):
        self.spark, self.operators = spark, {}

    def register(self, operator: Operator) -> None:
        if operator.kind in self.operators:
            raise ValueError(f"{operator.kind} is registered")
        if broken := conforms(operator.probe, self.spark):
            raise ValueError(f"{operator.kind} breaks: {', '.join(broken)}")
        self.operators[operator.kind] = operator

    def get(self, kind: str) -> Operator:
        return self.operators[kind]


class Embedder(Protocol):
    name: str
    version: str
    dim: int

    def documents(self, texts: pd.Series) -> Sequence[Sequence[float]]: ...

    def query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Words hashed to signed places; deterministic, without a model.  A text without words has a zero vector."""

    name, version = "hash", "1"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def query(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
            out[h % self.dim] += 1.0 if (h >> 40) & 1 else -1.0
        norm = float(np.sqrt((out * out).sum()))
        return (out / norm if norm else out).tolist()

    def documents(self, texts: pd.Series) -> list[list[float]]:
        return [self.query(t) for t in texts]


def embedded(df: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """``df`` with ``embedding`` and ``producer_version``; a null text has none; a wrong number of dimensions raises."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        vectors = list(embedder.documents(s[known]))
        if len(vectors) != int(known.sum()) or any(len(v) != embedder.dim for v in vectors):
            raise ValueError("the embedder must return one vector of its dimension per text")
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        for i, v in zip(s.index[known], vectors):
            out[i] = [float(x) for x in v]
        return out

    return df.withColumn("embedding", run(F.col(text))).withColumn("producer_version", F.lit(f"{embedder.name}-{embedder.version}-{embedder.dim}"))


def unit(vector: Column) -> Column:
    """A vector of length one; null for one without direction."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


#: Parsers give (section_path, text) of a document; policies give the write operations of documents; preconditions are columns.
Parser = Callable[[str | None, str], list[tuple[list[str], str]]]
WritePolicy = Callable[[DataFrame, DataFrame], DataFrame]
Precondition = Callable[[Column, Column], Column]
#: Describers and translators take a batch and give a text or None for each of it.
Describer = Callable[[Sequence[bytes]], Sequence[str | None]]
Translator = Callable[[Sequence[str]], Sequence[str | None]]


def described(pictures: DataFrame, describer: Describer | None, content: str = "content") -> DataFrame:
    """``pictures`` with ``description``, labelled as such, and ``warning`` where the describer failed; without one both are null."""
    if describer is None:
        return pictures.withColumns({"description": F.lit(None).cast("string"), "warning": F.lit(None).cast("string")})
    return _told(pictures, content, describer, "[Picture description] ", "description")


def glossed(texts: DataFrame, translator: Translator | None, text: str = "text") -> DataFrame:
    """``texts`` with ``gloss``, a labelled machine translation, and ``warning`` where it failed; without a translator both are null."""
    if translator is None:
        return texts.withColumns({"gloss": F.lit(None).cast("string"), "warning": F.lit(None).cast("string")})
    return _told(texts, text, translator, "[Machine translation] ", "gloss")


def _told(df: DataFrame, column: str, model, label: str, name: str) -> DataFrame:
    @F.pandas_udf("text string, warning string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                said = None if x is None else next(iter(model([x])), None)
                rows.append((label + said if said else None, None))
            except Exception as failed:  # noqa: BLE001 - one item that fails must not end the batch
                rows.append((None, f"{type(failed).__name__}: {failed}"[:500]))
        return pd.DataFrame(rows, columns=["text", "warning"])

    told = df.withColumn("__told", run(F.col(column)))
    return told.withColumns({name: F.col("__told.text"), "warning": F.col("__told.warning")}).drop("__told")
