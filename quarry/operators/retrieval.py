"""Literal, lexical and dense top-k search.

Each operator returns (op_kind, id, score, rank), rank from 0, and filters by
namespace before anything else.  A blank query gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

K1, B = 1.2, 0.75


def ranked(df: DataFrame, kind: str, k: int, key: str, ties: str) -> DataFrame:
    """The k rows of highest score, ties by ``ties``, ranked from 0; the sort of k rows is bounded."""
    top = df.orderBy(F.col("score").desc(), F.col(ties)).limit(k)
    rank = (F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(ties))) - 1).cast("long")
    return top.select(F.lit(kind).alias("op_kind"), F.col(key).alias("id"), "score", rank.alias("rank"))


def literal(df: DataFrame, query: str, k: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Substring search: 1000 per term that occurs, plus all occurrences; a repeated term counts again."""
    found = T.terms(query)
    if not found:
        return ranked(df.where(F.lit(False)).withColumn("score", F.lit(0.0)), "grep", k, key, key)
    # A text column is lowered once per row, whatever the number of terms.
    lowered = df.withColumn("__low", F.lower(text))
    counts = [T.occurrences(F.col("__low"), t) for t in found]
    total = sum(counts[1:], counts[0])
    distinct = sum([(c > 0).cast("long") for c in counts[1:]], (counts[0] > 0).cast("long"))
    scored = lowered.withColumn("score", (distinct * 1000 + total).cast("double")).where(F.col("score") > 0)
    return ranked(scored, "grep", k, key, key)


@dataclass
class Parsed:
    """A query as alternatives of required words, phrases and excluded words."""

    every: list[list[str]] = field(default_factory=list)
    phrases: list[list[list[str]]] = field(default_factory=list)
    never: list[str] = field(default_factory=list)


def parse(query: str) -> Parsed:
    """The web-search grammar: ``"a phrase"``, ``or`` between alternatives, ``-excluded``; other words are all required."""
    out = Parsed([[]], [[]], [])
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', T.sanitise(query)):
        if m[2] is not None:
            words = re.findall(r"[^\W_]+", m[2].lower())
            if m[1]:
                out.never += words
            elif words:
                out.every[-1] += words
                out.phrases[-1].append(words)
        elif m[3].lower() == "or" and (out.every[-1] or out.phrases[-1]):
            out.every.append([])
            out.phrases.append([])
        else:
            words = re.findall(r"[^\W_]+", m[3].lower())
            if m[3].startswith("-"):
                out.never += words
            else:
                out.every[-1] += words
    keep = [i for i, e in enumerate(out.every) if e]
    return Parsed([out.every[i] for i in keep], [out.phrases[i] for i in keep], out.never)


def matches(words: Column, parsed: Parsed) -> Column:
    """Whether an array of words satisfies the query."""
    hit = F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for every, phrases in zip(parsed.every, parsed.phrases):
        one = F.lit(True)
        for w in dict.fromkeys(every):
            one = one & F.array_contains(words, w)
        for p in phrases:
            one = one & F.contains(joined, F.lit(" " + " ".join(p) + " "))
        hit = hit | one
    for w in parsed.never:
        hit = hit & ~F.array_contains(words, w)
    return hit


def lexical(df: DataFrame, query: str, k: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Full-text search scored by BM25 over the rows of ``df`` (one tenant's).

    All words are required unless the query says otherwise.  Counts and
    lengths are taken over all rows in one aggregate of a single row.
    """
    parsed = parse(query)
    if not parsed.every:
        return ranked(df.where(F.lit(False)).withColumn("score", F.lit(0.0)), "bm25", k, key, key)
    terms = list(dict.fromkeys(w for e in parsed.every for w in e))
    rows = df.where(F.col(text).isNotNull()).select(key, T.words(F.col(text)).alias("w"))
    tf = [F.size("w") - F.size(F.array_remove("w", t)) for t in terms]
    rows = rows.select(key, F.size("w").alias("dl"), matches(F.col("w"), parsed).alias("hit"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = rows.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.where("hit").withColumn("one", F.lit(1)).join(F.broadcast(stats.withColumn("one", F.lit(1))), "one")
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("N") - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return ranked(joined.withColumn("score", F.round(score, 6)), "bm25", k, key, key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for unlike lengths or a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm, F.lit(0.0)))


def dense(df: DataFrame, query: list[float], k: int = 50, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Exact cosine search with the query as a literal; vectors of another length or without direction are left out.

    Non-finite similarities are dropped after the limit was taken.
    """
    if not query:
        return ranked(df.where(F.lit(False)).withColumn("score", F.lit(0.0)), "ann", k, key, key)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("score", F.round(cosine(F.col(vector), q), 6)).where(F.col("score").isNotNull())
    return ranked(scored, "ann", k, key, key).where(~F.isnan("score") & (F.abs("score") != float("inf")))


def dense_by_group(df: DataFrame, queries: DataFrame, k: int, group: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of each group most similar to the group's query row; the window keeps k rows a partition before it shuffles."""
    q = queries.select(F.col(group), F.col(vector).alias("q"))
    scored = df.join(q, group).withColumn("score", F.round(cosine(F.col(vector), F.col("q")), 6)).where(F.col("score").isNotNull())
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, key, "score", F.col("rank").cast("long").alias("rank"))
