"""Full-text search over postings.

An index is three folders: postings hashed by term into buckets and sorted by
term, the length of every document, and one row of totals per namespace.  A
query opens the buckets of its own terms only and never looks at a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import stemming
from quarry.functions import text as T
from quarry.operators.retrieval import K1, B, Parsed, parse, ranked
from quarry.session import scratch

#: Buckets of an index at least, and documents per bucket.
BUCKETS, PER_BUCKET = 16, 100_000


def postings(df: DataFrame, text: str = "text", key: str = "doc_id", config: str = "simple") -> DataFrame:
    """(key, term, tf, positions): the inverted index of a table; positions from 0, stop words keep theirs.

    Null texts have no postings.  With ``english`` words are reduced to stems
    after the words of a document were counted, so each is stemmed once.
    """
    exploded = df.where(F.col(text).isNotNull()).select(key, F.posexplode(T.words(F.col(text))).alias("pos", "term"))
    grouped = exploded.groupBy(key, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    if config == "simple":
        return grouped
    stemmed = grouped.withColumn("term", stemming.stems(F.col("term"))).where(F.col("term").isNotNull())
    return stemmed.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


@dataclass
class Index:
    """A stored index of the texts of many namespaces."""

    spark: SparkSession
    path: str
    config: str
    buckets: int = BUCKETS

    @classmethod
    def build(cls, df: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", namespace: str = "namespace", config: str = "simple", buckets: int | None = None) -> Index:
        """Writes the index of ``df``; a null namespace is indexed and found by nobody who names one."""
        named = df.select(F.col(key).alias("id"), F.col(namespace).alias("namespace"), F.col(text).alias("text")).where("text is not null")
        buckets = buckets or max(BUCKETS, named.count() // PER_BUCKET)
        home = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows = postings(named.withColumn("doc", F.struct("namespace", "id")), "text", "doc", config).select("doc.*", "term", "tf", "positions").withColumn("bucket", home)
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        if config == "simple":
            lengths = named.select("namespace", "id", F.size(T.words(F.col("text"))).cast("long").alias("dl"))
        else:
            counted = df.sparkSession.read.parquet(f"{path}/postings").groupBy("namespace", "id").agg(F.sum("tf").alias("dl"))
            lengths = named.select("namespace", "id").join(counted, ["namespace", "id"], "left").na.fill(0, ["dl"])
        lengths.write.parquet(f"{path}/lengths")
        return cls(df.sparkSession, path, config, buckets)

    def search(self, query: str, k: int = 50, namespace: str | None = None) -> DataFrame:
        """(op_kind, id, score, rank) by BM25, ties by id; counts are those of the namespace, or of all where it is None.

        A query without words, or of stop words only, finds nothing.
        """
        parsed = analysed(parse(query), self.config)
        read = self.spark.read
        if not parsed.every:
            none = read.parquet(f"{self.path}/lengths").where(F.lit(False)).withColumn("score", F.lit(0.0))
            return ranked(none, "bm25", k, "id", "id")
        terms = list(dict.fromkeys(w for e in parsed.every for w in e))
        named = list(dict.fromkeys([*terms, *parsed.never]))
        homes = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in named]).first()
        own = (lambda df: df) if namespace is None else (lambda df: df.where(F.col("namespace") == namespace))
        found = own(read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(*set(homes)) & F.col("term").isin(*named)))
        phrased = {w for ps in parsed.phrases for p in ps for w in p}
        per = found.groupBy("namespace", "id").agg(
            *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{n}") for n, t in enumerate(named)],
            *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"at{n}") for n, t in enumerate(named) if t in phrased],
        )
        lengths = own(read.parquet(f"{self.path}/lengths"))
        one = F.lit(1).alias("one")
        sizes = lengths.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl")).select("*", one)
        often = per.agg(*[F.sum((F.col(f"tf{n}") > 0).cast("long")).alias(f"df{n}") for n in range(len(terms))]).select("*", one)
        hits = per.where(_matches(parsed, named)).join(lengths, ["namespace", "id"])
        # Two rows of totals, whatever the data.
        joined = hits.select("*", one).join(F.broadcast(sizes), "one").join(F.broadcast(often), "one")
        score = F.lit(0.0)
        for n in range(len(terms)):
            f, d = F.col(f"tf{n}"), F.col(f"df{n}")
            score = score + F.log(1 + (F.col("N") - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return ranked(joined.withColumn("score", F.round(score, 6)), "bm25", k, "id", "id")


def analysed(parsed: Parsed, config: str) -> Parsed:
    """The query in the terms of the index; an alternative without terms is dropped."""
    every = [stemming.analyse(e, config) for e in parsed.every]
    phrases = [[q for p in ps if (q := stemming.analyse(p, config))] for ps in parsed.phrases]
    keep = [n for n, e in enumerate(every) if e]
    return Parsed([every[n] for n in keep], [phrases[n] for n in keep], stemming.analyse(parsed.never, config))


def _moved(positions, gap: int):
    return F.transform(positions, lambda x: x - gap)


def _matches(parsed: Parsed, named: list[str]):
    has = lambda t: F.col(f"tf{named.index(t)}") > 0
    hit = F.lit(False)
    for every, phrases in zip(parsed.every, parsed.phrases):
        one = F.lit(True)
        for w in dict.fromkeys(every):
            one = one & has(w)
        for p in phrases:
            starts = F.col(f"at{named.index(p[0])}")
            for gap, w in enumerate(p[1:], 1):
                starts = F.array_intersect(starts, _moved(F.col(f"at{named.index(w)}"), gap))
            one = one & F.coalesce(F.size(starts) > 0, F.lit(False))
        hit = hit | one
    for w in parsed.never:
        hit = hit & ~has(w)
    return hit


#: Indexes built by ``shared``, by application, table and configuration.
_BUILT: dict[tuple, Index] = {}


def shared(df: DataFrame, name: str, **how) -> Index:
    """The index of a table, built in the shared folder on first use in an application."""
    key = (df.sparkSession.sparkContext.applicationId, name, tuple(sorted(how.items())))
    if key not in _BUILT:
        _BUILT[key] = Index.build(df, scratch(df.sparkSession, "index"), **how)
    return _BUILT[key]
