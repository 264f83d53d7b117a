"""Ingest: documents become sections, chunks and keyed spans, are compared with what is live, and are written as operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, store


def spans(inputs: DataFrame, *, least: int = 256, average: int = 1024, most: int = 4096) -> DataFrame:
    """(namespace, source_id, stable_key, section_path, body_text, record_id) of documents (input_id, namespace, source_id, text).

    A path that comes again in its document is numbered, and so are the
    chunks of a section; null and blank texts have no spans.
    """
    good = inputs.where(F.col("input_id").isNotNull() & F.col("namespace").isNotNull() & F.col("source_id").isNotNull()).dropDuplicates(["input_id"])
    sections = chunking.sections(good.select("input_id", "source_id", "text"))
    path = F.array_join("section_path", "/")
    nth = F.row_number().over(Window.partitionBy("input_id", path).orderBy("ord")) - 1
    keyed = sections.withColumn("place", F.concat(path, F.when(nth > 0, F.concat(F.lit("@"), nth.cast("string"))).otherwise(F.lit(""))))
    named = keyed.withColumn("section", F.struct("input_id", "place", "section_path"))
    chunks = chunking.chunks(named, "section", least=least, average=average, most=most).select("section.*", "ordinal", F.col("chunk").alias("body_text"))
    null = F.lit(None).cast("int")
    return chunks.join(good.select("input_id", "namespace", "source_id"), "input_id").select(
        "input_id", "namespace", "source_id", F.concat("place", F.lit("#"), F.col("ordinal").cast("string")).alias("stable_key"), "section_path", "body_text",
        T.content_id(F.lit("chunk"), F.col("section_path"), F.col("body_text"), null, null).alias("record_id"),
    )


def operations(inputs: DataFrame, records: DataFrame, *, preconditions=(), prune: bool = False, **sizes) -> DataFrame:
    """The write operations (kind, span, record_id, old_id, target_id, body_text) that ingesting ``inputs`` asks for.

    A span without a live record is asserted, one whose content changed is
    superseded, an unchanged one is passed over.  Spans that a source no longer
    has are left alone unless ``prune``.  ``inputs`` has writer_namespace as
    well; documents of a foreign writer, and spans that fail a precondition
    over ``body_text`` and ``prior_text``, are refused.
    """
    admitted = inputs.where(F.col("namespace").eqNullSafe(F.col("writer_namespace")))
    new = spans(admitted, **sizes)
    live = store.live(records).groupBy(*store.SPAN).agg(F.max_by("record_id", "row_id").alias("old_id"), F.max_by("body_text", "row_id").alias("prior_text"))
    joined = new.join(live, store.SPAN, "left")
    for p in preconditions:
        joined = joined.where(F.coalesce(p(F.col("body_text"), F.col("prior_text")), F.lit(False)))
    kind = F.when(F.col("old_id").isNull(), "assert").when(F.col("old_id") != F.col("record_id"), "supersede")
    null = F.lit(None).cast("string")
    out = joined.withColumn("kind", kind).where("kind is not null").select("kind", *store.SPAN, "record_id", "old_id", null.alias("target_id"), "body_text")
    if not prune:
        return out
    sources = new.select("namespace", "source_id").distinct()
    gone = live.join(sources, ["namespace", "source_id"], "left_semi").join(new.select(*store.SPAN).distinct(), store.SPAN, "left_anti")
    return out.unionByName(
        gone.select(F.lit("forget").alias("kind"), *store.SPAN, null.alias("record_id"), null.alias("old_id"), F.col("old_id").alias("target_id"), null.alias("body_text"))
    )


def commit(changes: DataFrame, log: str, feed, refresh=()) -> int:
    """Numbers the operations, appends them to the log folder, applies them to a ``BucketStore`` and refreshes views; returns how many there were.

    The log is the truth: if applying fails, applying the same log again ends
    in the same state.
    """
    from quarry.sources import files

    spark = changes.sparkSession
    schema = "position long"
    known = spark.read.parquet(log).select("position") if files.exists(spark, log) else spark.createDataFrame([], schema)
    numbered = store.append_log(known, changes, [*store.SPAN, "kind"])
    before = known.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    numbered.write.mode("append").parquet(log)
    written = spark.read.parquet(log).where(F.col("position") > before)
    feed.apply(written.withColumn("op_seq", F.col("position")).withColumn("idempotency_key", F.lit(None).cast("string")))
    for view in refresh:
        view(written)
    return written.count()
