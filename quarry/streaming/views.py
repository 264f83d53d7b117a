"""Views kept up to date by a stream over the record log.

Each view is one streaming query with its own checkpoint, so a view added
later backfills from the log's start and a failed batch is taken again.  A
view is hashed by key into buckets; a batch deletes the view rows of the keys
it touches and derives them anew, and only buckets that hold such keys are
read and written.  A pointer names the current folder of every bucket, so
applying a batch twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import files

Derive = Callable[[DataFrame], DataFrame]


class View:
    """A materialised view in a folder: bucket folders, and a pointer per committed batch.

    ``derive`` makes view rows of the rows it is given: those of a batch, or,
    where ``source`` gives a frame of all records, those of the keys that the
    batch names.  ``lineage`` is a folder to which each commit appends the keys
    it derived anew.
    """

    def __init__(self, spark: SparkSession, path: str, derive: Derive, keys: list[str], *, source: Callable[[], DataFrame] | None = None, buckets: int = 64, lineage: str | None = None):
        self.spark, self.path, self.derive, self.keys = spark, path.rstrip("/"), derive, keys
        self.source, self.buckets, self.lineage = source, buckets, lineage

    def _pointers(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.path}/pointers") if n.endswith(".json")]

    def _last(self) -> dict:
        found = self._pointers()
        return json.loads(files.read_text(self.spark, f"{self.path}/pointers/{found[-1]}")) if found else {"done": {}, "buckets": {}, "reports": []}

    def _rows(self, paths: list[str], schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def read(self) -> DataFrame | None:
        paths = list(self._last()["buckets"].values())
        return self._rows(paths) if paths else None

    def reports(self) -> list[dict]:
        """Per committed batch, how many keys it touched, which buckets it wrote, and the rows removed and derived."""
        return self._last()["reports"]

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        """Deletes then derives again the touched keys; a batch of the stream that is committed is passed over."""
        last = self._last()
        if last["done"].get(stream, -1) >= batch_id:
            return
        home = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = batch.select(*self.keys).distinct().withColumn("__b", home).persist()
        try:
            names = {r[0] for r in touched.select("__b").distinct().collect()}
            given = batch if self.source is None else self.source().join(touched.drop("__b"), self.keys, "left_semi")
            fresh = self.derive(given)
            old = [p for b, p in last["buckets"].items() if int(b) in names]
            removed = 0
            if old:
                current = self._rows(old, fresh.schema)
                kept = current.join(touched.drop("__b"), self.keys, "left_anti")
                removed = current.count() - kept.count()
                fresh = kept.unionByName(fresh)
            data = f"{self.path}/data/{uuid.uuid4().hex}"
            fresh.withColumn("__b", home).repartition("__b").write.partitionBy("__b").parquet(data)
            made = {n[4:]: f"{data}/{n}" for n in files.names(self.spark, data) if n.startswith("__b=")}
            if self.lineage:
                touched.drop("__b").withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id)}).write.mode("append").parquet(self.lineage)
            report = {"batch": batch_id, "keys": touched.count(), "buckets": len(names), "removed": removed}
        finally:
            touched.unpersist()
        buckets = {b: p for b, p in last["buckets"].items() if int(b) not in names} | made
        new = {"done": {**last["done"], stream: batch_id}, "buckets": buckets, "reports": [*last["reports"], report]}
        if not files.write_text_atomic(self.spark, f"{self.path}/pointers/{len(self._pointers()):012d}.json", json.dumps(new)):
            raise RuntimeError("another writer committed first")

    def _stream(self) -> str:
        """The name of the checkpoint: a lost checkpoint gets another, so its batches aren't taken for committed ones."""
        path = f"{self.path}/checkpoint-name"
        if not files.exists(self.spark, f"{self.path}/checkpoint"):
            files.delete(self.spark, path)
        if not files.exists(self.spark, path):
            files.write_text_atomic(self.spark, path, uuid.uuid4().hex)
        return files.read_text(self.spark, path)

    def refresh(self, log: str, schema, files_per_batch: int = 200) -> DataFrame | None:
        """Takes in whatever the log folder has gained since the last run, then stops."""
        name = self._stream()
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        query = (
            stream.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n, name))
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.read()


def latest(keys: list[str], order: str) -> Derive:
    """A derivation that keeps, per key, the row of highest ``order``."""

    def derive(batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in keys]
        best = batch.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("b"))
        return best.select(*keys, "b.*")

    return derive


def event_counts(events: DataFrame, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """Counts and sums per event type and tumbling window; rows later than the watermark are left out of a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
