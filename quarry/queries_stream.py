"""Queries over streams, run to their end, with the SQL of a full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch, ship, table
from quarry.streaming import views


KEYS = ["namespace", "source_id", "stable_key"]


def _refreshed(spark: SparkSession, sf_dir: str) -> views.View:
    """A view of the latest record per span, refreshed after each of two deliveries of the log."""
    ship(spark)
    log = table(spark, sf_dir, "records").select(*KEYS, "wal_tx_id", "record_id")
    folder = scratch(spark, "log")
    whole = lambda: spark.read.schema(log.schema).parquet(folder)
    view = views.View(spark, scratch(spark, "view"), views.latest(KEYS, "wal_tx_id"), KEYS, source=whole, lineage=scratch(spark, "lineage"))
    late = F.pmod("wal_tx_id", F.lit(10)) == 0
    for part in (log.where(~late), log.where(late)):
        part.coalesce(4).write.mode("append").parquet(folder)
        view.refresh(folder, log.schema)
    return view


def incremental_equals_full_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).read()


def view_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_refreshed(spark, sf_dir).lineage).groupBy("batch").agg(F.count("*").alias("keys"), F.countDistinct("namespace").alias("namespaces"))


def view_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is added when the log is already there starts at the log's beginning."""
    ship(spark)
    log = table(spark, sf_dir, "records").select("namespace", "record_id", "wal_tx_id").distinct()
    folder = scratch(spark, "log")
    log.coalesce(4).write.parquet(folder)
    derive = lambda rows: rows.groupBy("namespace").agg(F.count("*").alias("entries"), F.max("wal_tx_id").alias("last"))
    return views.View(spark, scratch(spark, "view"), derive, ["namespace"]).refresh(folder, log.schema)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_counts(table(spark, sf_dir, "events"), 60 * 24).select("event_type", "n", "total")


QUERIES = {f.__name__: f for f in (incremental_equals_full_rebuild, view_lineage, view_backfill, event_windows)}

ORACLES = {
    "incremental_equals_full_rebuild": "SELECT namespace, source_id, stable_key, max(wal_tx_id) AS wal_tx_id, arg_max(record_id, wal_tx_id) AS record_id FROM records GROUP BY ALL",
    "view_lineage": """SELECT batch, count(*) AS keys, count(DISTINCT namespace) AS namespaces FROM (
     SELECT DISTINCT namespace, source_id, stable_key, CASE WHEN wal_tx_id % 10 = 0 THEN 1 ELSE 0 END AS batch FROM records) GROUP BY 1""",
    "view_backfill": "SELECT namespace, count(*) AS entries, max(wal_tx_id) AS last FROM (SELECT DISTINCT namespace, record_id, wal_tx_id FROM records) GROUP BY 1",
    "event_windows": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, time_bucket(interval '1 day', ts, timestamp '1970-01-01')",
}
