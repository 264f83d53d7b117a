"""Queries of the core operators on change feeds and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import changefeed, incremental
from quarry.session import scratch, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = changefeed.BucketStore(spark, scratch(spark, "ops"))
    feed = table(spark, sf_dir, "write_ops")
    # What arrived in the first month is the base, to which the rest of the feed is applied.
    early = F.coalesce(F.col("received_at") < F.lit("2026-02-01").cast("timestamp"), F.lit(True))
    for batch in (feed.where(early), feed.where(~early)):
        store.apply(batch)
    return store.live().select("namespace", "source_id", "stable_key", "record_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select(
        "row_id", "namespace", F.col("wal_tx_id").alias("version"), F.col("tx_from").alias("committed_at")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = ("dense", "lexical")
    runs = incremental.succeeded_runs(table(spark, sf_dir, "refresh_reports"), views)
    return incremental.to_process(_log(spark, sf_dir), runs, views).select("row_id", "view_name").distinct()


def p7_reread_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = ("dense", "lexical")
    runs = incremental.succeeded_runs(table(spark, sf_dir, "refresh_reports"), views)
    return incremental.reread_from(_log(spark, sf_dir), runs, views)


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_reread_from": p7_reread_from}

_P7 = """
WITH runs AS (
  SELECT DISTINCT namespace, unnest(map_keys(entries)) AS view_name, wal_after, wal_upto, started_at
  FROM refresh_reports WHERE status = 'succeeded'
), rows AS (SELECT DISTINCT row_id, namespace, wal_tx_id, tx_from FROM records),
pairs AS (SELECT rows.*, v.view_name FROM rows CROSS JOIN (VALUES ('dense'), ('lexical')) v(view_name)),
todo AS (
  SELECT p.* FROM pairs p WHERE NOT EXISTS (
    SELECT 1 FROM runs r WHERE r.namespace = p.namespace AND r.view_name = p.view_name
    AND r.wal_after < p.wal_tx_id AND p.wal_tx_id <= r.wal_upto AND p.tx_from <= r.started_at)
)"""

#: Every valid operation once, retries left out; per span its writes and the forgets of records ever written there, in order of op_seq.
STEPS = """
WITH ops AS (SELECT DISTINCT ON (namespace, op_seq) * FROM write_ops WHERE namespace IS NOT NULL AND op_seq IS NOT NULL AND kind IN ('assert', 'supersede', 'forget')
  AND CASE WHEN kind = 'forget' THEN target_id IS NOT NULL ELSE record_id IS NOT NULL AND source_id IS NOT NULL AND stable_key IS NOT NULL END),
first AS (SELECT namespace, idempotency_key, min(op_seq) AS op_seq FROM ops WHERE idempotency_key IS NOT NULL GROUP BY ALL),
valid AS (SELECT * FROM ops WHERE idempotency_key IS NULL OR (namespace, idempotency_key, op_seq) IN (SELECT (namespace, idempotency_key, op_seq) FROM first)),
spans AS (SELECT DISTINCT namespace, source_id, stable_key, record_id FROM ops WHERE kind <> 'forget'),
steps AS (SELECT namespace, source_id, stable_key, op_seq, kind, record_id, old_id FROM valid WHERE kind <> 'forget'
  UNION ALL SELECT s.namespace, s.source_id, s.stable_key, v.op_seq, 'forget', NULL, v.target_id FROM valid v JOIN spans s ON s.namespace = v.namespace AND s.record_id = v.target_id WHERE v.kind = 'forget'),
lists AS (SELECT namespace, source_id, stable_key, list({'k': kind, 'q': op_seq, 'r': record_id, 'o': old_id, 'h': []::struct(q bigint, r varchar, p varchar, o varchar)[]} ORDER BY op_seq) AS l FROM steps GROUP BY ALL),
ends AS (SELECT namespace, source_id, stable_key, list_reduce(list_prepend({'k': 'start', 'q': 0::bigint, 'r': NULL::varchar, 'o': NULL::varchar, 'h': []::struct(q bigint, r varchar, p varchar, o varchar)[]}, l), lambda a, x:
  CASE WHEN x.k = 'assert' AND a.r IS NOT DISTINCT FROM x.r THEN {'k': '', 'q': x.q, 'r': a.r, 'o': NULL::varchar, 'h': list_append(a.h, {'q': x.q, 'r': a.r, 'p': a.r, 'o': 'unchanged'})}
  WHEN x.k = 'assert' OR (x.k = 'supersede' AND a.r = x.o) THEN {'k': '', 'q': x.q, 'r': x.r, 'o': NULL::varchar,
    'h': list_append(a.h, {'q': x.q, 'r': x.r, 'p': a.r, 'o': CASE WHEN x.k = 'supersede' THEN 'superseded' WHEN a.r IS NULL THEN 'created' ELSE 'converted' END})}
  WHEN x.k = 'forget' AND a.r = x.o THEN {'k': '', 'q': x.q, 'r': NULL::varchar, 'o': NULL::varchar, 'h': list_append(a.h, {'q': x.q, 'r': NULL::varchar, 'p': a.r, 'o': 'forgotten'})}
  WHEN x.k = 'supersede' THEN {'k': '', 'q': x.q, 'r': a.r, 'o': NULL::varchar, 'h': list_append(a.h, {'q': x.q, 'r': a.r, 'p': a.r, 'o': 'refused'})} ELSE a END) AS e FROM lists)"""

ORACLES = {
    "p6_found": STEPS + " SELECT namespace, source_id, stable_key, e.r AS record_id FROM ends WHERE e.r IS NOT NULL",
    "p7_found": _P7 + " SELECT DISTINCT row_id, view_name FROM todo",
    "p7_reread_from": _P7 + """, zones AS (SELECT namespace, view_name, wal_tx_id // 64 AS zone, max(tx_from) AS latest FROM pairs WHERE namespace IS NOT NULL AND wal_tx_id >= 0 AND tx_from IS NOT NULL GROUP BY ALL)
     SELECT namespace, view_name, (min(zone) * 64)::bigint AS reread_from FROM zones z WHERE NOT EXISTS (
       SELECT 1 FROM runs r WHERE r.namespace = z.namespace AND r.view_name = z.view_name AND r.wal_after < z.zone * 64 AND z.zone * 64 + 63 <= r.wal_upto AND z.latest <= r.started_at)
     GROUP BY ALL""",
}
