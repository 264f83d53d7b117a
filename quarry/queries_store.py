"""Queries of the record store, the change log and incremental views, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import changefeed, store
from quarry.queries_core import STEPS
from quarry.session import table

NS = "tenant:canyonstack"
MOMENT = datetime(2026, 6, 1)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").drop("provenance").dropDuplicates(["row_id"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "write_ops")


def scan_live_namespace(spark: SparkSession, d: str) -> DataFrame:
    return store.live(_records(spark, d)).where(F.col("namespace") == NS).select("row_id", "record_id", "source_id", "stable_key")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    first = _records(spark, d).where("tx_to is null").orderBy("row_id").select("namespace", "record_id").first()
    return store.get_live(_records(spark, d), first[0], first[1]).select("row_id", "record_id")


def log_tail_since(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).where(F.col("op_seq") > 2000).select("op_seq", "namespace", "kind").distinct()


def log_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("namespace", "kind").agg(F.count("*").alias("deliveries"), F.countDistinct("op_seq").alias("operations"))


def bitemporal_versions(spark: SparkSession, d: str) -> DataFrame:
    return store.versions(_log(spark, d))


def write_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.history(_log(spark, d)).select(*store.SPAN, "op_seq", "outcome")


def live_records(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal_versions(spark, d).where("seq_to is null").select(*store.SPAN, "record_id")


def one_live_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per namespace its live spans and those with more than one live row; a closed row taken for live would be one."""
    r = _records(spark, d)
    spans = store.live(r).groupBy("namespace").agg(F.countDistinct("source_id", "stable_key").alias("spans"))
    bad = store.double_live(r).groupBy("namespace").agg(F.count("*").alias("violations"))
    reopened = store.double_live(r.withColumn("tx_to", F.lit(None).cast("timestamp"))).groupBy("namespace").agg(F.count("*").alias("if_all_were_live"))
    return spans.join(bad, "namespace", "left").join(reopened, "namespace", "left").na.fill(0)


def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return store.as_of(_records(spark, d), MOMENT).groupBy("namespace").agg(F.count("*").alias("rows"), F.min("row_id").alias("first_row"))


def forget_effect(spark: SparkSession, d: str) -> DataFrame:
    ended = changefeed.history(_log(spark, d)).where("outcome = 'forgotten'")
    return ended.select(*store.SPAN, F.col("prior").alias("record_id"), F.col("op_seq").alias("seq_to"))


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return store.since(_log(spark, d), 3000)


def tier_clamp(spark: SparkSession, d: str) -> DataFrame:
    return store.admit(table(spark, d, "records")).select("row_id", "tier").distinct()


def foreign_writers(spark: SparkSession, d: str) -> DataFrame:
    """Rows of foreign writers per namespace, and how many there would be if every writer were the one of a single namespace."""
    r = table(spark, d, "records")
    count = lambda df, name: df.groupBy("namespace").agg(F.countDistinct("row_id").alias(name))
    moved = r.withColumn("provenance", F.struct(F.struct(F.lit(NS).alias("namespace")).alias("writer")))
    return count(r, "rows").join(count(store.foreign_writers(r), "foreign"), "namespace", "left").join(count(store.foreign_writers(moved), "others"), "namespace", "left").na.fill(0)


def navigate_tree(spark: SparkSession, d: str) -> DataFrame:
    return store.navigate(_records(spark, d), NS)


def touched_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.touched_ids(_log(spark, d), 3500)


def _view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "view_dense").select("row_id", "record_id", "namespace", "producer_version").distinct()


def view_anti_remove(spark: SparkSession, d: str) -> DataFrame:
    dead = _records(spark, d).where("tx_to is not null").select("row_id")
    return _view(spark, d).join(dead, "row_id", "left_anti")


def view_rederive(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    touched = r.where(F.col("tx_from") >= F.lit(MOMENT)).select("namespace", "record_id").distinct()
    derive = lambda rows: rows.select("row_id", "record_id", "namespace", F.lit("hash64-v3").alias("producer_version"))
    return store.refresh_view(_view(spark, d), r, touched, derive)


def view_join_live(spark: SparkSession, d: str) -> DataFrame:
    r = store.live(_records(spark, d)).select("row_id", "namespace", "source_id")
    return _view(spark, d).join(r, ["row_id", "namespace"]).groupBy("namespace").agg(F.count("*").alias("rows"), F.countDistinct("source_id").alias("sources"))


def producer_drift(spark: SparkSession, d: str) -> DataFrame:
    return store.drifted(_view(spark, d), "hash64-v2")


def dimension_refusal(spark: SparkSession, d: str) -> DataFrame:
    return store.unlike_dimension(table(spark, d, "view_dense"), 64).select("row_id", F.size("embedding").alias("dim")).distinct()


def view_refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refresh_reports").dropDuplicates(["report_id"]).where("status = 'succeeded'")
    return r.select("namespace", F.explode("entries").alias("view_name", "n")).groupBy("namespace", "view_name").agg(F.sum("n").alias("entries"), F.count("*").alias("runs"))


def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("row_id", T.contextual(F.col("section_path"), F.col("body_text")).alias("text"))


def evidence_projection(spark: SparkSession, d: str) -> DataFrame:
    r = store.live(_records(spark, d)).where(F.col("namespace") == NS)
    return r.select(
        "record_id", "row_id", F.coalesce(F.element_at("section_path", 1), F.lit("")).alias("source_path"), T.snippet(F.col("body_text")).alias("snippet"),
        F.lit(0).cast("long").alias("span_start"), F.length("body_text").cast("long").alias("span_end"), F.unix_micros("tx_from").alias("freshness_us"),
    )


def record_hash(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("row_id", F.sha2("body_text", 256).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_live_namespace, point_lookup, log_tail_since, log_scan_counts, bitemporal_versions, write_outcomes, live_records, one_live_violations, as_of_snapshot,
        forget_effect, change_feed, tier_clamp, foreign_writers, navigate_tree, touched_ids, view_anti_remove, view_rederive, view_join_live,
        producer_drift, dimension_refusal, view_refresh_counts, contextual_text, evidence_projection, record_hash,
    )
}

_R = "r AS (SELECT DISTINCT ON (row_id) * EXCLUDE (provenance) FROM records)"
_V = STEPS + """, h AS (SELECT namespace, source_id, stable_key, unnest(e.h) AS x FROM ends),
 k AS (SELECT namespace, source_id, stable_key, x.q AS op_seq, x.o AS outcome, x.r AS record_id, x.p AS prior FROM h),
 m AS (SELECT *, lead(op_seq) OVER (PARTITION BY namespace, source_id, stable_key ORDER BY op_seq) AS seq_to FROM k WHERE outcome NOT IN ('unchanged', 'refused')),
 v AS (SELECT namespace, source_id, stable_key, record_id, op_seq AS seq_from, seq_to, prior AS supersedes FROM m WHERE outcome <> 'forgotten')"""
_VD = "v AS (SELECT DISTINCT row_id, record_id, namespace, producer_version FROM view_dense)"

ORACLES = {
    "scan_live_namespace": f"WITH {_R} SELECT row_id, record_id, source_id, stable_key FROM r WHERE tx_to IS NULL AND namespace = '{NS}'",
    "point_lookup": f"WITH {_R} SELECT row_id, record_id FROM r WHERE tx_to IS NULL ORDER BY row_id LIMIT 1",
    "log_tail_since": "SELECT DISTINCT op_seq, namespace, kind FROM write_ops WHERE op_seq > 2000",
    "log_scan_counts": "SELECT namespace, kind, count(*) AS deliveries, count(DISTINCT op_seq) AS operations FROM write_ops GROUP BY ALL",
    "bitemporal_versions": _V + " SELECT * FROM v",
    "live_records": _V + " SELECT namespace, source_id, stable_key, record_id FROM v WHERE seq_to IS NULL",
    "one_live_violations": f"""WITH {_R}, s AS (SELECT namespace, source_id, stable_key, count(DISTINCT row_id) FILTER (tx_to IS NULL) AS live, count(DISTINCT row_id) AS all_rows FROM r GROUP BY ALL)
     SELECT namespace, count(*) FILTER (live > 0) AS spans, count(*) FILTER (live > 1) AS violations, count(*) FILTER (all_rows > 1) AS if_all_were_live FROM s GROUP BY 1 HAVING count(*) FILTER (live > 0) > 0""",
    "as_of_snapshot": f"WITH {_R} SELECT namespace, count(*) AS rows, min(row_id) AS first_row FROM r WHERE tx_from <= timestamptz '2026-06-01 00:00:00+00' AND (tx_to IS NULL OR tx_to > timestamptz '2026-06-01 00:00:00+00') GROUP BY 1",
    "write_outcomes": _V + " SELECT namespace, source_id, stable_key, op_seq, outcome FROM k",
    "forget_effect": _V + " SELECT namespace, source_id, stable_key, prior AS record_id, op_seq AS seq_to FROM m WHERE outcome = 'forgotten'",
    "change_feed": "SELECT DISTINCT op_seq, namespace, coalesce(record_id, target_id) AS record_id, CASE WHEN kind = 'forget' THEN 'forgotten' ELSE 'created' END AS change FROM write_ops WHERE op_seq > 3000",
    "tier_clamp": """SELECT DISTINCT row_id, CASE WHEN lower(provenance.authority_tier) IN ('primary', 'corroborated')
     AND NOT coalesce(list_contains(provenance.writer.capabilities, 'verified_source'), false) THEN 'inferred' ELSE lower(provenance.authority_tier) END AS tier FROM records""",
    "foreign_writers": f"""SELECT namespace, count(DISTINCT row_id) AS rows, count(DISTINCT row_id) FILTER (namespace IS DISTINCT FROM provenance.writer.namespace) AS foreign,
     count(DISTINCT row_id) FILTER (namespace IS DISTINCT FROM '{NS}') AS others FROM records GROUP BY 1""",
    "navigate_tree": f"""WITH {_R}, o AS (SELECT row_id, record_id, section_path FROM r WHERE tx_to IS NULL AND namespace = '{NS}' AND section_path IS NOT NULL)
     SELECT array_to_string(section_path, chr(10)) AS path, len(section_path) AS depth, min(row_id) AS first_row, arg_min(record_id, row_id) AS record_id, count(*) AS records FROM o GROUP BY ALL""",
    "touched_ids": "SELECT DISTINCT namespace, record_id FROM (SELECT namespace, unnest([record_id, old_id, target_id]) AS record_id FROM write_ops WHERE op_seq > 3500) WHERE record_id IS NOT NULL",
    "view_anti_remove": f"WITH {_R}, {_VD} SELECT * FROM v WHERE row_id NOT IN (SELECT row_id FROM r WHERE tx_to IS NOT NULL)",
    "view_rederive": f"""WITH {_R}, {_VD}, t AS (SELECT DISTINCT namespace, record_id FROM r WHERE tx_from >= timestamptz '2026-06-01 00:00:00+00')
     SELECT v.* FROM v ANTI JOIN t USING (namespace, record_id) UNION ALL
     SELECT row_id, record_id, namespace, 'hash64-v3' FROM r SEMI JOIN t USING (namespace, record_id) WHERE tx_to IS NULL""",
    "view_join_live": f"WITH {_R}, {_VD} SELECT v.namespace, count(*) AS rows, count(DISTINCT source_id) AS sources FROM v JOIN r ON r.row_id = v.row_id AND r.namespace = v.namespace WHERE tx_to IS NULL GROUP BY 1",
    "producer_drift": f"WITH {_VD} SELECT * FROM v WHERE producer_version IS DISTINCT FROM 'hash64-v2'",
    "dimension_refusal": "SELECT DISTINCT row_id, len(embedding) AS dim FROM view_dense WHERE embedding IS NOT NULL AND len(embedding) <> 64",
    "view_refresh_counts": """WITH r AS (SELECT DISTINCT ON (report_id) * FROM refresh_reports WHERE status = 'succeeded'), e AS (SELECT namespace, unnest(map_entries(entries)) AS e FROM r)
     SELECT namespace, e.key AS view_name, sum(e.value)::bigint AS entries, count(*) AS runs FROM e GROUP BY ALL""",
    "contextual_text": f"WITH {_R} SELECT row_id, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' › ') || chr(10) || body_text ELSE body_text END AS text FROM r",
    "evidence_projection": f"""WITH {_R}, s AS (SELECT *, replace(body_text, chr(10), ' ') AS flat FROM r WHERE tx_to IS NULL AND namespace = '{NS}')
     SELECT record_id, row_id, coalesce(section_path[1], '') AS source_path, CASE WHEN length(flat) > 200 THEN flat[1:200] || '...' ELSE flat END AS snippet,
     0::bigint AS span_start, length(body_text) AS span_end, epoch_us(tx_from) AS freshness_us FROM s""",
    "record_hash": f"WITH {_R} SELECT row_id, sha256(body_text) AS hash FROM r",
}
