"""Queries of the evaluation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import fusion, rerank
from quarry.session import table


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "candidate_sets")
    return fusion.op_ranks(fusion.own_rows(c)), E.judgments(c)


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.mrr(*_both(spark, d), ["op_kind"])


def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg(*_both(spark, d), 10, ["op_kind"])


def recall_any_at_10(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_any(*_both(spark, d), 10, ["op_kind"])


def _dense(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_sets").where("namespace = plan_namespace and score_method = 'cosine' and not isnan(score)")
    return c.groupBy("plan_id").agg(F.max("score").alias("best"))


def calibration_grid(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration(*_both(spark, d), _dense(spark, d))


def calibrated_policies(spark: SparkSession, d: str) -> DataFrame:
    return E.calibrated(*_both(spark, d), _dense(spark, d), least=3)


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return E.split(table(spark, d, "candidate_sets").select("plan_id").distinct(), "plan_id")


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    cases = docs.select(F.col("source").alias("case_id")).distinct().withColumn("expected", F.array(F.lit("review"), F.lit("export")))
    hits = docs.select(F.col("source").alias("case_id"), "text", F.when(F.length("text") > 50, 0.6).otherwise(0.3).alias("sufficiency"))
    return E.gate(cases, hits)


def score_violations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_sets").where("score is not null and not isnan(score)")
    return E.score_violations(c.select("plan_id", "op_kind", "pos", "record_id", "score").distinct()).select("plan_id", "op_kind", "pos", "record_id")


def repeated_results(spark: SparkSession, d: str) -> DataFrame:
    return E.repeated(table(spark, d, "candidate_sets"))


def agreement_grid(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.op_ranks(fusion.own_rows(table(spark, d, "candidate_sets")))
    first = ranks.where("rank0 < 5").groupBy("plan_id").pivot("op_kind", ["ann", "bm25", "grep", "rerank"]).agg(F.count("record_id"))
    return first.na.fill(0)


def foreign_results(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_sets").where("not (namespace <=> plan_namespace)")
    return c.select("plan_id", "op_kind", "record_id", "namespace").distinct()


def rerank_by_overlap(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.op_ranks(fusion.own_rows(table(spark, d, "candidate_sets")))
    pool = fusion.rerank_pool(ranks, fusion.rrf(ranks))
    texts = table(spark, d, "records").groupBy("record_id").agg(F.min("body_text").alias("text"))
    return rerank.rerank(pool.join(texts, "record_id").withColumn("query", F.lit("review queue archive retention"))).select("plan_id", "record_id", "rank")


def first_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_sets").select("plan_id", "op_kind", "record_id", "pos")
    return rerank.first_position(c.withColumn("q", F.concat_ws("/", "plan_id", "op_kind")), "q", "record_id").select("q", "record_id", "rank")


QUERIES = {f.__name__: f for f in (rerank_by_overlap, first_positions, mrr, ndcg_at_10, recall_any_at_10, calibration_grid, calibrated_policies, holdout_split, regression_gate, score_violations, repeated_results, agreement_grid, foreign_results)}

_B = """WITH own AS (SELECT plan_id, op_kind, record_id, min(pos) AS pos FROM candidate_sets WHERE namespace = plan_namespace GROUP BY ALL),
 ranks AS (SELECT *, row_number() OVER (PARTITION BY plan_id, op_kind ORDER BY pos, record_id) - 1 AS rank0 FROM own),
 j AS (SELECT plan_id, record_id, (max(score) > 0)::int AS useful FROM candidate_sets WHERE op_kind = 'rerank' AND namespace = plan_namespace AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""

_GRID = _B + """, jn AS (SELECT plan_id, max(plan_namespace) AS ns FROM candidate_sets WHERE namespace = plan_namespace GROUP BY 1),
 top AS (SELECT plan_id, max(score) AS best FROM candidate_sets WHERE namespace = plan_namespace AND score_method = 'cosine' AND NOT isnan(score) GROUP BY 1),
 w AS (SELECT unnest([0.5, 1.0, 2.0])::double AS w), fl AS (SELECT unnest([0.35, 0.44, 0.55])::double AS floor),
 grid AS (SELECT (row_number() OVER (ORDER BY a.w, b.w, c.w, floor) - 1)::int AS setting, a.w AS grep, b.w AS bm25, c.w AS ann, floor FROM w a, w b, w c, fl),
 x AS (SELECT plan_id, record_id, max(CASE WHEN op_kind = 'grep' THEN 1 / (61.0::double + rank0) END) AS rg, max(CASE WHEN op_kind = 'bm25' THEN 1 / (61.0::double + rank0) END) AS rb,
   max(CASE WHEN op_kind = 'ann' THEN 1 / (61.0::double + rank0) END) AS ra FROM ranks WHERE op_kind <> 'rerank' AND plan_id IN (SELECT plan_id FROM j WHERE useful = 1) GROUP BY ALL),
 s AS (SELECT grid.*, plan_id, record_id, round(coalesce(rg, 0) * grep + coalesce(rb, 0) * bm25 + coalesce(ra, 0) * ann, 12) AS score FROM x, grid),
 r AS (SELECT *, row_number() OVER (PARTITION BY setting, plan_id ORDER BY score DESC, record_id) AS rank FROM s),
 p AS (SELECT setting, grep, bm25, ann, floor, plan_id, min(CASE WHEN useful = 1 THEN rank END) AS r FROM r LEFT JOIN j USING (plan_id, record_id) GROUP BY ALL),
 rr AS (SELECT p.*, ns, CASE WHEN best >= floor AND r IS NOT NULL THEN 1.0::double / r ELSE 0 END AS rr FROM p JOIN jn USING (plan_id) LEFT JOIN top USING (plan_id))"""
_FIFTH = "list_sum(list_transform(string_split(sha256(plan_id), ''), lambda x: instr('0123456789abcdef', x) - 1))::bigint % 5"

ORACLES = {
    "mrr": _B + """, p AS (SELECT op_kind, plan_id, min(CASE WHEN useful = 1 THEN rank0 + 1 END) AS r FROM ranks LEFT JOIN j USING (plan_id, record_id) GROUP BY ALL)
     SELECT op_kind, count(*) AS plans, round(avg(coalesce(1.0::double / r, 0)), 6) AS mrr FROM p GROUP BY 1""",
    "ndcg_at_10": _B + """, i AS (SELECT plan_id, sum(useful / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY useful DESC, record_id) AS i FROM j) WHERE i <= 10 GROUP BY 1),
     g AS (SELECT op_kind, plan_id, sum(coalesce(useful, 0) / log2(rank0 + 2)) AS dcg FROM ranks LEFT JOIN j USING (plan_id, record_id) WHERE rank0 < 10 GROUP BY ALL)
     SELECT op_kind, count(*) AS plans, round(avg(dcg / ideal), 6) AS ndcg FROM g JOIN i USING (plan_id) WHERE ideal > 0 GROUP BY 1""",
    "recall_any_at_10": _B + """, p AS (SELECT op_kind, plan_id, max(coalesce(useful, 0)) AS hit FROM ranks LEFT JOIN j USING (plan_id, record_id) WHERE rank0 < 10 GROUP BY ALL)
     SELECT op_kind, count(*) AS plans, round(avg(hit), 6) AS recall FROM p GROUP BY 1""",
    "calibration_grid": _GRID + " SELECT setting, grep, bm25, ann, floor, count(*) AS plans, round(avg(rr), 6) AS mrr FROM rr GROUP BY ALL",
    "calibrated_policies": _GRID + f""", f AS (SELECT *, CASE WHEN {_FIFTH} = 0 THEN 'holdout' ELSE 'train' END AS fold0 FROM rr),
     held AS (SELECT ns, count(DISTINCT plan_id) AS plans, bool_or(fold0 = 'holdout') AS any_held, max(plan_id) AS last FROM f GROUP BY 1),
     g AS (SELECT f.*, held.plans, CASE WHEN NOT any_held AND plan_id = last THEN 'holdout' ELSE fold0 END AS fold FROM f JOIN held USING (ns)),
     per AS (SELECT ns, plans, setting, grep, bm25, ann, floor, round(avg(rr) FILTER (fold = 'train'), 6) AS train_mrr, round(avg(rr) FILTER (fold = 'holdout'), 6) AS holdout_mrr FROM g GROUP BY ALL),
     best AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY coalesce(train_mrr, -1) DESC, setting) AS n FROM per)
     SELECT best.* EXCLUDE (n), d.holdout_mrr AS declared_mrr, plans >= 3 AND coalesce(best.holdout_mrr > d.holdout_mrr, false) AS promoted
     FROM best JOIN (SELECT ns, holdout_mrr FROM per WHERE grep = 1 AND bm25 = 1 AND ann = 1 AND floor = 0.44) d USING (ns) WHERE n = 1""",
    "holdout_split": """WITH d AS (SELECT DISTINCT plan_id FROM candidate_sets), b AS (SELECT plan_id, list_sum(list_transform(string_split(sha256(plan_id), ''), lambda x: instr('0123456789abcdef', x) - 1))::bigint % 5 AS bucket FROM d)
     SELECT plan_id, bucket, CASE WHEN bucket = 0 THEN 'holdout' ELSE 'train' END AS fold FROM b""",
    "regression_gate": """WITH h AS (SELECT source AS case_id, bool_or(contains(text, 'review')) AND bool_or(contains(text, 'export')) AS found, max(CASE WHEN length(text) > 50 THEN 0.6 ELSE 0.3 END) AS s FROM documents WHERE text IS NOT NULL GROUP BY 1)
     SELECT case_id, found AND s >= 0.5 AS passed FROM h""",
    "score_violations": """WITH c AS (SELECT DISTINCT plan_id, op_kind, pos, record_id, score FROM candidate_sets WHERE score IS NOT NULL AND NOT isnan(score)),
     l AS (SELECT *, lag(score) OVER (PARTITION BY plan_id, op_kind ORDER BY pos, record_id) AS before FROM c) SELECT plan_id, op_kind, pos, record_id FROM l WHERE score > before""",
    "repeated_results": "SELECT plan_id, op_kind, record_id, count(DISTINCT pos) AS times FROM candidate_sets GROUP BY ALL HAVING count(DISTINCT pos) > 1",
    "agreement_grid": _B + """ SELECT plan_id, count(*) FILTER (op_kind = 'ann') AS ann, count(*) FILTER (op_kind = 'bm25') AS bm25, count(*) FILTER (op_kind = 'grep') AS grep, count(*) FILTER (op_kind = 'rerank') AS rerank
     FROM ranks WHERE rank0 < 5 GROUP BY 1""",
    "first_positions": """WITH f AS (SELECT plan_id || '/' || op_kind AS q, record_id, min(pos) AS pos FROM candidate_sets GROUP BY ALL)
     SELECT q, record_id, row_number() OVER (PARTITION BY q ORDER BY pos, record_id) AS rank FROM f""",
    "foreign_results": "SELECT DISTINCT plan_id, op_kind, record_id, namespace FROM candidate_sets WHERE namespace IS DISTINCT FROM plan_namespace",
}
