"""Rank fusion, agreement, sufficiency, abstention and the rerank pool, over many plans at once.

Input rows are (plan_id, op_kind, pos, record_id, score, ...), already
restricted to the plan's namespace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LIMIT, POOL, OWN = 60, 50, 16, 3


def own_rows(candidates: DataFrame) -> DataFrame:
    """Rows of the plan's own namespace, each operator's records at their first position."""
    return (
        candidates.where(F.col("namespace") == F.col("plan_namespace"))
        .groupBy("plan_id", F.col("plan_namespace").alias("ns"), "op_kind", "record_id")
        .agg(F.min("pos").alias("pos"))
    )


def op_ranks(rows: DataFrame) -> DataFrame:
    """Adds ``rank0``: positions made compact after repeated records were dropped."""
    w = Window.partitionBy("plan_id", "op_kind").orderBy("pos", "record_id")
    return rows.withColumn("rank0", F.row_number().over(w) - 1)


def rrf(ranks: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(plan_id, ns, record_id, rrf, ops): weighted reciprocal rank sums; a missing weight is 1."""
    joined = ranks.withColumn("w", F.lit(1.0))
    if weights is not None:
        joined = ranks.join(weights.select(F.col("namespace").alias("ns"), "fusion_weights"), "ns", "left")
        joined = joined.withColumn("w", F.coalesce(F.element_at("fusion_weights", F.col("op_kind")), F.lit(1.0)))
    return joined.groupBy("plan_id", "ns", "record_id").agg(
        F.round(F.sum(F.col("w") / (RRF_K + F.col("rank0") + 1)), 9).alias("rrf"), F.count("*").alias("ops")
    )


def fused(scores: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``rank`` from 1 in order of (-rrf, record_id); the first ``limit`` of each plan."""
    w = Window.partitionBy("plan_id").orderBy(F.col("rrf").desc(), F.col("record_id"))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def evidence(ranks: DataFrame, result: DataFrame) -> DataFrame:
    """(plan_id, hits, agreement, sufficiency) of each plan's fused and limited list.

    Agreement is the share of hits that two or more operators found, and null
    unless two ran.
    """
    ran = ranks.groupBy("plan_id").agg(F.countDistinct("op_kind").alias("ran"))
    per = result.groupBy("plan_id").agg(
        F.count("*").alias("hits"), F.max("rrf").alias("top"), F.avg(F.when(F.col("ops") >= 2, 1.0).otherwise(0.0)).alias("agree")
    )
    both = per.join(ran, "plan_id").withColumn("agreement", F.when(F.col("ran") >= 2, F.col("agree")))
    return both.select("plan_id", "hits", F.round("agreement", 6).alias("agreement"), sufficiency(F.col("hits"), F.col("top"), F.col("agreement")).alias("sufficiency"))


def sufficiency(n, top, agreement):
    """min(0.9, mix of coverage, strength and agreement), to 4 digits; without hits 0, a NaN agreement counts 0."""
    coverage = 1 - 1 / (1 + n)
    strength = F.when(top > 0, 1 - 1 / (1 + top)).otherwise(0.0)
    agree = F.when(F.isnan(agreement), 0.0).otherwise(agreement)
    mixed = F.when(agree.isNull(), 0.5 * coverage + 0.5 * strength).otherwise(0.4 * coverage + 0.3 * strength + 0.3 * agree)
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(0.9), mixed), 4))


def abstains(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """(plan_id, best, floor, abstain): the best in-namespace cosine against the namespace's floor.

    A null floor never abstains; a plan without a dense signal does.
    """
    good = candidates.where((F.col("namespace") == F.col("plan_namespace")))
    cos = F.when((F.col("score_method") == "cosine") & ~F.isnan("score"), F.col("score"))
    best = good.groupBy("plan_id", F.col("plan_namespace").alias("namespace")).agg(F.max(cos).alias("best"))
    floor = policies.select("namespace", F.col("abstain_min_similarity").alias("floor"))
    return best.join(floor, "namespace", "left").select(
        "plan_id", "best", "floor", F.when(F.col("floor").isNull(), False).otherwise(F.coalesce(F.col("best") < F.col("floor"), F.lit(True))).alias("abstain")
    )


def rerank_pool(ranks: DataFrame, scores: DataFrame, depth: int = POOL, own: int = OWN) -> DataFrame:
    """(plan_id, record_id): the fused top ``depth`` and each operator's first ``own``; may exceed any limit."""
    top = fused(scores, depth).select("plan_id", "record_id")
    return top.unionByName(ranks.where(F.col("rank0") < own).select("plan_id", "record_id")).distinct()
