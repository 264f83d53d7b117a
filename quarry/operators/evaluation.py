"""Offline evaluation: reciprocal rank, nDCG, recall, gates, splits and weight calibration."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.normalise import normalised
from quarry.functions.text import fifth
from quarry.session import stage

#: The weights tried for each operator, the floors tried, and the policy in force where none was promoted.
WEIGHTS, FLOORS = (0.5, 1.0, 2.0), (0.35, 0.44, 0.55)
DECLARED = {"grep": 1.0, "bm25": 1.0, "ann": 1.0, "floor": 0.44}
#: Judged plans that a namespace needs before it is tuned.
LEAST = 8


def judgments(candidates: DataFrame) -> DataFrame:
    """(plan_id, record_id, useful): the reranker's verdict serves as judgment, positive scores as useful."""
    good = candidates.where((F.col("op_kind") == "rerank") & (F.col("namespace") == F.col("plan_namespace")) & F.col("score").isNotNull() & ~F.isnan("score"))
    return good.groupBy("plan_id", "record_id").agg((F.max("score") > 0).cast("int").alias("useful"))


def mrr(ranks: DataFrame, judged: DataFrame, by: list[str]) -> DataFrame:
    """Mean reciprocal rank of the first useful record; a ranking without one counts 0."""
    hit = ranks.join(judged, ["plan_id", "record_id"], "left").withColumn("r", F.when(F.col("useful") == 1, F.col("rank0") + 1))
    per = hit.groupBy(*by, "plan_id").agg(F.min("r").alias("r"))
    return per.groupBy(*by).agg(F.count("*").alias("plans"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def ndcg(ranks: DataFrame, judged: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Linear gain, log2 discount, against the ideal order of all judgments; plans without a useful record are left out."""
    ideal_rank = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("useful").desc(), "record_id"))
    ideal = judged.withColumn("i", ideal_rank).where(F.col("i") <= k).groupBy("plan_id").agg(F.sum(F.col("useful") / F.log2(F.col("i") + 1)).alias("ideal"))
    gain = ranks.where(F.col("rank0") < k).join(judged, ["plan_id", "record_id"], "left")
    got = gain.groupBy(*by, "plan_id").agg(F.sum(F.coalesce("useful", F.lit(0)) / F.log2(F.col("rank0") + 2)).alias("dcg"))
    both = got.join(ideal.where(F.col("ideal") > 0), "plan_id")
    return both.groupBy(*by).agg(F.count("*").alias("plans"), F.round(F.avg(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"))


def recall_any(ranks: DataFrame, judged: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The share of rankings with a useful record among the first k."""
    hit = ranks.where(F.col("rank0") < k).join(judged, ["plan_id", "record_id"], "left")
    per = hit.groupBy(*by, "plan_id").agg(F.max(F.coalesce("useful", F.lit(0))).alias("hit"))
    return per.groupBy(*by).agg(F.count("*").alias("plans"), F.round(F.avg("hit"), 6).alias("recall"))


def split(df: DataFrame, key: str) -> DataFrame:
    """Adds ``fold``: holdout for a fifth of the keys, by their hash."""
    return df.withColumn("bucket", fifth(F.col(key))).withColumn("fold", F.when(F.col("bucket") == 0, "holdout").otherwise("train"))


def grid(spark) -> DataFrame:
    """All settings of three weights and a floor; 81 rows, whatever the data."""
    rows = [(i, *w) for i, w in enumerate(product(WEIGHTS, WEIGHTS, WEIGHTS, FLOORS))]
    return spark.createDataFrame(rows, "setting int, grep double, bm25 double, ann double, floor double")


def reciprocal_ranks(ranks: DataFrame, judged: DataFrame, dense: DataFrame) -> DataFrame:
    """(plan_id, ns, setting, rr) of every judged plan under every setting of the grid, in one job.

    Operator ranks are taken once and weighed by each setting.  ``dense`` has
    the best cosine of a plan (plan_id, best); a plan whose best is missing or
    below a setting's floor is withheld, and counts 0.  Only plans with a
    useful record tell settings apart.
    """
    settings = grid(ranks.sparkSession)
    wide = ranks.where(F.col("op_kind").isin("grep", "bm25", "ann")).groupBy("plan_id", "ns", "record_id").agg(
        *[F.max(F.when(F.col("op_kind") == k, 1 / (61.0 + F.col("rank0")))).alias(f"r_{k}") for k in ("grep", "bm25", "ann")]
    )
    useful = judged.where("useful = 1").select("plan_id", "record_id").distinct().withColumn("useful", F.lit(1))
    wide = wide.join(useful.select("plan_id").distinct(), "plan_id", "left_semi").join(useful, ["plan_id", "record_id"], "left").join(dense, "plan_id", "left")
    # The floor doesn't change the order, so each weighting is ranked once and compared with every floor.
    weights = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("grep", "bm25", "ann"), w)]) for w in product(WEIGHTS, repeat=3)])
    joined = wide.select("*", F.inline(weights))
    score = F.round(sum((F.coalesce(f"r_{k}", F.lit(0.0)) * F.col(k) for k in ("bm25", "ann")), F.coalesce("r_grep", F.lit(0.0)) * F.col("grep")), 12)
    w = Window.partitionBy("plan_id", "grep", "bm25", "ann").orderBy(F.col("score").desc(), "record_id")
    ranked = joined.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    per = ranked.groupBy("plan_id", "ns", "grep", "bm25", "ann").agg(F.min(F.when(F.col("useful") == 1, F.col("rank"))).alias("r"), F.max("best").alias("best"))
    each = per.join(F.broadcast(settings), ["grep", "bm25", "ann"])
    shown = F.coalesce(F.col("best") >= F.col("floor"), F.lit(False)) & F.col("r").isNotNull()
    return each.select("plan_id", "ns", "setting", "grep", "bm25", "ann", "floor", F.when(shown, 1 / F.col("r")).otherwise(F.lit(0.0)).alias("rr"))


def calibration(ranks: DataFrame, judged: DataFrame, dense: DataFrame) -> DataFrame:
    """(setting, weights, floor, plans, mrr): the mean over all judged plans of every setting."""
    rr = reciprocal_ranks(ranks, judged, dense)
    return rr.groupBy("setting", "grep", "bm25", "ann", "floor").agg(F.count("*").alias("plans"), F.round(F.avg("rr"), 6).alias("mrr"))


def calibrated(ranks: DataFrame, judged: DataFrame, dense: DataFrame, least: int = LEAST) -> DataFrame:
    """(ns, plans, setting, weights, floor, train_mrr, holdout_mrr, declared_mrr, promoted): the best setting of every namespace.

    Four fifths of a namespace's judged plans, by hash, choose the setting
    (ties to the lowest number); the rest are held out, or the plan of highest
    id where none is.  It is promoted only with ``least`` judged plans, and if
    it is strictly better on the holdout than the declared policy.
    """
    rr = split(reciprocal_ranks(ranks, judged, dense), "plan_id")
    plans = rr.select("ns", "plan_id", "fold").distinct()
    held = plans.groupBy("ns").agg(F.count("*").alias("plans"), F.max((F.col("fold") == "holdout").cast("int")).alias("any"), F.max("plan_id").alias("last"))
    rr = rr.join(held, "ns").withColumn("fold", F.when((F.col("any") == 0) & (F.col("plan_id") == F.col("last")), "holdout").otherwise(F.col("fold")))
    mean = lambda fold: F.round(F.avg(F.when(F.col("fold") == fold, F.col("rr"))), 6)
    per = rr.groupBy("ns", "plans", "setting", "grep", "bm25", "ann", "floor").agg(mean("train").alias("train_mrr"), mean("holdout").alias("holdout_mrr"))
    declared = per.where(" and ".join(f"{k} = {v}" for k, v in DECLARED.items())).select("ns", F.col("holdout_mrr").alias("declared_mrr"))
    first = F.row_number().over(Window.partitionBy("ns").orderBy(F.coalesce("train_mrr", F.lit(-1.0)).desc(), "setting"))
    best = per.withColumn("n", first).where("n = 1").drop("n").join(declared, "ns")
    promoted = (F.col("plans") >= least) & F.coalesce(F.col("holdout_mrr") > F.col("declared_mrr"), F.lit(False))
    return best.withColumn("promoted", promoted)


def top_five(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, passed): whether the first five passages of a question hold what it asks for.

    ``questions`` has question, kind (single or conflict) and groups, an array
    per value of alternatives, each an array of terms; a group is held by one
    passage that has all its terms at word edges, after normalisation.  A
    question of kind conflict needs a group of both values.
    """
    n = F.row_number().over(Window.partitionBy("question").orderBy("rank"))
    first = passages.withColumn("__n", n).where("__n <= 5").select("question", normalised(F.col("text")).alias("text"))
    terms = questions.select("question", "kind", F.posexplode("groups").alias("value", "alternatives"))
    terms = terms.select("question", "kind", "value", F.posexplode("alternatives").alias("alternative", "terms")).select("*", F.explode("terms").alias("term")).drop("terms")
    terms = terms.withColumn("term", normalised(F.col("term")))
    # An edge is asked for only where the term has a word character at it.
    quoted = F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E"))
    left = F.when(F.col("term").rlike(r"^[\p{L}\p{N}_]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    right = F.when(F.col("term").rlike(r"[\p{L}\p{N}_]$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    terms = terms.withColumn("pattern", F.concat(left, quoted, right))
    numbered = first.withColumn("passage", F.monotonically_increasing_id())
    met = terms.join(stage(numbered, "passages"), "question", "left").withColumn("hit", F.coalesce(F.expr("text rlike pattern"), F.lit(False)))
    groups = met.groupBy("question", "kind", "value", "alternative", "passage").agg(F.bool_and("hit").alias("hit"))
    values = groups.groupBy("question", "kind", "value").agg(F.bool_or("hit").alias("hit"))
    return values.groupBy("question").agg(F.bool_and("hit").alias("passed"))


def gate(cases: DataFrame, hits: DataFrame, floor: float = 0.5) -> DataFrame:
    """(case_id, passed): all expected substrings stand in the hits and sufficiency reaches the floor; a case that expects nothing must have no hit.

    ``cases`` has case_id and expected (array); ``hits`` has case_id, text and sufficiency.
    """
    asked = cases.select("case_id", F.explode_outer("expected").alias("term"))
    # A term may stand in any hit; texts are looked at one by one and never put together.
    met = asked.join(hits.select("case_id", "text", "sufficiency"), "case_id", "left").withColumn("hit", F.coalesce(F.contains("text", "term"), F.lit(False)))
    terms = met.groupBy("case_id", "term").agg(F.bool_or("hit").alias("hit"), F.max("sufficiency").alias("sufficiency"), F.count("text").alias("hits"))
    found = terms.groupBy("case_id").agg(F.bool_and("hit").alias("found"), F.max("sufficiency").alias("sufficiency"), F.max("hits").alias("hits"), F.count("term").alias("terms"))
    passed = F.when(F.col("terms") == 0, F.col("hits") == 0).otherwise(F.col("found") & F.coalesce(F.col("sufficiency") >= floor, F.lit(False)))
    return found.select("case_id", passed.alias("passed"))


def formats_report(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(fmt, cases, ingested, retrieved, passed) per format: a case passes if its file was read and its fact is found.

    ``cases`` has fmt, filename, query and expect; ``hits`` has filename and
    text, null where the file could not be read.
    """
    joined = cases.join(hits, "filename", "left").groupBy("fmt", "filename", "query").agg(
        F.max(F.col("text").isNotNull().cast("int")).alias("read"), F.max(F.coalesce(F.contains("text", "expect"), F.lit(False)).cast("int")).alias("found")
    )
    return joined.groupBy("fmt").agg(F.count("*").alias("cases"), F.sum("read").alias("ingested"), F.sum("found").alias("retrieved"), F.bool_and(F.col("found") == 1).alias("passed"))


def id_sets(got: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(id, side): ids that only one of two frames has, as ``extra`` or ``missing``."""
    g, w = got.select(F.col(key).alias("id")).distinct(), want.select(F.col(key).alias("id")).distinct()
    return g.join(w, "id", "left_anti").withColumn("side", F.lit("extra")).unionByName(w.join(g, "id", "left_anti").withColumn("side", F.lit("missing")))


def score_violations(scores: DataFrame) -> DataFrame:
    """Adjacent rows, by position, whose score rises: an operator's scores must not."""
    w = Window.partitionBy("plan_id", "op_kind").orderBy("pos", "record_id")
    return scores.withColumn("before", F.lag("score").over(w)).where(F.col("score") > F.col("before"))


def repeated(scores: DataFrame) -> DataFrame:
    """Records that one operator returned at more than one position of a plan."""
    n = scores.select("plan_id", "op_kind", "record_id", "pos").distinct().groupBy("plan_id", "op_kind", "record_id").agg(F.count("*").alias("times"))
    return n.where("times > 1")


def bucket(column: Column) -> Column:
    return fifth(column)
