"""Reranking, conformance of operators, calibration decisions and other plan-time operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.filters import Group, Leaf, predicate

Scorer = Callable[[pd.Series, pd.Series], np.ndarray]


def overlap_scorer(query: pd.Series, text: pd.Series) -> np.ndarray:
    """A scorer without a model: the logit of the share of query words that a text has."""
    out = []
    for q, t in zip(query, text):
        words = set((q or "").lower().split())
        share = len(words & set((t or "").lower().split())) / len(words) if words else 0.0
        out.append(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return np.array(out, dtype=float)


def rerank(pool: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """(plan_id, record_id, score, rank): the pool, and only it, by the scorer's sigmoid, ties by record_id.

    ``pool`` has plan_id, record_id, query and text.  The scorer is called per
    Arrow batch, so a model is loaded once per worker.  A scorer that returns
    another number of scores than rows, or a non-finite one, raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.asarray(scorer(pdf["query"], pdf["text"]), dtype=float)
            if z.shape != (len(pdf),) or not np.isfinite(z).all():
                raise ValueError("the scorer must return one finite score per row")
            yield pd.DataFrame({"plan_id": pdf["plan_id"], "record_id": pdf["record_id"], "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))})

    scored = pool.select("plan_id", "record_id", "query", "text").mapInPandas(run, "plan_id string, record_id string, score double")
    w = Window.partitionBy("plan_id").orderBy(F.col("score").desc(), "record_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def first_position(ranking: DataFrame, query: str = "query_id", doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Each document of a ranking at its first position, positions made compact again from 1."""
    first = ranking.groupBy(query, doc).agg(F.min(pos).alias(pos))
    w = Window.partitionBy(query).orderBy(pos, doc)
    return first.withColumn("rank", F.row_number().over(w).cast("long")).drop(pos)


def uncovered(objects: DataFrame, pictures: DataFrame, share: float = 0.5) -> DataFrame:
    """Objects that no picture of their page covers by more than ``share`` of their area; both have page, x0, y0, x1, y1.

    An object without area is never covered.
    """
    p = pictures.select("page", *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    o = objects.alias("o")
    wide = F.greatest(F.lit(0.0), F.least("o.x1", "p_x1") - F.greatest("o.x0", "p_x0"))
    high = F.greatest(F.lit(0.0), F.least("o.y1", "p_y1") - F.greatest("o.y0", "p_y0"))
    area = (F.col("o.x1") - F.col("o.x0")) * (F.col("o.y1") - F.col("o.y0"))
    return o.join(p.alias("p"), (F.col("o.page") == F.col("p.page")) & (wide * high > share * area) & (area > 0), "left_anti")


def crop_box(x0, y0, x1, y1, height, width):
    """A bottom-up page box as a top-down pixel box, clamped to the page."""
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return F.struct(
        clamp(F.least(x0, x1), width).alias("left"), clamp(height - F.greatest(y0, y1), height).alias("top"),
        clamp(F.greatest(x0, x1), width).alias("right"), clamp(height - F.least(y0, y1), height).alias("bottom"),
    )


def large_enough(left, top, right, bottom, height, width, share: float = 0.015):
    """Whether a picture holds at least ``share`` of its page's area."""
    return (right - left) * (bottom - top) >= F.lit(share) * height * width


def best_reading(readings: DataFrame, script: str = "Latin", least: int = 24) -> DataFrame:
    """Per picture, of several readings the one with most letters of a script, if it has ``least`` of them; ties by engine."""
    letters = F.regexp_count("text", F.lit(rf"\p{{Is{script}}}"))
    counted = readings.withColumn("letters", letters).where(F.col("letters") >= least)
    best = counted.groupBy("picture_id").agg(F.min(F.struct((-F.col("letters")).alias("n"), "engine", "text")).alias("b"))
    return best.select("picture_id", "b.engine", "b.text")


def promote(current: float, candidate: float, judged: int, least: int = 8) -> bool:
    """Whether calibrated weights replace the declared ones: only with enough judged queries, and only if strictly better on the holdout."""
    return judged >= least and candidate > current


def useful_queries(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """(query, useful, not_useful): judged record ids per recovered query; judgments without a trace or query are left out."""
    joined = feedback.join(traces.select("plan_id", "namespace", "query").where(F.col("query").isNotNull()), ["plan_id", "namespace"])
    good, bad = (F.sort_array(F.collect_set(F.when(c, F.col("record_id")))) for c in (F.col("useful"), ~F.col("useful")))
    return joined.groupBy("namespace", "query").agg(good.alias("useful"), bad.alias("not_useful"))


def conforms(operator: Callable[[DataFrame, Leaf | Group], DataFrame], spark) -> list[str]:
    """Runs an operator on the fixed probe rows of the filter, tenancy and score rules; the names of the rules it breaks.

    An operator takes rows and a filter and returns the rows that pass, with
    their scores; it is registered only if this is empty.
    """
    rows = spark.createDataFrame(
        [("r1", "a", "EMEA", 0.2), ("r2", "a", None, 0.9), ("r3", "b", "EMEA", 0.5), ("r4", None, "APAC", 0.5)], "id string, tenant string, region string, score double"
    )
    cases = {
        "filter": (Group("not", (Leaf("region", "eq", "EMEA"),)), ["r2", "r4"]),
        "null-excludes": (Leaf("region", "not_in", ["EMEA"]), ["r4"]),
        "tenancy": (Leaf("tenant", "in", ["a"]), ["r1", "r2"]),
        "unevaluable": (Leaf("tenant", "ne", "a"), ["r3"]),
    }
    broken = []
    for name, (node, want) in cases.items():
        got = operator(rows, node).select("id", "score").collect()
        if sorted(r.id for r in got) != want:
            broken.append(name)
        if any(r.score is None or not np.isfinite(r.score) for r in got):
            broken.append(f"{name}: score")
        if [r.score for r in got] != sorted((r.score for r in got), reverse=True):
            broken.append(f"{name}: order")
    return broken


def reference_operator(rows: DataFrame, node: Leaf | Group) -> DataFrame:
    """The plainest conforming operator: filter, then order by score."""
    return rows.where(predicate(node)).orderBy(F.col("score").desc(), "id")
