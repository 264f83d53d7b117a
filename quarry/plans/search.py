"""The search planner: a request becomes an explicit plan, the plan one lazy DataFrame.

A plan is made before anything runs, can be explained and diffed, and its
trace can be stored, loaded and replayed.  The namespace is part of the plan
and every frame is filtered by it before the operators run; what they return
is checked again against the record store itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.context import Principal
from quarry.functions import filters, tokens
from quarry.functions import text as T
from quarry.operators import fusion, rerank, retrieval

#: Estimated milliseconds of each operator, and tokens of budget a result takes.
COST = {"grep": 5, "bm25": 10, "ann": 25}
TOKENS_PER_HIT, DEFAULT_LIMIT, CANDIDATES = 80, 50, 50
#: First records of each operator that join the rerank pool, and characters of a failure that a trace keeps.
OWN, MESSAGE = 3, 500


@dataclass(frozen=True)
class Policy:
    """How operators are weighted and when the answer is withheld."""

    weights: dict[str, float] = field(default_factory=lambda: {"grep": 1.0, "bm25": 1.0, "ann": 1.0})
    rerank_depth: int = 16
    floor: float | None = 0.44


def select_policy(namespace: str, overrides: dict[str, dict] | None = None, declared: Policy | None = None) -> Policy:
    """The policy of a namespace: the declared one with what was promoted for it."""
    declared, own = declared or Policy(), (overrides or {}).get(namespace, {})
    return Policy({**declared.weights, **own.get("weights", {})}, own.get("rerank_depth", declared.rerank_depth), own.get("floor", declared.floor))


@dataclass(frozen=True)
class Step:
    name: str
    params: dict
    fails_closed: bool = False


@dataclass(frozen=True)
class Plan:
    """``bound`` is false for a plan that was read from a trace: it can be looked at, not run."""

    plan_id: str
    namespace: str
    query: str
    limit: int
    steps: tuple[Step, ...]
    bound: bool = True

    def explain(self) -> str:
        return "\n".join(
            f"{i + 1}. {s.name}{{{', '.join(f'{k}={v}' for k, v in sorted(s.params.items()))}}}{' [fails closed]' if s.fails_closed else ''}"
            for i, s in enumerate(self.steps)
        )

    def cost_ms(self) -> int:
        return sum(self.cost_by_stage().values())

    def cost_by_stage(self) -> dict[str, int]:
        """Declared milliseconds per stage; reranking is local and declared as none."""
        out = {f"search:{s.params['operator']}": COST[s.params["operator"]] for s in self.steps if s.name == "search"}
        return out | {s.name: 0 for s in self.steps if s.name == "rerank"}

    def step(self, name: str) -> Step | None:
        return next((s for s in self.steps if s.name == name), None)

    def diff(self, other: Plan) -> dict[str, tuple]:
        """What differs, but for id and time."""
        out = {k: (getattr(self, k), getattr(other, k)) for k in ("namespace", "query", "limit") if getattr(self, k) != getattr(other, k)}
        if self.steps != other.steps:
            out["steps"] = ([asdict(s) for s in self.steps], [asdict(s) for s in other.steps])
        return out


@dataclass
class Frames:
    """What a plan runs on.

    ``documents`` is the record store: doc_id, text, namespace and source, and
    if it has them writer (the namespace of the writer) and live.  ``vectors``
    has doc_id, namespace and embedding, and ``query_vector`` is the embedded
    query.  ``index`` searches postings; without one texts are scanned.
    """

    documents: DataFrame
    vectors: DataFrame | None = None
    query_vector: list[float] | None = None
    index: object | None = None
    scorer: rerank.Scorer = rerank.overlap_scorer


def limit_of(tokens_max: int | None) -> int:
    return max(1, tokens_max // TOKENS_PER_HIT) if tokens_max else DEFAULT_LIMIT


def compile_plan(
    query: str, namespace: str, *, path_glob: str | None = None, tokens_max: int | None = 4000, available=("grep", "bm25", "ann"),
    policy: Policy | None = None, reranker: str | None = None, now: datetime | None = None,
) -> Plan:
    """The plan of a request; an empty namespace is refused here, before anything could run."""
    if not namespace:
        raise ValueError("a namespace is required")
    policy, now = policy or Policy(), now or datetime.now(timezone.utc)
    steps = [Step("acl_filter", {"namespace": namespace}, True)]
    steps += [Step("search", {"operator": k, "query": query, "k": CANDIDATES, "fusion_weight": policy.weights.get(k, 1.0)}) for k in ("grep", "bm25", "ann") if k in available]
    if path_glob:
        steps.append(Step("source_filter", {"path_glob": path_glob}))
    if reranker and policy.rerank_depth > 0:
        steps.append(Step("rerank", {"reranker": reranker, "depth": policy.rerank_depth}))
    if policy.floor is not None and "ann" in available:
        steps.append(Step("abstain_check", {"min_dense_similarity": policy.floor}, True))
    steps.append(Step("sufficiency_check", {"method": "coverage-strength-agreement"}))
    digest = hashlib.sha256("\0".join([query, "", namespace, now.isoformat()]).encode()).hexdigest()
    return Plan(f"pl_{digest[:20]}", namespace, query, limit_of(tokens_max), tuple(steps))


def _store(frames: Frames) -> DataFrame:
    """(id, source, text, owner, live) of the whole store, whatever the namespace: what the backstop looks at."""
    docs = frames.documents
    writer = F.col("writer") if "writer" in docs.columns else F.col("namespace")
    live = F.col("live") if "live" in docs.columns else F.lit(True)
    return docs.select(F.col("doc_id").alias("id"), "source", "text", writer.alias("owner"), live.alias("live"))


def candidates(plan: Plan, frames: Frames) -> DataFrame:
    """(op_kind, id, score, rank) of all operators, after the backstop: a record whose writer isn't the caller, or that isn't live, is dropped.

    The backstop joins the store, not the filtered frame that an operator was
    given, so an operator that returns what it should not is caught.  A record
    counts once per operator, at its first rank, and ranks are made compact.
    """
    if not plan.bound:
        raise ValueError("a plan from a trace can't be run; compile it again")
    own = filters.tenant(frames.documents, plan.namespace)
    if "live" in own.columns:
        own = own.where("live")
    branches = []
    for s in (s for s in plan.steps if s.name == "search"):
        kind, q, k = s.params["operator"], s.params["query"], s.params["k"]
        if kind == "ann":
            if frames.vectors is not None and frames.query_vector:
                # The view is joined with what is live, so a stale row of the view finds nothing.
                view = filters.tenant(frames.vectors, plan.namespace).join(own.select("doc_id"), "doc_id", "left_semi")
                branches.append(retrieval.dense(view, frames.query_vector, k, key="doc_id"))
        elif kind == "bm25" and frames.index is not None:
            branches.append(frames.index.search(q, k, plan.namespace))
        else:
            branches.append((retrieval.literal if kind == "grep" else retrieval.lexical)(own, q, k))
    if not branches:
        raise ValueError("the plan has no operator to run")
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    # At most k rows an operator are joined.
    kept = F.broadcast(rows).join(_store(frames).where((F.col("owner") == plan.namespace) & F.col("live")).select("id"), "id")
    once = kept.groupBy("op_kind", "id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    compact = F.row_number().over(Window.partitionBy("op_kind").orderBy("rank", "id")) - 1
    return once.withColumn("rank", compact.cast("long"))


def execute(plan: Plan, frames: Frames) -> DataFrame:
    """(id, rrf, ops, rank, score, sufficiency): one lazy DataFrame of all steps of the plan.

    The glob is applied after fusion and before the limit.  With a rerank step
    the result is the reranked pool, which may be longer than the limit, and
    ``score`` is the reranker's; else it is the fused score.  Below the floor,
    or without a dense signal, nothing is returned.
    """
    rows, docs = candidates(plan, frames), _store(frames)
    w = F.lit(1.0)
    for s in (s for s in plan.steps if s.name == "search"):
        w = F.when(F.col("op_kind") == s.params["operator"], F.lit(float(s.params["fusion_weight"]))).otherwise(w)
    fused = rows.groupBy("id").agg(F.round(F.sum(w / (61 + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("ops"), F.min("rank").alias("best"))
    if glob := plan.step("source_filter"):
        sources = docs.where((F.col("owner") == plan.namespace) & F.col("live")).select("id", "source")
        fused = F.broadcast(fused).join(sources, "id").where(T.glob_match(F.col("source"), glob.params["path_glob"])).drop("source")
    # A few rows from here on: at most k for each operator.
    placed = fused.withColumn("place", F.row_number().over(Window.orderBy(F.col("rrf").desc(), "id")).cast("long"))
    top = placed.where(F.col("place") <= plan.limit)
    one = F.lit(1).alias("one")
    kinds = rows.agg(F.countDistinct("op_kind").alias("ran")).select("*", one)
    agreed = top.agg(F.avg(F.when(F.col("ops") >= 2, 1.0).otherwise(0.0)).alias("agree")).select("*", one)
    if step := plan.step("rerank"):
        pool = placed.where((F.col("place") <= F.least(F.lit(step.params["depth"]), F.lit(plan.limit))) | (F.col("best") < OWN))
        texts = F.broadcast(pool).join(docs.where((F.col("owner") == plan.namespace) & F.col("live")).select("id", "text"), "id")
        asked = texts.select(F.lit(plan.plan_id).alias("plan_id"), F.col("id").cast("string").alias("record_id"), F.lit(plan.query).alias("query"), "text")
        scored = rerank.rerank(asked, frames.scorer).select("record_id", F.round("score", 9).alias("score"))
        result = pool.withColumn("record_id", F.col("id").cast("string")).join(scored, "record_id").drop("record_id", "place")
        result = result.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))).cast("long"))
    else:
        result = top.withColumnRenamed("place", "rank").withColumn("score", F.col("rrf"))
    if floor := plan.step("abstain_check"):
        best = rows.where("op_kind = 'ann'").agg(F.max("score").alias("dense")).select("*", one)
        shown = F.coalesce(F.col("dense") >= floor.params["min_dense_similarity"], F.lit(False))
        result = result.withColumn("one", F.lit(1)).join(F.broadcast(best), "one").where(shown).drop("dense", "one")
    whole = Window.partitionBy()
    told = result.withColumn("one", F.lit(1)).join(F.broadcast(kinds), "one").join(F.broadcast(agreed), "one")
    agreement = F.when(F.col("ran") >= 2, F.col("agree"))
    told = told.withColumn("sufficiency", fusion.sufficiency(F.count("*").over(whole), F.max("score").over(whole), agreement))
    return told.select("id", "rrf", "ops", "rank", "score", "sufficiency")


def hits(result: DataFrame, frames: Frames, plan: Plan) -> DataFrame:
    """(rank, id, source_path, snippet, span_start, span_end, sufficiency, status) of a result, joined with the records it names."""
    own = _store(frames).where((F.col("owner") == plan.namespace) & F.col("live"))
    joined = F.broadcast(result).join(own, "id")
    return joined.select(
        "rank", "id", F.coalesce("source", F.lit("")).alias("source_path"), T.snippet(F.col("text")).alias("snippet"), F.lit(0).cast("long").alias("span_start"),
        F.length("text").cast("long").alias("span_end"), "sufficiency", F.when(F.col("sufficiency") > 0, "sufficient").otherwise("insufficient_evidence").alias("status"),
    )


def _as_json(plan: Plan) -> str:
    return json.dumps({"plan_id": plan.plan_id, "namespace": plan.namespace, "query": plan.query, "limit": plan.limit, "steps": [asdict(s) for s in plan.steps]})


def trace(plan: Plan, result: DataFrame) -> DataFrame:
    """One row with the plan as JSON and what it returned; append it to a folder to keep it."""
    found = result.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "rrf", "ops"))).alias("hits"))
    return found.select(
        F.lit(plan.plan_id).alias("plan_id"), F.lit(plan.namespace).alias("namespace"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(_as_json(plan)).alias("plan"), "hits"
    )


def run(plan: Plan, frames: Frames, keep: Callable[[DataFrame], None]) -> list:
    """The rows of a plan, with a trace kept of it; if it fails, the trace has the error, which goes on to the caller."""
    spark = frames.documents.sparkSession
    schema = "plan_id string, namespace string, status string, error string, plan string, hits array<struct<rank:long,id:long,rrf:double,ops:long>>"
    row = (plan.plan_id, plan.namespace)
    try:
        rows = execute(plan, frames).orderBy("rank").collect()
    except Exception as failed:
        keep(spark.createDataFrame([(*row, "error", f"{type(failed).__name__}: {failed}"[:MESSAGE], _as_json(plan), [])], schema))
        raise
    keep(spark.createDataFrame([(*row, "ok", None, _as_json(plan), [(r.rank, r.id, r.rrf, r.ops) for r in rows])], schema))
    return rows


def load(traces: DataFrame, plan_id: str, namespace: str) -> Plan | None:
    """The first plan stored under an id, not to be run; a foreign namespace gets the same answer as an unknown id."""
    row = traces.where((F.col("plan_id") == plan_id) & (F.col("namespace") == namespace)).select("plan").first()
    if row is None:
        return None
    p = json.loads(row[0])
    return Plan(p["plan_id"], p["namespace"], p["query"], p["limit"], tuple(Step(**s) for s in p["steps"]), bound=False)


def replay(traces: DataFrame, plan_id: str, namespace: str) -> DataFrame:
    """What a stored plan returned, verbatim, without running it."""
    own = traces.where((F.col("plan_id") == plan_id) & (F.col("namespace") == namespace)).limit(1)
    return own.select(F.inline("hits"))


def recompile(stored: Plan, policy: Policy, *, available=("grep", "bm25", "ann"), reranker: str | None = None) -> Plan:
    """The stored request under the policy of today: query, glob, namespace and limit as they were."""
    glob = stored.step("source_filter")
    return compile_plan(
        stored.query, stored.namespace, path_glob=glob.params["path_glob"] if glob else None, tokens_max=stored.limit * TOKENS_PER_HIT, available=available, policy=policy, reranker=reranker
    )


def issue(principal: Principal, plan_id: str, record_id, key: bytes) -> str:
    """An opaque token of a hit, for ``fetch`` and feedback."""
    return tokens.issue({"namespace": principal.namespace, "plan_id": plan_id, "record": str(record_id)}, key)


def fetch(token: str, principal: Principal, frames: Frames, key: bytes) -> DataFrame:
    """(id, source, text) of the live record of a hit; an unknown token and one of another namespace both find nothing."""
    found = tokens.verify(token, key)
    own = _store(frames).where((F.col("owner") == principal.namespace) & F.col("live"))
    if found is None or found["namespace"] != principal.namespace:
        return own.where(F.lit(False)).select("id", "source", "text")
    return own.where(F.col("id").cast("string") == found["record"]).select("id", "source", "text")


def feedback(token: str, useful: bool, principal: Principal, spark, key: bytes) -> DataFrame | None:
    """One judgment row to append, or None for a token that isn't the principal's."""
    found = tokens.verify(token, key)
    if found is None or found["namespace"] != principal.namespace:
        return None
    row = (found["plan_id"], found["namespace"], found["record"], useful, principal.id)
    return spark.createDataFrame([row], "plan_id string, namespace string, record_id string, useful boolean, principal_id string")
