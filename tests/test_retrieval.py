"""Search operators, fusion arithmetic, filters and the planner."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import context
from quarry.context import Principal
from quarry.functions import filters
from quarry.functions import text as T
from quarry.functions import tokens
from quarry.functions.filters import Group, Leaf
from quarry.operators import fusion, retrieval
from quarry.plans import search


def docs(spark):
    rows = [
        (1, "the cat and the hat", "a", "x/one"), (2, "a cat sat", "a", "y/two"), (3, "dogs run in the morning", "a", "x/three"),
        (4, "cat cat cat", "b", "x/four"), (5, None, "a", "x/five"), (6, "", "a", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, namespace string, source string")


def test_literal_counts_repeated_terms(spark):
    got = {r.id: r.score for r in retrieval.literal(docs(spark), "cat cat", 10).collect()}
    assert got == {4: 2006.0, 1: 2002.0, 2: 2002.0}
    assert [r.id for r in retrieval.literal(docs(spark), "cat", 10).orderBy("rank").collect()] == [4, 1, 2]


@pytest.mark.parametrize("query", ["", "   ", "\0", None])
def test_blank_query_is_empty(spark, query):
    assert retrieval.literal(docs(spark), query, 10).count() == 0
    assert retrieval.lexical(docs(spark), query, 10).count() == 0


def test_lexical_needs_all_words_and_knows_or_not_phrase(spark):
    ids = lambda q: sorted(r.id for r in retrieval.lexical(docs(spark), q, 10).collect())
    assert ids("the cat") == [1]
    assert ids("hat or dogs") == [1, 3]
    assert ids("cat -sat") == [1, 4]
    assert ids('"cat sat"') == [2]
    assert ids("no-such") == []
    assert retrieval.lexical(docs(spark), "x " * 5000, 10).count() == 0


def test_words_far_into_a_text_count(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("cat "), 60_000), F.lit("zebra crossing")).alias("text"))
    last = df.select(T.words(F.col("text")).alias("w")).select(F.size("w"), F.element_at("w", -2), F.element_at("w", -1)).first()
    assert tuple(last) == (60_002, "zebra", "crossing")


def test_dense_drops_zero_and_unlike_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [0.6, 0.8]), (6, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.id, r.rank) for r in retrieval.dense(v, [1.0, 0.0], 10).orderBy("rank").collect()] == [(1, 0), (6, 1), (5, 2)]
    assert retrieval.dense(v, [], 3).count() == 0


def ranking(spark, rows):
    rows = [("p", "n", kind, pos, rec, ns, 1.0, "m") for kind, recs in rows for pos, (rec, ns) in enumerate(recs)]
    return spark.createDataFrame(rows, "plan_id string, plan_namespace string, op_kind string, pos int, record_id string, namespace string, score double, score_method string")


def order(spark, rows, weights=None):
    ranks = fusion.op_ranks(fusion.own_rows(ranking(spark, rows)))
    w = None if weights is None else spark.createDataFrame([("n", weights, 0.5)], "namespace string, fusion_weights map<string,double>, abstain_min_similarity double")
    return [r.record_id for r in fusion.fused(fusion.rrf(ranks, w)).orderBy("rank").collect()]


def own(*recs):
    return [(r, "n") for r in recs]


def test_rrf_order(spark):
    rows = [("opa", own("r1", "r2", "r3")), ("opb", own("r3", "r1"))]
    assert order(spark, rows) == ["r1", "r3", "r2"]
    assert order(spark, rows, {"opb": 3.0})[0] == "r3"
    assert order(spark, [("opa", own("r1"))] + [("rogue", [("evil", "other")])]) == ["r1"]


def test_repeat_counts_once_and_sufficiency(spark):
    ranks = fusion.op_ranks(fusion.own_rows(ranking(spark, [("dup", own("r1", "r1")), ("solo", own("r2"))])))
    result = fusion.fused(fusion.rrf(ranks))
    assert {r.record_id: r.rrf for r in result.collect()} == {"r1": round(1 / 61, 9), "r2": round(1 / 61, 9)}
    (e,) = fusion.evidence(ranks, result).collect()
    assert (e.hits, e.agreement, e.sufficiency) == (2, 0.0, 0.2715)


def test_rerank_pool(spark):
    ranks = fusion.op_ranks(fusion.own_rows(ranking(spark, [("opa", own(*[f"r{i}" for i in range(1, 8)])), ("opb", own("r7", "r6"))])))
    assert {r.record_id for r in fusion.rerank_pool(ranks, fusion.rrf(ranks), depth=2).collect()} == {"r7", "r6", "r1", "r2", "r3"}


T1 = datetime(2026, 1, 1)


@pytest.mark.parametrize(
    ("node", "want"),
    [
        (Group("or", (Group("and", (Leaf("department", "eq", "finance"), Leaf("tier", "gte", 2))), Leaf("department", "eq", "legal"))), "r1 r3 r4"),
        (Group("not", (Leaf("department", "eq", "finance"),)), "r3 r4 r5"),
        (Leaf("region", "in", ["EMEA", "APAC"]), "r1 r3 r5"),
        (Leaf("region", "not_in", ["EMEA"]), "r2 r5"),
        (Leaf("created_at", "gt", T1 - timedelta(days=30)), "r1 r3 r4"),
        (Leaf("region", "is_null"), "r4"),
        (Group("and", (Leaf("department", "eq", "hr"), Leaf("created_at", "not_in", [T1]))), ""),
        (Group("not", (Leaf("region", "eq", "EMEA"),)), "r2 r4 r5"),
    ],
)
def test_filter_algebra(spark, node, want):
    rows = [("r1", "finance", 2, "EMEA", T1 - timedelta(days=1)), ("r2", "finance", 1, "AMER", T1 - timedelta(days=400)), ("r3", "legal", 3, "EMEA", T1 - timedelta(hours=2)), ("r4", "legal", 2, None, T1), ("r5", "hr", 1, "APAC", None)]
    df = spark.createDataFrame(rows, "id string, department string, tier int, region string, created_at timestamp")
    assert " ".join(sorted(r.id for r in df.where(filters.predicate(node)).collect())) == want


def test_unknown_operators_and_empty_tenant_are_refused(spark):
    with pytest.raises(ValueError):
        filters.predicate(Leaf("a", "like", "x"))
    with pytest.raises(ValueError):
        filters.tenant(docs(spark), "")
    with pytest.raises(ValueError):
        search.compile_plan("q", "")


def test_glob(spark):
    values = ["a/b.md", "a.md", "b\nc.md", "x[1].md", ""]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    hit = lambda g: sorted(r.v for r in df.where(T.glob_match(df.v, g)).collect() if r.v is not None)
    import fnmatch

    for g in ("*", "*.md", "a?b*", "[ab]*", "[!a]*", "x[[]1*", "a.md"):
        assert hit(g) == sorted(v for v in values if fnmatch.fnmatchcase(v, g)), g


def test_plan_explain_trace_replay(spark):
    plan = search.compile_plan("cat", "a", path_glob="x/*", tokens_max=160, available=("grep", "bm25"))
    assert plan.limit == 2 and "source_filter" in plan.explain() and plan.explain().startswith("1. acl_filter")
    result = search.execute(plan, search.Frames(docs(spark)))
    assert [r.id for r in result.collect()] == [1]
    traces = search.trace(plan, result)
    assert [r.id for r in search.replay(traces, plan.plan_id, "a").collect()] == [1]
    assert search.load(traces, plan.plan_id, "b") is None
    stored = search.load(traces, plan.plan_id, "a")
    assert stored.diff(plan) == {} and search.recompile(stored, search.Policy(), available=("grep", "bm25")).diff(plan) == {}
    with pytest.raises(ValueError):
        search.execute(stored, search.Frames(docs(spark)))


def test_backstop_drops_foreign_and_dead_records(spark):
    df = spark.createDataFrame([(1, "cat", "a", "x", "a", True), (2, "cat", "a", "x", "b", True), (3, "cat", "a", "x", "a", False)], "doc_id long, text string, namespace string, source string, writer string, live boolean")
    plan = search.compile_plan("cat", "a", available=("grep",))
    assert [r.id for r in search.execute(plan, search.Frames(df)).collect()] == [1]

    class Open:
        def search(self, query, k, namespace):
            return spark.createDataFrame([("bm25", i, 1.0, i - 1) for i in (1, 2, 3, 4)] + [("bm25", 1, 0.5, 9)], "op_kind string, id long, score double, rank long")

    plan = search.compile_plan("cat", "a", available=("bm25",))
    assert [(r.id, r.ops) for r in search.execute(plan, search.Frames(df, index=Open())).collect()] == [(1, 1)]


def test_rerank_step_orders_the_pool(spark):
    plan = search.compile_plan("cat hat", "a", available=("grep",), reranker="overlap")
    assert "rerank" in plan.explain() and plan.cost_by_stage() == {"search:grep": 5, "rerank": 0}
    rows = search.execute(plan, search.Frames(docs(spark), scorer=lambda q, t: [-len(x) for x in t])).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1] and rows[0].sufficiency > 0


def test_floor_and_failure_traces(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0])], "doc_id long, namespace string, embedding array<float>")
    plan = search.compile_plan("cat", "a", policy=search.select_policy("a", {"a": {"floor": 0.9, "weights": {"grep": 2.0}}}))
    assert "fusion_weight=2.0" in plan.explain() and search.select_policy("b", {"a": {"floor": 0.9}}).floor == 0.44
    assert search.execute(plan, search.Frames(docs(spark), v, [1.0, 0.1])).count() == 2
    assert search.execute(plan, search.Frames(docs(spark), v, [1.0, 1.0])).count() == 0
    kept = []
    rows = search.run(plan, search.Frames(docs(spark), v, [1.0, 0.1]), kept.append)
    assert [r.id for r in rows] == [r.id for r in search.replay(kept[0], plan.plan_id, "a").orderBy("rank").collect()]
    with pytest.raises(ValueError):
        search.run(search.compile_plan("cat", "a", available=("ann",)), search.Frames(docs(spark)), kept.append)
    assert kept[1].first().status == "error" and "no operator" in kept[1].first().error


def test_tokens_open_only_their_namespace(spark):
    me, other, frames = Principal("p", "a"), Principal("q", "b"), search.Frames(docs(spark))
    t = search.issue(me, "pl_1", 2, b"k")
    assert [r.text for r in search.fetch(t, me, frames, b"k").collect()] == ["a cat sat"]
    assert search.fetch(t, other, frames, b"k").count() == 0 == search.fetch("junk", me, frames, b"k").count()
    assert search.feedback(t, True, other, spark, b"k") is None and search.feedback(t, True, me, spark, b"k").first().record_id == "2"
    with pytest.raises(PermissionError):
        context.current()
    with context.bound(me):
        assert context.current() is me


def test_glob_is_not_pushed_below_the_operators_limit(spark):
    plan = search.compile_plan("cat", "a", path_glob="x/*", available=("grep",))
    text = search.execute(plan, search.Frames(docs(spark)))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text


def test_abstains_without_dense_signal(spark):
    c = spark.createDataFrame([("p", "n", "ann", 0, "r", "n", 0.4, "cosine"), ("q", "n", "grep", 0, "r", "n", 5.0, "grep"), ("s", "n", "ann", 0, "r", "n", 0.9, "cosine")], ranking(spark, []).schema)
    w = spark.createDataFrame([("n", None, 0.63)], "namespace string, fusion_weights map<string,double>, abstain_min_similarity double")
    assert {r.plan_id: r.abstain for r in fusion.abstains(c, w).collect()} == {"p": True, "q": True, "s": False}


def test_tokens():
    t = tokens.issue({"id": "r1"}, b"k")
    assert tokens.verify(t, b"k") == {"id": "r1"} and tokens.verify(t, b"other") is None and tokens.verify("junk", b"k") is None
