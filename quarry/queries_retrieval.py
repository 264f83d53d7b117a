"""Queries of the retrieval, fusion and filter operators, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.context import Principal
from quarry.functions import filters
from quarry.functions import text as T
from quarry.operators import fusion, lexical, retrieval
from quarry.plans import search as plans
from quarry.session import table

NS = "tenant:canyonstack"
QUERY = "review queue archive"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return filters.tenant(table(spark, d, "documents"), NS)


def grep_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.literal(_docs(spark, d), "the and of", 10)


def grep_duplicate_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.literal(_docs(spark, d), "queue queue review", 50)


def grep_all_tenants(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.literal(table(spark, d, "documents"), "retention schedule", 100)


def _lexical_sql(where: str, terms: list[str], k: int, tenant: bool = True) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"sum((tf{i} > 0)::int) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (N - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    ns = f"AND namespace = '{NS}'" if tenant else ""
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL {ns}),
    r AS (SELECT doc_id, len(w) AS dl, w, {tf} FROM t), s AS (SELECT count(*) AS N, avg(dl) AS avgdl, {dfs} FROM r),
    c AS (SELECT doc_id, round({score}, 6) AS score FROM r, s WHERE {where} ORDER BY 2 DESC, 1 LIMIT {k})
    SELECT 'bm25' AS op_kind, doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM c"""


def _index(spark: SparkSession, d: str, config: str = "simple") -> lexical.Index:
    return lexical.shared(table(spark, d, "documents"), f"{d}/documents", config=config)


def lexical_match_all(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(QUERY, 50, NS)


def lexical_or_not(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search("glossary or inventory -payroll", 50, NS)


def lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search('"retention schedule"', 50)


def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search("audit export", 10)


def lexical_scan(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical(_docs(spark, d), QUERY, 50)


def lexical_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "english").search("the archived queues reviewing", 50)


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    p = lexical.postings(table(spark, d, "documents"))
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"), F.min("doc_id").alias("first_doc"), F.sum(F.element_at("positions", 1)).alias("first_positions"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense(table(spark, d, "embeddings"), _query_vector(spark, d), 20)


def dense_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return retrieval.dense_by_group(e, q, 5, "label")


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "candidate_sets"), table(spark, d, "fusion_policies")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused(fusion.rrf(fusion.op_ranks(fusion.own_rows(_candidates(spark, d)[0])))).select("plan_id", "record_id", "rrf", "ops", "rank")


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    c, p = _candidates(spark, d)
    return fusion.fused(fusion.rrf(fusion.op_ranks(fusion.own_rows(c)), p)).select("plan_id", "record_id", "rrf", "ops", "rank")


def operator_ranks(spark: SparkSession, d: str) -> DataFrame:
    return fusion.op_ranks(fusion.own_rows(_candidates(spark, d)[0])).select("plan_id", "op_kind", "record_id", F.col("rank0").cast("long").alias("rank0"))


def agreement_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.op_ranks(fusion.own_rows(_candidates(spark, d)[0]))
    return fusion.evidence(ranks, fusion.fused(fusion.rrf(ranks)))


def abstain_gate(spark: SparkSession, d: str) -> DataFrame:
    return fusion.abstains(*_candidates(spark, d))


def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.op_ranks(fusion.own_rows(_candidates(spark, d)[0]))
    return fusion.rerank_pool(ranks, fusion.rrf(ranks))


def top3_per_operator(spark: SparkSession, d: str) -> DataFrame:
    return operator_ranks(spark, d).where("rank0 < 3")


def source_glob_postfilter(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    top = retrieval.literal(docs, "the", 40)
    return top.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").where(T.glob_match(F.col("source"), "*-[a-m]*")).select("id", "source", "score", "rank")


def _frames(spark: SparkSession, d: str) -> plans.Frames:
    """The record store with its dense view, the postings of its texts, and a query vector of the namespace."""
    r = table(spark, d, "records").select(
        F.col("row_id").alias("doc_id"), F.col("body_text").alias("text"), "namespace", F.coalesce(F.element_at("section_path", 1), F.lit("")).alias("source"),
        F.col("provenance.writer.namespace").alias("writer"), F.col("tx_to").isNull().alias("live"),
    ).dropDuplicates(["doc_id"])
    v = table(spark, d, "view_dense").where("size(embedding) = 64").select(F.col("row_id").alias("doc_id"), "namespace", "embedding").dropDuplicates(["doc_id"])
    good = v.where((F.col("namespace") == NS) & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()) & F.exists("embedding", lambda x: x != 0))
    q = good.orderBy("doc_id").select("embedding").first()
    index = lexical.shared(r.where("live"), f"{d}/records")
    return plans.Frames(r, v, [float(x) for x in q[0]] if q else None, index)


HYBRID = "retention approval review"


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    plan = plans.compile_plan(HYBRID, NS, tokens_max=2000)
    return plans.execute(plan, _frames(spark, d))


def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    plan = plans.compile_plan(HYBRID, NS, tokens_max=2000, reranker="overlap", policy=plans.Policy(rerank_depth=5))
    return plans.execute(plan, _frames(spark, d)).select("id", "ops", "rank", F.round("score", 6).alias("score"), "sufficiency")


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    frames, plan = _frames(spark, d), plans.compile_plan(HYBRID, NS, tokens_max=800, available=("grep",))
    return plans.hits(plans.execute(plan, frames), frames, plan)


def fetch_hit(spark: SparkSession, d: str) -> DataFrame:
    frames, me = _frames(spark, d), Principal("reader", NS)
    first = frames.documents.where((F.col("namespace") == NS) & F.col("live")).agg(F.min("doc_id")).first()[0]
    return plans.fetch(plans.issue(me, "pl_0", first, b"key"), me, frames, b"key")


def search_trace(spark: SparkSession, d: str) -> DataFrame:
    frames = _frames(spark, d)
    plan = plans.compile_plan(HYBRID, NS, tokens_max=800, available=("grep",))
    kept = []
    plans.run(plan, frames, kept.append)
    return plans.replay(kept[0], plan.plan_id, NS)


# The filter algebra on documents: lang is the nullable field.
_L, _G = filters.Leaf, filters.Group
_CUT = datetime(2026, 6, 1)
FILTERS = {
    "or_and": (_G("or", (_G("and", (_L("source", "eq", "faq-portal"), _L("n_chars", "gte", 1000))), _L("lang", "eq", "fr"))), "(source = 'faq-portal' AND n_chars >= 1000) OR lang = 'fr'"),
    "not": (_G("not", (_L("lang", "eq", "en"),)), "NOT coalesce(lang = 'en', false)"),
    "in": (_L("lang", "in", ["en", "de"]), "lang IN ('en', 'de')"),
    "not_in": (_L("lang", "not_in", ["en", "de"]), "lang IS NOT NULL AND lang NOT IN ('en', 'de')"),
    "after": (_L("observed_at", "gt", _CUT), "observed_at > timestamptz '2026-06-01 00:00:00+00'"),
    "is_null": (_L("lang", "is_null"), "lang IS NULL"),
    "and_not_in": (_G("and", (_L("source", "eq", "wiki-export"), _L("n_chars", "not_in", [0, 1]))), "source = 'wiki-export' AND n_chars IS NOT NULL AND n_chars NOT IN (0, 1)"),
}


def _filtered(node):
    return lambda spark, d: table(spark, d, "documents").where(filters.predicate(node)).select("doc_id", "lang", "source")


def tenancy_exact(spark: SparkSession, d: str) -> DataFrame:
    return filters.tenant(table(spark, d, "records"), NS).select("row_id", "record_id").distinct()


def entitlement_fresh(spark: SparkSession, d: str) -> DataFrame:
    now = datetime(2026, 12, 1)
    ok = filters.entitled("policy_id", ["document-v1"], now - timedelta(minutes=5), now, timedelta(minutes=15))
    return table(spark, d, "records").where(ok).select("row_id").distinct()


def entitlement_stale(spark: SparkSession, d: str) -> DataFrame:
    """Rows per policy, those that a fresh grant shows, and those that a stale one does."""
    now, r = datetime(2026, 12, 1), table(spark, d, "records").select("row_id", "policy_id").distinct()
    ok = lambda hours: filters.entitled("policy_id", ["document-v1"], now - timedelta(hours=hours), now, timedelta(hours=1))
    shown = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return r.groupBy("policy_id").agg(F.count("*").alias("rows"), shown(ok(0.5), "fresh"), shown(ok(6), "stale"))


QUERIES = {
    f.__name__: f
    for f in (
        grep_topk, grep_duplicate_terms, grep_all_tenants, lexical_match_all, lexical_or_not, lexical_phrase, lexical_bm25_topk, lexical_scan, lexical_stemmed, postings_stats,
        dense_cosine_topk, dense_topk_per_label, rrf_fuse, rrf_weighted, operator_ranks, agreement_sufficiency, abstain_gate, rerank_pool,
        top3_per_operator, source_glob_postfilter, hybrid_search, hybrid_reranked, search_hits, fetch_hit, search_trace, tenancy_exact, entitlement_fresh, entitlement_stale,
    )
} | {f"filter_{k}": _filtered(n) for k, (n, _) in FILTERS.items()}


def _grep_sql(terms: list[str], k: int, tenant: bool = True) -> str:
    one = [f"coalesce((length(t) - length(replace(t, '{x}', ''))) // {len(x)}, 0)" for x in terms]
    score = f"(({' + '.join(f'({o} > 0)::int' for o in one)}) * 1000 + {' + '.join(one)})::double"
    ns = f"WHERE namespace = '{NS}'" if tenant else ""
    return f"""WITH s AS (SELECT doc_id, {score} AS score FROM (SELECT doc_id, lower(text) AS t FROM documents {ns})),
    c AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k})
    SELECT 'grep' AS op_kind, doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM c"""


_LIVE = f"WITH live AS (SELECT DISTINCT ON (row_id) row_id AS doc_id, body_text AS text, namespace, coalesce(section_path[1], '') AS source FROM records WHERE tx_to IS NULL AND namespace = '{NS}' AND provenance.writer.namespace = '{NS}')"
_WORDS = HYBRID.split()
_ON_LIVE = lambda sql: sql.replace("FROM documents", "FROM live")
_HITS = _LIVE + f", g AS ({_ON_LIVE(_grep_sql(_WORDS, 50))}), h AS (SELECT id, round(1.0::double / (61 + rank), 9) AS rrf, rank + 1 AS rank FROM g WHERE rank < 10)"


_ALL = lambda n: " AND ".join(f"tf{i} > 0" for i in range(n))
_RANKS = """own AS (SELECT plan_id, plan_namespace AS ns, op_kind, record_id, min(pos) AS pos FROM candidate_sets WHERE namespace = plan_namespace GROUP BY ALL),
 ranks AS (SELECT *, row_number() OVER (PARTITION BY plan_id, op_kind ORDER BY pos, record_id) - 1 AS rank0 FROM own)"""
_RRF = f"""WITH {_RANKS}, scores AS (SELECT plan_id, record_id, round(sum({{w}} / (60 + rank0 + 1)), 9) AS rrf, count(*) AS ops FROM ranks {{j}} GROUP BY ALL),
 fused AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY rrf DESC, record_id) AS rank FROM scores)"""
_PLAIN = _RRF.format(w="1.0::double", j="")
_WEIGHED = _RRF.format(w="coalesce(element_at(f.fusion_weights, op_kind)[1], 1.0)::double", j="LEFT JOIN fusion_policies f ON f.namespace = ranks.ns")
_TWO = ["review", "queue", "archive"]

_HYBRID = _LIVE + f""", g AS ({_ON_LIVE(_grep_sql(_WORDS, 50))}), l AS ({_ON_LIVE(_lexical_sql(_ALL(3), _WORDS, 50))}),
 v AS (SELECT DISTINCT ON (row_id) row_id, embedding::double[] AS e FROM view_dense WHERE namespace = '{NS}' AND len(embedding) = 64),
 q AS (SELECT e AS q FROM v WHERE NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)) ORDER BY row_id LIMIT 1),
 c AS (SELECT row_id AS id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE row_id IN (SELECT doc_id FROM live) AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0)) ORDER BY 2 DESC, 1 LIMIT 50),
 a AS (SELECT 'ann' AS op_kind, id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM c),
 r AS (FROM g UNION ALL FROM l UNION ALL FROM a), best AS (SELECT max(score) AS dense FROM a),
 s AS (SELECT id, round(sum(1.0::double / (61 + rank)), 9) AS rrf, count(*) AS ops, min(rank) AS best FROM r GROUP BY 1),
 f AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS place FROM s), t AS (SELECT id, rrf, ops, place AS rank FROM f WHERE place <= 25),
 agreed AS (SELECT avg(CASE WHEN ops >= 2 THEN 1.0 ELSE 0.0 END)::double AS agree FROM t)"""

ORACLES = {
    "grep_topk": _grep_sql(["the", "and", "of"], 10),
    "grep_duplicate_terms": _grep_sql(["queue", "queue", "review"], 50),
    "grep_all_tenants": _grep_sql(["retention", "schedule"], 100, False),
    "lexical_match_all": _lexical_sql(_ALL(3), _TWO, 50),
    "lexical_or_not": _lexical_sql("(tf0 > 0 OR tf1 > 0) AND NOT list_contains(w, 'payroll')", ["glossary", "inventory"], 50),
    "lexical_phrase": _lexical_sql("contains(' ' || array_to_string(w, ' ') || ' ', ' retention schedule ')", ["retention", "schedule"], 50, False),
    "lexical_bm25_topk": _lexical_sql(_ALL(2), ["audit", "export"], 10, False),
    "lexical_scan": _lexical_sql(_ALL(3), _TWO, 50),
    "postings_stats": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w), p AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM e GROUP BY ALL)
     SELECT term, count(*) AS docs, sum(tf)::bigint AS total, min(doc_id) AS first_doc, sum(first)::bigint AS first_positions FROM p GROUP BY term""",
    "dense_cosine_topk": """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
     c AS (SELECT vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20)
     SELECT 'ann' AS op_kind, vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM c""",
    "dense_topk_per_label": """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1),
     s AS (SELECT e.label, vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) AS score FROM embeddings e JOIN q USING (label)),
     r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    "rrf_fuse": _PLAIN + " SELECT * FROM fused WHERE rank <= 50",
    "rrf_weighted": _WEIGHED + " SELECT * FROM fused WHERE rank <= 50",
    "operator_ranks": f"WITH {_RANKS} SELECT plan_id, op_kind, record_id, rank0 FROM ranks",
    "top3_per_operator": f"WITH {_RANKS} SELECT plan_id, op_kind, record_id, rank0 FROM ranks WHERE rank0 < 3",
    "agreement_sufficiency": _PLAIN + """, ran AS (SELECT plan_id, count(DISTINCT op_kind) AS ran FROM ranks GROUP BY 1),
     p AS (SELECT plan_id, count(*) AS hits, max(rrf) AS top, avg(CASE WHEN ops >= 2 THEN 1.0 ELSE 0.0 END) AS agree FROM fused WHERE rank <= 50 GROUP BY 1),
     a AS (SELECT *, CASE WHEN ran >= 2 THEN agree END AS agreement, 1 - 1 / (1 + hits::double) AS cov, CASE WHEN top > 0 THEN 1 - 1 / (1 + top) ELSE 0 END AS str FROM p JOIN ran USING (plan_id))
     SELECT plan_id, hits, round(agreement, 6) AS agreement, round(least(0.9, CASE WHEN agreement IS NULL THEN 0.5 * cov + 0.5 * str ELSE 0.4 * cov + 0.3 * str + 0.3 * agreement END), 4) AS sufficiency FROM a""",
    "abstain_gate": """WITH b AS (SELECT plan_id, plan_namespace AS namespace, max(CASE WHEN score_method = 'cosine' AND NOT isnan(score) THEN score END) AS best
     FROM candidate_sets WHERE namespace = plan_namespace GROUP BY ALL)
     SELECT plan_id, best, abstain_min_similarity AS floor, CASE WHEN abstain_min_similarity IS NULL THEN false ELSE coalesce(best < abstain_min_similarity, true) END AS abstain
     FROM b LEFT JOIN fusion_policies USING (namespace)""",
    "rerank_pool": _PLAIN + " SELECT plan_id, record_id FROM fused WHERE rank <= 16 UNION SELECT plan_id, record_id FROM ranks WHERE rank0 < 3",
    "source_glob_postfilter": _grep_sql(["the"], 40).replace("SELECT 'grep' AS op_kind, doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM c",
     "SELECT id, source, score, rank FROM (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM c) JOIN documents ON doc_id = id WHERE source GLOB '*-[a-m]*'"),
    "hybrid_search": _HYBRID + """ SELECT id, rrf, ops, rank, rrf AS score,
     round(least(0.9, 0.4 * (1 - 1 / (1 + count(*) OVER ()::double)) + 0.3 * (1 - 1 / (1 + max(rrf) OVER ())) + 0.3 * agree), 4) AS sufficiency FROM t, best, agreed WHERE best.dense >= 0.44""",
    "hybrid_reranked": _HYBRID + f""", pool AS (SELECT f.*, greatest(p, 1e-300) AS p FROM (SELECT f.*, len(list_intersect(list_distinct(string_split('{HYBRID}', ' ')), list_distinct(regexp_extract_all(lower(text), '[^\\s]+')))) / 3.0::double AS p
       FROM f JOIN live ON doc_id = id WHERE place <= 5 OR best < 3) f),
     z AS (SELECT *, round(1 / (1 + exp(-ln((p + 1e-6) / (1 - p + 1e-6)))), 9) AS score FROM pool)
     SELECT id, ops, row_number() OVER (ORDER BY score DESC, id) AS rank, round(score, 6) AS score,
     round(least(0.9, 0.4 * (1 - 1 / (1 + count(*) OVER ()::double)) + 0.3 * (1 - 1 / (1 + max(score) OVER ())) + 0.3 * agree), 4) AS sufficiency FROM z, best, agreed WHERE best.dense >= 0.44""",
    "search_hits": _HITS + """ SELECT rank, id, coalesce(source, '') AS source_path, CASE WHEN length(flat) > 200 THEN flat[1:200] || '...' ELSE flat END AS snippet, 0::bigint AS span_start, length(text) AS span_end,
     round(least(0.9, 0.5 * (1 - 1 / (1 + count(*) OVER ()::double)) + 0.5 * (1 - 1 / (1 + max(rrf) OVER ()))), 4) AS sufficiency, 'sufficient' AS status FROM (SELECT h.*, source, text, replace(text, chr(10), ' ') AS flat FROM h JOIN live ON doc_id = id)""",
    "search_trace": _HITS + " SELECT rank, id, rrf, 1::bigint AS ops FROM h",
    "fetch_hit": _LIVE + " SELECT doc_id AS id, source, text FROM live ORDER BY doc_id LIMIT 1",
    "tenancy_exact": f"SELECT DISTINCT row_id, record_id FROM records WHERE namespace = '{NS}'",
    "entitlement_fresh": "SELECT DISTINCT row_id FROM records WHERE policy_id = 'document-v1'",
    "entitlement_stale": "SELECT policy_id, count(*) AS rows, count(*) FILTER (policy_id = 'document-v1') AS fresh, 0::bigint AS stale FROM (SELECT DISTINCT row_id, policy_id FROM records) GROUP BY 1",
} | {f"filter_{k}": f"SELECT doc_id, lang, source FROM documents WHERE {w}" for k, (_, w) in FILTERS.items()}
