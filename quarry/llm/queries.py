"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import fusing, mixing, near_duplicates, neighbours, scans, splitting, tokens, truncation
from quarry.session import stage, table


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "parsed_sections"), table(spark, sf_dir, "doc_inputs"), table(spark, sf_dir, "chunk_limits")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(*_items(spark, sf_dir))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(splitting.limited(*_items(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusing.winners(table(spark, sf_dir, "candidate_sets"), table(spark, sf_dir, "fusion_policies"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusing.ranking(table(spark, sf_dir, "candidate_sets"), table(spark, sf_dir, "fusion_policies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_rows(table(spark, sf_dir, "records").select("row_id", "source_id", "body_text"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "records").select("row_id", "body_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "view_dense"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "view_dense")).select("id", "other", "position")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(table(spark, sf_dir, "parsed_sections").select("section_id", "input_id", "text"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_items(*_items(spark, sf_dir)[:2])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Only documents of target sources are tokenized; the targets are a fixed, small table.
    wanted = docs.join(targets.select("source"), "source", "left_semi")
    # Sizes are read several times; they are few bytes a document, and dear to take.
    return mixing.schedule(stage(tokens.count_tokens(wanted), "sizes"), targets), targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].select("doc_id", "source", "pass_no", "n_tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

_P2 = """WITH b AS (SELECT plan_id, namespace, op_kind, record_id, max(score) AS score FROM candidate_sets
   WHERE namespace = plan_namespace AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
 u AS (SELECT DISTINCT plan_id, namespace, record_id FROM b), o AS (SELECT DISTINCT plan_id, namespace, op_kind FROM b),
 l AS (SELECT u.plan_id, u.namespace, o.op_kind, u.record_id, coalesce(b.score, '-infinity'::double) AS score FROM u JOIN o USING (plan_id, namespace)
   LEFT JOIN b ON b.plan_id = u.plan_id AND b.namespace = u.namespace AND b.op_kind = o.op_kind AND b.record_id = u.record_id),
 p AS (SELECT *, (rank() OVER s - 1 + count(*) OVER (PARTITION BY plan_id, namespace, op_kind, score) / 2.0) / count(*) OVER (PARTITION BY plan_id, namespace, op_kind) AS pct,
   count(*) OVER (PARTITION BY plan_id, namespace, op_kind) AS n FROM l WINDOW s AS (PARTITION BY plan_id, namespace, op_kind ORDER BY score)),
 f AS (SELECT x.plan_id, x.namespace, x.op_kind, x.record_id, sum(least(greatest(x.pct - y.pct, 0) / 0.25, 1) - least(greatest(y.pct - x.pct, 0) / 0.25, 1)) / greatest(max(x.n) - 1, 1) AS flow
   FROM p x JOIN p y USING (plan_id, namespace, op_kind) GROUP BY ALL),
 t AS (SELECT plan_id, record_id, round(sum(flow * coalesce(element_at(fusion_weights, op_kind)[1], 1.0)), 9) AS net_flow FROM f LEFT JOIN fusion_policies USING (namespace) GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY net_flow DESC, record_id) AS position FROM t)"""

_P4 = """WITH v AS (SELECT DISTINCT ON (row_id) row_id, namespace, producer_version, embedding::double[] AS e FROM view_dense
       WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
     s AS (SELECT a.row_id AS a, b.row_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.namespace = b.namespace AND a.producer_version = b.producer_version AND a.row_id <> b.row_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS p FROM s)"""

ORACLES = {
    "p1_found": """WITH t AS (SELECT input_id, min(lower(trim(split_part(content_type, ';', 1)))) AS type FROM doc_inputs GROUP BY 1),
     i AS (SELECT 'section' AS item_kind, section_id AS item_id, text, type FROM parsed_sections LEFT JOIN t USING (input_id)
       UNION ALL SELECT 'input', input_id, text, lower(trim(split_part(content_type, ';', 1))) FROM doc_inputs),
     j AS (SELECT i.*, coalesce(l.max_bytes, s.max_bytes) AS m FROM i LEFT JOIN chunk_limits l ON l.item_kind = i.item_kind AND l.content_type = i.type
       JOIN chunk_limits s ON s.item_kind = i.item_kind AND s.content_type = '*')
     SELECT DISTINCT item_kind, item_id FROM j WHERE strlen(text) > m""",
    "p2_found": _P2 + " SELECT plan_id, record_id FROM k WHERE position = 1",
    "p2_ranking": _P2 + " SELECT plan_id, record_id, net_flow, position FROM k",
    "p3_found": r"""WITH r AS (SELECT DISTINCT row_id, source_id, regexp_extract_all(lower(body_text), '[\p{L}\p{N}]+') AS w FROM records WHERE body_text IS NOT NULL),
     g AS (SELECT row_id, source_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM r WHERE len(w) >= 3),
     n AS (SELECT row_id, count(*) AS n FROM g GROUP BY 1),
     c AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id AND a.source_id <> b.source_id GROUP BY ALL)
     SELECT row_id_a, row_id_b FROM c JOIN n x ON x.row_id = row_id_a JOIN n y ON y.row_id = row_id_b WHERE k >= 0.5 * (x.n + y.n - k)""",
    "p4_found": _P4 + " SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM k WHERE p <= 10 AND c >= 0.85",
}
