"""Queries of sources, ingest, scalar functions and stateful streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import extend, ingest
from quarry.functions import text as T
from quarry.operators import changefeed, evaluation, rerank, store
from quarry.queries_core import STEPS
from quarry.session import scratch, table
from quarry.sources import documents, files, office
from quarry.streaming import spans


def find_span(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").drop("provenance").dropDuplicates(["row_id"])
    first = r.where("tx_to is null").groupBy().agg(F.min(F.struct("row_id", *store.SPAN)).alias("s")).first()[0]
    return store.find_span(r, *[first[c] for c in store.SPAN]).select("row_id", "record_id", *store.SPAN)


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").drop("provenance").dropDuplicates(["row_id"])
    null = F.lit(None).cast("int")
    return r.select("row_id", T.content_id(F.col("kind"), F.col("section_path"), F.col("body_text"), null, null).alias("id"))


def blob_store(spark: SparkSession, d: str) -> DataFrame:
    """Every text under the hash of its bytes, each content once."""
    docs = table(spark, d, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    digest = F.sha2("content", 256)
    path = scratch(spark, "blobs")
    documents.put_blobs(docs.select(digest.alias("hash"), F.substring(digest, 1, 2).alias("shard"), F.lit("").alias("path"), F.octet_length("content").cast("long").alias("length"), "content"), path)
    return spark.read.parquet(path).select("hash", "shard", "length")


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of a page made of every document's metadata."""
    docs = table(spark, d, "documents")
    page = F.concat(F.lit("<html><head><script>x()</script></head><body><h2>"), "source", F.lit("</h2><p>Read &amp; kept:\n <b>"), F.col("doc_id").cast("string"), F.lit("</b></p><ul><li>"), "namespace", F.lit("</ul></body></html>"))
    return documents.from_html(docs.withColumn("page", page), "doc_id", "page")


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "documents").select("doc_id", "lang", "source").write.option("header", "true").csv(path)
    return documents.from_csv(spark, path).select("text")


def formats_report(spark: SparkSession, d: str) -> DataFrame:
    """One file per format, each with a fact to be found; one is broken."""
    path = scratch(spark, "files")
    facts = {"a.md": "# Limits\n\nThe limit is 40.", "b.txt": "The limit is 41.", "c.html": "<p>The limit is <b>42</b>.</p>", "e.csv": "name,limit\nx,44\n", "f.docx": "not a zip"}
    for name, text in facts.items():
        files.write_text_atomic(spark, f"{path}/{name}", text)
    read = office.texts(spark.read.format("binaryFile").load(path)).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "text")
    cases = [(n.split(".")[1], n, "limit", str(40 + i)) for i, n in enumerate(["a.md", "b.txt", "c.html", "f.docx", "e.csv"])]
    return evaluation.formats_report(spark.createDataFrame(cases, "fmt string, filename string, query string, expect string"), read)


def ingest_document(spark: SparkSession, d: str) -> DataFrame:
    """The operations that ingesting every input asks for, against the records that are live."""
    inputs = table(spark, d, "doc_inputs").withColumn("writer_namespace", F.col("namespace"))
    ops = ingest.operations(inputs, table(spark, d, "records").drop("provenance"))
    return ops.groupBy("namespace", "kind").agg(F.count("*").alias("operations"), F.countDistinct("source_id").alias("sources"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = extend.embedded(table(spark, d, "documents").select("doc_id", "text"), extend.HashEmbedder(64))
    return docs.select("doc_id", F.size("embedding").alias("dim"), "producer_version")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embeddings").select("vec_id", extend.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda t, x: t + x * x), 6).alias("square"))


def surface_values(spark: SparkSession, d: str) -> DataFrame:
    """Times as ISO 8601 in UTC, a namespace's tenant from its name, and a row as JSON that keeps nulls."""
    docs = table(spark, d, "documents")
    body = F.to_json(F.struct("doc_id", "lang", "n_chars"), {"ignoreNullFields": "false"})
    return docs.select("doc_id", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed"), F.substring_index("namespace", ":", 1).alias("prefix"), body.alias("body"))


def uncovered_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as boxes on pages of their size: those of odd keys that no box of an even key covers by half."""
    p = table(spark, d, "part")
    x, y = F.col("p_partkey") % 97, (F.col("p_partkey") * 7) % 89
    box = p.select("p_partkey", F.col("p_size").alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 20).cast("double").alias("x1"), (y + 15).cast("double").alias("y1"))
    odd, even = box.where("p_partkey % 2 = 1"), box.where("p_partkey % 2 = 0")
    return rerank.uncovered(odd, even).select("p_partkey", "page")


def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    at = F.col("p_partkey").cast("double")
    box = rerank.crop_box(at % 50, at % 30, at % 50 + 90, at % 30 + 40, F.lit(60.0), F.lit(100.0))
    big = rerank.large_enough(box["left"], box["top"], box["right"], box["bottom"], F.lit(60.0), F.lit(100.0))
    return p.select("p_partkey", box.alias("b"), big.alias("large")).select("p_partkey", "b.*", "large")


def feedback_queries(spark: SparkSession, d: str) -> DataFrame:
    """Judgments joined with the queries of their plans; every fifth plan has no query."""
    c = table(spark, d, "candidate_sets").where("op_kind = 'rerank' and namespace = plan_namespace and score is not null and not isnan(score)")
    judged = c.groupBy("plan_id", "namespace", "record_id").agg((F.max("score") > 0).alias("useful"))
    n = F.length("plan_id") + F.ascii(F.substring("plan_id", -1, 1))
    traces = c.select("plan_id", "namespace").distinct().withColumn("query", F.when(n % 5 != 0, F.concat(F.lit("about "), F.substring("plan_id", -2, 2))))
    q = rerank.useful_queries(judged, traces)
    return q.select("namespace", "query", F.size("useful").cast("long").alias("useful"), F.size("not_useful").cast("long").alias("not_useful"))


def current_policies(spark: SparkSession, d: str) -> DataFrame:
    """The latest report per namespace, as the latest override would be taken."""
    r = table(spark, d, "refresh_reports").select("report_id", "namespace", "wal_upto", "status").dropDuplicates(["report_id"])
    return documents.current(r, "namespace", "report_id")


def stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each write did, by compare-and-set over a stream that takes the feed in two deliveries."""
    every = changefeed.operations(table(spark, d, "write_ops"))
    rows, _ = changefeed.events(every)
    names = table(spark, d, "write_ops").where("record_id is not null").select(*store.SPAN, F.xxhash64(*store.SPAN).alias("h1")).distinct()
    # Ids are compared by their hashes, as text.
    whole = rows.drop(*store.SPAN).join(names, "h1").select(*store.SPAN, "op_seq", "kind", F.col("rh").cast("string").alias("record_id"), F.col("oh").cast("string").alias("old_id"))
    folder, out = scratch(spark, "events"), scratch(spark, "outcomes")
    half = whole.agg(F.percentile_approx("op_seq", 0.5)).first()[0] or 0
    for part in (whole.where(F.col("op_seq") <= half), whole.where(F.col("op_seq") > half)):
        part.coalesce(4).write.mode("append").parquet(folder)
        stream = spans.outcomes(spark.readStream.schema(whole.schema).parquet(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(spans.OUT).parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        find_span, content_ids, blob_store, html_pages, csv_rows, formats_report, ingest_document, hash_embedding, unit_vectors, surface_values,
        uncovered_boxes, crop_boxes, feedback_queries, current_policies, stream_outcomes,
    )
}

_R = "WITH r AS (SELECT DISTINCT ON (row_id) * EXCLUDE (provenance) FROM records)"

ORACLES = {
    "find_span": _R + ", s AS (SELECT namespace, source_id, stable_key FROM r WHERE tx_to IS NULL ORDER BY row_id LIMIT 1) SELECT row_id, record_id, namespace, source_id, stable_key FROM r JOIN s USING (namespace, source_id, stable_key) WHERE tx_to IS NULL",
    "content_ids": _R + " SELECT row_id, 'rec_' || sha256(to_json({'end': NULL::int, 'kind': kind, 'section_path': section_path, 'start': NULL::int, 'text': body_text})::varchar) AS id FROM r",
    "blob_store": "SELECT DISTINCT sha256(text) AS hash, sha256(text)[1:2] AS shard, strlen(text) AS length FROM documents WHERE text IS NOT NULL",
    "html_pages": "SELECT doc_id, '## ' || source || chr(10) || chr(10) || 'Read & kept: ' || doc_id || chr(10) || chr(10) || '- ' || namespace AS text FROM documents",
    "csv_rows": "SELECT '| doc_id | lang | source |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || doc_id || ' | ' || coalesce(lang, '') || ' | ' || coalesce(source, '') || ' |' AS text FROM documents",
    "formats_report": "SELECT * FROM (VALUES ('md', 1::bigint, 1::bigint, 1::bigint, true), ('txt', 1, 1, 1, true), ('html', 1, 1, 1, true), ('csv', 1, 1, 1, true), ('docx', 1, 0, 0, false)) v(fmt, cases, ingested, retrieved, passed)",
    "unit_vectors": """WITH n AS (SELECT vec_id, embedding::double[] AS e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) AS n FROM embeddings)
     SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS square FROM n""",
    "surface_values": """SELECT doc_id, strftime(observed_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS observed, split_part(namespace, ':', 1) AS prefix,
     to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars})::varchar AS body FROM documents""",
    "uncovered_boxes": """WITH b AS (SELECT p_partkey, p_size AS page, (p_partkey % 97)::double AS x0, ((p_partkey * 7) % 89)::double AS y0 FROM part)
     SELECT p_partkey, page FROM b o WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b p WHERE p.p_partkey % 2 = 0 AND p.page = o.page
       AND greatest(0, least(o.x0, p.x0) + 20 - greatest(o.x0, p.x0)) * greatest(0, least(o.y0, p.y0) + 15 - greatest(o.y0, p.y0)) > 0.5 * 20 * 15)""",
    "crop_boxes": """WITH b AS (SELECT p_partkey, p_partkey % 50 AS x, p_partkey % 30 AS y FROM part), c AS (SELECT p_partkey, x::double AS "left", greatest(0, 60 - (y + 40))::double AS top, least(x + 90, 100)::double AS "right", (60 - y)::double AS bottom FROM b)
     SELECT *, ("right" - "left") * (bottom - top) >= 0.015 * 6000 AS large FROM c""",
    "feedback_queries": """WITH c AS (SELECT plan_id, namespace, record_id, max(score) > 0 AS useful FROM candidate_sets WHERE op_kind = 'rerank' AND namespace = plan_namespace AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
     q AS (SELECT *, 'about ' || right(plan_id, 2) AS query FROM c WHERE (length(plan_id) + ascii(right(plan_id, 1))) % 5 <> 0)
     SELECT namespace, query, count(DISTINCT record_id) FILTER (useful) AS useful, count(DISTINCT record_id) FILTER (NOT useful) AS not_useful FROM q GROUP BY ALL""",
    "current_policies": "SELECT DISTINCT ON (namespace) report_id, namespace, wal_upto, status FROM refresh_reports ORDER BY namespace, report_id DESC",
    "stream_outcomes": STEPS + ", h AS (SELECT namespace, source_id, stable_key, unnest(e.h) AS x FROM ends) SELECT namespace, source_id, stable_key, x.q AS op_seq, x.o AS outcome FROM h",
}
