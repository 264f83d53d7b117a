"""Queries of the parsers, the chunker and text functions, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.session import table


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_inputs").dropDuplicates(["input_id"])


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(_inputs(spark, d))


def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(_inputs(spark, d)).select("input_id", F.size("section_path").alias("depth")).groupBy("depth").agg(F.count("*").alias("sections"))


def cdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "parsed_sections"), "section_id")


def table_row_groups(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "parsed_sections"), "section_id").where("kind = 'table'")


def section_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_keys(table(spark, d, "parsed_sections")).select("section_id", "occurrence", "stable_key")


def ingest_ops(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "parsed_sections").where("section_path is not null and text is not null")
    keyed = chunking.section_keys(s).select("namespace", "source_id", "stable_key", F.sha2("text", 256).alias("record_id"), "input_id")
    # The later input of a source re-ingests it; each span meets its predecessor.
    first = keyed.groupBy("namespace", "source_id").agg(F.min("input_id").alias("first"))
    both = keyed.join(first, ["namespace", "source_id"])
    old = both.where("input_id = first").select("namespace", "source_id", "stable_key", "record_id").distinct()
    new = both.where("input_id > first").select("namespace", "source_id", "stable_key", "record_id", "input_id").distinct()
    return chunking.ingest_ops(new, old).select("namespace", "source_id", "stable_key", "record_id", "old_id", "input_id", "kind")


def script_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *[T.script_share(F.col("text"), s)[0].cast("long").alias(s.lower()) for s in ("Latin", "Han", "Hiragana", "Katakana")])


def script_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = []
    for script in ("Latin", "Han"):
        letters, share = T.script_share(F.col("line"), script)
        each.append(lines.withColumns({"letters": letters, "share": share}).where("letters >= 8 and share >= 0.6").select("doc_id", "line_no", F.lit(script).alias("script"), F.col("letters").cast("long").alias("letters")))
    return each[0].unionByName(each[1])


def word_edge_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(T.any_terms(F.col("text"), [["audit", "export"], ["glossary"]])).select("doc_id")


def text_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), T.snippet(F.col("text"), 40).alias("snippet"), F.sha2("text", 256).alias("hash"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    g = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("sources"))
    return g.where("copies > 1")


QUERIES = {
    f.__name__: f
    for f in (markdown_sections, markdown_headings, cdc_chunks, table_row_groups, section_keys, ingest_ops, script_counts, script_lines, word_edge_terms, text_profile, duplicate_texts)
}

_KEYS = """k AS (SELECT *, array_to_string(section_path, '/') AS path, row_number() OVER (PARTITION BY input_id, array_to_string(section_path, '/') ORDER BY section_id) - 1 AS occurrence FROM {t}),
 s AS (SELECT *, path || CASE WHEN occurrence > 0 THEN '@' || occurrence ELSE '' END || '#0' AS stable_key FROM k)"""
_COUNT = "len(regexp_extract_all(text, '\\p{{{s}}}'))"

ORACLES = {
    "section_keys": "WITH " + _KEYS.format(t="parsed_sections") + " SELECT section_id, occurrence, stable_key FROM s",
    "ingest_ops": "WITH g AS (SELECT * FROM parsed_sections WHERE section_path IS NOT NULL AND text IS NOT NULL), " + _KEYS.format(t="g") + """,
     f AS (SELECT namespace, source_id, min(input_id) AS first FROM s GROUP BY ALL), b AS (SELECT s.*, sha256(text) AS record_id, first FROM s JOIN f USING (namespace, source_id)),
     o AS (SELECT DISTINCT namespace, source_id, stable_key, record_id AS old_id FROM b WHERE input_id = first),
     n AS (SELECT DISTINCT namespace, source_id, stable_key, record_id, input_id FROM b WHERE input_id > first)
     SELECT namespace, source_id, stable_key, record_id, old_id, input_id, CASE WHEN old_id IS NULL THEN 'assert' ELSE 'supersede' END AS kind
     FROM n LEFT JOIN o USING (namespace, source_id, stable_key) WHERE old_id IS NULL OR old_id <> record_id""",
    "script_counts": "SELECT doc_id, " + ", ".join(f"{_COUNT.format(s=s)} AS {s.lower()}" for s in ("Latin", "Han", "Hiragana", "Katakana")) + " FROM documents WHERE text IS NOT NULL",
    "script_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
     c AS (SELECT doc_id, line_no::int AS line_no, len(regexp_extract_all(line, '\p{Latin}')) AS latin, len(regexp_extract_all(line, '\p{Han}')) AS han,
       length(regexp_replace(line, '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{0085}\x{2028}\x{2029}]', '', 'g')) AS visible FROM l)
     SELECT doc_id, line_no, 'Latin' AS script, latin AS letters FROM c WHERE latin >= 8 AND latin >= 0.6 * visible
     UNION ALL SELECT doc_id, line_no, 'Han', han FROM c WHERE han >= 8 AND han >= 0.6 * visible""",
    "word_edge_terms": r"""SELECT doc_id FROM documents WHERE (regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])audit($|[^\p{L}\p{N}_])') AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])export($|[^\p{L}\p{N}_])'))
     OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])glossary($|[^\p{L}\p{N}_])')""",
    "text_profile": """SELECT doc_id, coalesce(length(text), 0) AS chars, strlen(text) AS bytes,
     CASE WHEN length(text) > 40 THEN replace(text, chr(10), ' ')[1:40] || '...' ELSE replace(text, chr(10), ' ') END AS snippet, sha256(text) AS hash FROM documents""",
    "duplicate_texts": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
}
