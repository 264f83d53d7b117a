"""Readers of corpora, benchmarks and judgments, and sinks for traces, feedback and policies."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class _Text(HTMLParser):
    """The visible text of a page as Markdown: headings, list items, table rows and paragraphs."""

    _BLOCK = {"p", "div", "section", "article", "li", "tr", "table", "ul", "ol", "pre", "blockquote", "br", "hr", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skipped += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self._BLOCK:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skipped = max(0, self.skipped - 1)
        elif tag in self._BLOCK or len(tag) == 2 and tag[0] == "h":
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(" ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else " " if data else "")


def html_text(page: str | None) -> str | None:
    """Markdown of a page; null stays null, broken markup is read as far as it goes."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return html.unescape("\n".join(kept)).strip()


def from_html(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, text) of HTML pages."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [html_text(x) for x in pdf[page]]})

    return df.select(key, page).mapInPandas(run, f"`{key}` {kind}, text string")


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each CSV row as a Markdown table row under the header; the types stay text."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return rows.select(F.input_file_name().alias("path"), F.concat(F.lit(head + "\n"), row).alias("text"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder under the hash of their content: (hash, shard, path, length, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    return files.select(digest.alias("hash"), F.substring(digest, 1, 2).alias("shard"), "path", "length", "content")


def put_blobs(found: DataFrame, path: str) -> None:
    """Writes each content once below its shard; putting it again adds an equal row that reading drops."""
    found.dropDuplicates(["hash"]).write.mode("append").partitionBy("shard").parquet(path)


def get_blob(spark: SparkSession, path: str, digest: str) -> bytes | None:
    """The content of a hash, or None; anything but 64 lower-case hex digits is refused."""
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError("not a SHA-256 digest")
    row = spark.read.parquet(path).where((F.col("shard") == digest[:2]) & (F.col("hash") == digest)).select("content").first()
    return None if row is None else bytes(row[0])


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark's documents, one JSON object per line: (doc_id, title, text)."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), "title", "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments, tab-separated with a header: (query_id, doc_id, score)."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, doc_id string, score int")
    return rows.select("query_id", "doc_id", "score")


def _parsed(text: str, path: str):
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml package") from missing
    return yaml.safe_load(text)


def regression_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, query, expected, min_sufficiency, namespace) of a JSON or YAML list; a bare string where a list belongs is refused."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows, cases = [], _parsed(text, path)
    if not isinstance(cases, list) or not all(isinstance(c, dict) for c in cases):
        raise ValueError("a regression set is a list of cases")
    for n, case in enumerate(cases):
        expected = case.get("expected_content_substrings", [])
        if not isinstance(expected, list) or not all(isinstance(x, str) for x in expected):
            raise ValueError(f"case {n}: expected_content_substrings must be a list of strings")
        if not case.get("query") or not case.get("principal_namespace"):
            raise ValueError(f"case {n}: query and principal_namespace are required")
        rows.append((n, case["query"], expected, float(case.get("min_sufficiency", 0.5)), case["principal_namespace"]))
    return spark.createDataFrame(rows, "case_id int, query string, expected array<string>, min_sufficiency double, namespace string")


def append_once(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Appends rows whose key the folder doesn't have; the first stored row of a key holds."""
    from quarry.sources import files

    if files.exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def current(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key of an append-only table, as of policies and overrides."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
