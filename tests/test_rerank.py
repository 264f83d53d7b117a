"""Reranking, conformance, geometry and normalisation."""

import pytest

from quarry.functions.normalise import normalise_text
from quarry.operators import evaluation as E
from quarry.operators import rerank as R


def test_rerank_is_the_pool_by_score(spark):
    pool = spark.createDataFrame([("p", "r1", "red fox", "a red hen"), ("p", "r2", "red fox", "red fox"), ("p", "r3", "red fox", None), ("p", "r0", "red fox", "red fox")], "plan_id string, record_id string, query string, text string")
    assert [r.record_id for r in R.rerank(pool).orderBy("rank").collect()] == ["r0", "r2", "r1", "r3"]
    assert R.rerank(pool.limit(0)).count() == 0
    with pytest.raises(Exception, match="finite"):
        R.rerank(pool, lambda q, t: [float("nan")] * len(q)).collect()


def test_conformance_gate(spark):
    assert R.conforms(R.reference_operator, spark) == []
    assert "filter" in R.conforms(lambda rows, node: rows, spark)
    from pyspark.sql import functions as F

    assert any("order" in x for x in R.conforms(lambda rows, node: R.reference_operator(rows, node).orderBy(F.col("score")), spark))


def test_geometry(spark):
    cols = "page int, x0 double, y0 double, x1 double, y1 double"
    objects = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 5.0, 5.0, 6.0, 6.0), (2, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0)], cols)
    pictures = spark.createDataFrame([(1, 0.0, 0.0, 1.9, 1.9)], cols)
    assert sorted((r.page, r.x0) for r in R.uncovered(objects, pictures).collect()) == [(1, 1.0), (1, 5.0), (2, 0.0)]


def test_feedback_and_promotion(spark):
    f = spark.createDataFrame([("p", "n", "r1", True), ("p", "n", "r2", False), ("q", "n", "r1", True), ("p", "m", "r3", True)], "plan_id string, namespace string, record_id string, useful boolean")
    t = spark.createDataFrame([("p", "n", "what"), ("q", "n", None)], "plan_id string, namespace string, query string")
    assert [tuple(r) for r in R.useful_queries(f, t).collect()] == [("n", "what", ["r1"], ["r2"])]
    assert R.promote(0.5, 0.6, 9) and not R.promote(0.5, 0.5, 9) and not R.promote(0.1, 0.9, 7)


def test_first_position_and_readings(spark):
    r = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "query_id string, doc_id string, pos int")
    assert {x.doc_id: x.rank for x in R.first_position(r).collect()} == {"a": 1, "b": 2, "c": 3}
    texts = spark.createDataFrame([(1, "e1", "x" * 30), (1, "e2", "y" * 40), (2, "e1", "short")], "picture_id int, engine string, text string")
    assert [(x.picture_id, x.engine) for x in R.best_reading(texts).collect()] == [(1, "e2")]


def test_normaliser():
    assert normalise_text("Caf&eacute; \\– 1,234 per cent ") == "cafe - 1234 percent"
    assert normalise_text("3,5%") == "3.5 percent" and normalise_text("34.800") == "34800" and normalise_text("1.5") == "1.5"
    assert normalise_text("62h, 62 hours and 62 HRS") == "62 h, 62 h and 62 h" and normalise_text("96MB M-3R") == "96 mb m-3r"
    assert normalise_text(None) is None


def test_top_five_passages(spark):
    passages = [("q1", i, f"filler {i}") for i in range(4)] + [("q1", 4, "The limit is 3,000 kg."), ("q1", 5, "sixth passage 77"), ("q2", 0, "It says 5 h."), ("q2", 1, "It says 6 hours.")]
    p = spark.createDataFrame(passages, "question string, rank int, text string")
    q = [("q1", "single", [[["limit", "3000 kg"], ["nothing"]]]), ("q2", "conflict", [[["5 hours"]], [["6h"]]]), ("q3", "single", [[["x"]]]), ("q4", "conflict", [[["a"]], [["b"]]])]
    schema = "question string, kind string, groups array<array<array<string>>>"
    assert {r.question: r.passed for r in E.top_five(p, spark.createDataFrame(q, schema)).collect()} == {"q1": True, "q2": True, "q3": False, "q4": False}
    sixth = spark.createDataFrame([("q1", "single", [[["77"]]]), ("q2", "conflict", [[["5 h"]], [["7 h"]]])], schema)
    assert {r.question: r.passed for r in E.top_five(p, sixth).collect()} == {"q1": False, "q2": False}


def test_gate_and_formats(spark):
    cases = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, []), (4, []), (5, ["a"])], "case_id int, expected array<string>")
    hits = spark.createDataFrame([(1, "xa", 0.6), (1, "bx", 0.2), (2, "y", 0.9), (4, "hit", 0.9), (5, "a", 0.4)], "case_id int, text string, sufficiency double")
    assert {r.case_id: r.passed for r in E.gate(cases, hits).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    f = spark.createDataFrame([("md", "a.md", "q", "one"), ("csv", "b.csv", "q", "two"), ("csv", "c.csv", "q", "x")], "fmt string, filename string, query string, expect string")
    h = spark.createDataFrame([("a.md", "one fact"), ("b.csv", "two facts")], "filename string, text string")
    assert {tuple(r) for r in E.formats_report(f, h).collect()} == {("md", 1, 1, 1, True), ("csv", 2, 1, 1, False)}
    assert {tuple(r) for r in E.id_sets(cases.where("case_id < 3"), cases.where("case_id > 1"), "case_id").collect()} == {(1, "extra"), (3, "missing"), (4, "missing"), (5, "missing")}
