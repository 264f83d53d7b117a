"""Stemming, and the index against a scan of the texts."""

import random

from quarry.functions import stemming
from quarry.operators import lexical, retrieval
from quarry.session import scratch


def test_stems():
    pairs = (
        "running:run runs:run morning:morn generously:generous communication:communic happily:happili relational:relat hopping:hop hoping:hope "
        "nationally:nation conditional:condit sky:sky dying:die flies:fli ties:tie cries:cri digitizer:digit hopefulness:hope agreed:agre plastered:plaster "
        "sized:size triplicate:triplic electrical:electr adjustable:adjust rate:rate controlling:control knightly:knight youth:youth saying:say"
    )
    for p in pairs.split():
        word, want = p.split(":")
        assert stemming.stem(word) == want, word
    assert stemming.analyse(["the", "queues"], "english") == ["queue"] and stemming.analyse(["the"], "simple") == ["the"]


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    words = "red fox hen barn gate run the of".split()
    rows = [(i, rng.choice(["a", "a", "b", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(500, "a", None), (501, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, namespace string, text string")
    index = lexical.Index.build(df, scratch(spark, "index"))
    own = df.where("namespace = 'a'")
    for query in ("red fox", "fox or hen -barn", '"red fox"', '"red fox gate"', "-red", "absent", "the", '"fox hen" or run'):
        got = [tuple(r) for r in index.search(query, 200, "a").orderBy("rank").collect()]
        assert got == [tuple(r) for r in retrieval.lexical(own, query, 200).orderBy("rank").collect()], query
    assert index.search("", 5, "a").count() == 0
    plan = index.search("red", 5, "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "text" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1][:80]


def test_english_index(spark):
    rows = [(1, "a", "He was running in the mornings"), (2, "a", "a morning"), (3, "a", "run, morning; run"), (4, "a", "the of"), (5, "b", "running mornings")]
    index = lexical.Index.build(spark.createDataFrame(rows, "doc_id long, namespace string, text string"), scratch(spark, "index"), config="english")
    assert [r.id for r in index.search("morning runs", 10, "a").orderBy("rank").collect()] == [3, 1]
    assert index.search("the of", 10, "a").count() == 0  # stop words only
    assert sorted(r.id for r in index.search("running -mornings", 10).collect()) == []
