"""Versions, chunking, views, sources and the registered queries."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunking as C
from quarry.operators import evaluation, store
from quarry.sources import documents
from quarry.streaming import views


OPS = "op_seq long, namespace string, kind string, record_id string, old_id string, target_id string, source_id string, stable_key string, idempotency_key string"


def test_versions(spark):
    ops = [(1, "assert", "A", None), (2, "assert", "A", None), (3, "supersede", "B", "A"), (4, "forget", None, "B"), (5, "assert", "B", None), (6, "supersede", "C", "A"), (7, "supersede", "B", "B")]
    rows = [(s, "n", k, r, o if k != "forget" else None, o if k == "forget" else None, "src" if r else None, "key" if r else None, None) for s, k, r, o in ops]
    df = spark.createDataFrame(rows, OPS)
    got = sorted((r.record_id, r.seq_from, r.seq_to, r.supersedes) for r in store.versions(df.union(df)).collect())
    assert got == [("A", 1, 3, None), ("B", 3, 4, "A"), ("B", 5, 7, None), ("B", 7, None, "B")]
    from quarry.operators import changefeed

    assert {r.op_seq: r.outcome for r in changefeed.history(df).collect()} == {1: "created", 2: "unchanged", 3: "superseded", 4: "forgotten", 5: "created", 6: "refused", 7: "superseded"}


def test_history_in_pieces_is_the_same(spark, monkeypatch):
    from quarry.operators import changefeed
    from tests.test_changefeed import SCHEMA, feed

    df = spark.createDataFrame(feed(5), SCHEMA)
    whole = {tuple(r) for r in changefeed.history(df).collect()}
    monkeypatch.setattr(changefeed, "PIECE", 7)
    assert {tuple(r) for r in changefeed.history(df).collect()} == whole


def test_append_log_numbers_the_batch_in_order(spark):
    log = spark.createDataFrame([(7,)], "position long")
    batch = spark.createDataFrame([(n * 37 % 101, n) for n in range(101)], "at int, x int")
    got = {r.at: r.position for r in store.append_log(log, batch, ["at", "x"]).collect()}
    assert got == {n: 8 + n for n in range(101)}
    assert store.append_log(log.limit(0), batch.limit(0), ["at"]).count() == 0


def test_admission(spark):
    cols = "namespace string, source_id string, stable_key string, writer_namespace string, text string"
    changes = spark.createDataFrame([("n", "s", "a", "n", "new"), ("n", "s", "b", "m", "x"), ("n", "s", "c", "n", "same"), ("n", "s", "d", None, "x")], cols)
    records = spark.createDataFrame([(1, "n", "s", "c", "same", "r1", None), (2, "m", "s", "c", "same", "r1", None)], "row_id long, namespace string, source_id string, stable_key string, body_text string, record_id string, tx_to timestamp")
    from pyspark.sql import functions as F

    changed = F.col("prior_text").isNull() | (F.col("prior_text") != F.col("text"))
    assert [r.stable_key for r in store.admitted(changes, records, [changed]).collect()] == ["a"]
    assert [tuple(r) for r in store.ambiguous(records, records).collect()] == [("r1", 2)]


def test_markdown_fences_and_paths():
    text = "intro\n# A\nbody\n```\n# not a heading\n```\n## B\n\n## C\nc\n# D\n~~~\nopen # x\n# still code"
    assert C.sections_of(text, "doc") == [
        (["doc"], "intro"), (["doc", "A"], "body\n```\n# not a heading\n```"), (["doc", "A", "C"], "c"), (["doc", "D"], "~~~\nopen # x\n# still code"),
    ]
    assert C.sections_of(None, "d") == [] and C.sections_of("", "d") == []


@given(st.text(max_size=3000), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_prose_chunks_rebuild_and_keep_regions(text, seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6)))
    regions = [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
    got = C.prose_chunks(text, 64, 128, 512, regions)
    assert "".join(text[a:b] for a, b in got) == text
    assert not any(a < edge < b for a, b in regions for edge, _ in got)


def test_boundaries_resynchronise():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    edited = data[:20_000] + b"some new bytes" + data[20_000:]
    a = {data[i:j] for i, j in zip([0, *C.boundaries(data, 256, 1024, 4096)], C.boundaries(data, 256, 1024, 4096))}
    ends = C.boundaries(edited, 256, 1024, 4096)
    b = {edited[i:j] for i, j in zip([0, *ends], ends)}
    assert len(a & b) > 0.8 * len(a)
    sizes = [j - i for i, j in zip([0, *ends], ends)]
    assert max(sizes) <= 4096 and min(sizes[:-1]) >= 256


@pytest.mark.parametrize("sizes", [(64, 64, 64), (64, 128, 512), (256, 1024, 4096)])
def test_boundaries_byte_by_byte(sizes):
    rng, (least, average, most) = random.Random(7), sizes
    for n in (0, 1, least, least + 1, 3_000, 9_000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        bits = round(C.log2(average))
        want, start = [], 0
        while n - start > least:
            i, stop, h = start + least, min(n, start + most), 0
            for b in data[i - 64 : i]:
                h = (h << 1) + int(C._GEAR[b]) & (1 << 64) - 1
            while i < stop:
                h = (h << 1) + int(C._GEAR[data[i]]) & (1 << 64) - 1
                i += 1
                if h >> 64 - (bits + 2 if i - start < average else max(1, bits - 2)) == 0:
                    break
            want.append(i)
            start = i
        assert C.boundaries(data, *sizes) == want + ([n] if start < n else [])


def test_table_groups_repeat_the_header():
    rows = [f"| row {i} | {'x' * 20} |" for i in range(30)]
    text = "before | not a table\n\n| a | b |\n|---|---|\n" + "\n".join(rows) + "\n\nafter"
    parts = C.chunks_of(text, 64, 256, 512)
    tables = [t for k, t in parts if k == "table"]
    assert all(t.startswith("| a | b |\n|---|---|\n") and len(t) <= 256 for t in tables)
    assert [x for t in tables for x in t.split("\n")[2:]] == rows


def test_ingest_ops(spark):
    cols = "namespace string, source_id string, stable_key string, record_id string"
    live = spark.createDataFrame([("n", "s", "a", "1"), ("n", "s", "b", "2"), ("n", "s", "gone", "3")], cols)
    new = spark.createDataFrame([("n", "s", "a", "1"), ("n", "s", "b", "9"), ("n", "s", "c", "4")], cols)
    assert {(r.stable_key, r.kind) for r in C.ingest_ops(new, live).collect()} == {("b", "supersede"), ("c", "assert")}


def test_view_refresh_is_incremental_and_idempotent(spark, tmp_path):
    log = str(tmp_path / "log")
    view = views.View(spark, "file://" + str(tmp_path / "view"), views.latest(["k"], "v"), ["k"])
    df = lambda rows: spark.createDataFrame(rows, "k string, v long")
    df([("a", 1), ("b", 1)]).write.mode("append").parquet(log)
    assert {tuple(r) for r in view.refresh(log, df([]).schema).collect()} == {("a", 1), ("b", 1)}
    before = view._pointers()
    view.refresh(log, df([]).schema)
    assert view._pointers() == before
    df([("a", 2)]).write.mode("append").parquet(log)
    assert {tuple(r) for r in view.refresh(log, df([]).schema).collect()} == {("a", 2), ("b", 1)}
    view.apply(df([("a", 0)]), 0, view._stream())  # a batch that is committed is passed over
    assert {tuple(r) for r in view.read().collect()} == {("a", 2), ("b", 1)}
    kept = view._last()["buckets"]
    view.apply(df([("a", 3)]), 9, "other")
    after = view._last()["buckets"]
    assert sum(after[b] != kept.get(b) for b in after) == 1 and view.reports()[-1] == {"batch": 9, "keys": 1, "buckets": 1, "removed": 1}
    # A lost checkpoint reads the log again, and nothing is passed over.
    from quarry.sources import files

    files.delete(spark, view.path + "/checkpoint")
    df([("c", 1)]).write.mode("append").parquet(log)
    assert {tuple(r) for r in view.refresh(log, df([]).schema).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_sources(spark, tmp_path):
    page = "<html><title>T</title><script>x</script><h2>Head</h2><p>One <b>two</b></p><ul><li>a<li>b</ul></html>"
    assert documents.html_text(page).split("\n")[0] == "T" and "## Head" in documents.html_text(page) and "- a" in documents.html_text(page)
    assert documents.html_text(None) is None and "x" not in documents.html_text(page)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"one")
    (tmp_path / "f" / "b.txt").write_bytes(b"one")
    found = documents.blobs(spark, str(tmp_path / "f"))
    documents.put_blobs(found, str(tmp_path / "blobs"))
    digest = found.select("hash").first()[0]
    assert documents.get_blob(spark, str(tmp_path / "blobs"), digest) == b"one"
    assert documents.get_blob(spark, str(tmp_path / "blobs"), "0" * 64) is None
    with pytest.raises(ValueError):
        documents.get_blob(spark, str(tmp_path / "blobs"), "../x")
    (tmp_path / "c.json").write_text('[{"query": "q", "expected_content_substrings": "bare", "principal_namespace": "n"}]')
    with pytest.raises(ValueError):
        documents.regression_cases(spark, str(tmp_path / "c.json"))
    rows = spark.createDataFrame([("p", 1)], "plan_id string, x int")
    documents.append_once(spark, str(tmp_path / "t"), rows, "plan_id")
    documents.append_once(spark, str(tmp_path / "t"), rows.withColumn("x", rows.x + 1), "plan_id")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("p", 1)]


def test_fifth_is_the_hash_modulo_five(spark):
    import hashlib

    df = evaluation.split(spark.createDataFrame([(f"q{i}",) for i in range(30)], "q string"), "q")
    assert all(r.bucket == int(hashlib.sha256(r.q.encode()).hexdigest(), 16) % 5 for r in df.collect())


def test_queries_and_oracles_are_registered_alike(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["id", "rrf", "ops", "rank", "score", "sufficiency"]
    df.collect()
