"""Incremental runs against brute force, and surviving failure."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import incremental as I
from quarry.session import scratch

T0 = datetime(2026, 1, 1)


@given(st.integers(0, 10**9), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_blocks_cover_exactly(lo, size):
    blocks = sorted((i << (I.SHIFT * n), (i + 1) << (I.SHIFT * n)) for n, i in I._blocks(lo, lo + size))
    assert blocks[0][0] == lo and blocks[-1][1] == lo + size + 1
    assert all(a[1] == b[0] for a, b in zip(blocks, blocks[1:]))


def test_to_process_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(300), T0 + timedelta(hours=rng.randrange(100))) for i in range(200)]
    rows += [(900, "a", None, T0), (901, "a", 5, None), (902, None, 5, T0), *rows[:20]]
    reports = []
    for n in range(30):
        a = rng.randrange(250)
        views = rng.choice([{"dense": 1}, {"dense": 0, "lexical": 2}, {}, None])
        reports.append((n, rng.choice("ab"), a, a + rng.randrange(-2, 60), rng.choice(["succeeded", "succeeded", "failed", "running"]), T0 + timedelta(hours=rng.randrange(120)), views))
    reports += reports[:5]
    log = spark.createDataFrame(rows, "row_id long, namespace string, version long, committed_at timestamp")
    runs = I.succeeded_runs(spark.createDataFrame(reports, "report_id long, namespace string, wal_after long, wal_upto long, status string, started_at timestamp, entries map<string,long>"), ("dense", "lexical"))
    got = {(r.row_id, r.view_name) for r in I.to_process(log, runs, ("dense", "lexical")).collect()}
    want = {
        (i, v) for i, ns, w, t in rows for v in ("dense", "lexical")
        if not (ns and w is not None and t and any(x[1] == ns and x[4] == "succeeded" and v in (x[6] or {}) and x[2] < w <= x[3] and t <= x[5] for x in reports))
    }
    assert got == want


def test_no_reports(spark):
    log = spark.createDataFrame([(1, "a", 1, T0)], "row_id long, namespace string, version long, committed_at timestamp")
    empty = spark.createDataFrame([], "report_id long, namespace string, wal_after long, wal_upto long, status string, started_at timestamp, entries map<string,long>")
    assert I.to_process(log, I.succeeded_runs(empty, ("dense",)), ("dense",)).count() == 1
    assert I.to_process(log.limit(0), I.succeeded_runs(empty, ("dense",)), ("dense",)).count() == 0


def test_ledger_neither_skips_nor_repeats(spark):
    ledger = I.ProcessedLedger(spark, scratch(spark, "ledger"))
    log = lambda ids: spark.createDataFrame([(i, i) for i in ids], "row_id long, version long")
    first = ledger.next_batch(log([1, 2, 4]))  # 3 is still open
    assert {r.row_id for r in first.collect()} == {1, 2, 4}
    assert {r.row_id for r in ledger.next_batch(log([1, 2, 4])).collect()} == {1, 2, 4}  # the run failed before its commit
    ledger.commit(first, oldest_open=3)
    second = ledger.next_batch(log([1, 2, 3, 4, 5]))
    assert {r.row_id for r in second.collect()} == {3, 5}
    ledger.commit(second, oldest_open=6)
    assert ledger.next_batch(log([1, 2, 3, 4, 5])).count() == 0
    assert ledger._last()[1].count() == 0  # everything before position 6 is known to be processed
    ledger.commit(ledger.next_batch(log([6, 8, None])), oldest_open=7)
    assert {r.row_id for r in ledger._last()[1].collect()} == {8, None}
    assert {r.row_id for r in ledger.next_batch(log([6, 7, 8, 9, None])).collect()} == {7, 9}


def test_reread_is_before_whatever_is_open(spark):
    rows = [(i, "a", i, T0 + timedelta(hours=1)) for i in range(400)]
    late = (200, "a", 200, T0 + timedelta(hours=9))  # open when the first run started
    reports = [(1, "a", -1, 255, "succeeded", T0 + timedelta(hours=2), {"dense": 1}), (2, "a", 255, 383, "succeeded", T0 + timedelta(hours=2), {"dense": 1, "lexical": 1})]
    log = spark.createDataFrame(rows[:200] + [late] + rows[201:], "row_id long, namespace string, version long, committed_at timestamp")
    runs = I.succeeded_runs(spark.createDataFrame(reports, "report_id long, namespace string, wal_after long, wal_upto long, status string, started_at timestamp, entries map<string,long>"), ("dense", "lexical"))
    assert {(r.view_name, r.reread_from) for r in I.reread_from(log, runs, ("dense", "lexical")).collect()} == {("dense", 192), ("lexical", 0)}
    got = I.to_process(log, runs, ("dense", "lexical"))
    assert {r.row_id for r in got.where("view_name = 'dense'").collect()} == {200, *range(384, 400)}


REPORTS = "report_id long, namespace string, wal_after long, wal_upto long, status string, started_at timestamp, entries map<string,long>"


def test_what_reports_are_cut_into_is_never_broadcast(spark):
    # The planner takes it for as small as the reports' file, which passes the limit of 10 MB; it is many times larger.
    path = scratch(spark, "reports")
    spark.createDataFrame([(n, "a", 900 * n, 900 * n + 901, "succeeded", T0, {"dense": 1}) for n in range(20)], REPORTS).write.parquet(path)
    runs = I.succeeded_runs(spark.read.parquet(path), ("dense",))
    spark.range(2000).selectExpr("id as row_id", "'a' as namespace", "id * 9 as version", "timestamp'2025-01-01' as committed_at").write.parquet(path := scratch(spark, "rows"))
    rows = spark.read.parquet(path)
    for df in (I.reread_from(rows, runs, ("dense",)), I.to_process(rows, runs, ("dense",))):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for n, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = next((k for k in range(n + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
                assert "MapInPandas" not in "".join(lines[n:below]) and "wal_upto" not in "".join(lines[n:below])
    assert {r.row_id for r in I.to_process(rows, runs, ("dense",)).collect()} == {0}  # position 0 is before all runs


def test_copies_that_differ_are_processed_one_by_one(spark):
    rows = [(1, "a", 70, T0), (1, "a", 70, T0 + timedelta(hours=5)), (2, "a", 71, T0), (2, "a", 71, T0), (3, "a", 72, T0), (3, "a", 72, None), (4, "a", 73, T0), (4, "b", 73, T0)]
    log = spark.createDataFrame(rows, "row_id long, namespace string, version long, committed_at timestamp")
    runs = I.succeeded_runs(spark.createDataFrame([(1, "a", 60, 80, "succeeded", T0 + timedelta(hours=1), {"dense": 1})], REPORTS), ("dense",))
    assert sorted(r.row_id for r in I.to_process(log, runs, ("dense",)).collect()) == [1, 3, 4]
