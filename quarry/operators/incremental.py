"""Processing only what is new or changed since the last successful run.

A run covers positions ``after < position <= upto`` of the log and sees what
was committed when it started, so a transaction that was open then is missed
although its position lies inside.  The next run therefore rereads from the
oldest such transaction, and an anti-join of (key, version) pairs against the
ledger of what was processed removes the overlap.

Finding the run that covers a position is an interval stab, done by zones of
``2**SHIFT`` positions.  The zones that a run holds whole are cut into aligned
blocks of ``2**(FAN*level)`` zones, which a zone meets by equality, its one
block on each level; the two zones in which a run begins and ends keep it as a
piece.  Only rows of zones that no block clears are held against the pieces,
so no namespace is gathered in one place and no interval is compared with
every row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stage
from quarry.sources import files

#: A zone holds 2**SHIFT positions; blocks of level n hold 2**(FAN*n) zones, and LEVELS of them reach 2**48 positions.
SHIFT, FAN, LEVELS = 6, 3, 15


def succeeded_runs(reports: DataFrame, views: Sequence[str]) -> DataFrame:
    """(namespace, view_name, after, upto, started_at) of each run that succeeded with that view.

    Failed and running reports, empty intervals and null bounds cover nothing;
    copies count once.
    """
    return (
        reports.where(F.col("status") == "succeeded")
        .where(F.col("wal_after").isNotNull() & F.col("wal_upto").isNotNull() & F.col("started_at").isNotNull())
        .select(
            "namespace",
            F.explode(F.map_keys("entries")).alias("view_name"),
            F.greatest(F.col("wal_after"), F.lit(-1)).alias("after"),
            F.col("wal_upto").alias("upto"),
            "started_at",
        )
        .where(F.col("view_name").isin(*views) & (F.col("after") < F.col("upto")))
        .groupBy("namespace", "view_name", "after", "upto")
        .agg(F.max("started_at").alias("started_at"))
    )


def _blocks(lo: int, hi: int, shift: int = SHIFT) -> Iterator[tuple[int, int]]:
    """The numbers lo..hi, both included, as few aligned blocks (level, index) of ``2**(shift*level)`` numbers."""
    level = 0
    while lo <= hi:
        if level == LEVELS - 1:
            yield from ((level, i) for i in range(lo, hi + 1))
            return
        width = 1 << shift
        while lo <= hi and lo % width:
            yield level, lo
            lo += 1
        while lo <= hi and (hi + 1) % width:
            yield level, hi
            hi -= 1
        lo, hi, level = lo >> shift, ((hi + 1) >> shift) - 1, level + 1


def _cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = 1 << SHIFT
    for pdf in batches:
        cut = [list(_blocks((int(a) + width) // width, (int(u) + 1) // width - 1, FAN)) for a, u in zip(pdf["after"], pdf["upto"])]
        sizes = [len(c) for c in cut]
        flat = [b for c in cut for b in c]
        at = np.repeat(np.arange(len(pdf)), sizes)
        out = pdf[["namespace", "view_name", "started"]].iloc[at].reset_index(drop=True)
        out["level"] = np.array([b[0] for b in flat], dtype="int32")
        out["block"] = np.array([b[1] for b in flat], dtype="int64")
        yield out


def covered_until(runs: DataFrame) -> DataFrame:
    """Per block of zones, the latest start (microseconds) of a run that holds it whole."""
    # Reports are few bytes and many blocks; they are spread so that cutting them isn't left to one task.
    spread = runs.select("namespace", "view_name", "after", "upto", F.unix_micros("started_at").alias("started"))
    spread = spread.repartition(runs.sparkSession.sparkContext.defaultParallelism * 2)
    cut = spread.mapInPandas(_cut_runs, "namespace string, view_name string, started long, level int, block long")
    return cut.groupBy("namespace", "view_name", "level", "block").agg(F.max("started").alias("started"))


def pieces(runs: DataFrame) -> DataFrame:
    """(namespace, view_name, zone, lo, hi, started): the positions lo..hi of the zones that a run holds in part, two a run at most."""
    lo, hi, width = F.col("after") + 1, F.col("upto"), 1 << SHIFT
    at = lambda x: F.shiftright(x, SHIFT)
    head = F.struct(at(lo).alias("zone"), lo.alias("lo"), F.least(hi, at(lo) * width + width - 1).alias("hi"))
    tail = F.struct(at(hi).alias("zone"), F.greatest(lo, at(hi) * width).alias("lo"), hi.alias("hi"))
    both = runs.select("namespace", "view_name", F.unix_micros("started_at").alias("started"), F.inline(F.array(head, tail)))
    # What several runs hold of a zone is told by its ends, so a zone has few pieces however many runs there are.
    return both.where(F.col("hi") - F.col("lo") < width - 1).groupBy("namespace", "view_name", "zone", "lo", "hi").agg(F.max("started").alias("started"))


def _levels(runs: DataFrame) -> list[int]:
    """The block levels that a run can have: none holds a block wider than the longest run."""
    longest = runs.agg(F.max(F.col("upto") - F.col("after"))).first()[0] or 0
    return [n for n in range(LEVELS) if (1 << (SHIFT + FAN * n)) <= longest]


def _placed() -> Column:
    """Whether a run can have seen a row: it has a namespace, a position and a commit time."""
    return F.col("namespace").isNotNull() & F.coalesce(F.col("version") >= 0, F.lit(False)) & F.col("committed_at").isNotNull()


def open_zones(rows: DataFrame, runs: DataFrame, views: Sequence[str]) -> DataFrame:
    """(namespace, zone, view_name, until): the zones that a view may not have processed in full.

    ``until`` is the latest start (microseconds) of a run that holds the zone
    whole, null without one; a transaction of the zone was committed after it.
    ``rows`` has namespace, version (the log position) and committed_at.

    The joins are by sorting, as the planner takes the blocks for as small as
    the reports they are cut from, and would broadcast them.
    """
    zone, committed = F.shiftright("version", SHIFT).alias("zone"), F.unix_micros("committed_at")
    zones = rows.where(_placed()).groupBy("namespace", zone).agg(F.max(committed).alias("latest"))
    every = zones.select("namespace", "zone", "latest", F.explode(F.array(*map(F.lit, views))).alias("view_name"), F.lit(None).cast("long").alias("started"))
    levels = _levels(runs)
    if levels:
        above = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("zone", FAN * n).alias("block")) for n in levels])
        held = zones.select("namespace", "zone", "latest", F.inline(above)).join(covered_until(runs).hint("merge"), ["namespace", "level", "block"])
        every = every.unionByName(held.select("namespace", "zone", "latest", "view_name", "started"))
    known = every.groupBy("namespace", "zone", "view_name").agg(F.max("latest").alias("latest"), F.max("started").alias("until"))
    return known.where(F.col("until").isNull() | (F.col("latest") > F.col("until"))).drop("latest")


def _first_open(zones: DataFrame) -> DataFrame:
    return zones.groupBy("namespace", "view_name").agg(F.shiftleft(F.min("zone"), SHIFT).alias("reread_from"))


def reread_from(rows: DataFrame, runs: DataFrame, views: Sequence[str]) -> DataFrame:
    """(namespace, view_name, reread_from): the position from which the next run of a view must reread a namespace.

    It is the start of the first zone of ``2**SHIFT`` positions that no one
    run holds whole or in which a transaction committed after all runs that do
    had started: the oldest that was open, or left out, at the last run lies
    there at the earliest.  It is found from one latest commit time a zone,
    not row by row.  A view that has nothing to reread has no row.
    """
    return _first_open(open_zones(rows, runs, views))


def to_process(rows: DataFrame, runs: DataFrame, views: Sequence[str]) -> DataFrame:
    """(row_id, version, view_name) that no run has processed yet.

    Rows are reread from the oldest transaction that was open at the last run,
    and of these only those in open zones; a row is taken out if a run that
    holds its zone, or a piece of it with the row, started after its commit.
    Copies of a row count once; a row without namespace, position or commit
    time was never seen by a run and so is to be processed.
    """
    zones = stage(open_zones(rows, runs, views), "zones")
    first = _first_open(zones).groupBy("namespace").agg(F.min("reread_from").alias("first"))
    again = rows.where(_placed()).join(first, "namespace").where(F.col("version") >= F.col("first"))
    again = again.select("row_id", "version", "namespace", F.shiftright("version", SHIFT).alias("zone"), F.unix_micros("committed_at").alias("committed"))
    left = again.join(zones.hint("merge"), ["namespace", "zone"]).where(F.col("until").isNull() | (F.col("committed") > F.col("until")))
    p = pieces(runs).hint("merge")
    seen = [left[c] == p[c] for c in ("namespace", "zone", "view_name")]
    seen += [p["lo"] <= left["version"], left["version"] <= p["hi"], left["committed"] <= p["started"]]
    left = left.join(p, seen, "left_anti").select("row_id", "version", "view_name")
    lost = rows.where(~_placed()).select("row_id", "version", F.explode(F.array(*map(F.lit, views))).alias("view_name"))
    return left.unionByName(lost).distinct()


class ProcessedLedger:
    """The incremental reader: each ``next_batch`` is what ``commit`` hasn't recorded yet.

    ``state`` is a folder with one committed ledger: the oldest position that
    was open, and the pairs at or after it.  Everything before that position is
    processed, so the ledger doesn't grow with the log.  A run that fails
    before ``commit`` leaves no trace, so the next one reads the same rows
    again; the commit is one renamed file.  A row without a position is never
    before any, and so stays in the ledger.
    """

    def __init__(self, spark, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _last(self) -> tuple[int, DataFrame | None, int]:
        """(number of the next commit, pairs, oldest open position) of the last commit."""
        found = [n for n in files.names(self.spark, f"{self.state}/commits") if n.endswith(".json")]
        if not found:
            return 0, None, -1
        last = json.loads(files.read_text(self.spark, f"{self.state}/commits/{found[-1]}"))
        return len(found), self.spark.read.parquet(last["pairs"]), last["oldest_open"]

    @staticmethod
    def _since(rows: DataFrame, start: int) -> DataFrame:
        return rows if start < 0 else rows.where(F.col("version").isNull() | (F.col("version") >= start))

    def next_batch(self, log: DataFrame) -> DataFrame:
        """Rows of ``log`` (row_id, version, ...) at or after the oldest open position, without processed pairs."""
        _, pairs, start = self._last()
        new = self._since(log, start)
        if pairs is None:
            return new
        return new.join(pairs, new.row_id.eqNullSafe(pairs.row_id) & new.version.eqNullSafe(pairs.version), "left_anti")

    def commit(self, batch: DataFrame, oldest_open: int) -> None:
        """Record the pairs of ``batch``; ``oldest_open`` is the lowest position still open when it was read."""
        number, pairs, start = self._last()
        if oldest_open < start:
            raise ValueError("the oldest open position can't fall")
        own = batch.select("row_id", "version").distinct()
        path = f"{self.state}/pairs/{uuid.uuid4().hex}"
        self._since(own if pairs is None else pairs.unionByName(own), oldest_open).write.parquet(path)
        if not files.write_text_atomic(self.spark, f"{self.state}/commits/{number:010d}.json", json.dumps({"pairs": path, "oldest_open": oldest_open})):
            raise RuntimeError("another run committed first")
