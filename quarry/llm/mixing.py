"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in shuffled order.  Its virtual
finish time is the queue's cumulative tokens divided by the target share.
Served in order of finish time, the sources advance in proportion to their
shares.  The order is global: copies are sorted by ranges of finish time, and
the list ends where the running total reaches the token budget.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ranks import slotted_sum
from quarry.session import stage

#: Rows that a slot of a queue, or a range of finish times, holds on average.
SLOT = 200_000


def capacity(totals: list[tuple[int, float, int]]) -> int:
    """The largest total at which every source that is present still meets its share; ``totals`` has (tokens, share, repeats)."""
    until = min(n * r / s for n, s, r in totals)
    return int(until * sum(s for _, s, _ in totals) * (1 + 1e-12))


def virtual_end(totals: list[tuple[int, float, int]], budget: int) -> float:
    """The virtual time at which ``budget`` tokens are served, where a source whose passes are used up serves no more."""
    left, end, start, active = float(budget), 0.0, 0.0, sorted((n * r / s, s) for n, s, r in totals)
    while active:
        end = start + left / sum(s for _, s in active)
        until, _ = active[0]
        if end <= until:
            return end
        left -= (until - start) * sum(s for _, s in active)
        start, end, active = until, until, active[1:]
    return end


def schedule(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, pass_no, n_tokens, finish): the mix, a row per copy.

    ``sizes`` has doc_id, source and n_tokens; ``targets`` has source,
    target_share and max_repeats.  A source outside ``targets``, one with a
    null or non-positive share or with max_repeats below 1, and documents
    without tokens stay out.  A source is passed through at most max_repeats
    times; a document's next copy comes only after its whole source.

    ``budget`` is the total of tokens; the mix is the longest start of the
    finish order within it.  None takes the largest total at which every
    source that is present still meets its share, so shares are as near as
    max_repeats allows; what that costs is the part of the larger sources that
    stays out.  With a larger budget exhausted sources fall behind and the
    others go on in proportion.  Ties of finish time go by doc_id.
    """
    target = (
        targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
        .groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    )
    docs = sizes.where(F.col("n_tokens") > 0).join(target, "source")
    # One row per target source, of which there is a fixed, small number.
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("whole"), F.max("share").alias("share"), F.max("repeats").alias("repeats"), F.max("n_tokens").alias("most"), F.count("*").alias("rows")).collect()
    totals = [(int(r.whole), float(r.share), int(r.repeats)) for r in per]
    if not totals:
        return docs.select("doc_id", "source", F.lit(1).alias("pass_no"), "n_tokens", F.lit(0.0).alias("finish"))
    budget = capacity(totals) if budget is None else budget
    # Whole documents lag behind the fluid service by less than one document a source, so by this time the budget is reached.
    end = virtual_end(totals, budget + sum(r.most for r in per))
    # The first pass of a queue: cumulative tokens in shuffled order, in slots whose number grows with the input.
    bits = max(4, ceil(log2(max(1, sum(r.rows for r in per) / SLOT))))
    docs = docs.withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
    docs = docs.withColumn("slot", F.shiftright("turn", 64 - bits))
    queued = slotted_sum(docs, ["source"], "slot", [F.col("turn"), F.col("doc_id")], "n_tokens", "served")
    whole = F.create_map(*[x for r in per for x in (F.lit(r.source), F.lit(int(r.whole)))])
    finish = (F.col("served") + whole[F.col("source")] * (F.col("pass_no") - 1)) / F.col("share")
    copies = (
        queued.select("doc_id", "source", "n_tokens", "share", "served", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("pass_no"))
        .withColumn("finish", finish)
        .where(F.col("finish") <= end * (1 + 1e-9))
        .select("doc_id", "source", "pass_no", "n_tokens", "finish")
    )
    # Written once, so that every use of the ranges sees the same ones.
    order = ["finish", "doc_id", "pass_no"]
    copies = stage(copies, "copies")
    ranges = max(1, copies.count() // SLOT)
    placed = stage(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "finish")
    parts = placed.groupBy("range").agg(F.sum("n_tokens").alias("part"))
    before = parts.select("range", F.coalesce(F.sum("part").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ran = placed.withColumn("inside", inside).join(before, "range")
    return ran.where(F.col("inside") + F.col("before") <= budget).drop("range", "inside", "before")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, copies and most repeats in the mix, the actual and the target share.

    A source that contributes nothing is listed with zeros.
    """
    got = mix.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    got = got.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("c").alias("copies"), F.max("c").alias("most_repeats"))
    whole = Window.partitionBy()
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(got, "source", "left")
        .na.fill(0, ["tokens", "copies", "most_repeats"])
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0)), F.lit(0.0)))
    )
