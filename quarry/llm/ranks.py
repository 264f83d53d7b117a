"""Prefix sums and ranks within groups of any size.

A group's rows are spread over ordered slots, each slot is summed alone, and
the totals of the slots before it are added.  Slots are a function of the
row's own order key, so a rerun after a lost executor puts every row in the
same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slotted_sum(
    df: DataFrame, keys: list[str], slot: str, order: list[Column], value: str, out: str, also: dict[str, str] | None = None
) -> DataFrame:
    """``out``: the sum of ``value`` over the group's rows up to and with this one.

    ``slot`` is an integer column that never falls along ``order``, and order
    is total within a group.  The totals have one row per group and slot in
    use.  ``also`` names further values and their outputs.
    """
    sums = {value: out, **(also or {})}
    totals = df.groupBy(*keys, slot).agg(*[F.sum(v).alias(f"__part_{o}") for v, o in sums.items()])
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, slot, *[F.coalesce(F.sum(f"__part_{o}").over(before), F.lit(0)).alias(f"__base_{o}") for o in sums.values()])
    inside = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.select("*", *[F.sum(v).over(inside).alias(f"__in_{o}") for v, o in sums.items()])
    kept = [c for c in df.columns if c not in sums.values()]
    return summed.join(base, [*keys, slot]).select(*kept, *[(F.col(f"__in_{o}") + F.col(f"__base_{o}")).alias(o) for o in sums.values()])
