"""The bitemporal record store as views over an append-only log.

Nothing is updated: a row's closing time is the time of the next event on its
span, and what is live follows from windows over the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.changefeed import history
from quarry.session import stage

SPAN = ["namespace", "source_id", "stable_key"]


def live(records: DataFrame) -> DataFrame:
    return records.where(F.col("tx_to").isNull())


def find_span(records: DataFrame, namespace: str, source_id: str, stable_key: str) -> DataFrame:
    """Point lookup by span among live rows."""
    return live(records).where((F.col("namespace") == namespace) & (F.col("source_id") == source_id) & (F.col("stable_key") == stable_key))


def get_live(records: DataFrame, namespace: str, record_id: str) -> DataFrame:
    """The live row of lowest row_id with a content id, in one namespace."""
    if not namespace:
        raise ValueError("a namespace is required")
    return live(records).where((F.col("namespace") == namespace) & (F.col("record_id") == record_id)).orderBy("row_id").limit(1)


def as_of(records: DataFrame, moment) -> DataFrame:
    """What was live at a moment of transaction time; a row is live from tx_from until, not at, tx_to."""
    at = F.lit(moment)
    return records.where((F.col("tx_from") <= at) & (F.col("tx_to").isNull() | (F.col("tx_to") > at)))


def versions(changes: DataFrame) -> DataFrame:
    """(span, record_id, seq_from, seq_to, supersedes): the history of every span under a log of write operations.

    An assert of what is live is logged but opens no version; a supersede to
    equal content does.  A supersede of what isn't live, a retry and an empty
    operation open none; a forget closes its target's and opens none.
    """
    opened = history(changes).where(F.col("outcome").isin("created", "converted", "superseded"))
    return opened.select(*SPAN, "record_id", F.col("op_seq").alias("seq_from"), "seq_to", F.col("prior").alias("supersedes"))


def ambiguous(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, namespaces): of ``ids``, those that are live in several namespaces; a forget of one without a namespace is refused."""
    found = live(records).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return found.groupBy("record_id").agg(F.countDistinct("namespace").alias("namespaces")).where("namespaces > 1")


def admitted(changes: DataFrame, records: DataFrame, preconditions: list | tuple = ()) -> DataFrame:
    """``changes`` that may be written: by a writer of the same namespace, and passing every precondition.

    ``changes`` has namespace and writer_namespace besides the span.  A
    precondition is a column over the change and ``prior_text``, the body of
    what is live in its span (null if nothing is); where it is null or false
    the change is refused.
    """
    own = changes.where(F.col("namespace").eqNullSafe(F.col("writer_namespace")))
    prior = live(records).groupBy(*SPAN).agg(F.max_by("body_text", "row_id").alias("prior_text"))
    out = own.join(prior, SPAN, "left")
    for p in preconditions:
        out = out.where(F.coalesce(p, F.lit(False)))
    return out


def double_live(records: DataFrame) -> DataFrame:
    """Spans with more than one live row; a sound store has none."""
    n = live(records).select(*SPAN, "row_id").distinct().groupBy(*SPAN).agg(F.count("*").alias("rows"))
    return n.where(F.col("rows") > 1)


def since(log: DataFrame, marker: int) -> DataFrame:
    """The change feed after a log position: supersedes are reported as created, forgets as forgotten."""
    kind = F.when(F.col("kind") == "forget", "forgotten").otherwise("created")
    return (
        log.where(F.col("op_seq") > marker)
        .select("op_seq", "namespace", F.coalesce("record_id", "target_id").alias("record_id"), kind.alias("change"))
        .distinct()
    )


def next_marker(log: DataFrame, marker: int) -> int:
    """The highest position of the log, or the marker itself where nothing is newer."""
    return max(marker, log.agg(F.max("op_seq")).first()[0] or marker)


def admit(records: DataFrame) -> DataFrame:
    """Clamps the authority tier: primary and corroborated need the capability ``verified_source``."""
    caps = F.col("provenance.writer.capabilities")
    verified = F.coalesce(F.array_contains(caps, "verified_source"), F.lit(False))
    tier = F.lower(F.col("provenance.authority_tier"))
    return records.withColumn("tier", F.when(tier.isin("primary", "corroborated") & ~verified, "inferred").otherwise(tier))


def foreign_writers(records: DataFrame) -> DataFrame:
    """Rows whose namespace isn't their writer's; admission refuses them."""
    return records.where(~F.col("namespace").eqNullSafe(F.col("provenance.writer.namespace")))


def navigate(records: DataFrame, namespace: str) -> DataFrame:
    """The section tree of a namespace: per path of a live record, the first row and how many there are."""
    own = live(records).where(F.col("namespace") == namespace).select("row_id", "record_id", "section_path").distinct()
    path = F.array_join("section_path", "\n")
    return own.where(F.col("section_path").isNotNull()).groupBy(path.alias("path"), F.size("section_path").alias("depth")).agg(
        F.min("row_id").alias("first_row"), F.min_by("record_id", "row_id").alias("record_id"), F.count("*").alias("records")
    )


def touched_ids(log: DataFrame, marker: int) -> DataFrame:
    """(namespace, record_id) that the log names after a position: new, replaced and forgotten ones."""
    return (
        log.where(F.col("op_seq") > marker)
        .select("namespace", F.explode(F.array("record_id", "old_id", "target_id")).alias("record_id"))
        .where(F.col("record_id").isNotNull())
        .distinct()
    )


def refresh_view(view: DataFrame, records: DataFrame, touched: DataFrame, derive) -> DataFrame:
    """Deletes the view rows of touched ids and derives them again from what is live; doing it twice changes nothing."""
    kept = view.join(touched, ["namespace", "record_id"], "left_anti")
    again = derive(live(records).join(touched, ["namespace", "record_id"], "left_semi"))
    return kept.unionByName(again)


def drifted(view: DataFrame, current: str) -> DataFrame:
    """View rows made by another producer version than the current one."""
    return view.where(~F.col("producer_version").eqNullSafe(F.lit(current)))


def unlike_dimension(view: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector isn't ``dim`` long; a view with any is refused."""
    return view.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim))


def append_log(log: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """``batch`` with ``position``: the log's last one, plus its row number over ``order``.

    The batch is sorted by ranges, written once so that every use sees the
    same ranges, and numbered within each; only the ranges' sizes are gathered.
    """
    last = log.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    placed = stage(batch.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "append")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = placed.withColumn("__n", inside).join(F.broadcast(sizes), "__part")
    return numbered.withColumn("position", F.lit(last) + F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")
