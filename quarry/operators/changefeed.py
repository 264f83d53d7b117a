"""Applying a change feed by bucketed copy-on-write.

A ``BucketStore`` is a directory with immutable data files and numbered
manifests.  The base is hashed by key (namespace, source_id, stable_key) into
buckets; a batch of changes is routed to its buckets, only those are read,
merged and rewritten, and one new manifest makes all replacement files visible
at once.  A reader sees the manifest with the highest number, whole or not at
all.

Because deliveries repeat and arrive late, a bucket keeps its valid
operations, and the live rows of a bucket are folded from them again whenever
the bucket is touched.  What reaches across spans has an index, bucketed by its
own hash and read and rewritten in the same way: the first operation of every
idempotency key, the spans in which a record was ever written, and the forgets
of a record.  The result depends only on the set of operations ever delivered,
not on the number, order or grouping of deliveries.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import release, stage
from quarry.sources import files

SPAN = ["namespace", "source_id", "stable_key"]
#: A span of more operations than this is folded in pieces of so many op_seq values.
PIECE = 5_000
#: Buckets of a new store at least, and deliveries of its first batch per bucket; names of hot spans that are broadcast at most.
BUCKETS, PER_BUCKET, NAMED = 16, 50_000, 100_000

_SCHEMAS = {
    "ops": "bucket int, h1 long, h2 long, op_seq long, kind string, record_id string, rh long, oh long, namespace string, source_id string, stable_key string",
    "live": "namespace string, source_id string, stable_key string, record_id string, op_seq long",
    "keys": "k1 long, k2 long, op_seq long, bucket int, h1 long, h2 long, r1 long, r2 long",
    "records": "r1 long, r2 long, bucket int, h1 long, h2 long",
    "forgets": "r1 long, r2 long, op_seq long, oh long",
}

#: How rows are laid out: all of a span's rows, or of a hot span's piece, in one task; few buckets a task.
_HOME = ["bucket", "sub", "piece"]
_SPAN_KEY = [*_HOME, "h1", "h2"]


_SPAN_SCHEMA = "bucket int, h1 long, h2 long, namespace string, source_id string, stable_key string, "
_PARTS = _SPAN_SCHEMA + "piece long, fixed boolean, h string, r string, s long, moves array<struct<a:string,h:string,r:string,s:long>>"


def normalise(changes: DataFrame, buckets: int) -> DataFrame:
    """The deliveries as operations, with bucket and hashes; repeats are still there.

    A row takes part only with a namespace, an op_seq, a known kind and the
    ids that kind needs; anything else is an empty operation and changes
    nothing.  A forget has no bucket of its own.  k1 and k2 name the
    idempotency key, r1 and r2 the record written or forgotten, both within
    their namespace; rh and oh stand for record_id, and for old_id or target_id.
    """
    kind = F.lower(F.trim("kind"))
    span = kind != "forget"
    record = F.when(span, F.col("record_id")).otherwise(F.col("target_id"))
    whole = record.isNotNull() & (~span | (F.col("source_id").isNotNull() & F.col("stable_key").isNotNull()))
    h1, key = F.xxhash64(*SPAN), F.col("idempotency_key")
    old = F.when(span, F.when(kind == "supersede", F.col("old_id"))).otherwise(F.col("target_id"))
    return changes.where(F.col("namespace").isNotNull() & F.col("op_seq").isNotNull() & kind.isin("assert", "supersede", "forget") & whole).select(
        F.when(span, F.pmod(h1, F.lit(buckets)).cast("int")).alias("bucket"),
        F.when(span, h1).alias("h1"),
        F.when(span, F.xxhash64("stable_key", "source_id", F.lit(1))).alias("h2"),
        F.col("op_seq").cast("long").alias("op_seq"),
        kind.alias("kind"),
        F.when(span, F.col("record_id")).alias("record_id"),
        F.when(span, F.xxhash64("record_id")).alias("rh"),
        F.when(old.isNotNull(), F.xxhash64(old)).alias("oh"),
        "namespace",
        F.when(span, F.col("source_id")).alias("source_id"),
        F.when(span, F.col("stable_key")).alias("stable_key"),
        F.when(key.isNotNull(), F.xxhash64("namespace", key)).alias("k1"),
        F.when(key.isNotNull(), F.xxhash64(key, "namespace", F.lit(1))).alias("k2"),
        F.xxhash64("namespace", record).alias("r1"),
        F.xxhash64(record, "namespace", F.lit(1)).alias("r2"),
    )


def first_of_keys(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, lost): the operation of lowest op_seq of every key, and all others that have the key.

    Only hashes and numbers are shuffled, and keys are reduced before.
    """
    place = F.struct("op_seq", "bucket", "h1", "h2", "r1", "r2")
    first = keyed.groupBy("k1", "k2").agg(F.min(place).alias("f"), F.max("op_seq").alias("last"))
    repeated = first.where(F.col("last") > F.col("f.op_seq")).select("k1", "k2", F.col("f.op_seq").alias("first"))
    lost = keyed.join(repeated, ["k1", "k2"]).where(F.col("op_seq") > F.col("first")).select("op_seq", "bucket", "h1", "h2", "r1", "r2").distinct()
    return first.select("k1", "k2", "f.*"), lost


def in_spans(forgets: DataFrame, records: DataFrame) -> DataFrame:
    """(bucket, h1, h2, op_seq, oh): a forget goes to each span in which its record was ever written."""
    return forgets.join(records, ["r1", "r2"]).select("bucket", "h1", "h2", "op_seq", "oh")


def events(every: DataFrame) -> tuple[DataFrame, bool]:
    """(rows, pieces): per span and op_seq the one operation that takes place, and whether spans are folded in pieces.

    One wide shuffle brings the rows of a span together; repeats of an op_seq
    and retries are removed there.  Were the repeats of an op_seq to differ,
    the smallest row holds, so arrival doesn't matter.
    """
    key = ["bucket", "h1", "h2"]
    counts = every.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > PIECE).select(*key, F.lit(True).alias("hot"))
    # Few names are sent to every task; many are joined by a shuffle.
    few = counts.limit(NAMED + 1).collect()
    piece = F.lit(-1).cast("long")
    if few:
        named = F.broadcast(every.sparkSession.createDataFrame(few, counts.schema)) if len(few) <= NAMED else counts
        every = every.join(named, key, "left")
        piece = F.when(F.col("hot"), F.floor(F.col("op_seq") / PIECE)).otherwise(piece)
    placed = every.withColumns({"sub": F.pmod(F.shiftright("h1", 40), F.lit(2)).cast("int"), "piece": piece})
    body = F.struct("kind", "record_id", "rh", "oh", *SPAN)
    rows = (
        placed.repartition(*_HOME)
        .groupBy(*_SPAN_KEY, "op_seq")
        .agg(F.max("lost").alias("lost"), F.min(F.when(~F.col("lost"), body)).alias("b"), F.max("piece").alias("at"))
        .where(~F.col("lost") & F.col("b").isNotNull())
        .select(*_SPAN_KEY, "op_seq", "at", "b.*")
    )
    return rows, bool(few)


_NONE = "named_struct('r', cast(null as string), 'h', cast(null as bigint), 's', cast(null as bigint))"
_FOLD = (
    f"aggregate(steps, {_NONE}, (acc, x) -> "
    "CASE WHEN x.kind = 'assert' OR (x.kind = 'supersede' AND acc.h = x.oh) THEN named_struct('r', x.record_id, 'h', x.rh, 's', x.op_seq) "
    f"WHEN x.kind = 'forget' AND acc.h = x.oh THEN {_NONE} ELSE acc END)"
)


def fold(rows: DataFrame, pieces: bool) -> DataFrame:
    """The operations of each span (part ``ops``) and its live record (part ``live``).

    The events of a span in order of op_seq are each a function of what was
    live: an assert is constant, a supersede maps old_id to record_id, a
    forget maps its target to nothing.  Such functions compose, so a hot span
    is folded in pieces of at most ``PIECE`` operations that need not meet in
    one task; ``pieces`` says whether there are any.
    """
    columns = _names("ops")
    step = F.struct("op_seq", "kind", "record_id", "rh", "oh")
    null, number = "cast(null as string)", "cast(null as bigint)"
    # One pass gives both parts, so the rows are shuffled and grouped once.
    cold = (
        rows.groupBy(*_SPAN_KEY)
        .agg(F.sort_array(F.collect_list(step)).alias("steps"), *[F.max(c).alias(c) for c in SPAN], F.max("at").alias("at"))
        .where("at = -1")
        .withColumn("live", F.expr(_FOLD))
        .select("bucket", "h1", "h2", *SPAN, F.expr(
            "inline(concat(transform(steps, x -> named_struct('part', 'ops', 'op_seq', x.op_seq, 'kind', x.kind, 'record_id', x.record_id, 'rh', x.rh, 'oh', x.oh)), "
            f"filter(array(named_struct('part', 'live', 'op_seq', live.s, 'kind', {null}, 'record_id', live.r, 'rh', {number}, 'oh', {number})), x -> x.record_id IS NOT NULL)))"
        ))
    )
    if not pieces:
        return cold.select("part", *columns)
    large = rows.where("at >= 0")
    # As text, because a column of numbers with nulls would come as floats and lose bits.
    texts = large.withColumns({c: F.col(c).cast("string") for c in ("rh", "oh")})
    parts = texts.groupBy(*_SPAN_KEY).applyInPandas(_compose, _PARTS)
    # Only what follows the last piece that doesn't depend on what was before it matters.
    last = parts.where("fixed").groupBy("bucket", "h1", "h2").agg(F.max("piece").alias("last"))
    after = parts.join(last, ["bucket", "h1", "h2"], "left").where(F.col("last").isNull() | (F.col("piece") >= F.col("last"))).drop("last")
    live = after.groupBy("bucket", "h1", "h2").applyInPandas(_replay, _SPAN_SCHEMA + "r string, s long").where("r is not null")
    live = live.select(F.lit("live").alias("part"), "bucket", "h1", "h2", *SPAN, F.col("r").alias("record_id"), F.col("s").alias("op_seq"))
    hot = large.select(F.lit("ops").alias("part"), *columns).unionByName(live, allowMissingColumns=True)
    return cold.select("part", *columns).unionByName(hot.select("part", *columns))


def _none(x):
    return None if x is None or x != x else x


def _first(values):
    return next((x for x in values if _none(x) is not None), None)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The events of one piece as one function: a constant, or moves of single ids."""
    fixed, value, moves = False, (None, None, None), {}
    own = pdf.sort_values("op_seq")
    for seq, kind, new, rh, oh in zip(own["op_seq"], own["kind"], own["record_id"], own["rh"], own["oh"]):
        rh, oh = _none(rh), _none(oh)
        if kind == "assert":
            fixed, value, moves = True, (rh, new, int(seq)), {}
            continue
        to = (rh, _none(new), int(seq)) if kind == "supersede" else (None, None, None)
        if oh is None:
            continue
        if fixed:
            if value[0] == oh:
                value = to
        else:
            for a, (h, _, _) in list(moves.items()):
                if h == oh:
                    moves[a] = to
            moves.setdefault(oh, to)
    head = pdf.iloc[0]
    row = {**{c: head[c] for c in ["bucket", "h1", "h2", "piece"]}, **{c: _first(pdf[c]) for c in SPAN}, "fixed": fixed, "h": value[0], "r": value[1], "s": value[2]}
    return pd.DataFrame([{**row, "moves": [{"a": a, "h": h, "r": r, "s": s} for a, (h, r, s) in moves.items()]}]).astype({"s": "Int64"})


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    h, r, s = None, None, None
    own = pdf.sort_values("piece")
    for fixed, h_, r_, s_, moves in zip(own["fixed"], own["h"], own["r"], own["s"], own["moves"]):
        if fixed:
            h, r, s = _none(h_), _none(r_), (None if pd.isna(s_) else int(s_))
        elif h is not None:
            hit = next((m for m in moves if m["a"] == h), None)
            if hit is not None:
                h, r, s = hit["h"], hit["r"], hit["s"]
    row = {**{c: pdf[c].iloc[0] for c in ("bucket", "h1", "h2")}, **{c: _first(pdf[c]) for c in SPAN}, "r": r, "s": s}
    return pd.DataFrame([row]).astype({"s": "Int64"})


def operations(changes: DataFrame, buckets: int = 4096) -> DataFrame:
    """All that a whole feed does to each span: its writes, the forgets that reach it, and retries marked as lost; repeats are still there."""
    fresh = normalise(changes, buckets)
    write = F.col("kind") != "forget"
    _, lost = first_of_keys(fresh.where(F.col("k1").isNotNull()).select(*_names("keys")))
    spans = fresh.where(write).select(*_names("records")).distinct()
    gone = lost.where("bucket is null").select("r1", "r2", "op_seq")
    asked = fresh.where(~write).groupBy("r1", "r2", "op_seq").agg(F.min("oh").alias("oh")).join(gone, ["r1", "r2", "op_seq"], "left_anti")
    every = fresh.where(write).select(*_names("ops")).withColumn("lost", F.lit(False))
    every = every.unionByName(in_spans(asked, spans).withColumns({"kind": F.lit("forget"), "lost": F.lit(False)}), allowMissingColumns=True)
    undone = lost.where("bucket is not null").select("bucket", "h1", "h2", "op_seq").withColumn("lost", F.lit(True))
    return every.unionByName(undone, allowMissingColumns=True)


_STEP = (
    "aggregate(steps, named_struct('r', r0, 'h', h0, 'v', cast(array() as array<struct<q: bigint, r: string, p: string, o: string>>)), (acc, x) -> "
    "CASE WHEN x.kind = 'assert' AND acc.h = x.rh THEN named_struct('r', acc.r, 'h', acc.h, 'v', concat(acc.v, array(named_struct('q', x.op_seq, 'r', acc.r, 'p', acc.r, 'o', 'unchanged')))) "
    "WHEN x.kind = 'assert' OR (x.kind = 'supersede' AND acc.h = x.oh) THEN named_struct('r', x.record_id, 'h', x.rh, 'v', concat(acc.v, array(named_struct('q', x.op_seq, 'r', x.record_id, 'p', acc.r, "
    "'o', CASE WHEN x.kind = 'supersede' THEN 'superseded' WHEN acc.h IS NULL THEN 'created' ELSE 'converted' END)))) "
    "WHEN x.kind = 'forget' AND acc.h = x.oh THEN named_struct('r', cast(null as string), 'h', cast(null as bigint), 'v', concat(acc.v, array(named_struct('q', x.op_seq, 'r', cast(null as string), 'p', acc.r, 'o', 'forgotten')))) "
    "WHEN x.kind = 'forget' THEN acc "
    "ELSE named_struct('r', acc.r, 'h', acc.h, 'v', concat(acc.v, array(named_struct('q', x.op_seq, 'r', acc.r, 'p', acc.r, 'o', 'refused')))) END).v"
)


def history(changes: DataFrame) -> DataFrame:
    """(span, op_seq, outcome, record_id, prior, seq_to): what every operation of a feed did to its span.

    The outcome of a write is ``created``, ``unchanged`` (an assert of what is
    live), ``converted`` (an assert in place of another record),
    ``superseded``, or ``refused`` (a supersede whose old_id isn't live); that
    of a forget is ``forgotten``, in each span in which its target was live.
    ``record_id`` is what is live afterwards and ``prior`` what was before;
    ``seq_to`` is the op_seq of the next operation that changed the span.

    A span of more than ``PIECE`` operations is replayed in pieces, each from
    what was live at its start, so no span must fit in a task.
    """
    rows, pieces = events(operations(changes))
    step, null = F.struct("op_seq", "kind", "record_id", "rh", "oh"), F.lit(None)
    lists = rows.groupBy(*_SPAN_KEY).agg(F.sort_array(F.collect_list(step)).alias("steps"), *[F.max(c).alias(c) for c in SPAN])
    cold = lists.where("piece = -1").withColumns({"r0": null.cast("string"), "h0": null.cast("long")}).withColumn("v", F.expr(_STEP))
    done = cold.select(*SPAN, "v", null.cast("long").alias("later"))
    if pieces:
        texts = rows.where("at >= 0").withColumns({c: F.col(c).cast("string") for c in ("rh", "oh")})
        parts = texts.groupBy(*_SPAN_KEY).applyInPandas(_compose, _PARTS)
        # One row per piece of a hot span.
        starts = parts.groupBy("bucket", "h1", "h2").applyInPandas(_starts, "bucket int, h1 long, h2 long, piece long, namespace string, source_id string, stable_key string, r0 string, h0 string")
        hot = lists.where("piece >= 0").drop(*SPAN).join(starts.withColumn("h0", F.col("h0").cast("long")), ["bucket", "h1", "h2", "piece"]).withColumn("v", F.expr(_STEP))
        after = Window.partitionBy("bucket", "h1", "h2").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
        moved = F.expr("filter(v, x -> x.o <> 'unchanged' and x.o <> 'refused')")
        done = done.unionByName(hot.select(*SPAN, "v", F.first(F.get(moved, F.lit(0))["q"], ignorenulls=True).over(after).alias("later")))
    moved = done.withColumn("moved", F.expr("transform(filter(v, x -> x.o <> 'unchanged' and x.o <> 'refused'), x -> x.q)"))
    each = moved.select(*SPAN, "moved", "later", F.inline("v")).withColumnsRenamed({"q": "op_seq", "r": "record_id", "p": "prior", "o": "outcome"})
    # The changes of a span, or of a piece, are in order.
    seq_to = F.coalesce(F.get(F.filter("moved", lambda m: m > F.col("op_seq")), F.lit(0)), "later")
    return each.select(*SPAN, "op_seq", "outcome", "record_id", "prior", seq_to.alias("seq_to"))


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is live at the start of each piece of a span."""
    h, r, out = None, None, []
    own = pdf.sort_values("piece")
    for piece, fixed, h_, r_, moves in zip(own["piece"], own["fixed"], own["h"], own["r"], own["moves"]):
        out.append((piece, r, h))
        if fixed:
            h, r = _none(h_), _none(r_)
        elif h is not None and (hit := next((m for m in moves if m["a"] == h), None)) is not None:
            h, r = hit["h"], hit["r"]
    frame = pd.DataFrame(out, columns=["piece", "r0", "h0"])
    return frame.assign(**{c: pdf[c].iloc[0] for c in ("bucket", "h1", "h2")}, **{c: _first(pdf[c]) for c in SPAN})[["bucket", "h1", "h2", "piece", *SPAN, "r0", "h0"]]


class BucketStore:
    """Copy-on-write table of write operations and of what is live after them.

    One writer at a time: a commit fails if another took its number first.
    Null or empty batches commit nothing.  Columns that the feed has besides
    those of an operation are ignored.  The number of buckets is that of the
    first batch: one for each ``PER_BUCKET`` of its deliveries, and ``BUCKETS``
    at least, unless it is given.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self) -> dict:
        found = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, **{part: {} for part in _SCHEMAS}}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{found[-1]}"))

    def _part(self, manifest: dict, part: str, only: set[int] | None = None) -> DataFrame:
        """A part of the store, of all buckets or of some; no other file is opened."""
        paths = [p for b, p in manifest[part].items() if only is None or int(b) in only]
        reader = self.spark.read.schema(_SCHEMAS[part])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[part])

    def live(self) -> DataFrame:
        """The current state: one row per span that has a live record."""
        return self._part(self.manifest(), "live").select(*SPAN, "record_id", "op_seq")

    def apply(self, changes: DataFrame) -> list[int]:
        """Apply one batch of deliveries; returns the buckets it rewrote."""
        old, made = self.manifest(), f"{self.path}/data/{uuid.uuid4().hex}"
        base = old["version"] > 0
        rows = changes.count()
        count = old["buckets"] if base else self.buckets or max(BUCKETS, rows // PER_BUCKET)
        fresh, home = normalise(changes, count), lambda c: F.pmod(F.col(c), F.lit(count)).cast("int")
        write = F.col("kind") != "forget"
        keys, records, forgets = (self._part(old, p, set()) for p in ("keys", "records", "forgets"))
        if base:
            # Only buckets that the batch names are looked at.
            b, k, r = self._sets(fresh, home)
            keys, forgets = self._part(old, "keys", k), self._part(old, "forgets", r)
        if base and rows <= old["deliveries"]:
            # What they know already is left out, so that repeats touch nothing.  A batch that is larger than all
            # before it touches nearly everything anyway, and repeats change no bucket that is folded again.
            known = self._part(old, "ops", b).select("h1", "h2", "op_seq").unionByName(forgets.select(F.col("r1").alias("h1"), F.col("r2").alias("h2"), "op_seq"))
            named = fresh.withColumns({"h1_": F.when(write, F.col("h1")).otherwise(F.col("r1")), "h2_": F.when(write, F.col("h2")).otherwise(F.col("r2"))})
            new = named.join(known.select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "op_seq"), ["h1_", "h2_", "op_seq"], "left_anti").drop("h1_", "h2_")
            late = keys.select("k1", "k2", F.col("op_seq").alias("first"))
            new = new.join(late, ["k1", "k2"], "left").where(F.col("first").isNull() | (F.col("op_seq") <= F.col("first"))).select(*fresh.columns)
            new.write.parquet(f"{made}/batch")
            fresh = self.spark.read.schema(new.schema).parquet(f"{made}/batch")
            b, k, r = self._sets(fresh, home)
            keys = self._part(old, "keys", k)
        if base and not r:
            return []
        keyed = fresh.where(F.col("k1").isNotNull()).select(*_names("keys")).unionByName(keys)
        first, lost = first_of_keys(keyed)
        if base:
            lost = stage(lost, "lost")
            r |= {x[0] for x in lost.where("bucket is null").select(home("r1")).distinct().collect()}
            records, forgets = self._part(old, "records", r), self._part(old, "forgets", r)
        written = fresh.where(write).select(*_names("records")).distinct()
        spans = records.unionByName(written).distinct()
        asked = fresh.where(~write).groupBy("r1", "r2", "op_seq").agg(F.min("oh").alias("oh"))
        gone = lost.where("bucket is null").select("r1", "r2", "op_seq")
        asked, forgets = (x.join(gone, ["r1", "r2", "op_seq"], "left_anti") for x in (asked, forgets))
        ended = in_spans(asked, spans)
        if base:
            ended = ended.unionByName(in_spans(forgets, written.join(records, _names("records"), "left_anti")))
        undone = in_spans(gone.withColumn("oh", F.lit(None).cast("long")), spans).unionByName(
            lost.where("bucket is not null").select("bucket", "h1", "h2", "op_seq", F.lit(None).cast("long").alias("oh"))
        )
        every = fresh.where(write).select(*_names("ops")).withColumn("lost", F.lit(False))
        every = every.unionByName(ended.withColumns({"kind": F.lit("forget"), "lost": F.lit(False)}), allowMissingColumns=True)
        every = every.unionByName(undone.withColumn("lost", F.lit(True)), allowMissingColumns=True)
        touched = None
        if base:
            touched = {x[0] for x in every.select("bucket").distinct().collect()}
            every = every.unionByName(self._part(old, "ops", touched).withColumn("lost", F.lit(False)))
        steps, pieces = events(every)
        made_of = {"ops": fold(steps, pieces).withColumn("b", F.col("bucket"))}
        for part, frame, by in (("keys", first, "k1"), ("records", spans, "r1"), ("forgets", forgets.unionByName(asked).distinct(), "r1")):
            made_of[part] = frame.select(*_names(part), home(by).alias("b")).repartition("b")

        def save(part: str) -> None:
            by, path = (["part", "b"], f"{made}/files") if part == "ops" else (["b"], f"{made}/files/part={part}")
            made_of[part].write.mode("append").partitionBy(*by).parquet(path)

        for part in made_of:
            save(part)
            release(self.spark)
        return self._commit(old, f"{made}/files", {"buckets": count, "deliveries": old.get("deliveries", 0) + rows}, touched, k if base else None, r if base else None)

    def _sets(self, fresh: DataFrame, home) -> tuple[set[int], set[int], set[int]]:
        """The buckets of spans, keys and records that a batch names; at most as many as the store has."""
        row = fresh.agg(*[F.collect_set(c) for c in (F.col("bucket"), home("k1"), home("r1"))]).first()
        return tuple({x for x in c if x is not None} for c in row)  # type: ignore[return-value]

    def _commit(self, old: dict, made: str, facts: dict, touched: set[int] | None, k: set[int] | None, r: set[int] | None) -> list[int]:
        version, new = old["version"] + 1, {}
        for part, gone in (("ops", touched), ("live", touched), ("keys", k), ("records", r), ("forgets", r)):
            path = f"{made}/part={part}"
            found = {n[2:]: f"{path}/{n}" for n in files.names(self.spark, path) if n.startswith("b=")}
            new[part] = {b: p for b, p in old[part].items() if gone is not None and int(b) not in gone} | found
        if not files.write_text_atomic(self.spark, f"{self.path}/manifests/{version:010d}.json", json.dumps({"version": version, **facts, **new})):
            raise RuntimeError(f"version {version} was committed by another writer")
        return sorted(touched if touched is not None else map(int, new["ops"]))


def _names(part: str) -> list[str]:
    return [c.split()[0] for c in _SCHEMAS[part].split(", ")]
