"""One ranking from several differently scaled scores, by outranking net flow.

Per method the scores of a plan are turned into percentiles, so only order and
ties matter.  On each method every record is compared with every other by a
preference function of the percentile difference; what a record gains as
winner minus what it gives as loser, weighted over the methods, is its net
flow.  With the linear preference min(d / reach, 1) the sum over all others is
a difference of prefix sums over the sorted percentiles, so no pair is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.ranks import slotted_sum
from quarry.session import stage

#: Percentile difference from which one record is wholly preferred to another.
REACH = 0.25
#: Rows of a plan beyond which its prefix sums are made in slots; names of such plans that are broadcast at most.
GROUP, NAMED = 50_000, 100_000


def usable(candidates: DataFrame) -> DataFrame:
    """(plan_id, namespace, op_kind, record_id, score): each record of an operator once, at its best.

    Rows of another namespace than the plan's, with a null or NaN score, or
    without plan, operator or record do not count.
    """
    return (
        candidates.where((F.col("namespace") == F.col("plan_namespace")) & F.col("score").isNotNull() & ~F.isnan("score"))
        .where(F.col("plan_id").isNotNull() & F.col("op_kind").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("plan_id", "namespace", "op_kind", "record_id")
        .agg(F.max("score").alias("score"))
    )


KEYS = ["plan_id", "namespace", "op_kind"]


def percentiles(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, sizes): per method and score the count ``same`` and the percentile ``pct`` among the plan's records.

    The records that a method did not return tie below all it returned; they
    are one more level with a null score.  ``pct`` is the share below, ties
    counted half.  A group of more than ``GROUP`` scores is spread over slots
    by quantiles of its scores, so none is sorted in one place.
    """
    union = best.groupBy("plan_id", "namespace", "record_id").agg(F.lit(1).alias("x")).groupBy("plan_id", "namespace").agg(F.count("*").alias("all"))
    by_score = best.groupBy(*KEYS, "score").agg(F.count("*").alias("same"))
    sizes = by_score.groupBy(*KEYS).agg(
        F.sum("same").alias("n"),
        F.count("*").alias("levels"),
        F.percentile_approx("score", [i / 64 for i in range(1, 64)], 1000).alias("edges"),
    ).join(union, ["plan_id", "namespace"])
    hot = F.col("levels") > GROUP
    sized = by_score.join(sizes, KEYS)
    slot = F.when(hot, F.size(F.filter("edges", lambda e: e < F.col("score")))).otherwise(F.lit(0))
    ranked = slotted_sum(sized.withColumn("slot", slot).drop("edges"), KEYS, "slot", [F.col("score")], "same", "upto")
    missing = F.col("all") - F.col("n")
    present = ranked.select(*KEYS, "score", "same", "levels", "all", ((missing + F.col("upto") - F.col("same") / 2) / F.col("all")).alias("pct"))
    absent = sizes.where(missing > 0).select(
        *KEYS, F.lit(None).cast("double").alias("score"), missing.alias("same"), "levels", "all", (missing / 2 / F.col("all")).alias("pct")
    )
    return present.unionByName(absent), sizes


def net_flow(levels: DataFrame, reach: float = REACH) -> DataFrame:
    """Adds ``flow``: the mean over all others of preference given minus preference received, on one method.

    Let N and S be the prefix sums, by pct, of counts and of count times pct.
    Records lower by less than reach give (N * p - S) / reach together, those
    lower by more give 1 each, and likewise above; so N and S at p - reach, p
    and p + reach are all that is needed.  The three points of a level are
    sorted in among the levels, in slots of a quarter of the reach where the
    group is large.
    """
    points = levels.select(
        *KEYS,
        "levels",
        "pct",
        F.inline(
            F.array(
                F.struct(F.lit("own").alias("point"), F.col("pct").alias("x"), F.col("same").cast("double").alias("c"), (F.col("same") * F.col("pct")).alias("m")),
                F.struct(F.lit("low").alias("point"), (F.col("pct") - reach).alias("x"), F.lit(0.0).alias("c"), F.lit(0.0).alias("m")),
                F.struct(F.lit("high").alias("point"), (F.col("pct") + reach).alias("x"), F.lit(0.0).alias("c"), F.lit(0.0).alias("m")),
            )
        ),
    )
    slot = F.when(F.col("levels") > GROUP, F.floor(F.col("x") / reach * 64)).otherwise(F.lit(0)).cast("int")
    # At one x the level itself comes first, so that it is counted.
    order = [F.col("x"), F.col("c").desc(), F.col("point"), F.col("pct")]
    points = points.withColumn("slot", slot)
    summed = slotted_sum(points, KEYS, "slot", order, "c", "N", also={"m": "S"})
    at = lambda v, k: F.max(F.when(F.col("point") == k, F.col(v)))
    wide = summed.groupBy(*KEYS, "pct").agg(*[at(v, k).alias(f"{v}_{k}") for v in ("N", "S") for k in ("low", "own", "high")])
    p = F.col("pct")
    wins = F.col("N_low") + ((F.col("N_own") - F.col("N_low")) * p - (F.col("S_own") - F.col("S_low"))) / reach
    losses = F.col("all") - F.col("N_high") + ((F.col("S_high") - F.col("S_own")) - (F.col("N_high") - F.col("N_own")) * p) / reach
    joined = levels.join(wide, [*KEYS, "pct"])
    return joined.withColumn("flow", (wins - losses) / F.greatest(F.col("all") - 1, F.lit(1))).select(*KEYS, "score", "pct", "flow")


def _weighted(flow: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``weight``, of the namespace and op_kind; a null map, a missing key and a namespace without policy mean 1.0."""
    policy = policies.groupBy("namespace").agg(F.max(F.to_json("fusion_weights")).alias("j"))
    weights = policy.select("namespace", F.from_json("j", "map<string,double>").alias("w"))
    return flow.join(weights, "namespace", "left").withColumn("weight", F.coalesce(F.element_at("w", F.col("op_kind")), F.lit(1.0))).drop("w")


def _flows_in_place(rows: DataFrame, policies: DataFrame, reach: float) -> DataFrame:
    """Net flows of plans that fit in a task each: one shuffle by plan, and running sums within it.

    Every level stands three times in its method's order of percentiles, as
    itself and moved by ``reach`` either way; the prefix sums at the three
    points are all that its flow needs, so time is that of the sort.
    """
    best = usable(rows.repartition("plan_id"))
    plan = Window.partitionBy("plan_id", "namespace")
    first = F.row_number().over(Window.partitionBy("plan_id", "namespace", "record_id").orderBy("op_kind"))
    method = Window.partitionBy(*KEYS)
    sized = best.withColumn("new", (first == 1).cast("int")).withColumns({"all": F.sum("new").over(plan), "n": F.count("*").over(method)})
    below = F.rank().over(method.orderBy("score")) - 1
    same = F.count("*").over(Window.partitionBy(*KEYS, "score"))
    one = F.row_number().over(Window.partitionBy(*KEYS, "score").orderBy("record_id"))
    missing = F.col("all") - F.col("n")
    ranked = sized.withColumns({"pct": (missing + below + same / 2) / F.col("all"), "none": missing / 2 / F.col("all"), "one": one, "same": same, "missing": missing})
    # The records that the method did not return are one level more; its first record brings it along.
    point = lambda kind, x, c: F.struct(F.lit(kind).alias("point"), x.alias("x"), c.cast("double").alias("c"))
    nil, p, none = F.lit(0), F.col("pct"), F.col("none")
    head = (F.col("one") == 1) & (F.rank().over(method.orderBy("pct")) == 1)
    led = ranked.withColumn("head", head)
    points = F.filter(
        F.array(
            point("own", p, F.lit(1)), point("low", p - reach, nil), point("high", p + reach, nil),
            F.when(F.col("head") & (F.col("missing") > 0), point("none", none, F.col("missing"))),
            F.when(F.col("head") & (F.col("missing") > 0), point("nonehigh", none + reach, nil)),
        ),
        lambda s: s.isNotNull(),
    )
    spread = led.select(*KEYS, "record_id", "all", "n", "missing", "pct", "none", F.inline(points))
    # At one x what has a count comes first; a range frame up to the row takes in all of them.
    upto = method.orderBy("x", F.col("c") == 0)
    summed = spread.withColumns({"count_to": F.sum("c").over(upto), "sum_to": F.sum(F.col("c") * F.col("x")).over(upto)})
    at = lambda v, k: F.max(F.when(F.col("point") == k, F.col(v)))
    wide = summed.groupBy(*KEYS, "record_id").agg(
        *[at(v, k).alias(f"{v}_{k}") for v in ("count_to", "sum_to") for k in ("low", "own", "high", "none", "nonehigh")], *[F.max(c).alias(c) for c in ("all", "n", "missing", "pct", "none")]
    )
    N, S = (lambda k: F.col(f"count_to_{k}")), (lambda k: F.col(f"sum_to_{k}"))
    wins = N("low") + ((N("own") - N("low")) * p - (S("own") - S("low"))) / reach
    losses = F.col("all") - N("high") + ((S("high") - S("own")) - (N("high") - N("own")) * p) / reach
    others = F.greatest(F.col("all") - 1, F.lit(1))
    given = F.col("all") - N("nonehigh") + ((S("nonehigh") - S("none")) - (N("nonehigh") - N("none")) * none) / reach
    flow = wide.select(*KEYS, "record_id", "n", ((wins - losses) / others).alias("flow"), (-given / others).alias("lost"))
    weighted = _weighted(flow.withColumn("lost", F.coalesce(F.max("lost").over(method), F.lit(0.0))), policies)
    # What a record gets for a method that did not return it is the same for all, so it is added once per plan.
    floor = F.sum(F.col("lost") * F.col("weight") / F.col("n")).over(plan)
    gained = weighted.withColumn("floor", floor).groupBy("plan_id", "namespace", "record_id")
    total = gained.agg(F.sum((F.col("flow") - F.col("lost")) * F.col("weight")).alias("gain"), F.max("floor").alias("floor"))
    return total.select("plan_id", "namespace", "record_id", F.round(F.col("gain") + F.col("floor"), 9).alias("net_flow"))


def _flows_in_slots(rows: DataFrame, policies: DataFrame, reach: float) -> DataFrame:
    """The same for plans of any size, none of which is sorted in one place."""
    best = usable(rows)
    levels, _ = percentiles(best)
    weighted = _weighted(net_flow(levels, reach), policies)
    none = weighted.where(F.col("score").isNull()).select(*KEYS, (F.col("flow") * F.col("weight")).alias("none"))
    floor = none.groupBy("plan_id", "namespace").agg(F.sum("none").alias("floor"))
    own = weighted.where(F.col("score").isNotNull()).join(none, KEYS, "left")
    gain = own.select(*KEYS, "score", (F.col("flow") * F.col("weight") - F.coalesce("none", F.lit(0.0))).alias("gain"))
    return (
        best.join(gain, [*KEYS, "score"])
        .groupBy("plan_id", "namespace", "record_id")
        .agg(F.sum("gain").alias("gain"))
        .join(floor, ["plan_id", "namespace"], "left")
        .select("plan_id", "namespace", "record_id", F.round(F.col("gain") + F.coalesce("floor", F.lit(0.0)), 9).alias("net_flow"))
    )


def flows(candidates: DataFrame, policies: DataFrame, reach: float = REACH) -> DataFrame:
    """(plan_id, namespace, record_id, net_flow) for every record that takes part in a plan.

    Net flows are rounded to 9 digits, so that ties don't hang on summing
    order.  All plans are ranked by prefix sums; those of more than ``GROUP``
    rows take them in slots, so that no plan must fit in a task.
    """
    rows = candidates.select("plan_id", "plan_namespace", "namespace", "op_kind", "record_id", "score")
    counts = rows.groupBy("plan_id").agg(F.count("*").alias("n")).where((F.col("n") > GROUP) & F.col("plan_id").isNotNull())
    hot = stage(counts.select("plan_id"), "hot")
    many = hot.count()
    if not many:
        return _flows_in_place(rows, policies, reach)
    # Few names are sent to every task; many are joined by a shuffle.
    hot = F.broadcast(hot) if many <= NAMED else hot
    rest, large = rows.join(hot, "plan_id", "left_anti"), rows.join(hot, "plan_id", "left_semi")
    return _flows_in_place(rest, policies, reach).unionByName(_flows_in_slots(large, policies, reach))


def winners(candidates: DataFrame, policies: DataFrame, reach: float = REACH) -> DataFrame:
    """(plan_id, record_id): the record of highest net flow of each plan, ties to the lowest record_id."""
    first = flows(candidates, policies, reach).groupBy("plan_id").agg(F.min(F.struct((-F.col("net_flow")).alias("f"), "record_id")).alias("b"))
    return first.select("plan_id", "b.record_id")


def ranking(candidates: DataFrame, policies: DataFrame, reach: float = REACH) -> DataFrame:
    """(plan_id, record_id, net_flow, position), positions from 1; a plan of any size is ranked in slots."""
    f = flows(candidates, policies, reach)
    sizes = f.groupBy("plan_id").agg(F.count("*").alias("n"), F.percentile_approx("net_flow", [i / 64 for i in range(1, 64)], 1000).alias("edges"))
    sized = f.join(sizes, "plan_id").withColumn("one", F.lit(1))
    slot = F.when(F.col("n") > GROUP, F.size(F.filter("edges", lambda e: e > F.col("net_flow")))).otherwise(F.lit(0))
    placed = sized.withColumn("slot", slot).drop("edges")
    out = slotted_sum(placed, ["plan_id"], "slot", [F.col("net_flow").desc(), F.col("record_id")], "one", "position")
    return out.select("plan_id", "record_id", "net_flow", F.col("position").cast("long").alias("position"))
