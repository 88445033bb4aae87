"""Operators on ordered rows: islands, gaps, sweeps, weighted quantiles, chains, running choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.sources.scratch import written


def islands(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Add run: the number, from 1, of each stretch of equal neighbouring values within a group."""
    line = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(line).eqNullSafe(F.col(value)) & (F.row_number().over(line) > 1), 0).otherwise(1)
    return rows.withColumn("is_new", new).withColumn("run", F.sum("is_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("is_new")


def curve_support(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group, the share of true values, less where they are scattered: times the longest run of them over .4 of
    all, 1 at most."""
    runs = islands(rows, group, order, value).groupBy(group, "run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("long")).alias("hits"))
    by = runs.groupBy(group).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.max("hits").alias("longest"))
    return by.select(group, (F.col("hits") / F.col("n") * F.least(F.lit(1.0), F.col("longest") / (0.4 * F.col("n")))).alias("support"))


def sweep_merge(rows: DataFrame, group: list[str], low: str, high: str, reach: float = 0) -> DataFrame:
    """Merge intervals that overlap or lie within ``reach``: one row of group, low, high and parts for each."""
    line = Window.partitionBy(*group).orderBy(low, high)
    seen = F.max(high).over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col(low) <= seen + F.lit(reach), 0).otherwise(1)
    numbered = rows.withColumn("is_start", starts).withColumn("part", F.sum("is_start").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "part").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("parts")).drop("part")


def weighted_quantile(rows: DataFrame, group: str, value: str, weight: Column, q: float) -> DataFrame:
    """The first value at which the running weight reaches q of the whole; equal values are summed before they are ordered."""
    summed = rows.groupBy(group, value).agg(F.sum(weight).alias("mass"))
    line = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = summed.withColumn("so_far", F.sum("mass").over(line)).withColumn("whole", F.sum("mass").over(Window.partitionBy(group)))
    return summed.where(F.col("so_far") >= F.lit(q) * F.col("whole")).groupBy(group).agg(F.min(value).alias("quantile"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value of each group, the upper of two, from counts of equal values; no interpolation."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).count()
    line = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"so_far": F.sum("count").over(line), "whole": F.sum("count").over(Window.partitionBy(group))})
    return placed.where(F.col("so_far") > F.floor(F.col("whole") / 2)).groupBy(group).agg(F.min(value).alias("middle"))


def numbered(rows: DataFrame, group: str, value: str, tie: str, step: float) -> DataFrame:
    """Adds nth: the place of a row in its group by value, then tie, counted from 1.

    Counted in two levels, slices of the value and rows of a slice, so that a group may be far larger than a task.
    """
    sliced = rows.withColumn("slice", F.floor(F.col(value) / F.lit(step)).cast("long"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(group, "slice").count().select(group, "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(group, "slice").orderBy(value, tie))
    return sliced.withColumn("place", within).join(starts, [group, "slice"]).withColumn("nth", F.col("start") + F.col("place")).drop("slice", "place", "start")


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], slack: float = 0.001) -> DataFrame:
    """Exact interpolated percentiles of each group, a column each.

    A sketch gives two values that the wanted places lie between; what lies below is counted, and only the rows
    between the two are ordered. A place that the sketch missed would come out null, which the sketch's error bound of
    a ten-thousandth excludes.
    """
    rows = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    near = F.percentile_approx("v", [p for q in shares.values() for p in (max(0.0, q - slack), min(1.0, q + slack))], 10_000)
    ends = rows.groupBy(group).agg(near.alias("near"), F.count(F.lit(1)).alias("n"))
    out = ends.select(group)
    both = rows.join(F.broadcast(ends), group)  # one row for each group: groups of this operator are few and large
    for i, (name, q) in enumerate(shares.items()):
        low, high = F.get("near", F.lit(2 * i)), F.get("near", F.lit(2 * i + 1))
        at = F.lit(q) * (F.col("n") - 1)
        below = both.groupBy(group).agg(F.sum((F.col("v") < low).cast("long")).alias("below"), F.min(F.when(F.col("v") > high, F.col("v"))).alias("after"))
        inside = both.where(F.col("v").between(low, high)).groupBy(group, "v", "n").count().join(F.broadcast(below), group)
        upto = F.sum("count").over(Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = inside.withColumn("last", F.col("below") + upto - 1).withColumn("first", F.col("last") - F.col("count") + 1)
        holds = lambda p: F.max(F.when(p.between(F.col("first"), F.col("last")), F.col("v")))
        got = placed.groupBy(group, "n").agg(holds(F.floor(at)).alias("x"), F.coalesce(holds(F.ceil(at)), F.first("after")).alias("y"))  # the next place may be the next value
        out = out.join(got.select(group, (F.col("x") + (F.col("y") - F.col("x")) * (at - F.floor(at))).alias(name)), group)
    return out


def consensus(rows: DataFrame, group: str, value: str, share: float, least: int) -> DataFrame:
    """The largest cluster of values within ``share`` of an anchor among them, and its median; smaller anchors win ties."""
    a = rows.select(F.col(group), F.col(value).alias("anchor"))
    b = rows.select(F.col(group).alias("g"), F.col(value).alias("near"))
    met = a.distinct().join(b, (F.col(group) == F.col("g")) & (F.abs(F.col("near") - F.col("anchor")) <= F.lit(share) * F.col("anchor")))
    found = met.groupBy(group, "anchor").agg(F.count(F.lit(1)).alias("votes"), F.median("near").alias("middle")).where(F.col("votes") >= least)
    return found.groupBy(group).agg(F.max_by(F.struct("anchor", "votes", "middle"), F.struct("votes", -F.col("anchor"))).alias("best")).select(group, "best.*")


def running_choice(rows: DataFrame, group: str, order: list[str], score: str, item: str, gain: float) -> DataFrame:
    """Scan a group's rows in order; replace the choice only by a score better by ``gain`` at least."""
    line = F.array_sort(F.collect_list(F.struct(*order, F.col(score).alias("score"), F.col(item).alias("item"))))
    start = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast(rows.schema[item].dataType).alias("item"))

    def step(best, x):
        better = best["score"].isNull() | (x["score"] >= best["score"] + F.lit(gain))
        return F.when(better, F.struct(x["score"].cast("double").alias("score"), x["item"].alias("item"))).otherwise(best)

    folded = F.aggregate("line", start, step)
    return rows.groupBy(group).agg(line.alias("line")).select(group, folded["item"].alias(item), folded["score"].alias(score))


def peaks(rows: DataFrame, bin_col: str, weight: str, bins: int, least_share: float) -> DataFrame:
    """Bins of a circular histogram that outweigh the bin before and are no lighter than the one after."""
    sums = rows.groupBy(bin_col).agg(F.sum(weight).alias("mass"))
    full = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias(bin_col)).join(sums, bin_col, "left").fillna(0, ["mass"])
    side = lambda step, name: full.select(F.pmod(F.col(bin_col) + F.lit(step), F.lit(bins)).cast("int").alias(bin_col), F.col("mass").alias(name))
    whole = sums.agg(F.sum("mass").alias("whole"))  # one row
    met = full.join(side(1, "before"), bin_col).join(side(-1, "after"), bin_col).join(F.broadcast(whole), F.lit(True))
    return met.where((F.col("mass") > F.col("before")) & (F.col("mass") >= F.col("after")) & (F.col("mass") >= F.lit(least_share) * F.col("whole"))).select(bin_col, "mass")


def otsu(rows: DataFrame, group: str, level: str) -> DataFrame:
    """The level of each group's histogram that best splits it in two (levels up to it, levels above), least of equals."""
    n = rows.groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
    mass = F.col("n") * F.col(level)
    s = n.withColumns({"w": F.sum("n").over(upto), "m": F.sum(mass).over(upto), "w_all": F.sum("n").over(whole), "m_all": F.sum(mass).over(whole)})
    step = F.col("m") * F.col("w_all") - F.col("m_all") * F.col("w")
    between = step.cast("double") * step / (F.col("w") * (F.col("w_all") - F.col("w")))
    return s.where("w < w_all").groupBy(group).agg(F.max_by(level, F.struct(F.bround(between, 6), -F.col(level))).alias("threshold"))


def first_plateau(rows: DataFrame, group: str, order: str, value: str, share: float) -> DataFrame:
    """The first place of each group from which two steps in a row change the value by less than a share of it."""
    line = Window.partitionBy(group).orderBy(order)
    next1, next2 = F.lead(value, 1).over(line), F.lead(value, 2).over(line)
    flat = (F.abs(next1 - F.col(value)) < F.lit(share) * F.col(value)) & (F.abs(next2 - next1) < F.lit(share) * next1)
    return rows.select(group, F.when(flat, F.col(order)).alias("at")).groupBy(group).agg(F.min("at").alias("at")).where("at IS NOT NULL")


def elementary(rows: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Intervals cut at every end point of their group: pieces with the number of intervals over each, where any is."""
    ends = rows.select(*group, F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("step")), F.struct(F.col(high).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    at = ends.groupBy(*group, F.col("e.at").alias(low)).agg(F.sum("e.step").alias("step"))
    line = Window.partitionBy(*group).orderBy(low)
    cut = at.select(*group, low, F.lead(low).over(line).alias(high), F.sum("step").over(line).alias("covers"))
    return cut.where(F.col(high).isNotNull() & (F.col("covers") > 0))


def paying_rows(rows: DataFrame, group: str, value: str, tie: str, hit: Column, batch: int = 8, most: int = 60, after: int = 16, one_in: int = 12, step: float = 1024) -> DataFrame:
    """Rows that a budget lets through, in batches by value and tie: ``most`` of a group, and none from the first batch
    before which, ``after`` rows or more, there was no hit or fewer than one in ``one_in``."""
    placed = numbered(rows.withColumn("hit", hit.cast("long")), group, value, tie, step).withColumn("batch", F.floor((F.col("nth") - 1) / batch)).where(F.col("nth") <= most)
    line = Window.partitionBy(group).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    by = placed.groupBy(group, "batch").agg(F.sum("hit").alias("hits")).withColumn("before", F.coalesce(F.sum("hits").over(line), F.lit(0)))
    read = F.col("batch") * batch
    poor = by.where((read >= after) & (F.col("before") < F.greatest(F.lit(1.0), read / one_in))).groupBy(group).agg(F.min("batch").alias("stop"))
    return placed.join(poor, group, "left").where("stop IS NULL OR batch < stop").drop("stop", "hit")


def weighted_classes(rows: DataFrame, group: str, value: str, weight: str, tolerance: float = 0.18, share: float = 0.12, rounds: int = 3) -> DataFrame:
    """Up to ``rounds`` classes of values per group: the whole number with the most weight within tolerance x it + 1 (of
    equals the least) draws the rows there, whose weighted mean is the class, until one holds less than ``share`` of all."""
    left = rows.groupBy(group, F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("m"))
    total = left.groupBy(group).agg(F.sum("m").alias("whole"))
    left, out = written(left, "classes"), None
    for n in range(1, rounds + 1):
        at = F.explode(F.sequence(F.floor((F.col("v") - 1) / (1 + tolerance)), F.ceil((F.col("v") + 1) / (1 - tolerance))))
        near = left.withColumn("c", at).where(F.abs(F.col("v") - F.col("c")) <= tolerance * F.col("c") + 1)
        seats = left.select(group, F.rint("v").cast("long").alias("c")).distinct()
        sums = near.join(seats, [group, "c"], "left_semi").groupBy(group, "c").agg(F.sum("m").alias("mass"))
        best = sums.groupBy(group).agg(F.max(F.struct("mass", (-F.col("c")).alias("less"))).alias("b")).join(total, group)
        best = best.where((F.col("b.mass") > 0) & (F.col("b.mass") >= share * F.col("whole"))).select(group, (-F.col("b.less")).alias("c"))
        left = written(left.join(best, group).withColumn("drawn", F.abs(F.col("v") - F.col("c")) <= tolerance * F.col("c") + 1).drop("c"), "classes")  # groups without a class end
        made = left.where("drawn").groupBy(group).agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("middle"), F.sum("m").alias("mass")).withColumn("nth", F.lit(n))
        out, left = made if out is None else out.unionByName(made), left.where("NOT drawn").drop("drawn")
    return out


def scale_of_rooms(rooms: DataFrame) -> DataFrame:
    """Per plan, pixels of a unit from rooms (plan, space, pixels, side_a, side_b, unit): the square roots of a space's pixels
    over its printed area where it has one name, plausible sides and a root of 20 to 120; the median of the unit (ft or m)
    with more of them, ft of equals, and their number."""
    one = rooms.withColumn("names", F.count(F.lit(1)).over(Window.partitionBy("plan", "space"))).where("names = 1 AND pixels > 0")
    one = one.where("least(side_a, side_b) >= CASE WHEN unit = 'ft' THEN 2.5D ELSE 0.75D END").withColumn("root", F.sqrt(F.col("pixels") / (F.col("side_a") * F.col("side_b")))).where("root BETWEEN 20 AND 120")
    by = one.groupBy("plan", "unit").agg(F.count(F.lit(1)).alias("rooms"), F.median("root").alias("middle"))
    best = by.groupBy("plan").agg(F.max(F.struct("rooms", (F.col("unit") == "ft").alias("feet"), "unit", "middle")).alias("b"))
    return best.select("plan", "b.unit", F.bround("b.middle", 2).alias("pixels_per_unit"), "b.rooms")
