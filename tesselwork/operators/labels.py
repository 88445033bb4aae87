"""Texts on a drawing and the spaces that they name: label to space, votes of a label's points, sizes below a name,
functional zones from objects and labels. Pairs meet on a grid; spaces are polygons with their box and area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.functions import geometry
from tesselwork.operators import graph, spatial

CELL = 64


def _holders(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """Points (plan, x, y, w = h = 0) with each space (plan, id, shape, area) that holds them, edges included."""
    met = spatial.met_on_grid(points, spaces, CELL, 0, ["plan"])
    return met.where(geometry.contains(F.col("r.shape"), F.col("l.x"), F.col("l.y")))


def _points(labels: DataFrame, x: Column, y: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    return labels.select("plan", "id", x.alias("x"), y.alias("y"), zero.alias("w"), zero.alias("h"))


def to_space(labels: DataFrame, spaces: DataFrame, reach: int = 35) -> DataFrame:
    """plan, id, space and score of every label (its centre px, py): the smallest space that holds it, score 1; else
    the space whose box is nearest within ``reach``, score 1 - distance / reach; else none, score 0."""
    at = _points(labels, F.col("px"), F.col("py"))
    held = _holders(at, spaces).groupBy(F.col("l.plan").alias("plan"), F.col("l.id").alias("id")).agg(F.min(F.struct("r.area", "r.id")).alias("b"))
    held = held.select("plan", "id", F.col("b.id").alias("inner"))
    gap = lambda p, d: F.greatest(F.lit(0), F.col(f"r.{p}") - F.col(f"l.{p}"), F.col(f"l.{p}") - F.col(f"r.{p}") - F.col(f"r.{d}"))
    far = F.sqrt(gap("x", "w") * gap("x", "w") + gap("y", "h") * gap("y", "h"))
    loose = at.join(held.select("plan", "id"), ["plan", "id"], "left_anti")
    near = spatial.met_on_grid(loose, spaces, CELL, reach, ["plan"]).withColumn("far", far).where(F.col("far") <= reach)
    near = near.groupBy(F.col("l.plan").alias("plan"), F.col("l.id").alias("id")).agg(F.min(F.struct("far", "r.id")).alias("n"))
    out = labels.select("plan", "id").join(held, ["plan", "id"], "left").join(near, ["plan", "id"], "left")
    score = F.when(F.col("inner").isNotNull(), 1.0).when(F.col("n").isNotNull(), F.bround(1 - F.col("n.far") / reach, 3)).otherwise(0.0)
    return out.select("plan", "id", F.coalesce("inner", "n.id").alias("space"), score.alias("score"))


def by_points(labels: DataFrame, spaces: DataFrame) -> DataFrame:
    """plan, id and space of every label (box x, y, w, h): the smallest space that holds its centre; where none does,
    six points of the box vote, and the smallest of those with most votes takes it; else none."""
    mid = lambda p, d, share: F.col(p) + F.floor(F.col(d) * share)
    at = _points(labels, mid("x", "w", 0.5), mid("y", "h", 0.5))
    key = [F.col("l.plan").alias("plan"), F.col("l.id").alias("id")]
    held = _holders(at, spaces).groupBy(*key).agg(F.min(F.struct("r.area", "r.id")).alias("b")).select("plan", "id", F.col("b.id").alias("inner"))
    spots = F.explode(F.array(*[F.struct(mid("x", "w", fx).alias("x"), mid("y", "h", fy).alias("y")) for fx in (0.25, 0.5, 0.75) for fy in (0.3, 0.7)]))
    loose = labels.join(held.select("plan", "id"), ["plan", "id"], "left_anti").withColumn("spot", spots)
    votes = _holders(_points(loose, F.col("spot.x"), F.col("spot.y")), spaces).groupBy(*key, F.col("r.id").alias("space"), F.col("r.area").alias("area")).count()
    voted = votes.groupBy("plan", "id").agg(F.min(F.struct((-F.col("count")).alias("less"), "area", "space")).alias("v"))
    out = labels.select("plan", "id").join(held, ["plan", "id"], "left").join(voted, ["plan", "id"], "left")
    return out.select("plan", "id", F.coalesce("inner", "v.space").alias("space"), F.when(F.col("inner").isNull(), -F.col("v.less")).alias("votes"))


def size_of_label(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """plan, id, size and score: of the printed sizes (box and confidence) from 8 above to 155 below a label's lower
    edge, near its middle or under it, the one that scores lowest by distance, overlap and doubt."""
    reach = F.greatest(F.lit(210.0), F.col("w") * 1.4)
    middle, right = F.col("x") + F.col("w") / 2, F.col("x") + F.col("w")
    window = labels.select(
        "plan", "id", F.col("x").alias("lx"), F.col("w").alias("lw"), (F.col("y") + F.col("h")).alias("bottom"), reach.alias("reach"), middle.alias("middle"),
        F.least(F.col("x"), middle - reach).alias("x"), (F.col("y") + F.col("h") - 8).alias("y"), (F.greatest(right, middle + reach) - F.least(F.col("x"), middle - reach)).alias("w"), F.lit(163).alias("h"),
    )
    tops = sizes.select("plan", "id", "x", "y", "w", F.lit(0).alias("h"), "confidence")
    met = spatial.met_on_grid(window, tops, 128, 0, ["plan"]).selectExpr(
        "l.plan", "l.id", "r.id AS size", "r.y - l.bottom AS dy", "abs(r.x + r.w / 2 - l.middle) AS dx", "greatest(0, least(l.lx + l.lw, r.x + r.w) - greatest(l.lx, r.x)) AS overlap",
        "l.reach", "l.lw", "r.w", "r.confidence",
    )
    met = met.where("dy BETWEEN -8 AND 155 AND (dx <= reach OR overlap > 0)")
    score = "dy / 120D + dx / greatest(120D, lw) * 0.45D + 0.2D * (1 - overlap / greatest(1D, least(w, lw))) + greatest(0, 75 - confidence) / 250D"
    best = met.selectExpr("*", f"{score} AS score").groupBy("plan", "id").agg(F.min(F.struct("score", "size")).alias("b"))
    return best.select("plan", "id", "b.size", "b.score")


def zone_clusters(items: DataFrame, gap: float, decisive: list[str]) -> DataFrame:
    """Evidence clusters of a space's functions: plan, function, cluster (its least item), items, support, decided.

    ``items`` has plan (the space), id, function, kind, weight and a box; kind 'label' is a printed name. An object
    whose box holds the middle of a label of another function keeps .3 of its weight. Items of a function and
    a weight of .3 or more cluster where their boxes lie within ``gap``; repeats of a kind count whole, .3, .3 and
    no more. A cluster stands with a support of 1 and two items, a decisive object of .8, or a label.
    """
    label = F.col("kind") == "label"
    mids = items.where(label).select("plan", "function", "id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), F.lit(0).alias("w"), F.lit(0).alias("h"))
    inside = (F.col("l.x").between(F.col("r.x"), F.col("r.x") + F.col("r.w"))) & (F.col("l.y").between(F.col("r.y"), F.col("r.y") + F.col("r.h")))
    against = spatial.met_on_grid(mids, items.where(~label), 128, 0, ["plan"]).where(inside & (F.col("l.function") != F.col("r.function")))
    against = against.select(F.col("r.id").alias("id")).distinct().withColumn("less", F.lit(0.3))
    weighed = items.join(against, "id", "left").withColumn("weight", F.col("weight") * F.coalesce("less", F.lit(1.0))).where("weight >= 0.3D").drop("less")
    apart = lambda p, d: F.greatest(F.lit(0), F.greatest(f"l.{p}", f"r.{p}") - F.least(F.col(f"l.{p}") + F.col(f"l.{d}"), F.col(f"r.{p}") + F.col(f"r.{d}")))
    met = spatial.met_on_grid(weighed, weighed, max(CELL, int(gap)), int(gap) + 1, ["plan", "function"]).where("l.id < r.id")
    met = met.where(apart("x", "w") * apart("x", "w") + apart("y", "h") * apart("y", "h") <= gap * gap).selectExpr("l.id AS a", "r.id AS b")
    parts = graph.components(met).withColumnRenamed("node", "id")
    held = weighed.join(parts, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    nth = F.row_number().over(Window.partitionBy("plan", "function", "cluster", "kind").orderBy(F.desc("weight"), "id"))
    part = F.when(F.col("nth") == 1, F.col("weight")).when(F.col("nth") <= 3, 0.3 * F.col("weight")).otherwise(0.0)
    strong = F.max(F.col("kind").isin(decisive) & (F.col("weight") >= 0.8) | label)
    by = held.withColumn("nth", nth).groupBy("plan", "function", "cluster").agg(F.count(F.lit(1)).alias("items"), F.sum(part).alias("support"), strong.alias("decided"))
    return by.where((F.col("support") >= 1) & ((F.col("items") >= 2) | F.col("decided")))


def space_functions(clusters: DataFrame, open_functions: list[str]) -> DataFrame:
    """Per space: how many zones it has (clusters of open functions, where there are two or more), else the function
    of its best decided cluster, with its confidence."""
    open_ = F.col("function").isin(open_functions)
    decided = F.struct("support", (-F.col("cluster")).alias("c"), "function")
    by = clusters.groupBy("plan").agg(F.sum(open_.cast("long")).alias("zones"), F.max(F.when(F.col("decided"), decided)).alias("best"))
    single = F.col("zones") < 2
    return by.select(
        "plan", F.when(single, 0).otherwise(F.col("zones")).alias("zones"), F.when(single, F.col("best.function")).alias("function"),
        F.when(single, F.bround(1 - F.exp(-F.col("best.support")), 2)).alias("confidence"),
    )
