"""Joins on boxes, bands and points. A grid turns a spatial rule into an equi-join on cells plus the exact rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def cells(boxes: DataFrame, size: int, grow: int = 0) -> DataFrame:
    """One row for each cell that a box, grown on all sides, touches: adds cx, cy.

    Spark's size estimate of these rows is that of the boxes, however many cells they touch, so a join of them may not
    be broadcast by it: the hint shuffles both sides, and adaptive execution splits cells that hold many rows.
    """
    at = lambda v: F.floor((v) / F.lit(size)).cast("int")
    span = lambda p, d: F.sequence(at(F.col(p) - grow), at(F.col(p) + F.col(d) + grow))
    return boxes.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h"))).hint("merge")


def met_on_grid(left: DataFrame, right: DataFrame, size: int, grow: float = 0, keys: list[str] | None = None) -> DataFrame:
    """Rows of aliases l and r with equal keys whose boxes, the left one grown on all sides, share a cell: a superset
    of those that touch. Each pair is met in the first cell that it shares, so none comes twice."""
    a, b = cells(left, size, grow).alias("l"), cells(right, size).alias("r")
    at = lambda v: F.floor(v / F.lit(size)).cast("int")
    first = lambda p: F.greatest(at(F.col(f"l.{p}") - grow), at(F.col(f"r.{p}")))
    met = (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))
    for k in keys or ():
        met &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return a.join(b, met).where((F.col("l.cx") == first("x")) & (F.col("l.cy") == first("y")))


def grown(boxes: DataFrame, by: Column) -> DataFrame:
    """Boxes grown on all sides, each by its own number of whole units; the boxes as they were stand in ``own``."""
    was = boxes.withColumn("own", F.struct(*BOX))
    return was.withColumns({"x": F.col("own.x") - by, "y": F.col("own.y") - by, "w": F.col("own.w") + 2 * by, "h": F.col("own.h") + 2 * by})


def grid_join(left: DataFrame, right: DataFrame, rule: Column, size: int, left_id: str, right_id: str, grow: float = 0, keys: list[str] | None = None) -> DataFrame:
    """Pairs (left_id, right_id) of boxes that satisfy ``rule`` over aliases l and r; rule must imply that the grown
    left box touches the right one."""
    return met_on_grid(left, right, size, grow, keys).where(rule).select(F.col(f"l.{left_id}").alias("left_id"), F.col(f"r.{right_id}").alias("right_id"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, most: float, rule: Column | None = None) -> DataFrame:
    """Rows of aliases l and r with equal keys and values at most ``most`` apart: an equi-join on value buckets.

    The right side stands in its own bucket and both neighbours, so each pair is met exactly once.
    """
    bucket = lambda: F.floor(F.col(value) / F.lit(most)).cast("long")
    a = left.withColumn("bucket", bucket()).alias("l")
    b = right.withColumn("bucket", F.explode(F.array(bucket() - 1, bucket(), bucket() + 1))).alias("r")
    on = F.col("l.bucket") == F.col("r.bucket")
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    out = a.join(b, on).where(F.abs(F.col(f"l.{value}") - F.col(f"r.{value}")) <= most)
    return out.where(rule) if rule is not None else out


def nearest_on_line(points: DataFrame, hosts: DataFrame, point_id: str, host_id: str, keys: list[str], value: str, most: float) -> DataFrame:
    """Each point's nearest host with equal keys, by a value that both have, within ``most``; of equals the least id."""
    met = band_join(points, hosts, keys, value, most)
    rank = F.struct(F.abs(F.col(f"l.{value}") - F.col(f"r.{value}")).alias("distance"), F.col(f"r.{host_id}").alias(host_id))
    best = met.groupBy(F.col(f"l.{point_id}").alias(point_id)).agg(F.min(rank).alias("b"))
    return best.select(point_id, f"b.{host_id}", "b.distance")


def smallest_holder(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, size: int) -> DataFrame:
    """The smallest box (then the lowest id) that holds each point, edges included; null where none does."""
    spots = points.select(point_id, "px", "py", F.floor(F.col("px") / size).cast("int").alias("cx"), F.floor(F.col("py") / size).cast("int").alias("cy"))
    met = spots.alias("p").join(cells(boxes, size).alias("b"), ["cx", "cy"])
    inside = F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))
    best = met.where(inside).groupBy(point_id).agg(F.min(F.struct((F.col("w") * F.col("h")).alias("area"), F.col(box_id).alias("id"))).alias("b"))
    return points.select(point_id).join(best, point_id, "left").select(point_id, F.col("b.id").alias(box_id))


def keep_apart(first: DataFrame, second: DataFrame, keys: list[str], overlaps: Column) -> DataFrame:
    """All of ``first`` and the rows of ``second`` that overlap none of it (aliases s and f), by name."""
    on = overlaps
    for k in keys:
        on = (F.col(f"s.{k}") == F.col(f"f.{k}")) & on
    return first.unionByName(second.alias("s").join(first.alias("f"), on, "left_anti"))
