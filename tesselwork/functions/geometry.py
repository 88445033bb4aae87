"""Segments, boxes, intervals and polygons as column expressions.

A segment is four numbers x0, y0, x1, y1; a box is x, y, w, h; a polygon is an array of structs (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def undirected_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two undirected directions."""
    turn = F.pmod(a - b, F.lit(180.0))
    return F.least(turn, F.lit(180.0) - turn)


def orientation(angle: Column, tolerance: float = 10.0) -> Column:
    flat = F.least(angle, F.lit(180.0) - angle) <= tolerance
    return F.when(flat, "horizontal").when(F.abs(angle - 90.0) <= tolerance, "vertical").otherwise("diagonal")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance between intervals; zero where they touch."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.greatest(square, F.lit(1e-300)))))
    return length(px, py, x0 + t * dx, y0 + t * dy)


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """(along, offset) in the frame of a direction."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return x * c + y * s, y * c - x * s


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """struct(x, y) of two lines' crossing; null where they are parallel."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = a, b
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    p, q = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(d != 0, F.struct(((p * (x3 - x4) - (x1 - x2) * q) / d).alias("x"), ((p * (y3 - y4) - (y1 - y2) * q) / d).alias("y")))


def box_intersection(a: str, b: str) -> Column:
    """Common area of boxes held in columns of two aliases."""
    c = lambda t, n: F.col(f"{t}.{n}")
    wide = overlap(c(a, "x"), c(a, "x") + c(a, "w"), c(b, "x"), c(b, "x") + c(b, "w"))
    return wide * overlap(c(a, "y"), c(a, "y") + c(a, "h"), c(b, "y"), c(b, "y") + c(b, "h"))


def signed_area(points: Column) -> Column:
    """Shoelace sum of a polygon, halved."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def perimeter(points: Column) -> Column:
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda p, q: length(p["x"], p["y"], q["x"], q["y"])), F.lit(0.0), lambda s, v: s + v)


def bounds(points: Column) -> Column:
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def contains(points: Column, px: Column, py: Column) -> Column:
    """Even-odd rule; a point on the outline is inside."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))

    def crosses(p, q):
        spans = (p["y"] > py) != (q["y"] > py)
        at = p["x"] + (py - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return F.when(spans & (px < at), F.lit(1)).otherwise(F.lit(0))

    def touches(p, q):
        on = (q["x"] - p["x"]) * (py - p["y"]) == (q["y"] - p["y"]) * (px - p["x"])
        return on & px.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & py.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    odd = F.aggregate(F.zip_with(points, after, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1
    return odd | F.exists(F.zip_with(points, after, touches), lambda t: t)


def cubic_arc(p0: Column, c1: Column, c2: Column, p3: Column) -> Column:
    """struct(x, y, radius, sweep) of the circle whose arc a cubic curve draws; null where it draws none: the centre lies
    where the normals at its ends meet, and its ends and its middle are as far from it, within .08 of the radius."""
    ux, uy, vx, vy = c1["x"] - p0["x"], c1["y"] - p0["y"], p3["x"] - c2["x"], p3["y"] - c2["y"]
    det = uy * vx - ux * vy  # of the normals (-uy, ux) and (vy, -vx)
    s = ((p3["x"] - p0["x"]) * -vx - (p3["y"] - p0["y"]) * vy) / F.when(F.abs(det) >= 1e-9, det)
    x, y = p0["x"] + s * -uy, p0["y"] + s * ux
    r0, r3 = length(x, y, p0["x"], p0["y"]), length(x, y, p3["x"], p3["y"])
    mid = lambda k: (p0[k] + 3 * c1[k] + 3 * c2[k] + p3[k]) / 8
    off = F.abs(length(x, y, mid("x"), mid("y")) - r0)
    turn = F.degrees(F.atan2(p3["y"] - y, p3["x"] - x) - F.atan2(p0["y"] - y, p0["x"] - x))
    sweep = F.abs(F.pmod(turn + 180, F.lit(360.0)) - 180)
    ends = (F.hypot(ux, uy) >= 1e-6) & (F.hypot(vx, vy) >= 1e-6)
    round_ = ends & (r0 >= 1) & (F.abs(r0 - r3) <= 0.08 * r0) & (off <= 0.08 * r0)
    return F.when(round_, F.struct(x.alias("x"), y.alias("y"), ((r0 + r3) / 2).alias("radius"), sweep.alias("sweep")))


def gap_pieces(cuts: Column, gap: Column, least: Column) -> Column:
    """A gap cut at places along it, as an array of struct(low, high): a cut less than ``least`` beyond the last one is
    passed over, and a rest shorter than that joins the piece before it. Both ends are double."""
    zero = F.lit(0.0)
    kept = F.aggregate(F.array_sort(cuts), F.array(zero), lambda a, c: F.when(c - F.element_at(a, -1) >= least, F.concat(a, F.array(c))).otherwise(a))
    points = F.when(gap - F.element_at(kept, -1) < least, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(gap))).otherwise(F.concat(kept, F.array(gap)))
    whole = F.when(F.size(cuts) == 0, F.array(zero, gap)).otherwise(points)
    return F.zip_with(F.slice(whole, 1, F.size(whole) - 1), F.slice(whole, 2, F.size(whole)), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
