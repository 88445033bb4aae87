"""Openings and drawn lines as segments (plan, id, x0, y0, x1, y1, thickness): what cuts them, which are one opening, which
belong to a pattern. Pairs meet on a grid; the reach of a rule follows from the thickest and the longest segment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.operators import graph, select, spatial
from tesselwork.operators.walls import CELL, framed, thickest, to_segment, turn
from tesselwork.sources.scratch import written


def _longest(framed_rows: DataFrame) -> float:
    return float(framed_rows.agg(F.max("length")).first()[0] or 0.0)  # one number


def _from_left(k: int) -> str:
    """End k of r along l, from l's start."""
    return f"((r.x{k} - l.x0) * l.ux + (r.y{k} - l.y0) * l.uy)"


COMMON = f"least(l.length, greatest({_from_left(0)}, {_from_left(1)})) - greatest(0D, least({_from_left(0)}, {_from_left(1)}))"
DOT = "abs(l.ux * r.ux + l.uy * r.uy)"
ACROSS = "abs((r.my - l.my) * l.ux - (r.mx - l.mx) * l.uy)"


def cut_by_walls(segments: DataFrame, walls: DataFrame) -> DataFrame:
    """plan and id of the segments that run through a wall: at 20 degrees or more, between .15 and .85 of their length,
    within half the wall's thickness of its axis. ``skip``, an array of wall ids, names a segment's own walls."""
    reach = math.ceil(0.5 * thickest(walls)) + 1
    met = spatial.met_on_grid(framed(segments), framed(walls), CELL, reach, ["plan"])
    met = met.where(f"{turn('l', 'r')} >= 20 AND NOT coalesce(array_contains(l.skip, r.id), false)")
    at = "((r.x0 - l.x0) * r.uy - (r.y0 - l.y0) * r.ux) / (l.ux * r.uy - l.uy * r.ux)"
    met = met.selectExpr("*", f"{at} AS s").where("s > 0.15D * l.length AND s < 0.85D * l.length")
    return met.where(f"{to_segment('(l.x0 + s * l.ux)', '(l.y0 + s * l.uy)', 'r')} <= 0.5D * r.thickness").select("l.plan", "l.id").distinct()


def same_openings(openings: DataFrame) -> DataFrame:
    """Pairs a < b of one opening: parallel, on one axis, and overlapping by half of the shorter along the first."""
    f = framed(openings)
    reach = math.ceil(0.75 * max(3.0, thickest(openings)) + 0.17 * _longest(f)) + 1  # the second's middle may lie beyond the first
    met = spatial.met_on_grid(f, f, CELL, reach, ["plan"]).where(f"l.id < r.id AND {DOT} >= 0.95D AND {ACROSS} <= 0.75D * greatest(l.thickness, r.thickness, 3D)")
    return met.where(f"{COMMON} >= 0.5D * least(l.length, r.length)").selectExpr("l.id AS a", "r.id AS b")


def same_drawn_lines(lines: DataFrame, thickness: float) -> DataFrame:
    """Pairs a < b of one drawn line that was traced twice: within 15 degrees, crossing inside both, middles within a
    quarter of the shorter along the second and .4 of the walls' thickness across it."""
    f = framed(lines)
    side = lambda o, u, v, i, j: f"(({u}.x{i} - {o}.x0) * ({v}.y{j} - {o}.y0) - ({u}.y{i} - {o}.y0) * ({v}.x{j} - {o}.x0))"
    met = spatial.met_on_grid(f, f, CELL, 0, ["plan"]).where(f"l.id < r.id AND {DOT} >= 0.966D")
    met = met.where(f"{side('r', 'r', 'l', 1, 0)} * {side('r', 'r', 'l', 1, 1)} < 0 AND {side('l', 'l', 'r', 1, 0)} * {side('l', 'l', 'r', 1, 1)} < 0")
    met = met.where("abs((l.mx - r.mx) * r.ux + (l.my - r.my) * r.uy) <= 0.25D * least(l.length, r.length)")
    return met.where(f"abs((l.my - r.my) * r.ux - (l.mx - r.mx) * r.uy) < {0.4 * thickness}D").selectExpr("l.id AS a", "r.id AS b")


def doors_first(closures: DataFrame, thickness: float) -> DataFrame:
    """id of one closure for each gap: doors before others, then by id; a closure goes if its middle lies within
    three quarters of the walls' thickness (6 at least) of one that stays. ``closures`` has kind."""
    reach = max(6.0, 0.75 * thickness)
    zero = F.lit(0)
    at = framed(closures).select("plan", "id", F.col("mx").alias("x"), F.col("my").alias("y"), zero.alias("w"), zero.alias("h"))
    met = spatial.met_on_grid(at, at, CELL, math.ceil(reach), ["plan"]).where(f"l.id < r.id AND sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= {reach}D")
    return select.keep_first(closures.withColumn("first", (F.col("kind") == "door").cast("int")), met.selectExpr("l.id AS a", "r.id AS b"), "id", "first")


def repeated_lines(lines: DataFrame, thickness: float) -> DataFrame:
    """id of the lines of patterns, such as treads and hatching: four or more parallel lines of similar length, each
    within four thicknesses of a neighbour that it overlaps by half, spread over more than five thicknesses."""
    f = framed(lines)
    reach = math.ceil(4 * thickness + 0.08 * _longest(f)) + 1
    met = spatial.met_on_grid(f, f, CELL, reach, ["plan"]).where(f"l.id < r.id AND {DOT} >= 0.99D AND least(l.length, r.length) >= 0.6D * greatest(l.length, r.length)")
    met = met.where(f"{ACROSS} <= {4 * thickness}D AND {COMMON} >= 0.5D * least(l.length, r.length)")
    parts = graph.components(met.selectExpr("l.id AS a", "r.id AS b"))
    first = f.selectExpr("id AS component", "x0 AS fx", "y0 AS fy", "ux AS fu", "uy AS fv")
    off = F.expr("(my - fy) * fu - (mx - fx) * fv")
    by = f.join(parts.withColumnRenamed("node", "id"), "id").join(first, "component").withColumn("off", off)
    wide = by.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.max("off") - F.min("off")).alias("spread")).where((F.col("n") >= 4) & (F.col("spread") > 5.0 * thickness))
    return by.join(wide.select("component"), "component", "left_semi").select("id")


def absorbed_strips(pieces: DataFrame, share: float = 0.5) -> DataFrame:
    """strip, piece: narrow end pieces of a split gap that belong to the piece beside them: narrower than ``share`` of
    it, end to end with it on one line, and crossed by the same lines (``lines``, a set of whole offsets, not empty).
    A strip joins the least such id; none joins a piece that is itself a strip."""
    f = framed(pieces).withColumn("lines", F.array_sort(F.array_distinct("lines")))
    near = "least(" + ", ".join(f"sqrt(pow(l.x{i} - r.x{j}, 2) + pow(l.y{i} - r.y{j}, 2))" for i in (0, 1) for j in (0, 1)) + ")"
    met = spatial.met_on_grid(f, f, CELL, 1, ["plan"]).where(f"l.id <> r.id AND l.length < {share}D * r.length AND {DOT} >= 0.999D AND {near} <= 1")
    found = met.where("size(l.lines) > 0 AND l.lines = r.lines").groupBy(F.col("l.id").alias("strip")).agg(F.min("r.id").alias("piece"))
    return found.join(found.select(F.col("strip").alias("piece")), "piece", "left_anti").select("strip", "piece")


def new_openings(found: DataFrame, known: DataFrame) -> DataFrame:
    """plan and id of the found openings that are none of the known ones, by the rule of same_openings()."""
    f, k = framed(found), framed(known)
    thick = max(3.0, thickest(found), thickest(known))
    reach = math.ceil(0.75 * thick + 0.17 * max(_longest(f), _longest(k))) + 1
    met = spatial.met_on_grid(f, k, CELL, reach, ["plan"]).where(f"{DOT} >= 0.95D AND {ACROSS} <= 0.75D * greatest(l.thickness, r.thickness, 3D)")
    old = met.where(f"{COMMON} >= 0.5D * least(l.length, r.length)").select("l.plan", "l.id").distinct()
    return found.select("plan", "id").join(old, ["plan", "id"], "left_anti")


def atomic_segments(segments: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """plan, id and the ends of the pieces that segments fall into where others cross them, or end on them in their own
    line. Of places within half the tolerance the first counts: a segment's own ends, then others by their ids; pieces
    shorter than 2 are left out."""
    s = segments.selectExpr("*", "abs(x1 - x0) >= abs(y1 - y0) AS flat", "least(x0, x1) AS x", "least(y0, y1) AS y", "abs(x1 - x0) AS w", "abs(y1 - y0) AS h")
    met = spatial.met_on_grid(s, s, CELL, math.ceil(tolerance), ["plan"]).where("l.id <> r.id")
    cross = met.where("l.flat <> r.flat").selectExpr("l.plan", "l.id", "r.id AS other", "0 AS which", "CASE WHEN l.flat THEN (r.x0 + r.x1) / 2 ELSE (l.x0 + l.x1) / 2 END AS px", "CASE WHEN l.flat THEN (l.y0 + l.y1) / 2 ELSE (r.y0 + r.y1) / 2 END AS py", "l.x", "l.y", "l.w", "l.h", "r.x AS rx", "r.y AS ry", "r.w AS rw", "r.h AS rh", "l.flat")
    near = lambda p, low, size: f"{p} BETWEEN {low} - {tolerance}D AND {low} + {size} + {tolerance}D"
    cross = cross.where(f"({near('px', 'CASE WHEN flat THEN x ELSE rx END', 'CASE WHEN flat THEN w ELSE rw END')}) AND ({near('py', 'CASE WHEN flat THEN ry ELSE y END', 'CASE WHEN flat THEN rh ELSE h END')})")
    ends = met.where("l.flat = r.flat").selectExpr("l.plan", "l.id", "r.id AS other", "inline(array(struct(0 AS which, r.x0 AS px, r.y0 AS py), struct(1 AS which, r.x1 AS px, r.y1 AS py)))", "l.x0", "l.y0", "l.x1", "l.y1", "l.x", "l.y", "l.w", "l.h")
    ends = ends.where(f"abs((px - x0) * (y1 - y0) - (py - y0) * (x1 - x0)) <= {tolerance}D AND {near('px', 'x', 'w')} AND {near('py', 'y', 'h')}")
    own = s.selectExpr("plan", "id", "cast(NULL AS bigint) AS other", "inline(array(struct(0 AS which, x0 AS px, y0 AS py), struct(1 AS which, x1 AS px, y1 AS py)))")
    cols = ["plan", "id", "other", "which", "px", "py"]
    points = own.unionByName(cross.select(cols)).unionByName(ends.select(cols)).join(s.select("plan", "id", "flat"), ["plan", "id"])
    nth = F.row_number().over(Window.partitionBy("plan", "id").orderBy(F.col("other").asc_nulls_first(), "which"))
    points = written(points.withColumn("point", F.struct("plan", "id", nth.alias("nth"))).withColumn("along", F.when(F.col("flat"), F.col("px")).otherwise(F.col("py"))), "split-points")
    close = spatial.band_join(points, points, ["plan", "id"], "along", tolerance / 2).where(f"l.point < r.point AND sqrt(pow(l.px - r.px, 2) + pow(l.py - r.py, 2)) <= {tolerance / 2}D")
    stay = select.keep_first(points.withColumn("first", F.lit(0)), close.selectExpr("l.point AS a", "r.point AS b"), "point", "first")
    line = Window.partitionBy("plan", "id").orderBy("along", "point")
    out = points.join(stay, "point", "left_semi").select("plan", "id", F.col("px").alias("x0"), F.col("py").alias("y0"), F.lead("px").over(line).alias("x1"), F.lead("py").over(line).alias("y1"))
    return out.where("sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 2")
