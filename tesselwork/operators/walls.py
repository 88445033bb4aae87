"""Walls as segments (plan, id, x0, y0, x1, y1, thickness): joining collinear pieces, snapping ends, runs across openings.

Pairs meet on a grid whose reach is taken from the thickest wall, never each with each; groups are components.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.operators import graph, spatial
from tesselwork.sources.scratch import written

CELL = 64


def framed(segments: DataFrame) -> DataFrame:
    """Adds length, unit direction (ux, uy), midpoint (mx, my), undirected angle, and the box x, y, w, h."""
    length = segments.selectExpr("*", "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length", "(x0 + x1) / 2 AS mx", "(y0 + y1) / 2 AS my")
    return length.where("length > 0").selectExpr(
        "*", "(x1 - x0) / length AS ux", "(y1 - y0) / length AS uy", "pmod(degrees(atan2(y1 - y0, x1 - x0)), 180D) AS angle",
        "least(x0, x1) AS x", "least(y0, y1) AS y", "abs(x1 - x0) AS w", "abs(y1 - y0) AS h",
    )


def turn(a: str, b: str) -> str:
    return f"least(abs({a}.angle - {b}.angle), 180 - abs({a}.angle - {b}.angle))"


def _along(side: str, k: int, by: str = "l") -> str:
    return f"({side}.x{k} * {by}.ux + {side}.y{k} * {by}.uy)"


def to_segment(px: str, py: str, s: str) -> str:
    """Distance of a point to segment s."""
    t = f"greatest(0D, least(1D, (({px} - {s}.x0) * {s}.ux + ({py} - {s}.y0) * {s}.uy) / {s}.length)) * {s}.length"
    return f"sqrt(pow({px} - ({s}.x0 + {t} * {s}.ux), 2) + pow({py} - ({s}.y0 + {t} * {s}.uy), 2))"


def thickest(walls: DataFrame) -> float:
    return float(walls.agg(F.max("thickness")).first()[0] or 0.0)  # one number


def collinear_pairs(walls: DataFrame) -> DataFrame:
    """a, b of walls that are pieces of one: within 3 degrees, of similar thickness and on one line, with a break no
    wider than the wall is thick (3 at least), or one that a crossing wall fills. A filled wall never continues a thin
    one. ``walls`` also has style."""
    reach = math.ceil(thickest(walls)) + 10
    f = framed(walls)
    met = spatial.met_on_grid(f, f, CELL, reach, ["plan"]).where(f"l.id < r.id AND {turn('l', 'r')} <= 3")
    met = met.where("NOT (l.style = 'filled' AND r.style = 'thin') AND NOT (l.style = 'thin' AND r.style = 'filled')")
    met = met.where("abs(l.thickness - r.thickness) <= 0.35D * greatest(l.thickness, r.thickness) + 2")
    met = met.where("abs((r.mx - l.mx) * -l.uy + (r.my - l.my) * l.ux) <= 0.3D * greatest(l.thickness, r.thickness) + 1.5D")
    low, high = (lambda s: f"least({_along(s, 0)}, {_along(s, 1)})"), (lambda s: f"greatest({_along(s, 0)}, {_along(s, 1)})")
    met = met.selectExpr(
        "l.plan", "l.id AS a", "r.id AS b", "l.angle", "greatest(l.thickness, r.thickness) AS t", f"greatest({low('l')}, {low('r')}) - least({high('l')}, {high('r')}) AS gap",
        f"least({high('l')}, {high('r')}) AS upto", "l.ux", "l.uy", "l.mx * -l.uy + l.my * l.ux AS rho",
    )
    direct = met.where("gap <= greatest(3D, t)").select("a", "b")
    open_ = met.where("gap > greatest(3D, t)").selectExpr("*", "(upto + gap / 2) * ux + rho * -uy AS x", "(upto + gap / 2) * uy + rho * ux AS y", "0 AS w", "0 AS h")
    filled = spatial.met_on_grid(open_, f, CELL, reach, ["plan"]).where(f"r.id <> l.a AND r.id <> l.b AND {turn('l', 'r')} >= 60 AND l.gap <= r.thickness + 6")
    filled = filled.where(f"{to_segment('l.x', 'l.y', 'r')} <= 0.5D * r.thickness + 2").selectExpr("l.a", "l.b")
    return direct.unionByName(filled).distinct()


def merge_collinear(walls: DataFrame) -> DataFrame:
    """One wall for each group of pieces: id (the least), pieces, ends on the axis of the longest piece, thickness and
    offset weighted by length, that piece's style, and the best confidence."""
    parts = graph.components(collinear_pairs(walls))
    f = framed(walls).join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lead = f.groupBy("component").agg(F.max_by(F.struct("ux", "uy", "style"), F.struct("length", -F.col("id"))).alias("k"))
    both = f.join(lead, "component").selectExpr(
        "*", "x0 * k.ux + y0 * k.uy AS a0", "x1 * k.ux + y1 * k.uy AS a1", "(mx * -k.uy + my * k.ux) * length AS off"
    )
    by = both.groupBy("plan", "component").agg(
        F.count(F.lit(1)).alias("pieces"), F.min(F.least("a0", "a1")).alias("low"), F.max(F.greatest("a0", "a1")).alias("high"), (F.sum("off") / F.sum("length")).alias("rho"),
        (F.sum(F.col("thickness") * F.col("length")) / F.sum("length")).alias("thickness"), F.max("confidence").alias("confidence"), F.first("k").alias("k"),
    )
    ends = [f"low * k.ux + rho * -k.uy AS x0", "low * k.uy + rho * k.ux AS y0", "high * k.ux + rho * -k.uy AS x1", "high * k.uy + rho * k.ux AS y1"]
    return by.selectExpr("plan", "component AS id", "pieces", *ends, "thickness", "k.style AS style", "confidence")


def connect(walls: DataFrame, line_width: float) -> DataFrame:
    """For each wall end (0 or 1) that meets a crossing wall at or just beyond it: the nearest such wall and the point
    on its axis. All ends look at the walls as they are given."""
    f = framed(walls)
    ends = f.withColumn("e", F.explode(F.array(*[F.struct(F.lit(n).alias("end"), F.col(f"x{n}").alias("px"), F.col(f"y{n}").alias("py"), F.lit(2.0 * n - 1).alias("sign")) for n in (0, 1)])))
    ends = ends.selectExpr("plan", "id", "angle", "thickness", "e.end", "e.px", "e.py", "ux * e.sign AS ox", "uy * e.sign AS oy", "e.px AS x", "e.py AS y", "0 AS w", "0 AS h")
    reach = math.ceil(2 * thickest(walls) + 3 * line_width) + 8
    met = spatial.met_on_grid(ends, f, CELL, reach, ["plan"]).where(f"r.id <> l.id AND {turn('l', 'r')} >= 25")
    s = "((r.x0 - l.px) * r.uy - (r.y0 - l.py) * r.ux) / (l.ox * r.uy - l.oy * r.ux)"
    met = met.selectExpr("*", f"{s} AS s").selectExpr("l.*", "r.id AS other", "r.thickness AS thick", "s", "px + s * ox AS qx", "py + s * oy AS qy", f"struct(r.x0, r.y0, r.ux, r.uy, r.length) AS b")
    met = met.where(f"s BETWEEN -0.5D * thick - 2 AND 0.75D * (thick + thickness) + {2 * line_width + 3}D")
    met = met.where(f"{to_segment('qx', 'qy', 'b')} <= 0.5D * thickness + {line_width + 3}D")
    best = met.groupBy("plan", "id", "end").agg(F.min(F.struct(F.abs("s").alias("s"), "other", "qx", "qy")).alias("b"))
    return best.select("plan", "id", "end", "b.other", F.col("b.qx").alias("x"), F.col("b.qy").alias("y"))


def wall_runs(items: DataFrame, thickness: float) -> DataFrame:
    """Continuous boundaries: walls on one line joined across the openings that they host and across junction gaps.

    ``items`` has plan, id, kind (wall, or the type of an opening), exterior and the segment. One row for each run
    that has a wall: its least id, walls, openings, doors, windows, solid and open length, ends, median offset,
    and whether most of its walls are exterior. Pairs meet by direction (within 6 degrees) and offset.
    """
    f = framed(items).selectExpr("*", "CASE WHEN ux < -1e-9 OR (abs(ux) <= 1e-9 AND uy < 0) THEN -1D ELSE 1D END AS flip")
    f = f.selectExpr("plan", "id", "kind", "exterior", "ux * flip AS ux", "uy * flip AS uy", "x0", "y0", "x1", "y1")
    f = f.selectExpr("*", "y0 * ux - x0 * uy AS rho", "least(x0 * ux + y0 * uy, x1 * ux + y1 * uy) AS a", "greatest(x0 * ux + y0 * uy, x1 * ux + y1 * uy) AS b")
    near = max(3.0, 0.75 * thickness)
    f = written(f.selectExpr("*", "cast(floor((degrees(atan2(uy, ux)) + 90) / 6) AS int) AS turn"), "wall-lines")  # read four times below
    around = f.withColumn("turn", F.explode(F.array(*[F.pmod(F.col("turn") + F.lit(k), F.lit(31)) for k in (-1, 0, 1)])))  # 31: a vertical line has both ends of the scale
    around = around.unionByName(f.where("turn IN (0, 29, 30)").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(29), F.lit(30))))).distinct()
    met = spatial.band_join(f, around, ["plan", "turn"], "rho", near)
    met = met.where(f"l.id <> r.id AND abs(l.ux * r.ux + l.uy * r.uy) >= 0.995D AND greatest(l.a, r.a) - least(l.b, r.b) <= {1.5 * thickness}D")
    parts = graph.components(met.selectExpr("l.id AS a", "r.id AS b")).withColumnRenamed("node", "id")
    g = f.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    wall, length = F.col("kind") == "wall", F.col("b") - F.col("a")
    n = lambda c: F.sum(c.cast("long"))
    runs = g.groupBy("plan", F.col("component").alias("id")).agg(
        n(wall).alias("walls"), n(~wall).alias("openings"), n(F.col("kind") == "door").alias("doors"), n(F.col("kind") == "window").alias("windows"),
        F.sum(F.when(wall, length).otherwise(0.0)).alias("solid"), F.sum(F.when(~wall, length).otherwise(0.0)).alias("open"), F.min("a").alias("low"), F.max("b").alias("high"),
        F.median(F.when(wall, F.col("rho"))).alias("rho"), (2 * n(wall & F.col("exterior")) > n(wall)).alias("exterior"),
    )
    return runs.where("walls > 0")


def gaps_on_lines(walls: DataFrame, thickness: float) -> DataFrame:
    """Breaks between neighbouring pieces of one line (plan, rho): from, to, and whether each is wide enough for an
    opening: one and a half times the wall's thickness."""
    line = Window.partitionBy("plan", "rho").orderBy("a", "b")
    reach = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return walls.select("plan", "rho", reach.alias("low"), F.lead("a").over(line).alias("high")).where("high > low").withColumn("significant", F.col("high") - F.col("low") >= F.lit(1.5 * thickness))
