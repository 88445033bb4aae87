"""Queries of drawing operators: walls, openings, labels, zones, and rules on their numbers.

Walls, spaces and labels are laid out from keys by integer rules that the SQL spells out again; the SQL joins each with
each inside a plan, where the operators meet on grids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselwork.functions import geometry, numeric, text
from tesselwork.operators import labels, metrics, regions, select, spatial, walls
from tesselwork.plans.catalog import BOXES, boxes, query
from tesselwork.plans.more import CELLS, COMMON, cells, region_overlaps
from tesselwork.sources.tables import table

# --- walls of plans of fifty parts each: horizontal and vertical pieces on a few lines

_FLAT = "k % 2 = 0"
_WALL = (
    ("x0", f"CASE WHEN {_FLAT} THEN s ELSE line END"), ("y0", f"CASE WHEN {_FLAT} THEN line ELSE s END"),
    ("x1", f"CASE WHEN {_FLAT} THEN s + len ELSE line + k % 2 END"), ("y1", f"CASE WHEN {_FLAT} THEN line + k % 3 ELSE s + len END"),
)
WALLS = (
    "k AS (SELECT p_partkey AS k, p_size, (p_partkey * 7) % 5 * 80 + p_partkey % 3 AS line, (p_partkey * 37) % 300 AS s, 30 + p_size * 2 AS len FROM part), "
    "raw AS (SELECT k // 50 AS plan, k AS id, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _WALL) + ", (8 + k % 5)::DOUBLE AS thickness, CASE WHEN k % 7 = 0 THEN 'thin' WHEN k % 5 = 0 THEN 'filled' ELSE 'hollow' END AS style, (50 + k % 50) / 100.0::DOUBLE AS confidence FROM k), "
    "wall AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS ux, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS uy, "
    "fmod(fmod(degrees(atan2(y1 - y0, x1 - x0)), 180) + 180, 180) AS angle FROM raw)"
)


def wall_table(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "part").selectExpr("p_partkey AS k", "p_size", "(p_partkey * 7) % 5 * 80 + p_partkey % 3 AS line", "(p_partkey * 37) % 300 AS s", "30 + p_size * 2 AS len")
    ends = [f"cast({e} AS double) AS {n}" for n, e in _WALL]
    return k.selectExpr(
        "k div 50 AS plan", "k AS id", *ends, "cast(8 + k % 5 AS double) AS thickness", "CASE WHEN k % 7 = 0 THEN 'thin' WHEN k % 5 = 0 THEN 'filled' ELSE 'hollow' END AS style",
        "cast((50 + k % 50) / 100 AS double) AS confidence",
    )


def _turn(a: str, b: str) -> str:
    return f"least(abs({a}.angle - {b}.angle), 180 - abs({a}.angle - {b}.angle))"


def _far(px: str, py: str, s: str) -> str:
    """Distance of a point from a segment in SQL."""
    t = f"greatest(0, least({s}.len, ({px} - {s}.x0) * {s}.ux + ({py} - {s}.y0) * {s}.uy))"
    return f"sqrt(({px} - {s}.x0 - {t} * {s}.ux) ** 2 + ({py} - {s}.y0 - {t} * {s}.uy) ** 2)"


PIECES = (
    WALLS + ", pair AS (SELECT i.id AS a, j.id AS b, i.plan, i.angle, i.ux, i.uy, i.my * i.ux - i.mx * i.uy AS rho, greatest(i.thickness, j.thickness) AS t, "
    "greatest(least(i.x0 * i.ux + i.y0 * i.uy, i.x1 * i.ux + i.y1 * i.uy), least(j.x0 * i.ux + j.y0 * i.uy, j.x1 * i.ux + j.y1 * i.uy)) AS far_low, "
    "least(greatest(i.x0 * i.ux + i.y0 * i.uy, i.x1 * i.ux + i.y1 * i.uy), greatest(j.x0 * i.ux + j.y0 * i.uy, j.x1 * i.ux + j.y1 * i.uy)) AS near_high "
    f"FROM wall i JOIN wall j ON i.plan = j.plan AND i.id < j.id AND {_turn('i', 'j')} <= 3 AND {{'filled', 'thin'}} IS NOT NULL AND i.style || j.style NOT IN ('filledthin', 'thinfilled') "
    "AND abs(i.thickness - j.thickness) <= 0.35::DOUBLE * greatest(i.thickness, j.thickness) + 2 AND abs((j.my * i.ux - j.mx * i.uy) - (i.my * i.ux - i.mx * i.uy)) <= 0.3::DOUBLE * greatest(i.thickness, j.thickness) + 1.5), "
    "gap AS (SELECT *, far_low - near_high AS gap, (near_high + (far_low - near_high) / 2) * ux - rho * uy AS gx, (near_high + (far_low - near_high) / 2) * uy + rho * ux AS gy FROM pair), "
    f"linked AS (SELECT a, b FROM gap WHERE gap <= greatest(3, t) OR EXISTS (SELECT 1 FROM wall c WHERE c.plan = gap.plan AND c.id NOT IN (gap.a, gap.b) AND {_turn('c', 'gap')} >= 60 AND gap.gap <= c.thickness + 6 AND {_far('gap.gx', 'gap.gy', 'c')} <= 0.5 * c.thickness + 2)), "
    "ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT id AS node, id AS root FROM wall UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node), comp AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node)"
).replace("AND {'filled', 'thin'} IS NOT NULL ", "")


@query(f"WITH RECURSIVE {PIECES} SELECT a, b FROM linked")
def collinear_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return walls.collinear_pairs(wall_table(spark, folder))


@query(
    f"WITH RECURSIVE {PIECES}, held AS (SELECT * FROM wall JOIN comp USING (id)), lead AS (SELECT DISTINCT ON (root) root, ux AS kx, uy AS ky, style AS look FROM held ORDER BY root, len DESC, id), "
    "p AS (SELECT *, (my * kx - mx * ky) AS off FROM held JOIN lead USING (root)), g AS (SELECT plan, root AS id, count(*) AS pieces, min(least(x0 * kx + y0 * ky, x1 * kx + y1 * ky)) AS low, max(greatest(x0 * kx + y0 * ky, x1 * kx + y1 * ky)) AS high, "
    "sum(off * len) / sum(len) AS rho, sum(thickness * len) / sum(len) AS thickness, max(confidence) AS confidence, any_value(kx) AS kx, any_value(ky) AS ky, any_value(look) AS style FROM p GROUP BY plan, root) "
    "SELECT plan, id, pieces, round(low * kx - rho * ky, 4) AS x0, round(low * ky + rho * kx, 4) AS y0, round(high * kx - rho * ky, 4) AS x1, round(high * ky + rho * kx, 4) AS y1, round(thickness, 4) AS thickness, style, confidence FROM g"
)
def merge_collinear(spark: SparkSession, folder: str) -> DataFrame:
    out = walls.merge_collinear(wall_table(spark, folder))
    return out.select("plan", "id", "pieces", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1", "thickness")], "style", "confidence")


@query(
    f"WITH {WALLS}, e AS (SELECT *, 0 AS side, x0 AS px, y0 AS py, -ux AS ox, -uy AS oy FROM wall UNION ALL SELECT *, 1, x1, y1, ux, uy FROM wall), "
    f"m AS (SELECT e.plan, e.id, e.side, b.id AS other, ((b.x0 - e.px) * b.uy - (b.y0 - e.py) * b.ux) / (e.ox * b.uy - e.oy * b.ux) AS s, e.px, e.py, e.ox, e.oy, e.thickness AS own, b AS b FROM e JOIN wall b ON e.plan = b.plan AND e.id <> b.id AND {_turn('e', 'b')} >= 25), "
    f"q AS (SELECT *, px + s * ox AS qx, py + s * oy AS qy FROM m WHERE s >= -0.5 * b.thickness - 2 AND s <= 0.75 * b.thickness + 0.75 * own + 2 * 2 + 3), h AS (SELECT * FROM q WHERE {_far('qx', 'qy', 'b')} <= 0.5 * own + 2 + 3), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY plan, id, side ORDER BY abs(s), other) AS nth FROM h) SELECT plan, id, side AS \"end\", other, round(qx, 4) AS x, round(qy, 4) AS y FROM n WHERE nth = 1"
)
def connect_ends(spark: SparkSession, folder: str) -> DataFrame:
    return walls.connect(wall_table(spark, folder), 2.0).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


_ITEM_KIND = "CASE WHEN k % 6 = 0 THEN 'door' WHEN k % 9 = 1 THEN 'window' ELSE 'wall' END"


@query(
    f"WITH RECURSIVE {WALLS}, i AS (SELECT w.*, {_ITEM_KIND} AS kind, p_size > 40 AS exterior FROM wall w JOIN k ON k = id), f AS (SELECT *, CASE WHEN ux < -1e-9 OR (abs(ux) <= 1e-9 AND uy < 0) THEN -1 ELSE 1 END AS flip FROM i), "
    "o AS (SELECT plan, id, kind, exterior, ux * flip AS vx, uy * flip AS vy, x0, y0, x1, y1 FROM f), p AS (SELECT *, y0 * vx - x0 * vy AS rho, least(x0 * vx + y0 * vy, x1 * vx + y1 * vy) AS a, greatest(x0 * vx + y0 * vy, x1 * vx + y1 * vy) AS b FROM o), "
    "e AS (SELECT l.id AS a, r.id AS b FROM p l JOIN p r ON l.plan = r.plan AND l.id <> r.id AND abs(l.vx * r.vx + l.vy * r.vy) >= 0.995 AND abs(l.rho - r.rho) <= 7.5 AND greatest(l.a, r.a) - least(l.b, r.b) <= 15), "
    "reach AS (SELECT id AS node, id AS root FROM p UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), c AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node) "
    "SELECT plan, root AS id, count(*) FILTER (kind = 'wall') AS walls, count(*) FILTER (kind <> 'wall') AS openings, count(*) FILTER (kind = 'door') AS doors, count(*) FILTER (kind = 'window') AS windows, "
    "round(coalesce(sum(b - a) FILTER (kind = 'wall'), 0), 4) AS solid, round(coalesce(sum(b - a) FILTER (kind <> 'wall'), 0), 4) AS open, round(min(a), 4) AS low, round(max(b), 4) AS high, round(median(rho) FILTER (kind = 'wall'), 4) AS rho, "
    "2 * count(*) FILTER (kind = 'wall' AND exterior) > count(*) FILTER (kind = 'wall') AS exterior FROM p JOIN c USING (id) GROUP BY plan, root HAVING count(*) FILTER (kind = 'wall') > 0"
)
def wall_runs(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "part").selectExpr("p_partkey AS id", f"{_ITEM_KIND.replace('k %', 'p_partkey %')} AS kind", "p_size > 40 AS exterior")
    out = walls.wall_runs(wall_table(spark, folder).join(sizes, "id"), 10.0)
    return out.select("plan", "id", "walls", "openings", "doors", "windows", *[F.round(c, 4).alias(c) for c in ("solid", "open", "low", "high", "rho")], "exterior")


# --- openings found against true ones

OPENINGS = (
    "g AS (SELECT o_custkey // 20 AS plan, o_orderkey AS id, (o_orderkey * 31) % 400 AS s, o_orderkey % 4 * 60 AS line, 12 + o_orderkey % 25 AS len, o_orderkey % 3 = 0 AS real, (o_orderkey // 3) % 5 AS d, o_orderstatus FROM orders), "
    "o AS (SELECT plan, id, real, s::DOUBLE AS x0, line::DOUBLE AS y0, (s + len)::DOUBLE AS x1, (line + d)::DOUBLE AS y1, CASE o_orderstatus WHEN 'O' THEN 'door' WHEN 'F' THEN 'window' ELSE 'opening' END AS kind, (6 + id % 9)::DOUBLE AS thickness FROM g), "
    "w AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM o), scored AS (SELECT p.plan, p.id AS pred, t.id AS truth, p.len AS length, t.len AS width, "
    "least((p.x0 - t.x0) * (t.x1 - t.x0) / t.len + (p.y0 - t.y0) * (t.y1 - t.y0) / t.len, (p.x1 - t.x0) * (t.x1 - t.x0) / t.len + (p.y1 - t.y0) * (t.y1 - t.y0) / t.len) AS low, "
    "greatest((p.x0 - t.x0) * (t.x1 - t.x0) / t.len + (p.y0 - t.y0) * (t.y1 - t.y0) / t.len, (p.x1 - t.x0) * (t.x1 - t.x0) / t.len + (p.y1 - t.y0) * (t.y1 - t.y0) / t.len) AS high "
    "FROM w p JOIN w t ON p.plan = t.plan AND NOT p.real AND t.real AND abs((p.x1 - p.x0) * (t.x1 - t.x0) + (p.y1 - p.y0) * (t.y1 - t.y0)) / p.len / t.len >= cos(radians(25)) "
    "AND abs(((p.y0 + p.y1) / 2 - t.y0) * (t.x1 - t.x0) / t.len - ((p.x0 + p.x1) / 2 - t.x0) * (t.y1 - t.y0) / t.len) <= greatest(0.9::DOUBLE * t.thickness, 8)), "
    "u AS (SELECT *, greatest(0, least(high, width) - greatest(low, 0)) AS common, greatest(high, width) - least(low, 0) AS whole FROM scored), "
    "pairs AS (SELECT plan, pred, truth, round_even(common / whole, 6) AS score FROM u WHERE common >= 0.4::DOUBLE * least(width, length) AND round_even(common / whole, 6) >= 0.2)"
)
MATCHED = (
    OPENINGS + ", turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score DESC, pred DESC, truth DESC) AS nth FROM pairs), "
    "greedy AS (SELECT plan, 0::BIGINT AS nth, []::BIGINT[] AS used, NULL::BIGINT AS pred, NULL::BIGINT AS truth, NULL::DOUBLE AS score, false AS took FROM (SELECT DISTINCT plan FROM pairs) "
    "UNION ALL SELECT t.plan, t.nth, CASE WHEN list_has_any(g.used, [t.pred, t.truth]) THEN g.used ELSE list_concat(g.used, [t.pred, t.truth]) END, t.pred, t.truth, t.score, NOT list_has_any(g.used, [t.pred, t.truth]) "
    "FROM greedy g JOIN turns t ON t.plan = g.plan AND t.nth = g.nth + 1), matched AS (SELECT pred, truth, score FROM greedy WHERE took)"
)


def openings(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders").selectExpr("o_custkey div 20 AS plan", "o_orderkey AS id", "(o_orderkey * 31) % 400 AS s", "o_orderkey % 4 * 60 AS line", "12 + o_orderkey % 25 AS len", "(o_orderkey div 3) % 5 AS d", "o_orderstatus")
    kind = "CASE o_orderstatus WHEN 'O' THEN 'door' WHEN 'F' THEN 'window' ELSE 'opening' END"
    return g.selectExpr(
        "plan", "id", "id % 3 = 0 AS real", "cast(s AS double) AS x0", "cast(line AS double) AS y0", "cast(s + len AS double) AS x1", "cast(line + d AS double) AS y1", f"{kind} AS kind", f"{kind} AS type",
        "cast(6 + id % 9 AS double) AS thickness",
    )


@query(f"WITH {OPENINGS} SELECT plan, pred, truth, score FROM pairs")
def opening_scores(spark: SparkSession, folder: str) -> DataFrame:
    o = openings(spark, folder)
    return metrics.opening_scores(o.where("NOT real"), o.where("real"))


@query(f"WITH RECURSIVE {MATCHED} SELECT pred, truth, score FROM matched")
def opening_match(spark: SparkSession, folder: str) -> DataFrame:
    return select.greedy_match(opening_scores(spark, folder), "pred", "truth", "score")


@query(
    f"WITH RECURSIVE {MATCHED}, f AS (SELECT id AS pred, kind AS type FROM o WHERE NOT real), t AS (SELECT id AS truth, kind FROM o WHERE real), j AS (SELECT f.type, t.kind FROM f LEFT JOIN matched USING (pred) LEFT JOIN t USING (truth)), "
    "a AS (SELECT (SELECT count(*) FROM t WHERE kind <> 'opening') AS gt, (SELECT count(*) FROM t WHERE kind = 'door') AS doors, (SELECT count(*) FROM t WHERE kind = 'window') AS windows, count(*) FILTER (kind IN ('door', 'window')) AS hits, "
    "count(*) FILTER (kind = type AND kind <> 'opening') AS correct, count(*) FILTER (kind IN ('door', 'window') AND type = 'opening') AS unknown, count(*) FILTER (kind IS NULL) AS false_candidates, count(*) FILTER (kind = 'opening') AS passages_found, "
    "count(*) FILTER (kind = 'door' AND type = 'door') AS dtp, count(*) FILTER (type = 'door') - count(*) FILTER (type = 'door' AND kind = 'opening') AS dsaid, count(*) FILTER (kind = 'window' AND type = 'window') AS wtp, count(*) FILTER (type = 'window') - count(*) FILTER (type = 'window' AND kind = 'opening') AS wsaid FROM j) "
    "SELECT round_even(hits / gt, 6) AS candidate_recall, round_even(dtp / dsaid, 6) AS door_precision, round_even(wtp / wsaid, 6) AS window_precision, round_even(dtp / doors, 6) AS door_recall, round_even(wtp / windows, 6) AS window_recall, round_even(correct / hits, 6) AS classification_accuracy, "
    "round_even(correct / gt, 6) AS end_to_end_accuracy, round_even(unknown / hits, 6) AS unknown_rate, false_candidates, passages_found FROM a"
)
def opening_report(spark: SparkSession, folder: str) -> DataFrame:
    o = openings(spark, folder)
    return metrics.opening_report(o.where("NOT real"), o.where("real"), opening_match(spark, folder))


# --- regions found against true ones


@query(
    f"WITH {COMMON}, r AS (SELECT ta.plan, ta.truth, coalesce(max(common / (found_area + ta.truth_area - common)), 0) AS best, coalesce(sum((common >= 0.2::DOUBLE * ta.truth_area)::INTEGER), 0) AS parts FROM ta LEFT JOIN common c ON c.plan = ta.plan AND c.truth = ta.truth GROUP BY ta.plan, ta.truth), "
    "s AS (SELECT pa.plan, pa.found, any_value(pa.found_area) AS area, coalesce(sum(common), 0) AS covered, coalesce(sum((common >= 0.3::DOUBLE * truth_area)::INTEGER), 0) AS holds FROM pa LEFT JOIN common c ON c.plan = pa.plan AND c.found = pa.found GROUP BY pa.plan, pa.found), "
    "x AS (SELECT plan, count(*) AS rooms, count(*) FILTER (best >= 0.7) AS detected, round_even(avg(best), 6) AS mean_iou, count(*) FILTER (parts >= 2) AS split FROM r GROUP BY plan), y AS (SELECT plan, count(*) AS spaces, count(*) FILTER (holds >= 2) AS merged, count(*) FILTER (covered < 0.5 * area) AS false_spaces FROM s GROUP BY plan) "
    "SELECT * FROM x FULL JOIN y USING (plan)"
)
def structure_report(spark: SparkSession, folder: str) -> DataFrame:
    found, truth = cells(spark, folder, "O"), cells(spark, folder, "F")
    return regions.structure_report(region_overlaps(spark, folder), found, truth, ["plan"])


def _borders_sql(name: str, runs: str) -> str:
    return (
        f"{name} AS (SELECT DISTINCT plan, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT plan, label AS a, lead(label) OVER w AS b, x1, lead(x0) OVER w AS nx FROM {runs} WINDOW w AS (PARTITION BY plan, y ORDER BY x0)) WHERE nx = x1 AND a <> b "
        f"UNION SELECT d.plan, least(d.label, u.label), greatest(d.label, u.label) FROM {runs} d JOIN {runs} u ON d.plan = u.plan AND d.y = u.y + 10 AND u.x0 < d.x1 AND d.x0 < u.x1 AND u.label <> d.label)"
    )


@query(
    f"WITH {COMMON}, {_borders_sql('fb', 'p')}, {_borders_sql('tb', 't')}, best AS (SELECT DISTINCT ON (plan, found) plan, found, truth, common, found_area FROM common ORDER BY plan, found, common DESC, truth DESC), half AS (SELECT plan, found, truth FROM best WHERE common >= 0.5 * found_area), "
    "mapped AS (SELECT DISTINCT fb.plan, least(x.truth, y.truth) AS a, greatest(x.truth, y.truth) AS b FROM fb JOIN half x ON x.plan = fb.plan AND x.found = fb.a JOIN half y ON y.plan = fb.plan AND y.found = fb.b WHERE x.truth <> y.truth) "
    "SELECT plan, count(*) FILTER (got AND is_true) AS tp, count(*) FILTER (got AND NOT is_true) AS fp, count(*) FILTER (NOT got AND is_true) AS fn FROM (SELECT coalesce(mapped.plan, tb.plan) AS plan, mapped.a IS NOT NULL AS got, tb.a IS NOT NULL AS is_true FROM mapped FULL JOIN tb ON mapped.plan = tb.plan AND mapped.a = tb.a AND mapped.b = tb.b) GROUP BY plan"
)
def adjacency_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a plan are every tenth supplier, so neighbours are ten apart."""
    packed = lambda status: cells(spark, folder, status).withColumn("y", F.floor(F.col("y") / 10))
    found, truth = regions.borders(packed("O"), ["plan"]), regions.borders(packed("F"), ["plan"])
    return regions.adjacency_report(region_overlaps(spark, folder), found, truth, ["plan"])


# --- labels and spaces: triangles over the boxes of parts, labels by order keys

SPACES = BOXES + ", space AS (SELECT id // 2000 AS plan, id, x, y, w, h, w * h AS area, x AS ax, y AS ay, x + w AS bx, y AS by_, x + w // 2 AS cx, y + h AS cy FROM boxes)"
_LABEL = "SELECT o_orderkey // 15000 AS plan, o_orderkey AS id, (o_orderkey * 6151) % 9973 + o_orderkey // 15000 * 10000 AS x, (o_orderkey * 3571) % 1000 AS y, 10 + o_orderkey % 60 AS w, 8 + o_orderkey % 7 AS h FROM orders"
LABELS = f"label AS ({_LABEL})"


def spaces(spark: SparkSession, folder: str) -> DataFrame:
    corner = lambda a, b: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    x, y, w, h = (F.col(c) for c in spatial.BOX)
    shape = F.array(corner(x, y), corner(x + w, y), corner(x + F.floor(w / 2), y + h))
    return boxes(spark, folder).select(F.expr("id div 2000").alias("plan"), "id", "x", "y", "w", "h", (w * h).alias("area"), shape.alias("shape"))


def label_table(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.selectExpr("o_orderkey div 15000 AS plan", "o_orderkey AS id", "(o_orderkey * 6151) % 9973 + o_orderkey div 15000 * 10000 AS x", "(o_orderkey * 3571) % 1000 AS y", "10 + o_orderkey % 60 AS w", "8 + o_orderkey % 7 AS h")


def _inside(px: str, py: str) -> str:
    return (
        f"{px} BETWEEN s.ax AND s.bx AND {py} BETWEEN s.ay AND s.cy AND (s.bx - s.ax) * ({py} - s.ay) >= 0 AND (s.cx - s.bx) * ({py} - s.by_) - (s.cy - s.by_) * ({px} - s.bx) >= 0 "
        f"AND (s.ax - s.cx) * ({py} - s.cy) - (s.ay - s.cy) * ({px} - s.cx) >= 0"
    )


@query(
    f"WITH {SPACES}, {LABELS}, held AS (SELECT l.id, arg_min(s.id, s.area * 1000000 + s.id) AS inner_id FROM label l JOIN space s ON l.plan = s.plan AND {_inside('l.x', 'l.y')} GROUP BY l.id), "
    "far AS (SELECT l.id, s.id AS space, sqrt(greatest(0, s.x - l.x, l.x - s.x - s.w) ** 2 + greatest(0, s.y - l.y, l.y - s.y - s.h) ** 2) AS d FROM label l JOIN space s ON l.plan = s.plan AND s.x - l.x <= 35 AND l.x - s.x - s.w <= 35 AND s.y - l.y <= 35 AND l.y - s.y - s.h <= 35), "
    "near AS (SELECT DISTINCT ON (id) id, space, d FROM far WHERE d <= 35 ORDER BY id, d, space) "
    "SELECT l.plan, l.id, coalesce(inner_id, space) AS space, CASE WHEN inner_id IS NOT NULL THEN 1.0::DOUBLE WHEN space IS NOT NULL THEN round_even(1 - d / 35, 3) ELSE 0.0::DOUBLE END AS score FROM label l LEFT JOIN held USING (id) LEFT JOIN near USING (id)"
)
def label_to_space(spark: SparkSession, folder: str) -> DataFrame:
    rows = label_table(spark, folder).withColumns({"px": F.col("x"), "py": F.col("y")})
    return labels.to_space(rows, spaces(spark, folder))


@query(
    f"WITH {SPACES}, {LABELS}, c AS (SELECT *, x + floor(w * 0.5)::BIGINT AS px, y + floor(h * 0.5)::BIGINT AS py FROM label), held AS (SELECT c.id, arg_min(s.id, s.area * 1000000 + s.id) AS inner_id FROM c JOIN space s ON c.plan = s.plan AND {_inside('c.px', 'c.py')} GROUP BY c.id), "
    "q AS (SELECT plan, id, x + floor(w * fx)::BIGINT AS px, y + floor(h * fy)::BIGINT AS py FROM label CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(fx) CROSS JOIN (VALUES (0.3::DOUBLE), (0.7::DOUBLE)) b(fy) WHERE id NOT IN (SELECT id FROM held)), "
    f"v AS (SELECT q.id, s.id AS space, s.area, count(*) AS n FROM q JOIN space s ON q.plan = s.plan AND {_inside('q.px', 'q.py')} GROUP BY ALL), best AS (SELECT DISTINCT ON (id) id, space, n FROM v ORDER BY id, n DESC, area, space) "
    "SELECT l.plan, l.id, coalesce(inner_id, space) AS space, n AS votes FROM label l LEFT JOIN held USING (id) LEFT JOIN best USING (id)"
)
def label_point_votes(spark: SparkSession, folder: str) -> DataFrame:
    return labels.by_points(label_table(spark, folder), spaces(spark, folder))


_ROOM = "id % 2 = 0"


@query(
    f"WITH {LABELS}, room AS (SELECT * FROM label WHERE {_ROOM}), size AS (SELECT *, (id * 13) % 100 AS confidence FROM label WHERE NOT {_ROOM}), m AS (SELECT r.plan, r.id, s.id AS size, s.y - r.y - r.h AS dy, abs(s.x + s.w / 2 - r.x - r.w / 2) AS dx, greatest(0, least(r.x + r.w, s.x + s.w) - greatest(r.x, s.x)) AS overlap, r.w AS rw, s.w AS sw, confidence "
    "FROM room r JOIN size s ON r.plan = s.plan AND s.y - r.y - r.h BETWEEN -8 AND 155 AND abs(s.x - r.x) < 600), e AS (SELECT *, dy / 120 + dx / greatest(120, rw) * 0.45::DOUBLE + 0.2::DOUBLE * (1 - overlap / greatest(1, least(sw, rw))) + greatest(0, 75 - confidence) / 250 AS score FROM m WHERE dx <= greatest(210, rw * 1.4::DOUBLE) OR overlap > 0), "
    "b AS (SELECT DISTINCT ON (id) plan, id, size, score FROM e ORDER BY id, score, size) SELECT plan, id, size, round(score, 6) AS score FROM b"
)
def size_of_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = label_table(spark, folder)
    sizes = rows.where(f"NOT ({_ROOM})").withColumn("confidence", (F.col("id") * 13) % 100)
    return labels.size_of_label(rows.where(_ROOM), sizes).withColumn("score", F.round("score", 6))


# --- zones: spaces are users, objects their events

DECISIVE, OPEN = ["purchase", "signup"], ["cook", "live", "dine"]
_ZONE_ITEM = (
    "user_id AS plan", "event_id AS id", "CASE WHEN event_id % 11 = 0 THEN 'label' ELSE event_type END AS kind", "CASE event_id % 4 WHEN 0 THEN 'cook' WHEN 1 THEN 'live' WHEN 2 THEN 'dine' ELSE 'bath' END AS function",
    "CASE WHEN event_id % 11 = 0 THEN 1.5 ELSE 0.2 + (event_id * 7) % 9 / 10.0 END AS weight", "(event_id * 97) % 900 AS x", "(event_id * 61) % 700 AS y", "20 + event_id % 80 AS w", "15 + event_id % 50 AS h",
)
ZONES = (
    "item AS (SELECT " + ", ".join(_ZONE_ITEM).replace("THEN 1.5 ELSE 0.2 + (event_id * 7) % 9 / 10.0", "THEN 1.5::DOUBLE ELSE 0.2::DOUBLE + (event_id * 7) % 9 / 10.0::DOUBLE") + " FROM events), "
    "lowered AS (SELECT i.* REPLACE (CASE WHEN kind <> 'label' AND EXISTS (SELECT 1 FROM item l WHERE l.plan = i.plan AND l.kind = 'label' AND l.function <> i.function AND l.x + l.w / 2 BETWEEN i.x AND i.x + i.w AND l.y + l.h / 2 BETWEEN i.y AND i.y + i.h) THEN 0.3::DOUBLE * weight ELSE weight END AS weight) FROM item i), "
    "heavy AS (SELECT * FROM lowered WHERE weight >= 0.3::DOUBLE), e AS (SELECT a.id AS a, b.id AS b FROM heavy a JOIN heavy b ON a.plan = b.plan AND a.function = b.function AND a.id <> b.id AND greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) ** 2 + greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) ** 2 <= 150 * 150), "
    "reach AS (SELECT id AS node, id AS root FROM heavy UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), c AS (SELECT node AS id, min(root) AS cluster FROM reach GROUP BY node), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY plan, function, cluster, kind ORDER BY weight DESC, id) AS nth FROM heavy JOIN c USING (id)), "
    "g AS (SELECT plan, function, cluster, count(*) AS items, sum(CASE WHEN nth = 1 THEN weight WHEN nth <= 3 THEN 0.3::DOUBLE * weight ELSE 0 END) AS support, bool_or(kind = 'label' OR (kind IN ('purchase', 'signup') AND weight >= 0.8::DOUBLE)) AS decided FROM n GROUP BY ALL), "
    "zone AS (SELECT * FROM g WHERE support >= 1 AND (items >= 2 OR decided))"
)


def zone_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*[c.replace("1.5", "1.5D").replace("0.2 +", "0.2D +").replace("10.0", "10.0D") for c in _ZONE_ITEM])


@query(f"WITH RECURSIVE {ZONES} SELECT plan, function, cluster, items, round(support, 6) AS support, decided FROM zone")
def zone_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return labels.zone_clusters(zone_items(spark, folder), 150.0, DECISIVE).withColumn("support", F.round("support", 6))


@query(
    f"WITH RECURSIVE {ZONES}, z AS (SELECT plan, count(*) FILTER (function IN ('cook', 'live', 'dine')) AS n, arg_max(function, support * 1000000 - cluster / 1000000) FILTER (decided) AS best, max(support) FILTER (decided) AS s FROM zone GROUP BY plan) "
    "SELECT plan, CASE WHEN n < 2 THEN 0 ELSE n END AS zones, CASE WHEN n < 2 THEN best END AS function, CASE WHEN n < 2 THEN round_even(1 - exp(-s), 2) END AS confidence FROM z"
)
def space_functions(spark: SparkSession, folder: str) -> DataFrame:
    return labels.space_functions(labels.zone_clusters(zone_items(spark, folder), 150.0, DECISIVE), OPEN)
