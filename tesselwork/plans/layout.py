"""Queries of openings and layouts: what cuts and repeats, lines and blocks of text, faces, buildings, look-ups, reports.

Each input is laid out from keys by integer rules that the SQL spells out again; the SQL joins each with each inside a
plan, where the operators meet on grids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselwork.functions import geometry, rules
from tesselwork.operators import layout, openings, sequence, spatial
from tesselwork.plans.catalog import query
from tesselwork.plans.drawing import LABELS, OPENINGS, SPACES, WALLS, _far, _inside, _turn, label_table, spaces, wall_table
from tesselwork.plans.drawing import openings as opening_table
from tesselwork.plans.more import CELLS, cells
from tesselwork.sources.tables import table

# --- openings and drawn lines

_END = "((r.x{k} - l.x0) * l.ux + (r.y{k} - l.y0) * l.uy)"
_COMMON = f"(least(l.len, greatest({_END.format(k=0)}, {_END.format(k=1)})) - greatest(0, least({_END.format(k=0)}, {_END.format(k=1)})))"
_DOT, _ACROSS = "abs(l.ux * r.ux + l.uy * r.uy)", "abs((r.my - l.my) * l.ux - (r.mx - l.mx) * l.uy)"


@query(
    f"WITH {WALLS}, m AS (SELECT l.*, r AS r, ((r.x0 - l.x0) * r.uy - (r.y0 - l.y0) * r.ux) / (l.ux * r.uy - l.uy * r.ux) AS s FROM wall l JOIN wall r ON l.plan = r.plan AND l.id % 3 = 0 AND l.id <> r.id AND {_turn('l', 'r')} >= 20) "
    f"SELECT DISTINCT plan, id FROM m WHERE s > 0.15::DOUBLE * len AND s < 0.85::DOUBLE * len AND {_far('(x0 + s * ux)', '(y0 + s * uy)', 'r')} <= 0.5 * r.thickness"
)
def cut_by_walls(spark: SparkSession, folder: str) -> DataFrame:
    """Every third wall stands for a closure whose own wall is itself."""
    w = wall_table(spark, folder)
    return openings.cut_by_walls(w.where("id % 3 = 0").withColumn("skip", F.array("id")), w)


@query(f"WITH {WALLS} SELECT l.id AS a, r.id AS b FROM wall l JOIN wall r ON l.plan = r.plan AND l.id < r.id AND {_DOT} >= 0.95 AND {_ACROSS} <= 0.75 * greatest(l.thickness, r.thickness, 3) AND {_COMMON} >= 0.5 * least(l.len, r.len)")
def same_openings(spark: SparkSession, folder: str) -> DataFrame:
    return openings.same_openings(wall_table(spark, folder))


_LINE = ("(k * 31) % 400 AS x0", "k % 4 * 60 + k % 7 AS y0", "(k * 31) % 400 + 12 + k % 60 AS x1", "k % 4 * 60 + (k * 3) % 7 AS y1")
LINES = (
    "k AS (SELECT o_orderkey AS k FROM orders), raw AS (SELECT k // 200 AS plan, k AS id, " + ", ".join(f"({c.split(' AS ')[0]})::DOUBLE AS {c.split(' AS ')[1]}" for c in _LINE) + " FROM k), "
    "line AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS ux, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS uy FROM raw)"
)


def drawn_lines(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "orders").selectExpr("o_orderkey AS k")
    return k.selectExpr("k div 200 AS plan", "k AS id", *[f"cast({c.split(' AS ')[0]} AS double) AS {c.split(' AS ')[1]}" for c in _LINE])


def _side(o: str, u: str, v: str, i: int, j: int) -> str:
    return f"(({u}.x{i} - {o}.x0) * ({v}.y{j} - {o}.y0) - ({u}.y{i} - {o}.y0) * ({v}.x{j} - {o}.x0))"


@query(
    f"WITH {LINES} SELECT l.id AS a, r.id AS b FROM line l JOIN line r ON l.plan = r.plan AND l.id < r.id AND {_DOT} >= 0.966 AND {_side('r', 'r', 'l', 1, 0)} * {_side('r', 'r', 'l', 1, 1)} < 0 AND {_side('l', 'l', 'r', 1, 0)} * {_side('l', 'l', 'r', 1, 1)} < 0 "
    "AND abs((l.mx - r.mx) * r.ux + (l.my - r.my) * r.uy) <= 0.25 * least(l.len, r.len) AND abs((l.my - r.my) * r.ux - (l.mx - r.mx) * r.uy) < 4"
)
def same_drawn_lines(spark: SparkSession, folder: str) -> DataFrame:
    return openings.same_drawn_lines(drawn_lines(spark, folder), 10.0)


@query(
    f"WITH RECURSIVE {OPENINGS.split(', scored AS')[0]}, m AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM o), near AS (SELECT l.id, list(r.id) AS others FROM m l JOIN m r ON l.plan = r.plan AND l.id <> r.id AND sqrt((l.mx - r.mx) ** 2 + (l.my - r.my) ** 2) <= 7.5 GROUP BY l.id), "
    "turns AS MATERIALIZED (SELECT plan, id, coalesce(others, []) AS others, row_number() OVER (PARTITION BY plan ORDER BY kind = 'door' DESC, id) AS nth FROM m LEFT JOIN near USING (id)), "
    "walk AS (SELECT plan, 0::BIGINT AS nth, NULL::BIGINT AS id, []::BIGINT[] AS kept, false AS stays FROM (SELECT DISTINCT plan FROM m) UNION ALL SELECT t.plan, t.nth, t.id, CASE WHEN list_has_any(w.kept, t.others) THEN w.kept ELSE list_append(w.kept, t.id) END, NOT list_has_any(w.kept, t.others) "
    "FROM walk w JOIN turns t ON t.plan = w.plan AND t.nth = w.nth + 1) SELECT id FROM walk WHERE stays"
)
def doors_first(spark: SparkSession, folder: str) -> DataFrame:
    return openings.doors_first(opening_table(spark, folder), 10.0)


@query(
    f"WITH RECURSIVE {LINES}, e AS (SELECT l.id AS a, r.id AS b FROM line l JOIN line r ON l.plan = r.plan AND l.id < r.id AND {_DOT} >= 0.99 AND least(l.len, r.len) >= 0.6 * greatest(l.len, r.len) AND {_ACROSS} <= 4 AND {_COMMON} >= 0.5 * least(l.len, r.len)), "
    "ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT id AS node, id AS root FROM line UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node), c AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node), "
    "o AS (SELECT line.id, root, (line.my - f.y0) * f.ux - (line.mx - f.x0) * f.uy AS off FROM line JOIN c USING (id) JOIN line f ON f.id = root) SELECT id FROM o WHERE root IN (SELECT root FROM o GROUP BY root HAVING count(*) >= 4 AND max(off) - min(off) > 5)"
)
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return openings.repeated_lines(drawn_lines(spark, folder), 1.0)


_PIECE = (
    "CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 14 + (k - 1) % 60 END", "CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 14 + k % 60 ELSE 19 + (k - 1) % 60 + k % 9 END",
)


@query(
    f"WITH p AS (SELECT p_partkey AS k, p_partkey // 3 AS plan, {_PIECE[0].replace('k', 'p_partkey')} AS a, {_PIECE[1].replace('k', 'p_partkey')} AS b, CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 7 = 0 THEN [3, 8] ELSE [4, 3, 4] END AS lines FROM part), q AS (SELECT *, b - a AS len, list_sort(list_distinct(lines)) AS held FROM p), "
    "f AS (SELECT l.k AS strip, min(r.k) AS piece FROM q l JOIN q r ON l.plan = r.plan AND l.k <> r.k AND l.len < 0.5 * r.len AND least(abs(l.a - r.a), abs(l.a - r.b), abs(l.b - r.a), abs(l.b - r.b)) <= 1 AND len(l.held) > 0 AND l.held = r.held GROUP BY l.k) SELECT * FROM f WHERE piece NOT IN (SELECT strip FROM f)"
)
def absorbed_strips(spark: SparkSession, folder: str) -> DataFrame:
    """Three pieces of a gap lie end to end; parts are the pieces, three of a plan."""
    of = lambda e: f"cast({e.replace('k', 'p_partkey')} AS double)"
    lines = "CASE WHEN p_partkey % 5 = 0 THEN cast(array() AS array<int>) WHEN p_partkey % 7 = 0 THEN array(3, 8) ELSE array(4, 3, 4) END AS lines"
    return openings.absorbed_strips(table(spark, folder, "part").selectExpr("p_partkey AS id", "p_partkey div 3 AS plan", f"{of(_PIECE[0])} AS x0", "0D AS y0", f"{of(_PIECE[1])} AS x1", "0D AS y1", lines))


# --- texts of pages: words by order keys

_WORD = ("o_orderkey AS id", "(o_orderkey * 31) % 2000 AS x", "(o_orderkey * 17) % 1000 AS y", "20 + o_orderkey % 30 AS w", "6 + o_orderkey % 13 AS h", "CASE WHEN o_orderkey % 10 = 0 THEN 90 ELSE 0 END AS rotation", "o_orderkey % 2 = 0 AS is_term", "4 + o_orderkey % 9 AS glyph")
WORDS = "word AS (SELECT o_orderkey // 1000 AS plan, " + ", ".join(_WORD) + ", 'w' || o_orderkey % 50 AS text FROM orders)"


def words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("o_orderkey div 1000 AS plan", *_WORD, "concat('w', o_orderkey % 50) AS text")


@query(
    "WITH p AS (SELECT p_partkey, p_name AS text, ((p_partkey * 37) % 700 - 40)::DOUBLE AS x0, ((p_partkey * 53) % 900 - 50) / 4.0::DOUBLE AS y0, 612.0::DOUBLE AS pw, 792.0::DOUBLE AS ph FROM part), "
    "q AS (SELECT *, round_even(x0 * (1275 / pw), 0)::BIGINT AS x, round_even(y0 * (1650 / ph), 0)::BIGINT AS y, greatest(1, round_even(((x0 + p_partkey % 40) - x0) * (1275 / pw), 0)::BIGINT) AS w, greatest(1, round_even(((y0 + p_partkey % 60) - y0) * (1650 / ph), 0)::BIGINT) AS h FROM p) "
    "SELECT p_partkey, x, y, w, h, CASE WHEN h > 1.5 * w AND length(text) > 2 THEN 90 ELSE 0 END AS rotation FROM q WHERE x < 1275 AND y < 1650 AND x + w > 0 AND y + h > 0"
)
def in_pixels(spark: SparkSession, folder: str) -> DataFrame:
    k = "p_partkey"
    at = table(spark, folder, "part").selectExpr(k, "p_name AS text", f"cast(({k} * 37) % 700 - 40 AS double) AS x0", f"(({k} * 53) % 900 - 50) / 4D AS y0", "612D AS page_w", "792D AS page_h", "1275 AS width", "1650 AS height")
    return layout.in_pixels(at.selectExpr("*", f"x0 + {k} % 40 AS x1", f"y0 + {k} % 60 AS y1")).select(k, "x", "y", "w", "h", "rotation")


_HIGH, _LOW = "greatest(l.h, r.h)", "least(l.h, r.h)"
_ALIKE = "l.h / greatest(1, r.h) >= 0.6::DOUBLE AND l.h / greatest(1, r.h) <= 1.65::DOUBLE"
_GAP = "greatest(l.x, r.x) - least(l.x + l.w, r.x + r.w)"
_MIDDLES = "abs((l.y + l.h / 2) - (r.y + r.h / 2))"
LINED = (
    f"{WORDS}, e AS (SELECT l.id AS a, r.id AS b FROM word l JOIN word r ON l.plan = r.plan AND (l.y, l.x, l.id) < (r.y, r.x, r.id) AND l.rotation = r.rotation AND {_MIDDLES} <= 0.5 * {_HIGH} AND (({_ALIKE} AND {_GAP} <= 1.2::DOUBLE * {_HIGH}) OR (NOT ({_ALIKE}) "
    f"AND CASE WHEN l.h <= r.h THEN r.y - 1 <= l.y AND l.y + l.h <= r.y + r.h + 1 ELSE l.y - 1 <= r.y AND r.y + r.h <= l.y + l.h + 1 END AND {_MIDDLES} <= 0.25 * {_HIGH} AND {_GAP} >= -1 AND {_GAP} <= 0.6::DOUBLE * {_HIGH} AND l.is_term AND r.is_term))), "
    "ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT id AS node, id AS root FROM word UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node), c AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node)"
)


@query(
    f"WITH RECURSIVE {LINED} SELECT plan, root AS id, count(*) AS words, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, string_agg(text, ' ' ORDER BY x, id) AS text FROM word JOIN c USING (id) GROUP BY plan, root"
)
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.text_lines(words(spark, folder))


_G = "greatest(l.glyph, r.glyph)"


@query(
    f"WITH RECURSIVE {WORDS}, e AS (SELECT l.id AS a, r.id AS b FROM word l JOIN word r ON l.plan = r.plan AND l.id <> r.id AND l.x - {_G} <= r.x + r.w AND r.x - {_G} <= l.x + l.w AND l.y - 1.5 * {_G} <= r.y + r.h AND r.y - 1.5 * {_G} <= l.y + l.h), "
    "reach AS (SELECT id AS node, id AS root FROM word UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), c AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node), "
    "b AS (SELECT plan, root AS id, count(*) AS lines, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1, max(glyph) AS glyph FROM word JOIN c USING (id) GROUP BY plan, root) SELECT plan, id, lines, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b WHERE x1 - x0 >= 3 * glyph"
)
def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return layout.text_blocks(words(spark, folder))


@query(
    f"WITH {WORDS}, l AS (SELECT plan, id, id % 97 % 23 AS space, y, w, glyph FROM word), n AS (SELECT plan, id % 23 AS space, h AS height FROM word WHERE id % 97 = 0), u AS (SELECT plan, median(height) AS usual FROM n GROUP BY plan), "
    "f AS (SELECT l.* FROM l LEFT JOIN u USING (plan) WHERE space > 0 AND w BETWEEN 2 * glyph AND 40 * glyph AND NOT EXISTS (SELECT 1 FROM n WHERE n.plan = l.plan AND n.space = l.space) AND (usual IS NULL OR glyph BETWEEN 0.5 * usual AND 2 * usual)), "
    "r AS (SELECT plan, space, id, row_number() OVER (PARTITION BY plan, space ORDER BY glyph DESC, y, id)::INTEGER AS nth FROM f) SELECT * FROM r WHERE nth <= 3"
)
def lines_to_read(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder)
    return layout.lines_to_read(w.selectExpr("plan", "id", "id % 97 % 23 AS space", "y", "w", "glyph"), w.where("id % 97 = 0").selectExpr("plan", "id % 23 AS space", "h AS height"))


# --- segments, entities, faces, networks


@query(
    "WITH p AS (SELECT p_partkey AS k, p_size FROM part), s AS (SELECT k, ((k * 7) % 50)::DOUBLE AS x0, ((k * 11) % 40)::DOUBLE AS y0, CASE WHEN k % 13 = 0 THEN (k * 7) % 50 ELSE (k * 3) % 50 END::DOUBLE AS x1, CASE WHEN k % 13 = 0 THEN (k * 11) % 40 ELSE (k * 5) % 40 END::DOUBLE AS y1, "
    "CASE WHEN k % 3 <> 1 OR p_size % 5 = 0 THEN 6.0::DOUBLE ELSE greatest(0, p_size - 10)::DOUBLE END AS thickness, CASE WHEN k % 3 <> 1 OR p_size % 7 = 0 THEN 0.5::DOUBLE ELSE greatest(0, least(1, (p_size - 10) / 30)) END AS confidence FROM p WHERE k % 3 < 2), "
    "l AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, fmod(fmod(degrees(atan2(y1 - y0, x1 - x0)), 180) + 180, 180) AS angle FROM s) "
    "SELECT k AS id, x0, y0, x1, y1, thickness, round(confidence, 6) AS confidence, round(len, 6) AS length, CASE WHEN least(angle, 180 - angle) <= 10 THEN 'horizontal' WHEN abs(angle - 90) <= 10 THEN 'vertical' ELSE 'diagonal' END AS orientation FROM l WHERE len > 0"
)
def normalised_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, pairs of points, and broken ones, by part."""
    p = table(spark, folder, "part").selectExpr("p_partkey AS k", "p_size").selectExpr("*", "array((k * 7) % 50, (k * 11) % 40) AS a", "CASE WHEN k % 13 = 0 THEN array((k * 7) % 50, (k * 11) % 40) ELSE array((k * 3) % 50, (k * 5) % 40) END AS b")
    rows = p.selectExpr(
        "k AS id", "CASE k % 3 WHEN 0 THEN concat(a, b) WHEN 2 THEN a END AS line", "CASE k % 3 WHEN 1 THEN a END AS start", "CASE k % 3 WHEN 1 THEN b END AS end",
        "CASE WHEN p_size % 5 > 0 THEN cast(p_size - 10 AS double) END AS thickness", "CASE WHEN p_size % 7 > 0 THEN (p_size - 10) / 30D END AS confidence",
    )
    return layout.normalised_segments(rows, 6.0).withColumns({"confidence": F.round("confidence", 6), "length": F.round("length", 6)})


@query(
    "WITH b AS (SELECT p_type AS layer, CASE WHEN p_size % 2 = 0 THEN 'LINE' ELSE 'LWPOLYLINE' END AS entity, p_size FROM part), a AS (SELECT CASE WHEN p_size = 9 THEN 'lost' ELSE layer END AS layer, entity FROM b WHERE p_size <> 17) "
    "SELECT * FROM (SELECT layer, entity, coalesce(n, 0) AS before, coalesce(m, 0) AS after FROM (SELECT layer, entity, count(*) AS n FROM b GROUP BY ALL) FULL JOIN (SELECT layer, entity, count(*) AS m FROM a GROUP BY ALL) USING (layer, entity)) WHERE before <> after"
)
def count_differences(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "part").selectExpr("p_type AS layer", "CASE WHEN p_size % 2 = 0 THEN 'LINE' ELSE 'LWPOLYLINE' END AS entity", "p_size")
    after = before.where("p_size <> 17").withColumn("layer", F.when(F.col("p_size") == 9, "lost").otherwise(F.col("layer")))
    return layout.count_differences(before, after, ["layer", "entity"])


_FACE = ("o_orderkey AS id", "(o_orderkey * 131) % 40000 - 18000 AS area", "50 + o_orderkey % 350 AS w", "40 + o_orderkey % 170 AS h", "20000 AS page")


@query(
    "WITH f AS (SELECT o_orderkey // 500 AS plan, [o_orderkey % 9, (o_orderkey * 2) % 9, (o_orderkey * 5) % 11 % 4] AS nodes, " + ", ".join(_FACE) + " FROM orders), k AS (SELECT *, array_to_string(list_sort(nodes), ',') AS key, abs(area) AS size FROM f), "
    "o AS (SELECT DISTINCT ON (plan, key) *, min(id) OVER (PARTITION BY plan, key) AS first FROM k ORDER BY plan, key, size, id), v AS (SELECT * FROM o WHERE size >= 700 AND size <= 0.85::DOUBLE * page AND size / greatest(1, w * h) >= 0.15::DOUBLE) "
    "SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY size DESC, first)::INTEGER AS room, id, size FROM v"
)
def valid_faces(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "orders").selectExpr("o_orderkey div 500 AS plan", "array(o_orderkey % 9, (o_orderkey * 2) % 9, (o_orderkey * 5) % 11 % 4) AS nodes", *_FACE)
    return layout.valid_faces(f, 700)


@query(
    f"WITH {CELLS}, s AS (SELECT o_orderkey % 10 AS plan, o_orderkey AS id, greatest(0, least((o_orderkey * 31) % 2200 - 50, 1999)) AS x, greatest(0, least((o_orderkey * 17) % 120 - 5, 99)) AS y FROM orders), "
    "m AS (SELECT s.plan, s.id, label, sum(least(p.x1 - 1, x + 6) - greatest(p.x0, x - 6) + 1) AS n, bool_or(p.y = s.y AND x >= p.x0 AND x < p.x1) AS here FROM s JOIN p ON p.plan = s.plan AND p.label > 0 AND abs(p.y - s.y) <= 6 AND p.x0 <= x + 6 AND p.x1 > x - 6 GROUP BY ALL), "
    "b AS (SELECT DISTINCT ON (id) * FROM m ORDER BY id, here DESC, n DESC, label) SELECT s.plan, s.id, coalesce(label, 0) AS label FROM s LEFT JOIN b USING (id)"
)
def label_at(spark: SparkSession, folder: str) -> DataFrame:
    at = table(spark, folder, "orders").selectExpr("o_orderkey % 10 AS plan", "o_orderkey AS id", "(o_orderkey * 31) % 2200 - 50 AS x", "(o_orderkey * 17) % 120 - 5 AS y")
    return layout.label_at(at, cells(spark, folder, "O"), 2000, 100)


_NETWORK = ("o_orderkey AS id", "(o_orderkey * 31) % 900 AS x", "(o_orderkey * 17) % 700 AS y", "(20 + o_orderkey % 30) * (1 + o_orderkey % 9) AS w", "(10 + o_orderkey % 18) * (1 + o_orderkey % 9) AS h", "(o_orderkey * 7) % 41 AS openings")


@query(
    "WITH n AS (SELECT o_orderkey // 400 AS plan, " + ", ".join(_NETWORK) + " FROM orders), r AS (SELECT *, w * h AS area, max(openings) FILTER (openings >= 2) OVER (PARTITION BY plan) AS most FROM n WHERE openings >= 2), fit AS (SELECT * FROM r WHERE NOT openings < greatest(2, 0.15::DOUBLE * most)), "
    "c AS (SELECT l.plan, l.id AS a, r.id AS b, l.openings AS ao, r.openings AS bo, l.area AS aa, r.area AS ba, (least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * (least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) AS common FROM fit l JOIN fit r ON l.plan = r.plan AND l.id <> r.id AND l.x < r.x + r.w AND r.x < l.x + l.w AND l.y < r.y + r.h AND r.y < l.y + l.h), "
    "frame AS (SELECT DISTINCT a AS id FROM c WHERE bo > ao AND common >= 0.8::DOUBLE * ba), kept AS (SELECT * FROM fit WHERE id NOT IN (SELECT id FROM frame)), part AS (SELECT DISTINCT a AS id FROM c WHERE a IN (SELECT id FROM kept) AND b IN (SELECT id FROM kept) AND common >= 0.8::DOUBLE * aa AND ba > aa), big AS (SELECT plan, max(area) AS largest FROM kept GROUP BY plan) "
    "SELECT r.plan, r.id, CASE WHEN openings < greatest(2, 0.15::DOUBLE * most) THEN 'few openings' WHEN r.id IN (SELECT id FROM frame) THEN 'frame' WHEN r.id IN (SELECT id FROM part) THEN 'part' WHEN area < 0.05::DOUBLE * largest THEN 'too small' ELSE 'building' END AS what FROM r LEFT JOIN big USING (plan)"
)
def buildings(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "orders").selectExpr("o_orderkey div 400 AS plan", *_NETWORK).selectExpr("*", "w * h AS area")
    common = "(least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * (least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) AS common"
    met = spatial.met_on_grid(n, n, 64, 0, ["plan"]).where("l.id < r.id AND l.x < r.x + r.w AND r.x < l.x + l.w AND l.y < r.y + r.h AND r.y < l.y + l.h")
    return layout.buildings(n, met.selectExpr("l.plan", "l.id AS a", "r.id AS b", common))


# --- reports against true plans


@query(
    f"WITH {SPACES}, {LABELS}, p AS (SELECT *, CASE WHEN id % 4 = 0 THEN '_' || id ELSE (id % 3)::VARCHAR END AS grp FROM label), h AS (SELECT l.id, l.grp, s.id AS polygon FROM p l JOIN space s ON l.plan = s.plan AND {_inside('l.x', 'l.y')}), mixed AS (SELECT polygon, count(DISTINCT grp) > 1 AS mixed FROM h GROUP BY polygon), "
    "f AS (SELECT id, min(polygon) AS polygon FROM h GROUP BY id) SELECT p.plan, p.id, CASE WHEN mixed THEN 'merged' WHEN polygon IS NULL THEN 'missed' ELSE 'recovered' END AS status FROM p LEFT JOIN f USING (id) LEFT JOIN mixed USING (polygon)"
)
def point_recovery(spark: SparkSession, folder: str) -> DataFrame:
    points = label_table(spark, folder).withColumn("group", F.expr("CASE WHEN id % 4 > 0 THEN id % 3 END"))
    return layout.point_recovery(points, spaces(spark, folder))


_POINT = ("o_custkey % 50 AS plan", "CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 END AS space", "CASE o_orderkey % 4 WHEN 0 THEN 'cook' WHEN 1 THEN 'live' WHEN 2 THEN 'dine' END AS zone_function")


@query(
    "WITH p AS (SELECT " + ", ".join(_POINT) + ", CASE WHEN o_orderkey % 6 = 1 THEN ['live'] WHEN o_orderkey % 5 = 0 THEN ['cook', 'dine'] ELSE ['live'] END AS functions FROM orders), z AS (SELECT c_custkey % 55 AS plan, c_custkey % 9 AS space FROM customer), "
    "s AS (SELECT plan, space FROM (SELECT plan, space, unnest(functions) AS f FROM p WHERE space IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT f) > 1), h AS (SELECT plan, count(*) AS zone_points, count(*) FILTER (list_contains(functions, zone_function)) AS correct, count(*) FILTER (NOT list_contains(functions, zone_function)) AS wrong_function, count(*) FILTER (zone_function IS NULL) AS no_zone FROM p JOIN s USING (plan, space) GROUP BY plan), "
    "m AS (SELECT plan, count(*) AS zones, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.plan = z.plan AND s.space = z.space)) AS unsupported_zones FROM z GROUP BY plan) "
    "SELECT plan, coalesce(zone_points, 0) AS zone_points, coalesce(correct, 0) AS correct, coalesce(wrong_function, 0) AS wrong_function, coalesce(no_zone, 0) AS no_zone, coalesce(zones, 0) AS zones, coalesce(unsupported_zones, 0) AS unsupported_zones FROM h FULL JOIN m USING (plan)"
)
def zone_report(spark: SparkSession, folder: str) -> DataFrame:
    functions = "CASE WHEN o_orderkey % 6 = 1 THEN array('live') WHEN o_orderkey % 5 = 0 THEN array('cook', 'dine') ELSE array('live') END AS functions"
    return layout.zone_report(table(spark, folder, "orders").selectExpr(*_POINT, functions), table(spark, folder, "customer").selectExpr("c_custkey % 55 AS plan", "c_custkey % 9 AS space"))


_CONNECTS = (("s1", "s2"), ("exterior", "s1"), ("s2", "s2"), ("s4", "s3"), ("exterior", "exterior"), ("s9", "s3"), ("exterior", "s8"), ("s7",))
_MATCHED = ("o_custkey % 40 AS plan", "CASE o_orderstatus WHEN 'O' THEN 'door' WHEN 'F' THEN 'window' ELSE 'opening' END AS kind", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS host", "CASE o_orderkey % 3 WHEN 0 THEN 'single hinged' WHEN 1 THEN 'sliding' END AS operation")


@query(
    "WITH m AS (SELECT " + ", ".join(_MATCHED) + ", [" + ", ".join("['" + "', '".join(c) + "']" for c in _CONNECTS) + "][o_orderkey % 8 + 1] AS c, 's' || o_orderkey % 4 AS swing FROM orders), g AS (SELECT c_custkey % 40 AS plan, 's' || c_custkey % 6 AS space, list(DISTINCT c_nationkey % 6) AS rooms FROM customer GROUP BY ALL), "
    "r AS (SELECT *, list_filter(c, lambda x: x <> 'exterior') AS inside, list_filter(c, lambda x: x NOT IN ('exterior', 's9')) AS rooms, list_contains(c, 'exterior') AS outer_ FROM m WHERE kind <> 'opening'), "
    "j AS (SELECT r.*, a.rooms AS ar, b.rooms AS br, d.rooms AS dr FROM r LEFT JOIN g a ON a.plan = r.plan AND a.space = inside[1] LEFT JOIN g b ON b.plan = r.plan AND b.space = inside[2] LEFT JOIN g d ON d.plan = r.plan AND d.space = r.rooms[1]), "
    "v AS (SELECT *, kind = 'door' AS door, CASE WHEN len(list_distinct(inside)) = 2 THEN NOT coalesce(list_has_any(ar, br), false) ELSE outer_ AND len(inside) = 1 END AS joins FROM j) "
    "SELECT plan, count(*) AS matched, count(host) AS hosted, count(*) FILTER (door) AS doors, count(*) FILTER (door AND joins) AS door_connects, count(*) FILTER (door AND operation = 'single hinged') AS hinged, count(*) FILTER (door AND operation = 'single hinged' AND list_contains(inside, swing)) AS swing_resolved, "
    "count(*) FILTER (NOT door) AS windows, count(*) FILTER (NOT door AND len(c) = 2 AND len(rooms) = 1 AND dr IS NOT NULL) AS window_exterior FROM v GROUP BY plan"
)
def topology_report(spark: SparkSession, folder: str) -> DataFrame:
    connects = F.element_at(F.array(*[F.array(*[F.lit(s) for s in c]) for c in _CONNECTS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, folder, "orders").withColumn("connects", connects)
    matched = o.selectExpr(*_MATCHED, "connects", "concat('s', o_orderkey % 4) AS swing_into", "array('s9') AS outdoor")
    points = table(spark, folder, "customer").selectExpr("c_custkey % 40 AS plan", "concat('s', c_custkey % 6) AS space", "c_nationkey % 6 AS group")
    return layout.topology_report(matched, points)


_PACKED = "{n}w AS (SELECT plan, y // 10 AS y, x0, x1, label FROM {n})"
_GROWN = (
    "{n}g AS (SELECT plan, y + dy AS y, x0 - dx AS x0, x1 + dx AS x1 FROM {of} CROSS JOIN (VALUES (-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) s(dy, dx)), {n}s AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY plan, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM {n}g), "
    "{n}p AS (SELECT *, sum(starts) OVER (PARTITION BY plan, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS part FROM {n}s), {n}d AS (SELECT plan, y, min(x0) AS x0, max(x1) AS x1 FROM {n}p GROUP BY plan, y, part)"
)


def _on(runs: str, by: str, name: str) -> str:
    return f"{name} AS (SELECT r.plan, sum(least(r.x1, b.x1) - greatest(r.x0, b.x0))::BIGINT AS n FROM {runs} r JOIN {by} b ON r.plan = b.plan AND r.y = b.y AND b.x0 < r.x1 AND r.x0 < b.x1 GROUP BY r.plan)"


def _walls(spark: SparkSession, folder: str, status: str) -> DataFrame:
    """Rows of a plan are every tenth supplier, so neighbours are ten apart."""
    return cells(spark, folder, status).withColumn("y", F.floor(F.col("y") / 10))


@query(
    f"WITH {CELLS}, {_PACKED.format(n='p')}, {_PACKED.format(n='t')}, band AS (SELECT * FROM tw WHERE label < 3), {_GROWN.format(n='f', of='pw')}, {_GROWN.format(n='d', of='tw')}, {_GROWN.format(n='b', of='band')}, {_on('pw', 'dd', 'fw')}, {_on('tw', 'fd', 'dc')}, {_on('pw', 'bd', 'ob')}, "
    "a AS (SELECT plan, sum(x1 - x0)::BIGINT AS found_px FROM pw GROUP BY plan), c AS (SELECT plan, sum(x1 - x0)::BIGINT AS drawn_px FROM tw GROUP BY plan), j AS (SELECT plan, coalesce(found_px, 0) AS found_px, coalesce(fw.n, 0) AS found_on_wall, coalesce(drawn_px, 0) AS drawn_px, coalesce(dc.n, 0) AS drawn_covered, coalesce(ob.n, 0) AS on_band "
    "FROM a FULL JOIN c USING (plan) LEFT JOIN fw USING (plan) LEFT JOIN dc USING (plan) LEFT JOIN ob USING (plan)) SELECT plan, found_px, found_on_wall, drawn_px, drawn_covered, found_px - on_band AS fabricated_px, round_even(found_on_wall / found_px, 6) AS precision, round_even(drawn_covered / drawn_px, 6) AS recall FROM j"
)
def wall_report(spark: SparkSession, folder: str) -> DataFrame:
    drawn = _walls(spark, folder, "F")
    return layout.wall_report(_walls(spark, folder, "O"), drawn, drawn.where("label < 3"), ["plan"])


@query(
    f"WITH RECURSIVE {CELLS}, {_PACKED.format(n='p')}, {_PACKED.format(n='t')}, band AS (SELECT * FROM tw WHERE label = 0), thin AS (SELECT * FROM pw WHERE label > 1), {_GROWN.format(n='b', of='band')}, "
    "s AS (SELECT *, CASE WHEN x0 <= lag(x1) OVER (PARTITION BY plan, y ORDER BY x0) THEN 0 ELSE 1 END AS starts FROM thin), q AS (SELECT *, sum(starts) OVER (PARTITION BY plan, y ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS part FROM s), "
    "r AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT plan, y, min(x0) AS x0, max(x1) AS x1 FROM q GROUP BY plan, y, part)), e AS (SELECT l.id AS a, u.id AS b FROM r l JOIN r u ON l.plan = u.plan AND abs(l.y - u.y) = 1 AND u.x0 <= l.x1 AND l.x0 <= u.x1), "
    "reach AS (SELECT id AS node, id AS root FROM r UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node), c AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node), "
    "h AS (SELECT r.id, sum(least(r.x1, b.x1) - greatest(r.x0, b.x0)) AS n FROM r JOIN bd b ON r.plan = b.plan AND r.y = b.y AND b.x0 < r.x1 AND r.x0 < b.x1 GROUP BY r.id), k AS (SELECT plan, root, sum(x1 - x0) AS size, coalesce(sum(n), 0) AS on_band FROM r JOIN c USING (id) LEFT JOIN h USING (id) GROUP BY plan, root) "
    "SELECT plan, count(*) AS components, count(*) FILTER (size >= 20 AND on_band * 10 < size) AS phantoms FROM k GROUP BY plan"
)
def phantoms(spark: SparkSession, folder: str) -> DataFrame:
    found = sequence.sweep_merge(_walls(spark, folder, "O").where("label > 1"), ["plan", "y"], "x0", "x1").withColumn("id", F.concat_ws(":", "plan", "y", "x0"))
    return layout.phantoms(found, _walls(spark, folder, "F").where("label = 0"), ["plan"])


@query(
    "WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS near, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, near ORDER BY event_id) AS part FROM e), "
    "k AS (SELECT user_id, part, count(*) AS run FROM r WHERE near GROUP BY ALL), l AS (SELECT user_id, max(run) AS longest FROM k GROUP BY user_id) "
    "SELECT user_id, round(avg(near::INTEGER) * least(1, coalesce(any_value(longest), 0) / (0.4::DOUBLE * count(*))), 6) AS support FROM e LEFT JOIN l USING (user_id) GROUP BY user_id"
)
def curve_support(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events stand for the points of a curve; clicks and views are drawn ones."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("near"))
    return sequence.curve_support(e, "user_id", ["event_id"], "near").withColumn("support", F.round("support", 6))


# --- pieces, arcs, classes, budgets, types


@query(
    f"WITH {WALLS} SELECT plan, id FROM wall l WHERE id % 10 <> 1 AND NOT EXISTS (SELECT 1 FROM wall r WHERE l.plan = r.plan AND r.id % 10 = 1 AND {_DOT} >= 0.95 AND {_ACROSS} <= 0.75 * greatest(l.thickness, r.thickness, 3) AND {_COMMON} >= 0.5 * least(l.len, r.len))"
)
def new_openings(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth wall stands for a known opening."""
    w = wall_table(spark, folder)
    return openings.new_openings(w.where("id % 10 <> 1"), w.where("id % 10 = 1"))


@query(
    f"WITH RECURSIVE {WALLS}, s AS (SELECT plan, id, x0, y0, x1, y1, abs(x1 - x0) >= abs(y1 - y0) AS flat FROM wall), met AS (SELECT l, r FROM s l JOIN s r ON l.plan = r.plan AND l.id <> r.id), "
    "x AS (SELECT l.plan AS plan, l.id AS id, r.id AS other, 0 AS which, CASE WHEN l.flat THEN l ELSE r END AS h, CASE WHEN l.flat THEN r ELSE l END AS v FROM met WHERE l.flat <> r.flat), c AS (SELECT plan, id, other, which, (v.x0 + v.x1) / 2 AS px, (h.y0 + h.y1) / 2 AS py FROM x "
    "WHERE (v.x0 + v.x1) / 2 BETWEEN least(h.x0, h.x1) - 10 AND greatest(h.x0, h.x1) + 10 AND (h.y0 + h.y1) / 2 BETWEEN least(v.y0, v.y1) - 10 AND greatest(v.y0, v.y1) + 10), "
    "e AS (SELECT l.plan AS plan, l.id AS id, r.id AS other, which, CASE which WHEN 0 THEN r.x0 ELSE r.x1 END AS px, CASE which WHEN 0 THEN r.y0 ELSE r.y1 END AS py, l FROM met CROSS JOIN (VALUES (0), (1)) w(which) WHERE l.flat = r.flat), "
    "p AS (SELECT plan, id, NULL::BIGINT AS other, 0 AS which, x0 AS px, y0 AS py FROM s UNION ALL SELECT plan, id, NULL, 1, x1, y1 FROM s UNION ALL SELECT * FROM c UNION ALL SELECT plan, id, other, which, px, py FROM e "
    "WHERE abs((px - l.x0) * (l.y1 - l.y0) - (py - l.y0) * (l.x1 - l.x0)) <= 10 AND px BETWEEN least(l.x0, l.x1) - 10 AND greatest(l.x0, l.x1) + 10 AND py BETWEEN least(l.y0, l.y1) - 10 AND greatest(l.y0, l.y1) + 10), "
    "turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan, id ORDER BY other NULLS FIRST, which) AS nth FROM p), "
    "walk AS (SELECT plan, id, 0::BIGINT AS nth, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, NULL::DOUBLE AS px, NULL::DOUBLE AS py, false AS stays FROM s UNION ALL SELECT t.plan, t.id, t.nth, CASE WHEN len(list_filter(w.kept, lambda k: sqrt((k.x - t.px) ** 2 + (k.y - t.py) ** 2) <= 5)) > 0 THEN w.kept ELSE list_append(w.kept, {'x': t.px, 'y': t.py}) END, "
    "t.px, t.py, len(list_filter(w.kept, lambda k: sqrt((k.x - t.px) ** 2 + (k.y - t.py) ** 2) <= 5)) = 0 FROM walk w JOIN turns t ON t.plan = w.plan AND t.id = w.id AND t.nth = w.nth + 1), "
    "o AS (SELECT plan, id, px AS x0, py AS y0, lead(px) OVER q AS x1, lead(py) OVER q AS y1 FROM walk JOIN s USING (plan, id) WHERE stays WINDOW q AS (PARTITION BY plan, id ORDER BY CASE WHEN flat THEN px ELSE py END, nth)) SELECT * FROM o WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 2"
)
def atomic_segments(spark: SparkSession, folder: str) -> DataFrame:
    return openings.atomic_segments(wall_table(spark, folder))


_CUBIC = {"ax": "0", "ay": "k % 5", "bx": "k % 7", "by_": "10 + k % 6", "cx": "8 + k % 5", "cy": "18 + k % 4", "dx": "20", "dy": "18 + k % 7"}


@query(
    "WITH c AS (SELECT p_partkey AS k, " + ", ".join(f"({e.replace('k', 'p_partkey')})::DOUBLE AS {n}" for n, e in _CUBIC.items()) + " FROM part), u AS (SELECT *, bx - ax AS ux, by_ - ay AS uy, dx - cx AS vx, dy - cy AS vy FROM c), d AS (SELECT *, uy * vx - ux * vy AS det FROM u WHERE sqrt(ux ** 2 + uy ** 2) >= 1e-6 AND sqrt(vx ** 2 + vy ** 2) >= 1e-6), "
    "s AS (SELECT *, (-(dx - ax) * vx - (dy - ay) * vy) / det AS s FROM d WHERE abs(det) >= 1e-9), m AS (SELECT *, ax - s * uy AS x, ay + s * ux AS y FROM s), r AS (SELECT *, sqrt((x - ax) ** 2 + (y - ay) ** 2) AS r0, sqrt((x - dx) ** 2 + (y - dy) ** 2) AS r3, sqrt((x - (ax + 3 * bx + 3 * cx + dx) / 8) ** 2 + (y - (ay + 3 * by_ + 3 * cy + dy) / 8) ** 2) AS mid, degrees(atan2(dy - y, dx - x) - atan2(ay - y, ax - x)) AS turn FROM m) "
    "SELECT k AS p_partkey, round(x, 4) AS x, round(y, 4) AS y, round((r0 + r3) / 2, 4) AS radius, round(abs(fmod(fmod(turn + 180, 360) + 360, 360) - 180), 4) AS sweep FROM r WHERE r0 >= 1 AND abs(r0 - r3) <= 0.08::DOUBLE * r0 AND abs(mid - r0) <= 0.08::DOUBLE * r0"
)
def cubic_arcs(spark: SparkSession, folder: str) -> DataFrame:
    at = {n: F.expr(f"cast({e.replace('k', 'p_partkey')} AS double)") for n, e in _CUBIC.items()}
    point = lambda x, y: F.struct(at[x].alias("x"), at[y].alias("y"))
    arc = geometry.cubic_arc(point("ax", "ay"), point("bx", "by_"), point("cx", "cy"), point("dx", "dy"))
    return table(spark, folder, "part").select("p_partkey", arc.alias("a")).where("a IS NOT NULL").select("p_partkey", *[F.round(f"a.{c}", 4).alias(c) for c in ("x", "y", "radius", "sweep")])


@query(
    "WITH RECURSIVE o AS (SELECT o_custkey, list((o_orderkey % 97)::DOUBLE ORDER BY o_orderkey % 97) FILTER (o_orderkey % 3 > 0) AS cuts, 100.0::DOUBLE AS gap, 9.0::DOUBLE AS least FROM orders GROUP BY o_custkey), w AS (SELECT o_custkey, coalesce(cuts, []) AS cuts, gap, least, 1 AS i, [0.0::DOUBLE] AS kept FROM o "
    "UNION ALL SELECT o_custkey, cuts, gap, least, i + 1, CASE WHEN cuts[i] - kept[-1] >= least THEN list_append(kept, cuts[i]) ELSE kept END FROM w WHERE i <= len(cuts)), f AS (SELECT o_custkey, CASE WHEN len(cuts) = 0 THEN [0.0::DOUBLE, gap] WHEN gap - kept[-1] < least THEN list_append(kept[:-2], gap) ELSE list_append(kept, gap) END AS p FROM w WHERE i = len(cuts) + 1) "
    "SELECT o_custkey, p[j] AS low, p[j + 1] AS high FROM f, LATERAL (SELECT unnest(range(1, len(p))) AS j)"
)
def gap_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders stand for cuts of a gap of a hundred; pieces are nine long at least."""
    cut = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 97).cast("double"))
    by = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list(cut).alias("cuts"))  # the cuts of one gap
    return by.select("o_custkey", F.inline(geometry.gap_pieces(F.col("cuts"), F.lit(100.0), F.lit(9.0))))


_RATE = "(event_id * 7 + user_id) % (9 + user_id % 40) = 0"


@query(
    f"WITH e AS (SELECT user_id, event_id, {_RATE} AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events), b AS (SELECT *, (nth - 1) // 8 AS batch FROM e WHERE nth <= 60), "
    "s AS (SELECT user_id, min(b.batch) AS stop FROM b WHERE b.batch * 8 >= 16 AND (SELECT count(*) FILTER (hit) FROM b a WHERE a.user_id = b.user_id AND a.batch < b.batch) < greatest(1, b.batch * 8 / 12) GROUP BY user_id) SELECT user_id, event_id FROM b LEFT JOIN s USING (user_id) WHERE stop IS NULL OR batch < stop"
)
def paying_rows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id")
    return sequence.paying_rows(e, "user_id", "event_id", "event_id", F.expr(_RATE)).select("user_id", "event_id")


def _class(n: int) -> str:
    """A round of classes in SQL: from rows r{n} to class k{n} and rows r{n + 1}."""
    return (
        f"c{n} AS (SELECT g, c, sum(m) AS mass FROM r{n} JOIN (SELECT DISTINCT g, round_even(v, 0) AS c FROM r{n}) USING (g) WHERE abs(v - c) <= 0.18::DOUBLE * c + 1 GROUP BY ALL), b{n} AS (SELECT DISTINCT ON (g) g, c FROM c{n} JOIN total USING (g) WHERE mass >= 0.12::DOUBLE * whole ORDER BY g, mass DESC, c), "
        f"k{n} AS (SELECT g, {n} AS nth, sum(v * m) / sum(m) AS middle, sum(m)::BIGINT AS mass FROM r{n} JOIN b{n} USING (g) WHERE abs(v - c) <= 0.18::DOUBLE * c + 1 GROUP BY g), r{n + 1} AS (SELECT g, v, m FROM r{n} JOIN b{n} USING (g) WHERE NOT abs(v - c) <= 0.18::DOUBLE * c + 1)"
    )


@query(
    "WITH r1 AS (SELECT o_custkey AS g, (o_orderkey * 13 % 211) / 4.0::DOUBLE AS v, sum(o_orderkey % 50 + 1) AS m FROM orders GROUP BY ALL), total AS (SELECT g, sum(m) AS whole FROM r1 GROUP BY g), " + ", ".join(_class(n) for n in (1, 2, 3)) + ", a AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) SELECT g, nth, round(middle, 6) AS middle, mass FROM a"
)
def weighted_classes(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").selectExpr("o_custkey AS g", "(o_orderkey * 13 % 211) / 4D AS v", "o_orderkey % 50 + 1 AS m")
    return sequence.weighted_classes(o, "g", "v", "m").select("g", "nth", F.round("middle", 6).alias("middle"), "mass")


_ROOM = ("o_custkey % 60 AS plan", "o_orderkey % 400 AS space", "2000 + (o_orderkey * 37) % 90000 AS pixels", "CASE WHEN o_orderkey % 5 < 3 THEN 'ft' ELSE 'm' END AS unit")


@query(
    "WITH r AS (SELECT " + ", ".join(_ROOM) + ", 0.5::DOUBLE + (o_orderkey % 9) / 2.0::DOUBLE AS a, 1 + (o_orderkey % 7) / 4.0::DOUBLE AS b FROM orders), o AS (SELECT *, count(*) OVER (PARTITION BY plan, space) AS names, sqrt(pixels / (a * b)) AS root FROM r), e AS (SELECT plan, unit, count(*) AS rooms, median(root) AS middle FROM o WHERE names = 1 AND least(a, b) >= CASE unit WHEN 'ft' THEN 2.5::DOUBLE ELSE 0.75::DOUBLE END AND root BETWEEN 20 AND 120 GROUP BY ALL) "
    "SELECT DISTINCT ON (plan) plan, unit, round_even(middle, 2) AS pixels_per_unit, rooms FROM e ORDER BY plan, rooms DESC, unit"
)
def scale_of_rooms(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.scale_of_rooms(table(spark, folder, "orders").selectExpr(*_ROOM, "0.5D + (o_orderkey % 9) / 2D AS side_a", "1 + (o_orderkey % 7) / 4D AS side_b"))


_EVIDENCE = (
    "CASE k % 4 WHEN 0 THEN 'single_line' WHEN 1 THEN 'line_pair' ELSE 'wall_gap' END AS source", "CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'same_space' WHEN 2 THEN 'between_rooms' ELSE 'room_to_exterior' END AS relation", "k % 23 = 0 AS sliding", "k % 11 / 12.0 AS arc", "k % 13 / 16.0 AS double_arc", "k % 17 / 20.0 AS leaf",
    "CASE WHEN k % 6 > 3 THEN k % 6 - 3 ELSE 0 END AS glazed", "k % 7 = 3 AS dashed", "k % 6 > 3 OR k % 7 = 3 OR k % 9 = 1 AS inner_", "k % 3 AS faces", "k % 4 AS covered", "k % 8 / 8.0 AS most", "(k % 90 + 10) * 1.0 AS width", "(4 + k % 5) * 1.0 AS thickness", "(k % 7) * 1.0 AS wall", "CASE WHEN k % 2 = 0 THEN k % 12 * 1.0 END AS feet",
)
_SINGLE = "source = 'single_line'"


@query(
    "WITH e AS (SELECT p_partkey AS k, " + ", ".join(c.replace("k %", "p_partkey %").replace(".0", ".0::DOUBLE") for c in _EVIDENCE) + f" FROM part), a AS (SELECT k, source, relation, sliding AND NOT {_SINGLE} AS slides, arc, double_arc * 1.05::DOUBLE AS two, leaf * 0.95::DOUBLE AS one, CASE WHEN {_SINGLE} THEN least(1, covered) ELSE faces END AS f, inner_ AND NOT {_SINGLE} AS held, most, feet, width, thickness, greatest(wall, 1) AS t, "
    f"CASE WHEN {_SINGLE} THEN 0 WHEN glazed >= 2 OR (glazed = 1 AND faces > 0) THEN 0.92::DOUBLE WHEN glazed = 1 THEN 0.8::DOUBLE WHEN dashed THEN 0.62::DOUBLE ELSE 0 END AS glass FROM e), b AS (SELECT *, greatest(arc, two, one) AS door, relation = 'between_rooms' AS inside, relation = 'room_to_exterior' AS outside, CASE WHEN feet IS NULL THEN width <= 6 * greatest(thickness, t) ELSE feet <= 4.6::DOUBLE END AS small, CASE WHEN feet IS NULL THEN width >= 14 * t ELSE feet >= 8 END AS garage FROM a), "
    "w AS (SELECT *, CASE WHEN slides THEN 1 WHEN door >= 0.55::DOUBLE AND door >= glass - 0.1::DOUBLE THEN 2 WHEN glass >= 0.62::DOUBLE AND inside AND glass < 0.8::DOUBLE THEN 3 WHEN glass >= 0.62::DOUBLE THEN 4 WHEN f > 0 AND NOT held THEN 5 WHEN most < 0.2::DOUBLE AND door < 0.35::DOUBLE THEN 6 ELSE 7 END AS way FROM b), "
    "v AS (SELECT *, CASE WHEN way IN (1, 2) THEN 'door' WHEN way = 4 THEN 'window' WHEN way = 5 AND (inside OR (outside AND ((small AND f >= 2) OR garage))) THEN 'door' ELSE 'opening' END AS kind, "
    "CASE way WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN least(0.95::DOUBLE, 0.6::DOUBLE + 0.35::DOUBLE * door + CASE WHEN inside THEN 0.05::DOUBLE ELSE 0 END) WHEN 3 THEN 0.45::DOUBLE WHEN 4 THEN least(0.95::DOUBLE, 0.45::DOUBLE + 0.5 * glass - CASE WHEN inside THEN 0.15::DOUBLE ELSE 0 END) WHEN 5 THEN CASE WHEN inside THEN 0.72::DOUBLE WHEN outside AND small AND f >= 2 THEN 0.62::DOUBLE WHEN outside AND garage THEN 0.58::DOUBLE ELSE 0.4::DOUBLE END ELSE 0.4::DOUBLE END AS c, "
    "CASE way WHEN 1 THEN 'sliding panels' WHEN 2 THEN CASE WHEN two >= greatest(arc, one) THEN 'double swing' WHEN arc >= one THEN 'swing arc' ELSE 'door leaf' END WHEN 3 THEN 'weak glazing' WHEN 4 THEN CASE WHEN glass >= 0.8::DOUBLE THEN 'glazing lines' ELSE 'dashed glazing line' END WHEN 5 THEN 'outline only' WHEN 6 THEN 'bare gap' ELSE 'none' END AS symbol FROM w) "
    "SELECT k AS p_partkey, kind, round_even(c * CASE WHEN relation IN ('unknown', 'same_space') AND kind <> 'opening' THEN 0.85::DOUBLE ELSE 1 END, 2) AS confidence, symbol FROM v"
)
def opening_types(spark: SparkSession, folder: str) -> DataFrame:
    of = [c.replace("k %", "p_partkey %").replace(".0", ".0D").replace("inner_", "inner") for c in _EVIDENCE]
    return table(spark, folder, "part").selectExpr("p_partkey", *of).withColumn("t", rules.opening_type()).select("p_partkey", "t.kind", "t.confidence", "t.symbol")
