"""Queries of small rules: pairs of boxes that are one thing, statuses, scales, names, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselwork.functions import geometry, rules
from tesselwork.operators import regions, select, spatial
from tesselwork.plans.catalog import query
from tesselwork.plans.drawing import LABELS, SPACES, _inside, label_table, spaces
from tesselwork.plans.more import COMMON, cells, region_overlaps
from tesselwork.sources.tables import table

# --- boxes of texts: orders on a page of 2,000 by 1,000, a plan for each thousand

_BOX = ("o_orderkey AS id", "(o_orderkey * 31) % 400 AS x", "(o_orderkey * 17) % 300 AS y", "20 + o_orderkey % 30 AS w", "10 + o_orderkey % 8 AS h", "o_orderkey % 3 AS kind", "o_orderstatus AS text", "(o_orderkey * 7919) % 101 AS conf")
TEXT_BOXES = "box AS (SELECT o_orderkey // 1000 AS plan, " + ", ".join(_BOX) + " FROM orders)"
_COMMON = "greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y))"
_APART = "sqrt((l.x + l.w / 2 - r.x - r.w / 2) ** 2 + (l.y + l.h / 2 - r.y - r.h / 2) ** 2)"


def text_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("o_orderkey div 1000 AS plan", *_BOX)


@query(
    f"WITH {TEXT_BOXES} SELECT l.id AS left_id, r.id AS right_id FROM box l JOIN box r ON l.plan = r.plan AND l.id < r.id AND l.h / greatest(1, r.h) >= 0.6::DOUBLE AND l.h / greatest(1, r.h) <= 1.65::DOUBLE AND l.w / greatest(1, r.w) BETWEEN 0.5 AND 2 "
    f"AND ({_COMMON} >= 0.6::DOUBLE * least(l.w * l.h, r.w * r.h) OR {_APART} <= 0.25::DOUBLE * greatest(least(l.w, l.h), least(r.w, r.h), 4))"
)
def same_place_pairs(spark: SparkSession, folder: str) -> DataFrame:
    b = text_boxes(spark, folder)
    return spatial.met_on_grid(b, b, 64, 16, ["plan"]).where("l.id < r.id").where(select.same_place()).selectExpr("l.id AS left_id", "r.id AS right_id")


@query(
    f"WITH {TEXT_BOXES} SELECT l.id AS left_id, r.id AS right_id FROM box l JOIN box r ON l.plan = r.plan AND l.id < r.id AND l.text = r.text AND ({_APART} <= greatest(20, 0.75::DOUBLE * greatest(l.w, l.h, r.w, r.h)) OR {_COMMON} / (l.w * l.h + r.w * r.h - {_COMMON}) >= 0.25::DOUBLE)"
)
def same_text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    b = text_boxes(spark, folder)
    return spatial.met_on_grid(b, b, 64, 40, ["plan", "text"]).where("l.id < r.id").where(select.same_text()).selectExpr("l.id AS left_id", "r.id AS right_id")


@query(
    f"WITH RECURSIVE {TEXT_BOXES}, near AS (SELECT l.id, list(r.id) AS others FROM box l JOIN box r ON l.plan = r.plan AND l.id <> r.id AND ({_COMMON} >= 0.85::DOUBLE * (l.w * l.h + r.w * r.h - {_COMMON}) OR (l.kind = r.kind AND {_COMMON} >= 0.5 * (l.w * l.h + r.w * r.h - {_COMMON}))) GROUP BY l.id), "
    "turns AS MATERIALIZED (SELECT plan, id, coalesce(others, []) AS others, row_number() OVER (PARTITION BY plan ORDER BY conf DESC, id) AS nth FROM box LEFT JOIN near USING (id)), "
    "walk AS (SELECT plan, 0::BIGINT AS nth, NULL::BIGINT AS id, []::BIGINT[] AS kept, false AS stays FROM (SELECT DISTINCT plan FROM box) UNION ALL SELECT t.plan, t.nth, t.id, CASE WHEN list_has_any(w.kept, t.others) THEN w.kept ELSE list_append(w.kept, t.id) END, NOT list_has_any(w.kept, t.others) "
    "FROM walk w JOIN turns t ON t.plan = w.plan AND t.nth = w.nth + 1) SELECT id FROM walk WHERE stays"
)
def objects_once(spark: SparkSession, folder: str) -> DataFrame:
    """One box for each drawn thing: of near-identical ones the most confident."""
    b = text_boxes(spark, folder)
    clashes = spatial.met_on_grid(b, b, 64, 0, ["plan"]).where("l.id < r.id").where(select.same_object()).selectExpr("l.id AS a", "r.id AS b")
    return select.keep_first(b, clashes, "id", "conf")


@query(
    f"WITH {TEXT_BOXES}, d AS (SELECT * FROM box WHERE id % 2 = 0), g AS (SELECT * FROM box WHERE id % 2 = 1), m AS (SELECT l.id, r.id AS truth, l.kind = r.kind AS ok, round_even({_COMMON} / (l.w * l.h + r.w * r.h - {_COMMON}), 6) AS iou FROM d l JOIN g r ON l.plan = r.plan AND {_COMMON} >= 0.6::DOUBLE * least(l.w * l.h, r.w * r.h)), "
    "n AS (SELECT DISTINCT ON (id) * FROM m WHERE iou >= 0.15::DOUBLE ORDER BY id, ok DESC, iou DESC, truth) SELECT d.id, truth, CASE WHEN truth IS NULL THEN 'false' WHEN ok THEN 'correct' ELSE 'wrong kind' END AS verdict FROM d LEFT JOIN n USING (id)"
)
def detection_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each detection against its best true object: of its kind first, then by overlap; .6 of the smaller, IoU .15."""
    b = text_boxes(spark, folder)
    found, truth = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    met = spatial.met_on_grid(found, truth, 64, 0, ["plan"]).withColumn("common", geometry.box_intersection("l", "r"))
    met = met.selectExpr("l.id", "r.id AS truth", "l.kind = r.kind AS ok", "bround(common / (l.w * l.h + r.w * r.h - common), 6) AS iou", "common / least(l.w * l.h, r.w * r.h) AS share").where("share >= 0.6D AND iou >= 0.15D")
    best = met.groupBy("id").agg(F.max(F.struct("ok", "iou", (-F.col("truth")).alias("less"))).alias("b"))
    verdict = F.when(F.col("b").isNull(), "false").when(F.col("b.ok"), "correct").otherwise("wrong kind")
    return found.select("id").join(best, "id", "left").select("id", (-F.col("b.less")).alias("truth"), verdict.alias("verdict"))


@query(
    "WITH p AS (SELECT o_custkey % 700 AS truth, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 900 END AS found FROM orders), o AS (SELECT found, count(DISTINCT truth) AS owners FROM p WHERE found > 0 GROUP BY found), "
    "s AS (SELECT truth, count(DISTINCT p.found) FILTER (p.found > 0) AS n, bool_or(p.found = 0) AS missed, coalesce(max(owners), 0) AS owners FROM p LEFT JOIN o ON o.found = p.found GROUP BY truth) "
    "SELECT truth, CASE WHEN missed AND n = 0 THEN 'missed' WHEN owners > 1 THEN 'merged' WHEN n > 1 THEN 'split' WHEN missed THEN 'partly_missed' ELSE 'recovered' END AS status FROM s"
)
def space_statuses(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "orders").selectExpr("o_custkey % 700 AS truth", "CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 900 END AS found")
    return regions.point_statuses(points, "truth", "found")


@query(
    f"WITH {COMMON}, s AS (SELECT pa.plan, pa.found, any_value(pa.found_area) AS area, coalesce(sum(common), 0) AS inside FROM pa LEFT JOIN common c ON c.plan = pa.plan AND c.found = pa.found AND c.truth < 2 GROUP BY pa.plan, pa.found) SELECT plan, found AS label, round_even(inside / area, 6) AS share FROM s WHERE inside / area < 0.5"
)
def outside_spaces(spark: SparkSession, folder: str) -> DataFrame:
    """Spaces of which less than half lies inside a building: here, true labels 0 and 1."""
    return regions.outside(region_overlaps(spark, folder).where("truth < 2"), cells(spark, folder, "O"), ["plan"])


@query(
    f"WITH {SPACES}, {LABELS}, h AS (SELECT l.id, min(s.id) AS space FROM label l JOIN space s ON l.plan = s.plan AND {_inside('l.x', 'l.y')} GROUP BY l.id), z AS (SELECT l.id, min(s.id) AS zone FROM label l JOIN h USING (id) JOIN space s ON l.plan = s.plan AND s.id % 5 = h.space % 5 AND s.id > h.space AND {_inside('l.x', 'l.y')} GROUP BY l.id) "
    "SELECT l.id, space, zone FROM label l LEFT JOIN h USING (id) LEFT JOIN z USING (id)"
)
def first_container(spark: SparkSession, folder: str) -> DataFrame:
    """Points to the first space that holds them, then to the first of its zones that does."""
    at = label_table(spark, folder).selectExpr("plan", "id", "x", "y", "0 AS w", "0 AS h")
    held = spatial.met_on_grid(at, spaces(spark, folder), 64, 0, ["plan"]).where(geometry.contains(F.col("r.shape"), F.col("l.x"), F.col("l.y"))).selectExpr("l.id", "r.id AS space")
    first = held.groupBy("id").agg(F.min("space").alias("space"))
    zone = held.withColumnRenamed("space", "zone").join(first, "id").where("zone % 5 = space % 5 AND zone > space").groupBy("id").agg(F.min("zone").alias("zone"))
    return at.select("id").join(first, "id", "left").join(zone, "id", "left")


# --- rules on numbers


@query(
    "WITH a AS (SELECT p_partkey, (p_partkey * 7) % 360 AS a, (p_partkey * 11) % 540 AS b, (p_partkey * 3) % 50 AS x, (p_partkey * 5) % 70 AS y FROM part), d AS (SELECT *, ((a - b) % 180 + 180) % 180 AS turn FROM a) "
    "SELECT p_partkey, least(turn, 180 - turn)::DOUBLE AS apart, round(x * cos(radians(a)) + y * sin(radians(a)), 6) AS along, round(y * cos(radians(a)) - x * sin(radians(a)), 6) AS off, greatest(0, greatest(x, y) - least(x + 5, y + 9)) AS gap FROM d"
)
def frame_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest angle between directions, place in a direction's frame, and the gap of two intervals."""
    k = F.col("p_partkey")
    a, b, x, y = k * 7 % 360, k * 11 % 540, k * 3 % 50, k * 5 % 70
    along, off = geometry.rotate(x.cast("double"), y.cast("double"), a.cast("double"))
    return table(spark, folder, "part").select(
        k, geometry.angle_difference(a.cast("double"), b.cast("double")).alias("apart"), F.round(along, 6).alias("along"), F.round(off, 6).alias("off"), geometry.gap(x, x + 5, y, y + 9).alias("gap"),
    )


@query(
    "WITH p AS (SELECT p_partkey, (p_partkey % 7) * 1.5::DOUBLE AS per, CASE p_partkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'ft' ELSE 'px' END AS unit, p_size * 10.0::DOUBLE AS px FROM part) "
    "SELECT p_partkey, CASE WHEN per > 0 AND unit <> 'px' THEN round(CASE unit WHEN 'm' THEN 1000.0::DOUBLE ELSE 304.8::DOUBLE END / per, 6) END AS mm, CASE WHEN per > 0 AND unit <> 'px' THEN 'printed' ELSE 'uncalibrated' END AS reason, "
    "CASE WHEN per > 0 THEN round(px / per * CASE unit WHEN 'm' THEN 3.28084::DOUBLE ELSE 1 END, 6) END AS feet FROM p"
)
def calibrated_widths(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    per, unit = (k % 7) * 1.5, F.when(k % 3 == 0, "m").when(k % 3 == 1, "ft").otherwise("px")
    scale = rules.millimetres_per_pixel(per, unit)
    return table(spark, folder, "part").select(k, F.round(scale["mm"], 6).alias("mm"), scale["reason"].alias("reason"), F.round(rules.width_in_feet(F.col("p_size") * 10.0, per, unit), 6).alias("feet"))


@query(
    "WITH g AS (SELECT o_custkey, list((o_orderkey % 60 + 40)::DOUBLE) FILTER (o_orderstatus = 'F') AS doors, max(CASE WHEN o_orderstatus = 'P' THEN 9 ELSE 0 END) AS printed, CASE WHEN o_custkey % 2 = 0 THEN 'm' ELSE 'ft' END AS unit FROM orders GROUP BY o_custkey) "
    "SELECT o_custkey, round(CASE WHEN printed > 0 THEN printed / CASE unit WHEN 'm' THEN 100.0::DOUBLE ELSE 30.48::DOUBLE END WHEN len(doors) >= 3 THEN list_median(doors) / 82 END, 6) AS px_per_cm, CASE WHEN printed > 0 THEN 'printed' WHEN len(doors) >= 3 THEN 'doors' END AS source FROM g"
)
def drawing_scales(spark: SparkSession, folder: str) -> DataFrame:
    """A drawing's scale from printed sizes, else from its doors, else none."""
    door = F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 60 + 40).cast("double"))
    g = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list(door).alias("doors"), F.max(F.when(F.col("o_orderstatus") == "P", 9).otherwise(0)).alias("printed"))  # the doors of one drawing
    s = rules.drawing_scale(F.col("printed"), F.when(F.col("o_custkey") % 2 == 0, "m").otherwise("ft"), F.col("doors"))
    return g.select("o_custkey", F.round(s["px_per_cm"], 6).alias("px_per_cm"), s["source"].alias("source"))


@query(
    "WITH s AS (SELECT p_partkey, x0, y0, x1, y1, (p_partkey % 5)::DOUBLE AS half, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM (SELECT p_partkey, ((p_partkey * 17) % 30)::DOUBLE AS x0, ((p_partkey * 31) % 20)::DOUBLE AS y0, ((p_partkey * 53) % 31)::DOUBLE AS x1, ((p_partkey * 13) % 19)::DOUBLE AS y1 FROM part)) "
    "SELECT p_partkey, round(x0 - (y1 - y0) / len * half, 6) AS ax, round(y0 + (x1 - x0) / len * half, 6) AS ay, round(x1 + (y1 - y0) / len * half, 6) AS cx, round(y1 - (x1 - x0) / len * half, 6) AS cy FROM s WHERE len > 0 AND half > 0"
)
def wall_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    ends = [((k * a) % b).cast("double") for a, b in ((17, 30), (31, 20), (53, 31), (13, 19))]
    rows = table(spark, folder, "part").select(k, rules.rectangle_around(*ends, (k % 5).cast("double")).alias("r")).where("r IS NOT NULL")
    at = lambda i, c: F.round(F.col("r")[i][c], 6)
    return rows.select(k, at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(2, "x").alias("cx"), at(2, "y").alias("cy"))


@query(
    "WITH p AS (SELECT p_partkey AS k, (p_partkey % 40 - 3)::DOUBLE AS gap, (p_partkey % 11 - 1)::DOUBLE AS thick, (p_partkey % 23)::DOUBLE / 4 - 0.5 AS ratio, (p_partkey % 17)::DOUBLE / 10 - 0.2::DOUBLE AS conf, ((p_partkey * 7) % 360)::DOUBLE AS angle, p_size FROM part) "
    "SELECT k AS p_partkey, gap > 0 AND thick > 0 AND gap >= 1.5 * thick AS significant, CASE WHEN ratio <= 0 THEN 0.0::DOUBLE ELSE round(0.6::DOUBLE * least(1, ratio / 4) + 0.4::DOUBLE * greatest(0, least(1, conf)), 6) END AS score, "
    "k % 4 = 0 OR (k % 90 BETWEEN 10 AND 40 AND k % 70 BETWEEN 5 AND 60) OR (k % 90 BETWEEN 50 AND 80 AND k % 70 BETWEEN 0 AND 20) AS labelled, least(abs(fmod(angle, 180) - 0), 180 - abs(fmod(angle, 180) - 0)) <= 8 OR least(abs(fmod(angle, 180) - 93), 180 - abs(fmod(angle, 180) - 93)) <= 8 AS along, "
    "CASE WHEN p_size % 9 = 0 THEN 'no enclosed space' WHEN (p_size % 10) / 10.0 >= 0.6 THEN 'one space holds most of the floor' WHEN (k % 100) / 200.0 > 0.3 THEN 'too much wall' WHEN (k % 100) / 200.0 < 0.005 THEN 'almost no wall' END AS suspicion FROM p"
)
def gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps wide enough, their score, points in labelled regions, directions along walls, and readings to try again."""
    k, size = F.col("p_partkey"), F.col("p_size")
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    labelled = F.when(k % 4 != 0, F.array(box(10, 5, 40, 60), box(50, 0, 80, 20)))
    return table(spark, folder, "part").select(
        k, rules.significant_gap((k % 40 - 3).cast("double"), (k % 11 - 1).cast("double")).alias("significant"), F.round(rules.opening_size_score((k % 23) / 4 - 0.5, (k % 17) / 10 - 0.2), 6).alias("score"),
        rules.in_any_region(k % 90, k % 70, labelled).alias("labelled"), rules.along_any(((k * 7) % 360).cast("double"), F.array(F.lit(0.0), F.lit(93.0))).alias("along"),
        rules.suspicious_reading(size % 9, (size % 10) / 10, (k % 100) / 200).alias("suspicion"),
    )


# --- names

_TOKENS = ("'BR'", "'bed.'", "'12'", "'123'", "'3.5'", "'x1'", "'WC,'", "'Living-room'", "'ab'", "'sq'", "p_name", "'.;'", "'4''2'")
_NAMES = ("Kitchen", "Den", "Bath", "great room", "Garage", "Living room")


@query(
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TOKENS)) + " END AS token FROM part), c AS (SELECT *, trim(trim(token), '.,:;') AS t FROM t) "
    "SELECT p_partkey, t <> '' AND NOT regexp_matches(upper(t), '[0-9]+\\s*[''″′\"]|[0-9]+[.,][0-9]+|\\bM2\\b|M²|\\bSQ\\b|\\bFT\\b|[0-9]{3,}') AND (regexp_full_match(t, '[0-9]{1,2}') OR (regexp_full_match(t, '[A-Za-z][A-Za-z''./-]*') AND (length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 3 OR upper(t) IN ('BR', 'WC', 'CL')))) AS is_name FROM c"
)
def name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    token = F.element_at(F.array(*[F.expr(t.replace("''", "\\'")) for t in _TOKENS]), (k % 13 + 1).cast("int"))
    return table(spark, folder, "part").select(k, rules.is_name_token(token, ("BR", "WC", "CL")).alias("is_name"))


@query(
    "WITH n AS (SELECT o_custkey, o_orderkey, ['" + "', '".join(_NAMES) + "'][o_orderkey % 6 + 1] AS name FROM orders), f AS (SELECT *, CASE lower(name) WHEN 'kitchen' THEN 'kitchen' WHEN 'den' THEN 'living' WHEN 'bath' THEN 'bath' WHEN 'great room' THEN 'living' WHEN 'living room' THEN 'living' END AS function FROM n) "
    "SELECT o_custkey, CASE WHEN bool_and(name IN ('Kitchen', 'Den', 'Living room')) THEN 'open-plan' ELSE 'merged' END AS kind, count(DISTINCT function) AS functions, count(*) FILTER (function IS NULL) AS others FROM f GROUP BY o_custkey"
)
def shared_spaces(spark: SparkSession, folder: str) -> DataFrame:
    """Names that share a space: an open plan or merged rooms, and what they stand for."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_custkey", name.alias("name")).withColumn("function", rules.label_function(F.col("name")))
    by = rows.groupBy("o_custkey").agg(F.collect_set("name").alias("names"), F.countDistinct("function").alias("functions"), F.sum(F.col("function").isNull().cast("long")).alias("others"))  # six names at most
    return by.select("o_custkey", rules.shared_space_kind(F.col("names")).alias("kind"), "functions", "others")


@query(
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || ' 12′ × 9″;' WHEN 1 THEN '--' || p_name || '##' || p_size || '.' WHEN 2 THEN p_name || '  ' || p_name ELSE '...' END AS t FROM part) "
    "SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(translate(upper(t), '×′″', 'X''\"'), '[^A-Z0-9''\"X.\\- /]+', ' ', 'g'), ' .,:;-'), '\\s+', ' ', 'g')) AS norm FROM t"
)
def normalised_readings(spark: SparkSession, folder: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    t = F.when(k % 4 == 0, F.concat(F.lit(" "), name, F.lit(" 12′ × 9″;"))).when(k % 4 == 1, F.concat(F.lit("--"), name, F.lit("##"), F.col("p_size"), F.lit("."))).when(k % 4 == 2, F.concat(name, F.lit("  "), name)).otherwise("...")
    return table(spark, folder, "part").select(k, rules.normalised_reading(t).alias("norm"))


@query(
    "SELECT o_orderkey, NOT ((o_orderkey % 10) / 10.0 > 0.5 AND (NOT (o_custkey % 3 > 0) OR NOT (o_orderpriority = '5-LOW'))) AS stays FROM orders"
)
def labels_inside(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, folder, "orders").select(o, rules.label_stays((o % 10) / 10, F.col("o_custkey") % 3 > 0, F.col("o_orderpriority") == "5-LOW").alias("stays"))
