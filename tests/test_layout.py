"""Worked cases of openings, layouts and ordered rules: small inputs with results known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tesselwork.functions import geometry, rules
from tesselwork.operators import layout, openings, sequence

SEGMENT = "plan int, id int, x0 double, y0 double, x1 double, y1 double, thickness double"


def segments(spark, *rows):
    return spark.createDataFrame([(0, i, *map(float, r), 8.0) for i, r in enumerate(rows)], SEGMENT)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_wall_cuts_a_closure_only_between_its_jambs(spark):
    walls = segments(spark, (50, -40, 50, 40), (5, -40, 5, 40), (0, 30, 100, 30))
    closure = segments(spark, (0, 0, 100, 0)).withColumn("skip", F.array().cast("array<int>"))
    assert pairs(openings.cut_by_walls(closure, walls)) == [(0, 0)]
    assert pairs(openings.cut_by_walls(closure, walls.where("id <> 0"))) == []  # one at a jamb, one parallel
    assert pairs(openings.cut_by_walls(closure.withColumn("skip", F.array(F.lit(0))), walls)) == []


def test_one_opening_found_twice(spark):
    rows = segments(spark, (0, 0, 40, 0), (4, 3, 44, 3), (30, 0, 70, 0), (0, 20, 40, 20), (0, 0, 0, 40))
    assert pairs(openings.same_openings(rows)) == [(0, 1)]
    assert pairs(openings.new_openings(rows.where("id > 0"), rows.where("id = 0"))) == [(0, 2), (0, 3), (0, 4)]


def test_a_line_traced_twice_crosses_itself(spark):
    assert pairs(openings.same_drawn_lines(segments(spark, (0, 0, 60, 4), (0, 4, 60, 0), (0, 9, 60, 9)), 10.0)) == [(0, 1)]


def test_a_door_wins_over_glazing_in_its_gap(spark):
    rows = segments(spark, (0, 0, 40, 0), (2, 0, 42, 0), (100, 0, 140, 0), (60, 0, 70, 0))
    kinds = rows.withColumn("kind", F.when(F.col("id") == 1, "door").otherwise("window"))
    assert pairs(openings.doors_first(kinds, 8.0)) == [(1,), (2,), (3,)]


def test_treads_are_a_pattern_and_an_outline_is_none(spark):
    treads = [(0, 10 * i, 50, 10 * i) for i in range(6)]
    outline = [(200, 0, 250, 0), (200, 3, 250, 3), (200, 6, 250, 6)]
    assert pairs(openings.repeated_lines(segments(spark, *treads, *outline), 4.0)) == [(i,) for i in range(6)]


def test_a_strip_joins_the_window_beside_it(spark):
    rows = segments(spark, (0, 0, 8, 0), (8, 0, 60, 0), (60, 0, 66, 0)).withColumn("lines", F.when(F.col("id") < 2, F.array(F.lit(2), F.lit(-2))).otherwise(F.array(F.lit(1))))
    assert pairs(openings.absorbed_strips(rows)) == [(0, 1)]


def test_crossing_segments_fall_into_pieces(spark):
    got = pairs(openings.atomic_segments(segments(spark, (0, 0, 100, 0), (50, -50, 50, 50))).select("id", "x0", "y0", "x1", "y1"))
    assert got == [(0, 0, 0, 50, 0), (0, 50, 0, 100, 0), (1, 50, -50, 50, 0), (1, 50, 0, 50, 50)]


def test_words_of_a_line_and_lines_of_a_block(spark):
    words = spark.createDataFrame(
        [(0, 1, 0, 0, 40, 10, "LIVING", 0, True), (0, 2, 48, 1, 30, 10, "ROOM", 0, True), (0, 3, 0, 30, 40, 10, "12x14", 0, False), (0, 4, 82, 2, 20, 5, "x", 0, False)],
        "plan int, id int, x int, y int, w int, h int, text string, rotation int, is_term boolean",
    )
    assert sorted(r.text for r in layout.text_lines(words).collect()) == ["12x14", "LIVING ROOM", "x"]
    blocks = layout.text_blocks(words.withColumn("glyph", F.lit(15))).collect()
    assert [(r.lines, r.x, r.y) for r in blocks] == [(4, 51.0, 20.0)]


def test_page_words_in_pixels(spark):
    words = spark.createDataFrame([("door", 10.0, 10.0, 20.0, 40.0), ("off", 700.0, 0.0, 720.0, 9.0), ("I", 1.0, 1.0, 1.1, 9.0)], "text string, x0 double, y0 double, x1 double, y1 double")
    page = words.selectExpr("*", "600D AS page_w", "800D AS page_h", "1200 AS width", "1600 AS height")
    assert [(r.text, r.x, r.y, r.w, r.h, r.rotation) for r in layout.in_pixels(page).collect()] == [("door", 20, 20, 20, 60, 90), ("I", 2, 2, 1, 16, 0)]


def test_a_frame_and_a_core_are_no_buildings(spark):
    networks = spark.createDataFrame([(0, 1, 2, 10_000), (0, 2, 10, 6_000), (0, 3, 3, 500), (0, 4, 1, 900), (0, 5, 9, 100)], "plan int, id int, openings int, area int")
    common = spark.createDataFrame([(0, 1, 2, 6_000), (0, 2, 3, 500)], "plan int, a int, b int, common int")
    assert {r.id: r.what for r in layout.buildings(networks, common).collect()} == {1: "frame", 2: "building", 3: "part", 5: "too small"}


def test_label_under_a_glyph_comes_from_around_it(spark):
    runs = spark.createDataFrame([(0, 10, 0, 8, 3), (0, 10, 12, 40, 2), (0, 11, 0, 40, 0)], "plan int, y int, x0 int, x1 int, label int")
    points = spark.createDataFrame([(0, 1, 2, 10), (0, 2, 9, 11), (0, 3, 200, 90)], "plan int, id int, x int, y int")
    assert {r.id: r.label for r in layout.label_at(points, runs, 100, 50).collect()} == {1: 3, 2: 3, 3: 0}


def test_a_square_of_walls_is_one_component(spark):
    ring = spark.createDataFrame([(0, 1, 0, 0, 5), (0, 2, 1, 0, 1), (0, 3, 1, 4, 5), (0, 4, 2, 0, 5), (0, 5, 3, 5, 30), (0, 6, 9, 0, 3)], "plan int, id int, y int, x0 int, x1 int")
    assert {r.id: r.component for r in layout.run_components(ring, ["plan"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_walls_found_beside_drawn_ones_count(spark):
    runs = lambda *r: spark.createDataFrame([(0, *x) for x in r], "plan int, y int, x0 int, x1 int")
    got = layout.wall_report(runs((2, 0, 10), (20, 0, 5)), runs((0, 0, 10)), runs((0, 0, 10)), ["plan"]).first()
    assert (got.found_px, got.found_on_wall, got.drawn_px, got.drawn_covered, got.fabricated_px) == (15, 10, 10, 10, 5)


def test_quarter_circle_and_straight_curve(spark):
    k = 4 / 3 * math.tan(math.pi / 8) * 10
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    row = spark.range(1).select(geometry.cubic_arc(point(10, 0), point(10, k), point(k, 10), point(0, 10)).alias("arc"), geometry.cubic_arc(point(0, 0), point(1, 0), point(2, 0), point(3, 0)).alias("line")).first()
    assert [round(v, 6) for v in row.arc] == [0, 0, 10, 90]
    assert row.line is None


def test_cuts_too_close_are_passed_over(spark):
    cut = lambda *c: geometry.gap_pieces(F.array(*[F.lit(float(x)) for x in c]).cast("array<double>"), F.lit(50.0), F.lit(10.0))
    row = spark.range(1).select(cut(12, 18, 30).alias("a"), cut(45).alias("b"), cut().alias("c")).first()
    assert [tuple(p) for p in row.a] == [(0, 12), (12, 30), (30, 50)]
    assert [tuple(p) for p in row.b] == [(0, 50)] and [tuple(p) for p in row.c] == [(0, 50)]


def test_reading_stops_when_it_does_not_pay(spark):
    rows = spark.range(100).selectExpr("id", "id % 2 AS g")
    got = {r.g: r["count"] for r in sequence.paying_rows(rows, "g", "id", "id", F.expr("g = 1 AND id % 10 = 1")).groupBy("g").count().collect()}
    assert got == {0: 16, 1: 50}


def test_two_wall_thicknesses(spark):
    rows = spark.createDataFrame([(0, 10.0, 40), (0, 11.0, 40), (0, 20.0, 30), (0, 90.0, 5)], "g int, d double, w int")
    assert [(r.nth, r.middle) for r in sequence.weighted_classes(rows, "g", "d", "w").orderBy("nth").collect()] == [(1, 10.5), (2, 20.0)]


def test_support_of_a_scattered_curve_is_less(spark):
    rows = spark.range(20).selectExpr("id", "id % 2 AS g", "CASE WHEN id % 2 = 0 THEN id < 10 ELSE id % 4 = 1 END AS near")
    assert {r.g: round(r.support, 6) for r in sequence.curve_support(rows, "g", ["id"], "near").collect()} == {0: 0.5, 1: 0.125}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({"sliding": True}, ("door", 0.85, "sliding panels")),
        ({"arc": 0.8}, ("door", 0.93, "swing arc")),
        ({"glazed": 2, "relation": "room_to_exterior"}, ("window", 0.91, "glazing lines")),
        ({"dashed": True}, ("opening", 0.45, "weak glazing")),
        ({"faces": 2}, ("door", 0.72, "outline only")),
        ({"faces": 2, "relation": "room_to_exterior", "width": 300.0}, ("door", 0.58, "outline only")),
        ({"faces": 1, "relation": "unknown"}, ("opening", 0.4, "outline only")),
        ({"arc": 0.8, "relation": "unknown"}, ("door", 0.75, "swing arc")),
        ({}, ("opening", 0.4, "bare gap")),
        ({"most": 0.5}, ("opening", 0.4, "none")),
    ],
)
def test_opening_types(spark, change, expected):
    plain = {
        "source": "wall_gap", "relation": "between_rooms", "sliding": False, "arc": 0.0, "double_arc": 0.0, "leaf": 0.0, "glazed": 0, "dashed": False, "inner": False, "faces": 0, "covered": 0, "most": 0.0,
        "width": 40.0, "thickness": 8.0, "wall": 8.0,
    }
    row = spark.createDataFrame([plain | change]).withColumn("feet", F.lit(None).cast("double"))
    got = row.select(rules.opening_type().alias("t")).first().t
    assert (got.kind, got.confidence, got.symbol) == expected
