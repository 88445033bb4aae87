"""Operators that SQL cannot say, and worked cases, against plain loops."""

import random

from pyspark.sql import functions as F

from tesselwork.functions import geometry, text
from tesselwork.operators import evidence, graph, select, sequence, spatial
from tesselwork.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for s, a, b in sorted(pairs, reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b))
    return out


def test_match_query_is_the_greedy_one(spark):
    pairs = [(r.iou, r.pred, r.truth) for r in catalog.iou_pairs(spark, FOLDER).collect()]
    got = {(r.pred, r.truth) for r in catalog.QUERIES["match_iou"](spark, FOLDER).collect()}
    assert got and got == greedy(pairs)


def test_match_with_ties_and_nothing(spark):
    draw = random.Random(0)
    pairs = list({(a, b): (draw.randint(1, 3) / 3, a, b) for a, b in ((draw.randint(0, 15), draw.randint(0, 15)) for _ in range(90))}.values())
    frame = spark.createDataFrame(pairs, "s double, a long, b long")
    assert {(r.a, r.b) for r in select.greedy_match(frame, "a", "b", "s").collect()} == greedy(pairs)
    assert select.greedy_match(frame.limit(0), "a", "b", "s").collect() == []


def test_match_metrics(spark):
    rows = catalog.QUERIES["match_iou_metrics"](spark, FOLDER).collect()
    matched = catalog.QUERIES["match_iou"](spark, FOLDER).count()
    assert sum(r.tp for r in rows) == matched and all(r.precision is None or 0 <= r.precision <= 1 for r in rows)


def test_keep_first_is_the_greedy_one(spark):
    clash = {frozenset((r.left_id, r.right_id)) for r in catalog.touching(spark, FOLDER).collect()}
    stay = []
    for r in sorted(catalog.boxes(spark, FOLDER).collect(), key=lambda r: (-r["size"], r.id)):
        if not any(frozenset((r.id, s)) in clash for s in stay):
            stay.append(r.id)
    assert sorted(r.id for r in catalog.QUERIES["nms_keep_first"](spark, FOLDER).collect()) == sorted(stay)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(401)} == {0} and {got[1000 + k] for k in range(300)} == {1000} and got[5000] == 5000
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_readings_resolve(spark):
    rows = [(1, "BETH", v, 93.0) for v in range(4)] + [(1, "BATH", 9, 78.0), (2, "HALL", 0, 40.0), (2, "HALL", 1, 45.0), (3, "XQ", 0, 40.0), (4, "DEN", 0, 30.0)]
    got = {r.place: r for r in evidence.resolve(spark.createDataFrame(rows, "place int, reading string, variant int, conf double"), "place", "reading", "variant", "conf", ["BATH", "DEN"]).collect()}
    assert (got[1].reading, got[1].corrected, got[1].reason) == ("BATH", True, "confident")
    assert got[2].reason == "supported" and got[3].reason == "rejected" and got[4].reason == "known"


def test_printed_sizes(spark):
    cases = {"22'11\" x 18'0\"": (22 + 11 / 12, 18.0, "ft"), "12' x 9'6\"": (12.0, 9.5, "ft"), "3.5 x 4,2 m": (3.5, 4.2, "m"), "350 x 420 cm": (3.5, 4.2, "m"), "Bedroom 2": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.printed_size(F.col("t")).alias("s")).collect()
    for r in rows:
        want = cases[r.t]
        assert r.s is None if want is None else (round(r.s.width, 6), round(r.s.height, 6), r.s.unit) == (round(want[0], 6), round(want[1], 6), want[2])


def test_polygon_edge_counts_as_inside(spark):
    corner = "named_struct('x', {}L, 'y', {}L)"
    square = "array(" + ", ".join(corner.format(*c) for c in ((0, 0), (4, 0), (4, 4), (0, 4))) + ")"
    spots = spark.createDataFrame([(0, 0, True), (4, 2, True), (2, 2, True), (5, 2, False), (2, -1, False)], "px long, py long, inside boolean")
    got = spots.withColumn("s", F.expr(square)).select("inside", geometry.contains(F.col("s"), F.col("px"), F.col("py")).alias("got")).collect()
    assert all(r.inside == r.got for r in got)


def test_crossing_and_rotation(spark):
    lines = [F.lit(float(v)) for v in (0, 0, 4, 4, 0, 4, 4, 0, 0, 0, 1, 1)]
    r = spark.range(1).select(geometry.intersection(tuple(lines[:4]), tuple(lines[4:8])).alias("p"), geometry.intersection(tuple(lines[:4]), tuple(lines[8:])).alias("q"), *geometry.rotate(F.lit(1.0), F.lit(1.0), F.lit(45.0))).first()
    assert (r.p.x, r.p.y) == (2.0, 2.0) and r.q is None and abs(r[2] - 2**0.5) < 1e-9 and abs(r[3]) < 1e-9


def test_band_join_is_a_range_join(spark):
    draw = random.Random(4)
    rows = [(i, draw.randint(-50, 50), i % 2) for i in range(120)]
    f = spark.createDataFrame(rows, "id long, v long, k long")
    got = sorted((r[0], r[1]) for r in spatial.band_join(f, f, ["k"], "v", 7).select("l.id", "r.id").collect())
    assert got == sorted((a, b) for a, v, k in rows for b, w, m in rows if k == m and abs(v - w) <= 7)


def test_running_choice_needs_its_gain(spark):
    rows = [(1, 1, 1.0, "a"), (1, 2, 1.2, "b"), (1, 3, 1.3, "c"), (2, 1, 0.0, "d")]
    got = {r.g: r.item for r in sequence.running_choice(spark.createDataFrame(rows, "g int, n int, s double, item string"), "g", ["n"], "s", "item", 0.25).collect()}
    assert got == {1: "c", 2: "d"}


def test_seeded_groups_are_the_plain_ones(spark):
    from tesselwork.plans import extra

    near = {}
    for r in catalog.touching(spark, FOLDER).collect():
        near.setdefault(r.left_id, set()).add(r.right_id)
        near.setdefault(r.right_id, set()).add(r.left_id)
    seeds, want = [], {}
    for r in sorted(catalog.boxes(spark, FOLDER).collect(), key=lambda r: (-r["size"], r.id)):
        want[r.id] = next((s for s in seeds if s in near.get(r.id, ())), None)
        if want[r.id] is None:
            seeds.append(r.id)
            want[r.id] = r.id
    assert {r.id: r.seed for r in extra.seeded_grouping(spark, FOLDER).collect()} == want


def test_subsets_find_more_with_more_passes(spark):
    from tesselwork.plans import extra

    rows = sorted(extra.subset_of_passes(spark, FOLDER).collect())
    assert [r.passes for r in rows] == [1, 2, 4] and rows[0].accepted <= rows[-1].accepted


def test_support_counts_the_next_two_of_a_kind_only(spark):
    rows = spark.createDataFrame([(1, w, "sink") for w in (0.5, 0.4, 0.3, 0.2)] + [(1, 1.0, "range"), (2, 0.2, "chair")], "g int, w double, kind string")
    got = {r.g: (r.support, r.kinds) for r in evidence.diminishing(rows, "g", "w", "kind").collect()}
    assert got == {1: (0.5 + 0.3 * (0.4 + 0.3) + 1.0, 2), 2: (0.2, 1)}


def test_support_needs_the_mean_of_all_observations(spark):
    """Two passes whose best reads reach forty are not enough where their other reads pull the mean below."""
    rows = [(1, "XQZ", 0, 45.0), (1, "XQZ", 1, 45.0), (2, "XQZ", 0, 45.0), (2, "XQZ", 0, 5.0), (2, "XQZ", 0, 5.0), (2, "XQZ", 1, 45.0), (3, "AX", 0, 50.0), (3, "AB", 1, 70.0), (3, "AB", 2, 1.0)]
    frame = spark.createDataFrame([*rows, (3, "AX", 3, 50.0)], "place int, reading string, variant int, conf double")
    got = {r.place: r for r in evidence.resolve(frame, "place", "reading", "variant", "conf", ["AB"]).collect()}
    assert got[1].reason == "supported" and got[2].reason == "rejected" and got[2].mean == 25.0
    assert (got[3].reading, got[3].corrected, got[3].rivals) == ("AX", False, "AB:2")  # words of two letters are not corrected


def test_chains_longer_than_any_number_of_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "a long, b long")
    got = {r.node: r.distance for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(25)}
    assert graph.prune_ends(edges).collect() == []
    labels = {r.node: (r.distance, r.label) for r in graph.nearest_source(edges, spark.createDataFrame([(0, 7), (24, 8)], "node long, label long")).collect()}
    assert labels[11] == (11, 7) and labels[12] == (12, 7) and labels[13] == (11, 8)
    items = spark.createDataFrame([(i, 0) for i in range(25)], "id long, p long")
    assert sorted(r.id for r in select.keep_first(items, edges, "id", "p").collect()) == list(range(0, 25, 2))
    pairs = spark.createDataFrame([(i, i + k, float(2 * i + k)) for i in range(14) for k in (0, 1)], "a long, b long, s double")
    assert sorted((r.a, r.b) for r in select.greedy_match(pairs, "a", "b", "s").collect()) == [(i, i + 1) for i in range(14)]


def test_percentiles_and_places_in_two_levels(spark):
    import numpy as np

    draw = random.Random(2)
    rows = [(g, float(draw.choice([1, 5, 5, draw.randint(0, 400), draw.random() * 1000])), i) for i, g in enumerate(draw.choices("abc", k=3000))] + [("d", 3.0, 3000), ("d", 4.0, 3001)]
    frame = spark.createDataFrame([*rows, ("a", None, 5000)], "g string, v double, i long")
    got = {r.g: (r.low, r.mid) for r in sequence.percentiles(frame, "g", "v", {"low": 0.03, "mid": 0.5}).collect()}
    for g in "abcd":
        values = [v for k, v, _ in rows if k == g]
        assert np.allclose(got[g], [np.quantile(values, 0.03), np.quantile(values, 0.5)])
    nth = {r.i: r.nth for r in sequence.numbered(frame.where("v IS NOT NULL"), "g", "v", "i", 50.0).collect()}
    for g in "abcd":
        assert [nth[i] for _, i in sorted((v, i) for k, v, i in rows if k == g)] == list(range(1, 1 + sum(k == g for k, _, _ in rows)))
