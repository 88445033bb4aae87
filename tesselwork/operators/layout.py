"""Texts and regions of a page: frames, lines, blocks, lines worth reading again, faces, buildings, look-ups, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.functions import geometry
from tesselwork.functions.numeric import ratio
from tesselwork.operators import graph, sequence, spatial

CELL = 64


def in_pixels(words: DataFrame) -> DataFrame:
    """Words of a text layer (x0, y0, x1, y1 in points of a page page_w x page_h) as boxes of its picture (width x
    height): rounded half to even, one pixel at least, those off the picture left out; rotation 90 where a word of
    three or more characters is half as high again as it is wide."""
    whole = lambda e: F.rint(e).cast("long")
    sx, sy = F.col("width") / F.col("page_w"), F.col("height") / F.col("page_h")
    at = words.withColumns({
        "x": whole(F.col("x0") * sx), "y": whole(F.col("y0") * sy),
        "w": F.greatest(F.lit(1), whole((F.col("x1") - F.col("x0")) * sx)), "h": F.greatest(F.lit(1), whole((F.col("y1") - F.col("y0")) * sy)),
    })
    seen = at.where("x < width AND y < height AND x + w > 0 AND y + h > 0")
    return seen.withColumn("rotation", F.when((F.col("h") > 1.5 * F.col("w")) & (F.length("text") > 2), 90).otherwise(0))


def same_line() -> str:
    """The rule over aliases l and r (own box, rotation, is_term), l the upper one, that two words stand in one line: of
    like height and little apart; or, of unlike height, one inside the other's rows, side by side and both terms."""
    a, b = "l.own", "r.own"
    high, low = f"greatest({a}.h, {b}.h)", f"least({a}.h, {b}.h)"
    alike = f"{a}.h / greatest(1, {b}.h) BETWEEN 0.6D AND 1.65D"
    middles = f"abs(({a}.y + {a}.h / 2) - ({b}.y + {b}.h / 2))"
    top, bottom = f"CASE WHEN {a}.h <= {b}.h THEN {b}.y ELSE {a}.y END", f"CASE WHEN {a}.h <= {b}.h THEN {a}.y ELSE {b}.y END"
    held = f"({top}) - 1 <= ({bottom}) AND ({bottom}) + {low} <= ({top}) + {high} + 1 AND {middles} <= 0.25D * {high}"
    gap = f"greatest({a}.x, {b}.x) - least({a}.x + {a}.w, {b}.x + {b}.w)"
    return (
        f"l.rotation = r.rotation AND {middles} <= 0.5D * {high} AND (({alike} AND {gap} <= 1.2D * {high}) "
        f"OR (NOT ({alike}) AND {held} AND {gap} BETWEEN -1 AND 0.6D * {high} AND l.is_term AND r.is_term))"
    )


def text_lines(words: DataFrame) -> DataFrame:
    """One row for each line of words (plan, id, x, y, w, h, text, rotation, is_term): its least id, the number of words, its
    box, and its text from left to right. Words are joined by same_line() and through others."""
    b = spatial.grown(words, F.ceil(1.2 * F.col("h")))
    above = "(l.own.y < r.own.y OR (l.own.y = r.own.y AND (l.own.x < r.own.x OR (l.own.x = r.own.x AND l.id < r.id))))"
    met = spatial.met_on_grid(b, b, CELL, 0, ["plan"]).where(f"l.id <> r.id AND {above} AND {same_line()}")
    parts = graph.components(met.selectExpr("l.id AS a", "r.id AS b")).withColumnRenamed("node", "id")
    by = words.join(parts, "id", "left").withColumn("line", F.coalesce("component", "id")).groupBy("plan", F.col("line").alias("id"))
    return by.agg(
        F.count(F.lit(1)).alias("words"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "id", "text"))), lambda t: t["text"]), " ").alias("text"),  # the words of one line
    )


def text_blocks(lines: DataFrame) -> DataFrame:
    """Middles of the blocks that lines (plan, id, x, y, w, h, glyph) make, where the larger glyph is as wide as the break
    across and two thirds as high as the one along; blocks narrower than three glyphs are left out."""
    b = spatial.grown(lines, F.ceil(1.5 * F.col("glyph")))
    g = "greatest(l.glyph, r.glyph)"
    near = lambda p, d, k: f"l.own.{p} - {k}D * {g} <= r.own.{p} + r.own.{d} AND r.own.{p} - {k}D * {g} <= l.own.{p} + l.own.{d}"
    met = spatial.met_on_grid(b, b, CELL, 0, ["plan"]).where(f"l.id < r.id AND {near('x', 'w', 1)} AND {near('y', 'h', 1.5)}")
    parts = graph.components(met.selectExpr("l.id AS a", "r.id AS b")).withColumnRenamed("node", "id")
    by = lines.join(parts, "id", "left").withColumn("block", F.coalesce("component", "id")).groupBy("plan", F.col("block").alias("id"))
    out = by.agg(F.count(F.lit(1)).alias("lines"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("h")).alias("y1"), F.max("glyph").alias("glyph"))
    return out.where("x1 - x0 >= 3 * glyph").selectExpr("plan", "id", "lines", "(x0 + x1) / 2 AS x", "(y0 + y1) / 2 AS y")


def lines_to_read(lines: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """The lines (plan, id, space, y, w, glyph) worth reading again: in spaces that no name (plan, space, height) stands in,
    2 to 40 glyphs wide, of a glyph within half and twice the plan's median name; the ``most`` largest of a space."""
    middle = names.where("height > 0").groupBy("plan").agg(F.median("height").alias("usual"))
    named = names.where("space > 0").select("plan", "space").distinct()
    fit = lines.where("space > 0 AND w >= 2 * glyph AND w <= 40 * glyph").join(named, ["plan", "space"], "left_anti").join(middle, "plan", "left")
    fit = fit.where("usual IS NULL OR glyph BETWEEN 0.5D * usual AND 2 * usual")
    nth = F.row_number().over(Window.partitionBy("plan", "space").orderBy(F.desc("glyph"), "y", "id"))
    return fit.withColumn("nth", nth).where(F.col("nth") <= most).select("plan", "space", "id", "nth")


def normalised_segments(rows: DataFrame, thickness: float = 0.0, confidence: float = 0.5) -> DataFrame:
    """Segments given as four numbers (line) or as two points (start, end, with thickness and confidence) in one form;
    numbers that are missing take the given ones, thickness is not negative, confidence lies in 0 to 1. Rows without
    four coordinates or without length are left out."""
    points = (F.size("start") == 2) & (F.size("end") == 2)
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    line = F.when(F.size("line") == 4, F.col("line")).when(points, F.concat("start", "end"))
    both = rows.withColumn("line", line).select(
        "id", *[at("line", i).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.coalesce(F.when(points & F.col("thickness").isNotNull(), F.greatest(F.lit(0.0), F.col("thickness"))), F.lit(thickness)).alias("thickness"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(points, F.col("confidence")), F.lit(confidence)))).alias("confidence"),
    )
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    both = both.withColumn("length", geometry.length(*ends)).where("length > 0")
    return both.withColumn("orientation", geometry.orientation(geometry.undirected_angle(*ends)))


def count_differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows changed, with both numbers: none means that a round trip lost and added nothing."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = n(before, "before").join(n(after, "after"), keys, "full").fillna(0, ["before", "after"])
    return both.where("before <> after")


def valid_faces(faces: DataFrame, least: float, share: float = 0.85, rectangularity: float = 0.15) -> DataFrame:
    """Faces (plan, id, nodes, area, w, h, page) as rooms: of equal sets of nodes the smallest, then those of ``least``
    to ``share`` of the page that fill enough of their box, numbered in a plan from the largest."""
    size = F.abs("area")
    by = faces.withColumn("key", F.array_join(F.array_sort("nodes"), ",")).groupBy("plan", "key")
    one = by.agg(F.min("id").alias("first"), F.min(F.struct(size.alias("size"), "id", "w", "h", "page")).alias("b")).selectExpr("plan", "first", "b.*")
    fit = one.where((F.col("size") >= least) & (F.col("size") <= share * F.col("page")) & (F.col("size") / F.greatest(F.lit(1), F.col("w") * F.col("h")) >= rectangularity))
    return fit.withColumn("room", F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("size"), "first"))).select("plan", "room", "id", "size")


def label_at(points: DataFrame, runs: DataFrame, width: int, height: int, around: int = 6) -> DataFrame:
    """plan, id and label of points (plan, id, x, y), moved onto the page: the label of the run (plan, y, x0, x1, label) there,
    else the most frequent within ``around`` pixels, the least of equals, else 0."""
    zero = F.lit(0)
    spots = points.select("plan", "id", F.greatest(zero, F.least(F.col("x"), F.lit(width - 1))).alias("x"), F.greatest(zero, F.least(F.col("y"), F.lit(height - 1))).alias("y"), zero.alias("w"), zero.alias("h"))
    boxes = runs.where("label > 0").select("plan", F.col("x0").alias("x"), "y", (F.col("x1") - F.col("x0") - 1).alias("w"), zero.alias("h"), "label")
    met = spatial.met_on_grid(spots, boxes, CELL, around, ["plan"])
    n = F.expr(f"least(r.x + r.w, l.x + {around}) - greatest(r.x, l.x - {around}) + 1")
    met = met.withColumn("n", n).where(f"n > 0 AND abs(l.y - r.y) <= {around}")
    on = F.expr("l.y = r.y AND l.x BETWEEN r.x AND r.x + r.w")
    by = met.groupBy(F.col("l.plan").alias("plan"), F.col("l.id").alias("id"), "label").agg(F.sum("n").alias("n"), F.max(on).alias("here"))
    best = by.groupBy("plan", "id").agg(F.max(F.struct("here", "n", (-F.col("label")).alias("less"))).alias("b"))
    return points.select("plan", "id").join(best.select("plan", "id", (-F.col("b.less")).alias("label")), ["plan", "id"], "left").fillna(0, ["label"])


def buildings(networks: DataFrame, common: DataFrame, least: int = 2) -> DataFrame:
    """What each network of walls (plan, id, openings, area) with ``least`` openings is: few openings (under .15 of the most of
    its plan), a frame (holds .8 of a network with more openings), part of a larger one (.8 inside it), too small (under
    a twentieth of the largest), or a building. ``common`` has plan, a, b and the area that two share, each pair once.

    Networks meet their pairs by a shuffle: Spark's estimate of them is a part of the compressed file, and a hashed row
    takes many times that in the driver."""
    rows = networks.where(F.col("openings") >= least).withColumn("most", F.max("openings").over(Window.partitionBy("plan")))
    rows = rows.withColumn("few", F.col("openings") < F.greatest(F.lit(float(least)), 0.15 * F.col("most")))
    fit = rows.where("NOT few").select("plan", "id", "openings", "area")
    both = common.select("plan", "a", "b", "common").unionByName(common.select("plan", F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    side = lambda d, s: d.select("plan", F.col("id").alias(s), F.col("openings").alias(f"{s}_openings"), F.col("area").alias(f"{s}_area")).hint("merge")
    pairs = lambda d: both.join(side(d, "a"), ["plan", "a"]).join(side(d, "b"), ["plan", "b"])
    frames = pairs(fit).where("b_openings > a_openings AND common >= 0.8D * b_area").select("plan", F.col("a").alias("id")).distinct()
    kept = fit.join(frames, ["plan", "id"], "left_anti")
    parts = pairs(kept).where("common >= 0.8D * a_area AND b_area > a_area").select("plan", F.col("a").alias("id")).distinct()
    largest = kept.groupBy("plan").agg(F.max("area").alias("largest"))
    mark = lambda d, n: d.withColumn(n, F.lit(True))
    out = rows.join(mark(frames, "frame"), ["plan", "id"], "left").join(mark(parts, "part"), ["plan", "id"], "left").join(largest, "plan", "left")
    what = F.when(F.col("few"), "few openings").when(F.col("frame"), "frame").when(F.col("part"), "part").when(F.col("area") < 0.05 * F.col("largest"), "too small").otherwise("building")
    return out.select("plan", "id", what.alias("what"))


def point_recovery(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Status of labelled points (plan, id, x, y, group): missed where no polygon (plan, id, shape and its box) holds one,
    merged where the first that does holds a point of another group, else recovered. A point without group is its own."""
    zero = F.lit(0)
    at = points.select("plan", "id", "x", "y", zero.alias("w"), zero.alias("h"), F.coalesce(F.col("group").cast("string"), F.concat(F.lit("_"), "id")).alias("group"))
    held = spatial.met_on_grid(at, polygons, CELL, 0, ["plan"]).where(geometry.contains(F.col("r.shape"), F.col("l.x"), F.col("l.y")))
    held = held.selectExpr("l.plan", "l.id", "l.group", "r.id AS polygon")
    mixed = held.groupBy("plan", "polygon").agg((F.min("group") < F.max("group")).alias("mixed"))
    first = held.groupBy("plan", "id").agg(F.min("polygon").alias("polygon")).join(mixed, ["plan", "polygon"])
    return at.select("plan", "id").join(first, ["plan", "id"], "left").select("plan", "id", F.when(F.col("mixed"), "merged").when(F.col("polygon").isNull(), "missed").otherwise("recovered").alias("status"))


def zone_report(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Per plan, true points (plan, space, zone_function, functions) and zones (plan, space): points in spaces of two or
    more true functions, those whose zone has one of theirs, has another, or is none; zones, and those in other spaces."""
    known = points.where("space IS NOT NULL")
    split = known.select("plan", "space", F.explode("functions").alias("f")).groupBy("plan", "space").agg((F.min("f") < F.max("f")).alias("split")).where("split")
    good = F.array_contains("functions", F.col("zone_function"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    hits = known.join(split, ["plan", "space"]).groupBy("plan").agg(
        F.count(F.lit(1)).alias("zone_points"), n(good).alias("correct"), n(~good).alias("wrong_function"), n(F.col("zone_function").isNull()).alias("no_zone")
    )
    made = zones.join(split, ["plan", "space"], "left").groupBy("plan").agg(F.count(F.lit(1)).alias("zones"), n(F.col("split").isNull()).alias("unsupported_zones"))
    return hits.join(made, "plan", "full").fillna(0)


def topology_report(matched: DataFrame, points: DataFrame) -> DataFrame:
    """Per plan, matched doors and windows (plan, kind, host, connects, operation, swing_into, and outdoor, the plan's outdoor
    spaces) and true points (plan, space, group): hosted openings; doors that join two spaces of no common group, or a
    space and the exterior; hinged doors and those that swing into one of their spaces; windows between the exterior or
    an outdoor space and a space with a true point."""
    groups = points.where("space IS NOT NULL").groupBy("plan", "space").agg(F.collect_set("group").alias("groups"))  # the rooms of one space
    away = lambda c: (c == "exterior") | F.coalesce(F.array_contains("outdoor", c), F.lit(False))
    rows = matched.where("kind IN ('door', 'window')").withColumn("inside", F.array_distinct(F.filter("connects", lambda c: c != "exterior")))
    rows = rows.withColumns({"a": F.get("inside", F.lit(0)), "b": F.get("inside", F.lit(1)), "outer": F.array_contains("connects", "exterior"), "rooms": F.filter("connects", lambda c: ~away(c))})
    rows = rows.withColumn("c", F.get("rooms", F.lit(0)))
    of = lambda s: groups.select("plan", F.col("space").alias(s), F.col("groups").alias(f"{s}_groups"))
    rows = rows.join(of("a"), ["plan", "a"], "left").join(of("b"), ["plan", "b"], "left").join(of("c"), ["plan", "c"], "left")
    door, two = F.col("kind") == "door", F.size("inside") == 2
    joins = F.when(two, ~F.coalesce(F.arrays_overlap("a_groups", "b_groups"), F.lit(False))).otherwise(F.col("outer") & (F.size(F.filter("connects", lambda c: c != "exterior")) == 1))
    hinged = door & F.coalesce(F.col("operation").endswith("hinged"), F.lit(False))
    outside = (F.size("rooms") == 1) & (F.size("connects") == 2) & F.col("c_groups").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.groupBy("plan").agg(
        F.count(F.lit(1)).alias("matched"), n(F.col("host").isNotNull()).alias("hosted"), n(door).alias("doors"), n(door & joins).alias("door_connects"), n(hinged).alias("hinged"),
        n(hinged & F.array_contains("inside", F.col("swing_into"))).alias("swing_resolved"), n(~door).alias("windows"), n(~door & outside).alias("window_exterior"),
    )


def dilated(runs: DataFrame, keys: list[str], half: dict[int, int]) -> DataFrame:
    """Runs (keys, y, x0, x1) grown by a shape: ``half`` gives its half width for each row above or below; merged in a row."""
    shape = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in sorted(half.items())])
    spread = runs.select(*keys, "y", "x0", "x1", F.explode(shape).alias("s")).selectExpr(*keys, "y + s.dy AS y", "x0 - s.dx AS x0", "x1 + s.dx AS x1")
    return sequence.sweep_merge(spread, [*keys, "y"], "x0", "x1").drop("parts")


def _covered(runs: DataFrame, by: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Cells of runs that lie in ``by``, whose runs of a row do not overlap, per keys and more columns of the runs."""
    b = by.select(*keys, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    met = runs.join(b, [*keys, "y"]).where("b0 < x1 AND x0 < b1")
    return met.groupBy(*keys, *more).agg(F.sum(F.least("x1", "b1") - F.greatest("x0", "b0")).alias("covered"))


#: Half widths of an ellipse five pixels high and wide, by row.
NEAR = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}


def wall_report(found: DataFrame, drawn: DataFrame, band: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys, cells of found walls, those within two of drawn ones, drawn cells, those within two of found ones, and
    found cells that lie off the walls' bands by more; with the shares. Runs of a row do not overlap."""
    size = lambda d, n: d.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias(n))
    part = lambda a, b, n: _covered(a, dilated(b, keys, NEAR), keys).withColumnRenamed("covered", n)
    out = size(found, "found_px").join(size(drawn, "drawn_px"), keys, "full")
    for d in (part(found, drawn, "found_on_wall"), part(drawn, found, "drawn_covered"), part(found, band, "on_band")):
        out = out.join(d, keys, "left")
    out = out.fillna(0)
    return out.select(
        *keys, "found_px", "found_on_wall", "drawn_px", "drawn_covered", (F.col("found_px") - F.col("on_band")).alias("fabricated_px"),
        F.bround(ratio(F.col("found_on_wall"), F.col("found_px")), 6).alias("precision"), F.bround(ratio(F.col("drawn_covered"), F.col("drawn_px")), 6).alias("recall"),
    )


def run_components(runs: DataFrame, keys: list[str]) -> DataFrame:
    """id and component of runs (keys, id, y, x0, x1): joined where they share or touch a corner in neighbouring rows, so
    components are those of their cells and eight neighbours. Runs of a row do not touch."""
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("id").alias("above"))
    met = runs.join(up, [*keys, "y"]).where("u0 <= x1 AND x0 <= u1").select(F.col("id").alias("a"), F.col("above").alias("b"))
    parts = graph.components(met).withColumnRenamed("node", "id")
    return runs.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))


def phantoms(found: DataFrame, band: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Per keys, components of found walls, and phantoms: those of ``least`` cells of which under a tenth lies within two
    of the walls' bands."""
    parts = run_components(found, keys)
    size = parts.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0")).alias("size"))
    both = size.join(_covered(parts, dilated(band, keys, NEAR), keys, "component"), [*keys, "component"], "left").fillna(0, ["covered"])
    phantom = (F.col("size") >= least) & (F.col("covered") * 10 < F.col("size"))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("components"), F.sum(phantom.cast("long")).alias("phantoms"))
