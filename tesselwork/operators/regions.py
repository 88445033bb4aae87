"""Operators on run-length rows and labelled regions: (y, x0, x1, label) with x1 exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.functions.numeric import ratio


def long_runs(runs: DataFrame, least: int) -> DataFrame:
    return runs.where(F.col("x1") - F.col("x0") >= least)


def row_gaps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between neighbouring runs of a row."""
    after = F.lead("x0").over(Window.partitionBy(*keys, "y").orderBy("x0"))
    return runs.withColumn("gap_to", after).where(F.col("gap_to") > F.col("x1")).select(*keys, "y", F.col("x1").alias("gap_from"), "gap_to")


def touching_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (left id, right id) of runs in neighbouring rows that share a column. Equal keys and rows join; runs of a
    row do not overlap, so pairs grow with the runs."""
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("id").alias("above"), F.col("label").alias("above_label"))
    return runs.join(up, [*keys, "y"]).where((F.col("u0") < F.col("x1")) & (F.col("x0") < F.col("u1")))


def overlaps(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Common cells of every found label and true label, with the sizes of both."""
    area = lambda d, n: d.groupBy(*keys, F.col("label").alias(n)).agg(F.sum(F.col("x1") - F.col("x0")).alias(f"{n}_area"))
    p = found.select(*keys, "y", F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("label").alias("found"))
    t = truth.select(*keys, "y", F.col("x0").alias("t0"), F.col("x1").alias("t1"), F.col("label").alias("truth"))
    met = p.join(t, [*keys, "y"]).withColumn("n", F.least("p1", "t1") - F.greatest("p0", "t0")).where("n > 0")
    return met.groupBy(*keys, "found", "truth").agg(F.sum("n").alias("common")).join(area(found, "found"), [*keys, "found"]).join(area(truth, "truth"), [*keys, "truth"])


def region_status(common: DataFrame, keys: list[str]) -> DataFrame:
    """Per true region: best IoU, found at 0.7, split (two parts of a fifth), merged (shares a find that holds 0.3 of
    two regions)."""
    iou = ratio(F.col("common"), F.col("found_area") + F.col("truth_area") - F.col("common"))
    both = common.withColumns({"iou": iou, "part": F.col("common") * 5 >= F.col("truth_area"), "held": F.col("common") * 10 >= F.col("truth_area") * 3})
    many = both.withColumn("holds", F.sum(F.col("held").cast("long")).over(Window.partitionBy(*keys, "found")))
    by = many.groupBy(*keys, "truth").agg(
        F.bround(F.max("iou"), 6).alias("iou"), F.sum(F.col("part").cast("long")).alias("parts"), F.max(F.col("held") & (F.col("holds") >= 2)).alias("merged")
    )
    return by.select(*keys, "truth", "iou", (F.col("iou") >= 0.7).alias("found"), (F.col("parts") >= 2).alias("split"), "merged")


def borders(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the border between every two labels: neighbours in a row, and shared columns of neighbouring rows."""
    line = Window.partitionBy(*keys, "y").orderBy("x0")
    side = runs.withColumns({"next": F.lead("label").over(line), "at": F.lead("x0").over(line)}).where("at = x1 AND next <> label")
    side = side.select(*keys, F.least("label", "next").alias("a"), F.greatest("label", "next").alias("b"), F.lit(1).cast("long").alias("n"))
    down = touching_runs(runs.withColumn("id", F.lit(0)), keys).where("label <> above_label")
    down = down.select(*keys, F.least("label", "above_label").alias("a"), F.greatest("label", "above_label").alias("b"), (F.least("x1", "u1") - F.greatest("x0", "u0")).cast("long").alias("n"))
    return side.unionByName(down).groupBy(*keys, "a", "b").agg(F.sum("n").alias("length"))


def structure_report(common: DataFrame, found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per plan: rooms, spaces, rooms detected (IoU .7), mean best IoU, rooms split (two spaces with a fifth of it each),
    spaces that merge two rooms (.3 of each), and false spaces, of which rooms cover under half. ``common`` is what
    overlaps() returns for these regions."""
    size = lambda d, n: d.groupBy(*keys, F.col("label").alias(n)).agg(F.sum(F.col("x1") - F.col("x0")).alias(f"{n}_area"))
    iou = F.col("common") / (F.col("found_area") + F.col("truth_area") - F.col("common"))
    per_room = common.withColumn("iou", iou).groupBy(*keys, "truth").agg(F.max("iou").alias("best"), F.sum((F.col("common") >= 0.2 * F.col("truth_area")).cast("int")).alias("parts"))
    rooms = size(truth, "truth").join(per_room, [*keys, "truth"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rooms"), F.sum((F.coalesce("best", F.lit(0.0)) >= 0.7).cast("long")).alias("detected"), F.bround(F.avg(F.coalesce("best", F.lit(0.0))), 6).alias("mean_iou"),
        F.sum((F.coalesce("parts", F.lit(0)) >= 2).cast("long")).alias("split"),
    )
    per_space = common.groupBy(*keys, "found").agg(F.sum("common").alias("covered"), F.sum((F.col("common") >= 0.3 * F.col("truth_area")).cast("int")).alias("holds"))
    spaces = size(found, "found").join(per_space, [*keys, "found"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spaces"), F.sum((F.coalesce("holds", F.lit(0)) >= 2).cast("long")).alias("merged"), F.sum((F.coalesce("covered", F.lit(0)) < 0.5 * F.col("found_area")).cast("long")).alias("false_spaces")
    )
    return rooms.join(spaces, keys, "full")


def adjacency_report(common: DataFrame, found_borders: DataFrame, truth_borders: DataFrame, keys: list[str]) -> DataFrame:
    """Per plan: borders of found spaces that, by the room that covers half of each or more, are borders of true rooms
    (tp), are not (fp), and true borders without one (fn)."""
    best = common.groupBy(*keys, "found").agg(F.max(F.struct("common", "truth", "found_area")).alias("b")).where("b.common >= 0.5D * b.found_area")
    room = lambda side: best.select(*keys, F.col("found").alias(side), F.col("b.truth").alias(f"room_{side}"))
    mapped = found_borders.join(room("a"), [*keys, "a"]).join(room("b"), [*keys, "b"]).where("room_a <> room_b")
    mapped = mapped.select(*keys, F.least("room_a", "room_b").alias("a"), F.greatest("room_a", "room_b").alias("b")).distinct().withColumn("got", F.lit(True))
    both = mapped.join(truth_borders.select(*keys, "a", "b").distinct().withColumn("real", F.lit(True)), [*keys, "a", "b"], "full")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    got, real = F.coalesce("got", F.lit(False)), F.coalesce("real", F.lit(False))
    return both.groupBy(*keys).agg(n(got & real).alias("tp"), n(got & ~real).alias("fp"), n(~got & real).alias("fn"))


def point_statuses(points: DataFrame, truth: str, found: str) -> DataFrame:
    """Status of each true space from the found spaces at its points (0 for none): missed, merged (a found space also
    holds points of another), split, partly missed or recovered."""
    owners = points.where(F.col(found) > 0).groupBy(found).agg(F.countDistinct(truth).alias("owners"))
    by = points.join(owners, found, "left").groupBy(truth).agg(
        F.countDistinct(F.when(F.col(found) > 0, F.col(found))).alias("n"), F.max(F.col(found) <= 0).alias("none"), F.coalesce(F.max("owners"), F.lit(0)).alias("owners")
    )
    status = F.when(F.col("none") & (F.col("n") == 0), "missed").when(F.col("owners") > 1, "merged").when(F.col("n") > 1, "split").when(F.col("none"), "partly_missed").otherwise("recovered")
    return by.select(truth, status.alias("status"))


def outside(common: DataFrame, spaces: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Spaces of which less than a share lies in any building: common is what overlaps() returns for the two."""
    inside = common.groupBy(*keys, F.col("found").alias("label")).agg(F.sum("common").alias("inside"))
    area = spaces.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    share = F.coalesce("inside", F.lit(0)) / F.col("area")
    return area.join(inside, [*keys, "label"], "left").where(share < least).select(*keys, "label", F.bround(share, 6).alias("share"))
