"""Evaluation: confusion counts with null-safe ratios, set agreement, status changes, interval matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselwork.functions.numeric import ratio
from tesselwork.operators.spatial import met_on_grid
from tesselwork.operators.walls import framed


def precision_recall(rows: DataFrame, truth: Column, found: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall by group; ratios are null on a zero denominator."""
    count = lambda c: F.sum(c.cast("long"))
    counted = rows.groupBy(*by).agg(count(truth & found).alias("tp"), count(~truth & found).alias("fp"), count(truth & ~found).alias("fn"))
    return counted.withColumns(
        {"precision": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6)}
    )


def set_agreement(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows two sets share and how many only one has."""
    a, b = found.select(*keys).distinct().withColumn("in_a", F.lit(1)), truth.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = a.join(b, keys, "full")
    hit = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(hit(has_a & has_b).alias("shared"), hit(has_a & ~has_b).alias("only_found"), hit(~has_a & has_b).alias("only_truth"))


def status_changes(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """Counts of each (old, new) status over the full join of two states; a missing side is 'absent'."""
    a, b = old.select(key, F.col(status).alias("was")), new.select(key, F.col(status).alias("now"))
    both = a.join(b, key, "full").fillna("absent", ["was", "now"])
    return both.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two short lists of names, the axes of a report; the report has as many rows."""
    return left.join(F.broadcast(right), F.lit(True))  # names of one axis of a report


def opening_scores(found: DataFrame, truth: DataFrame, size: int = 64) -> DataFrame:
    """pred, truth and score of found openings against true ones: the shares of their common and whole extent on the
    true axis, for those within 25 degrees of it, off it by at most .9 of the wall (8 at least), that overlap by
    .4 of the shorter. Both have plan, id, x0, y0, x1, y1; truth has the wall's thickness. Scores under .2 do not count.
    """
    f, t = framed(found).where("length >= 1"), framed(truth).where("length >= 1")
    reach = float(truth.agg(F.max("thickness")).first()[0] or 0) + 10  # one number
    met = met_on_grid(f, t, size, reach, ["plan"])
    met = met.where("abs(l.ux * r.ux + l.uy * r.uy) >= cos(radians(25D))").where("abs((l.mx - r.x0) * -r.uy + (l.my - r.y0) * r.ux) <= greatest(0.9D * r.thickness, 8D)")
    along = lambda k: f"((l.x{k} - r.x0) * r.ux + (l.y{k} - r.y0) * r.uy)"
    met = met.selectExpr("l.plan", "l.id AS pred", "r.id AS truth", "l.length", "r.length AS width", f"least({along(0)}, {along(1)}) AS low", f"greatest({along(0)}, {along(1)}) AS high")
    met = met.selectExpr("*", "greatest(0D, least(high, width) - greatest(low, 0D)) AS common", "greatest(high, width) - least(low, 0D) AS whole").where("common >= 0.4D * least(width, length)")
    return met.selectExpr("plan", "pred", "truth", "bround(common / whole, 6) AS score").where("score >= 0.2D")


def opening_report(found: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of counts and ratios of matched openings: found has id and type, truth id and kind (door, window or
    opening), matched pred and truth. A prediction on a passage is neither right nor wrong; ratios of nothing are null."""
    p = found.select(F.col("id").alias("pred"), F.col("type"))
    g = truth.select(F.col("id").alias("truth"), F.col("kind"))
    both = p.join(matched.select("pred", "truth"), "pred", "full").join(g, "truth", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    kind, type_, hit = F.col("kind"), F.col("type"), F.col("kind").isNotNull() & F.col("type").isNotNull()
    dw = kind.isin("door", "window")
    cols = {"gt": n(dw), "hits": n(dw & hit), "right": n(hit & (kind == type_) & dw), "unknown": n(dw & hit & (type_ == "opening")), "false_candidates": n(type_.isNotNull() & kind.isNull()), "passages_found": n(hit & (kind == "opening"))}
    for c in ("door", "window"):
        cols |= {f"{c}_tp": n(hit & (kind == c) & (type_ == c)), f"{c}_said": n((type_ == c) & ~F.coalesce(kind == "opening", F.lit(False))), f"{c}_gt": n(kind == c)}
    s = both.agg(*[v.alias(k) for k, v in cols.items()])
    r = lambda a, b: F.bround(ratio(F.col(a), F.col(b)), 6)
    return s.select(
        r("hits", "gt").alias("candidate_recall"), *[r(f"{c}_tp", f"{c}_said").alias(f"{c}_precision") for c in ("door", "window")], *[r(f"{c}_tp", f"{c}_gt").alias(f"{c}_recall") for c in ("door", "window")],
        r("right", "hits").alias("classification_accuracy"), r("right", "gt").alias("end_to_end_accuracy"), r("unknown", "hits").alias("unknown_rate"), "false_candidates", "passages_found",
    )
