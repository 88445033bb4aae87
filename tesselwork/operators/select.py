"""Greedy selections: one-to-one matching, keep-first suppression, seeded grouping, retention.

Rounds settle all choices that depend on no open one; each settles some, so they end without a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.sources.scratch import compacted, release, sized, written


def greedy_match(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """The one-to-one matching that takes pairs by falling score, then falling a and b.

    A pair that is the best of both its ends is in that matching whatever else is, so each round takes all such pairs
    at once and drops the pairs that share an end with them.
    """
    left = written(pairs.select(a, b, score), "match")
    rank = F.struct(F.col(score), F.col(a), F.col(b))
    taken, parts = left.limit(0), []
    while not left.isEmpty():
        both = left.withColumn("top_a", F.max(rank).over(Window.partitionBy(a))).withColumn("top_b", F.max(rank).over(Window.partitionBy(b)))
        won = written(both.where((rank == F.col("top_a")) & (rank == F.col("top_b"))).select(a, b, score), "match-won")
        old, left = left, written(left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti").select(a, b, score), "match")
        taken, parts = compacted(taken.unionByName(won) if parts else won, [*parts, won], "match-taken")
        release(old)
    return taken


def keep_first(items: DataFrame, clashes: DataFrame, item: str, priority: str) -> DataFrame:
    """Greedy suppression: by falling priority (then rising id) an item stays unless it clashes with one that stayed.

    ``clashes`` has pairs a, b of items. Each round settles every open item whose better open neighbours are none:
    it stays, and its neighbours go.
    """
    order = F.struct(-F.col(priority), F.col(item))
    ranked = written(items.select(item, order.alias("rank")), "nms-items")
    both = clashes.unionByName(clashes.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left = most = ranked.count()
    known = lambda side: sized(ranked.select(F.col(item).alias(side), F.col("rank").alias(f"rank_{side}")), most)
    worse = written(both.join(known("a"), "a").join(known("b"), "b").where("rank_b < rank_a").select("a", "b"), "nms-pairs")
    open_, stayed, parts = ranked.select(item), ranked.select(item).limit(0), []
    while left:
        blocked = worse.join(sized(open_.select(F.col(item).alias("b")), left), "b", "left_semi").select(F.col("a").alias(item)).distinct()
        won = written(open_.join(sized(blocked, most), item, "left_anti"), "nms-won")
        gone = worse.join(sized(won.select(F.col(item).alias("b")), left), "b", "left_semi").select(F.col("a").alias(item)).distinct()
        old, open_ = open_, written(open_.join(sized(won, left), item, "left_anti").join(sized(gone, most), item, "left_anti"), "nms-open")
        left = open_.count()
        stayed, parts = compacted(stayed.unionByName(won) if parts else won, [*parts, won], "nms-stayed")
        release(old)
    return stayed


def newest(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def seeded_groups(items: DataFrame, matches: DataFrame, item: str, priority: str) -> DataFrame:
    """Group items around seeds: by falling priority (then rising id) an item joins the first seed that it matches, or
    becomes a seed. Groups are not chained through members. Return item and seed for every item.

    Seeds are the items that keep_first() keeps, since only seeds take others in.
    """
    seeds = written(keep_first(items, matches, item, priority).select(F.col(item).alias("seed")), "seeds")
    most = items.count()
    ranked = sized(seeds.join(sized(items.select(F.col(item).alias("seed"), F.col(priority).alias("p")), most), "seed"), most)
    both = matches.select("a", "b").unionByName(matches.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joins = both.where("a <> b").select(F.col("a").alias(item), F.col("b").alias("seed")).join(ranked, "seed")
    first = joins.groupBy(item).agg(F.min(F.struct(-F.col("p"), F.col("seed"))).alias("f"))
    own = seeds.select(F.col("seed").alias(item), F.col("seed").alias("own"))
    return items.select(item).join(sized(own, most), item, "left").join(sized(first, most), item, "left").select(item, F.coalesce("own", "f.seed").alias("seed"))


def same_place(grow: float = 0.25) -> str:
    """The rule over aliases l and r (x, y, w, h) that two boxes hold the same text: alike in height and width, and either
    overlapping by .6 of the smaller or with middles within a quarter of a side."""
    common = "greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y))"
    apart = "sqrt(pow(l.x + l.w / 2 - r.x - r.w / 2, 2) + pow(l.y + l.h / 2 - r.y - r.h / 2, 2))"
    return (
        "l.h / greatest(1, r.h) BETWEEN 0.6D AND 1.65D AND l.w / greatest(1, r.w) BETWEEN 0.5D AND 2D "
        f"AND ({common} / greatest(1, least(l.w * l.h, r.w * r.h)) >= 0.6D OR {apart} <= {grow}D * greatest(least(l.w, l.h), least(r.w, r.h), 4))"
    )


def same_text() -> str:
    """The rule over aliases l and r (text, x, y, w, h) that two boxes are one observation: equal texts, and middles
    within three quarters of the largest side (20 at least) or an overlap of a quarter of their union."""
    common = "greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y))"
    apart = "sqrt(pow(l.x + l.w / 2 - r.x - r.w / 2, 2) + pow(l.y + l.h / 2 - r.y - r.h / 2, 2))"
    return f"l.text = r.text AND ({apart} <= greatest(20D, 0.75D * greatest(l.w, l.h, r.w, r.h, 1)) OR {common} / (l.w * l.h + r.w * r.h - {common}) >= 0.25D)"


def same_object() -> str:
    """The rule over aliases l and r (kind, x, y, w, h) that two boxes are one thing: IoU .85, or .5 and of one kind."""
    common = "greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y))"
    iou = f"{common} / (l.w * l.h + r.w * r.h - {common})"
    return f"({iou} >= 0.85D OR (l.kind = r.kind AND {iou} >= 0.5D))"
