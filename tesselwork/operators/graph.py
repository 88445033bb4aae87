"""Graph operators by fixpoint: each round is an aggregation and a join, written to the shared folder.

Every round settles something, so all of them end without a limit on rounds. Components and faces take a logarithmic
number of rounds; those that grow or prune step by step take as many as the longest path that they follow.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.sources.scratch import compacted, release, sized, written

EDGES_A_FILE = 1_000_000  # of a round of components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: return node, component (its smallest node) for every node.

    Alternates large-star and small-star steps: every node links its larger, then its smaller neighbours to the
    smallest one it knows. A hub's edges are reduced by partial aggregation and met again by a join that adaptive
    execution may split, so no node's neighbourhood has to fit a task. Stops when a round changes no edge. Edges
    with a null end are no edges; self-loops make a node known.

    A round never has more edges than the first, so their number says how many files a round needs; a few edges are
    not written as a file for each shuffle partition.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    known = written(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    nodes = written(known.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    now, before = known.where("u <> v"), None
    files = max(known.sparkSession.sparkContext.defaultParallelism, known.count() // EDGES_A_FILE + 1)
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
                "node", F.coalesce("component", "node").alias("component")
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v").coalesce(files), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        old, now = now, written(small.where("u <> v").distinct().coalesce(files), "small-star")
        release(old, large)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node and distance (least number of edges) of all that undirected edges a, b reach from ``start``'s nodes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "reach-edges")
    seen = front = written(start.select("node").distinct().withColumn("distance", F.lit(0)), "reach")
    parts, known = [seen], front.count()
    new = known
    for step in count(1):
        near = both.join(sized(front.select(F.col("node").alias("a")), new), "a").select(F.col("b").alias("node")).distinct()
        front = written(near.join(sized(seen, known), "node", "left_anti").withColumn("distance", F.lit(step)), "reach-front")
        new = front.count()
        if not new:
            return seen
        seen, parts = compacted(seen.unionByName(front), [*parts, front], "reach")
        front, known = seen.where(F.col("distance") == step) if len(parts) == 1 else front, known + new


def prune_ends(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Remove edges with an end that no other edge supports, again and again until none is left to remove.

    ``keep`` (node) names ends that count as supported.
    """
    now = written(edges.distinct(), "prune")
    while True:
        ends = now.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().where("count = 1").select("node")
        if keep is not None:
            ends = ends.join(keep.select("node"), "node", "left_anti")
        ends = written(ends, "prune-ends")
        if ends.isEmpty():
            return now
        old, now = now, written(now.join(ends.withColumnRenamed("node", "a"), "a", "left_anti").join(ends.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "prune")
        release(old, ends)


def planar_faces(edges: DataFrame) -> DataFrame:
    """Faces of a planar drawing of straight edges (ax, ay, bx, by): one row of face, sides and signed area each.

    Each edge is two half-edges. After a half-edge comes, at its end, the one next in clockwise order of angle from
    its reverse. Pointer jumping over that permutation, in a logarithmic number of rounds, labels every cycle by its
    least half-edge. Inner faces have a positive area; outlines a negative one.
    """
    e = edges.select("ax", "ay", "bx", "by").distinct().where("ax <> bx OR ay <> by")
    half = e.unionByName(e.select(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))).distinct()
    half = half.withColumn("id", F.concat_ws(",", "ax", "ay", "bx", "by")).withColumn("angle", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    spin = Window.partitionBy("ax", "ay").orderBy("angle")
    around = half.withColumn("before", F.coalesce(F.lag("id").over(spin), F.last("id").over(spin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    half, around = written(half, "half-edges"), around.select(F.concat_ws(",", "bx", "by", "ax", "ay").alias("id"), F.col("before").alias("to"))
    jump = written(around.withColumn("least", F.least("id", "to")), "faces")  # where a half-edge leads, and the least on the way
    while True:
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        new = written(jump.join(far, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")), "faces")
        if new.where("moved").isEmpty():
            cross = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
            return half.join(new, "id").groupBy(F.col("least").alias("face")).agg(F.count(F.lit(1)).alias("sides"), F.sum(cross).alias("area"))
        release(jump)
        jump = new


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, distance and label: the nearest of ``sources`` (node, label) over undirected edges a, b, of equals the
    least label. All sources grow at one pace; a node is settled once."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "grow-edges")
    seen = front = written(sources.groupBy("node").agg(F.min("label").alias("label")).withColumn("distance", F.lit(0)), "grow")
    parts = [seen]
    for step in count(1):
        near = both.join(front.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        front = written(near.join(seen, "node", "left_anti").select("node", "label", F.lit(step).alias("distance")), "grow-front")
        if front.isEmpty():
            return seen
        seen, parts = compacted(seen.unionByName(front), [*parts, front], "grow")
        front = seen.where(F.col("distance") == step) if len(parts) == 1 else front
