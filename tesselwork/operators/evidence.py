"""Aggregation of repeated readings: support, score, correction by a vocabulary, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.functions.text import one_substitution

BONUS = 1.25  # fixed value: weight of a reading that the vocabulary knows


def resolve(readings: DataFrame, place: str, reading: str, variant: str, confidence: str, vocabulary: list[str], rivals: int = 5) -> DataFrame:
    """One row for each place: the chosen reading, its support (passes), score, best and mean confidence, whether it
    took over from an unknown one, the reason, and the next ``rivals`` readings with their support.

    A reading's score is the sum over passes of its best confidence there / 100, times BONUS if known. If the
    best reading is unknown, the first known one of confidence 60 and one letter away takes over. Accepted: best
    confidence 60; else support 2 and a mean of all its observations of 40; else known and 25.
    """
    known = F.col(reading).isin(vocabulary)
    per = readings.groupBy(place, reading, variant).agg(F.max(confidence).alias("best"), F.sum(confidence).alias("whole"), F.count(F.lit(1)).alias("n"))
    scored = per.groupBy(place, reading).agg(
        F.count(F.lit(1)).alias("support"), F.sum("best").alias("total"), F.max("best").alias("best"), (F.sum("whole") / F.sum("n")).alias("mean")
    )
    scored = scored.withColumn("known", known).withColumn("score", F.bround(F.col("total") / 100 * F.when(known, BONUS).otherwise(1.0), 6))
    line = Window.partitionBy(place).orderBy(F.desc("score"), F.desc("support"), reading)
    ranked = scored.withColumn("rank", F.row_number().over(line))
    top = ranked.withColumns({"top": F.first(reading).over(line), "top_known": F.first("known").over(line)})
    fix = ~F.col("top_known") & F.col("known") & (F.col("best") >= 60) & one_substitution(F.col("top"), F.col(reading))
    picked = Window.partitionBy(place).orderBy("turn", "rank")
    chosen = top.withColumn("turn", F.when(fix, 0).otherwise(1)).withColumn("pick", F.row_number().over(picked))
    chosen = chosen.where(F.col("pick") <= rivals + 1).groupBy(place).agg(
        *[F.max(F.when(F.col("pick") == 1, F.col(c))).alias(c) for c in (reading, "support", "score", "best", "mean", "turn", "known")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pick") > 1, F.struct("pick", F.concat_ws(":", reading, "support").alias("r"))))), lambda x: x["r"]), ",").alias("rivals"),
    )
    reason = (
        F.when(F.col("best") >= 60, "confident").when((F.col("support") >= 2) & (F.col("mean") >= 40), "supported").when(F.col("known") & (F.col("best") >= 25), "known").otherwise("rejected")
    )
    return chosen.select(place, reading, "support", "score", "best", F.bround("mean", 6).alias("mean"), (F.col("turn") == 0).alias("corrected"), reason.alias("reason"), "rivals")


def diminishing(rows: DataFrame, group: str, weight: str, kind: str, first: float = 1.0, rest: float = 0.3, most: int = 3) -> DataFrame:
    """Support of a group in which repeats of a kind count less: the heaviest whole, the next two in part, others not."""
    line = Window.partitionBy(group, kind).orderBy(F.desc(weight))
    part = F.when(F.col("nth") == 1, first).when(F.col("nth") <= most, rest).otherwise(0.0)
    each = rows.withColumn("nth", F.row_number().over(line)).withColumn("part", F.col(weight) * part)
    return each.groupBy(group).agg(F.bround(F.sum("part"), 4).alias("support"), F.countDistinct(kind).alias("kinds"))
