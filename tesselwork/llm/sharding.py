"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their content. How many rows of each block go to each shard is drawn exactly
from the multivariate hypergeometric law, so that every assignment of rows to shards of the given sizes is
equally likely. Each block is then permuted by itself and dealt out by its row of the matrix (the exchange), and
each shard is permuted again for its slots.

The driver holds the matrix alone: at most ``max_blocks`` x shards numbers, whatever the input. Rows keep 64 bits
of hash per permutation, so the order is that of a seeded random one, the same in each run and after a lost
executor. Slots of one shard are numbered in several slices of its key order, so no task gets a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.llm.columns import crc32, order, spread, text_or_empty
from tesselwork.sources.scratch import written

#: Above this numpy's own sampler refuses its arguments.
_NUMPY_MOST = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many good ones are among ``take`` drawn without replacement."""
    if not good or not take:
        return 0
    if not bad or take == good + bad:
        return min(good, take)
    if max(good, bad, take) < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, take))
    # Inversion over the mass around the mode: successive ratios of the probabilities are exact fractions.
    total, low, high = good + bad, max(0, take - bad), min(good, take)
    mode = min(max(((take + 1) * (good + 1)) // (total + 2), low), high)
    share = good / total
    span = int(40 * (take * share * (1 - share) * (total - take) / max(total - 1, 1)) ** 0.5) + 50
    up = np.arange(mode, min(high, mode + span), dtype=np.float64)
    down = np.arange(mode, max(low, mode - span), -1, dtype=np.float64)
    right = np.cumprod((good - up) * (take - up) / ((up + 1) * (bad - take + up + 1)))
    left = np.cumprod(down * (bad - take + down) / ((good - down + 1) * (take - down + 1)))
    mass = np.concatenate([left[::-1], [1.0], right])
    at = np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right")
    return int(mode - len(left) + min(at, len(mass) - 1))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row i: how many rows of block i go to each shard. Sums are exactly ``blocks`` and ``shards``."""
    rng, room, matrix = np.random.default_rng(seed), list(shards), []
    for rows in blocks:
        left, pool, row = rows, sum(room), []
        for free in room:
            pool -= free
            drawn = hypergeometric(rng, free, pool, left)
            row.append(drawn)
            left -= drawn
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards get the odd rows."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shuffle_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    seed: int = 20_011,
    rows_per_block: int = 50_000,
    max_blocks: int = 8192,
    rows_per_slice: int = 200_000,
) -> DataFrame:
    """Return doc_id, size, text_crc32, shard and slot for every row.

    size: UTF-8 bytes of the text (none for null) plus 16. Rows with a null id or text, empty texts and repeated
    rows are rows like any other; each repeat gets a slot of its own. The law is uniform over rows: equal texts are
    shuffled apart like any others, and no shard is theirs. An empty table gives no rows. Other columns
    of ``docs`` are not read, so their names cannot clash.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text)) + F.lit(16)).cast("long").alias("size"),
        crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("h"),
    )
    rows = written(rows, "shard-rows")
    total = rows.count()
    blocks = min(max_blocks, max(16, total // rows_per_block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(blocks)).cast("int"))

    counted = dict(rows.groupBy("block").count().collect())  # at most max_blocks rows
    names = sorted(counted)
    matrix = communication_matrix([counted[b] for b in names], shard_sizes(total, shards), seed)
    bounds = [(b, [int(x) for x in np.cumsum(row)]) for b, row in zip(names, matrix, strict=True)]
    bounds_df = docs.sparkSession.createDataFrame(bounds, "block int, bounds array<long>")

    tie = ["h", "doc_id", "text_crc32", "size"]
    local = Window.partitionBy("block").orderBy(F.xxhash64("h", F.lit(seed + 1)), *tie)
    dealt = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(F.broadcast(bounds_df), "block")  # max_blocks rows of `shards` numbers at most
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("rank"))))
        .withColumn("key", F.xxhash64("h", F.lit(seed + 2)))
    )
    slices = max(2, -(-total // (shards * rows_per_slice)))
    dealt = written(dealt.withColumn("slice", spread(slices, F.col("key"))).drop("block", "rank", "bounds"), "shard-dealt")

    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "slice").count().select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy(order(F.col("key")), "key", *tie)
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(starts, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
    )
