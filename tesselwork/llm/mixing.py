"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Each source's documents stand in a seeded random order on a line of words. The line is cut into blocks of equal
length, sources get blocks one by one by the highest quotient target / (2 x seats + 1), and the shards of the mix
take consecutive runs of these awards: since apportionment is house-monotone, every shard's integer quotas
already have the target proportions. A source's quota is then selected from its line as a cyclic run of blocks
from a seeded start; because the documents' order is random, so is the selection. Beyond its line a source
repeats itself, at most ``cap`` times.

A block is a 32nd of the least target at most (or one word), so that a tiny source beside huge ones gets its share
too; the awards are not walked one by one but found by bisection on the quotient.

Where a document begins on the line is a prefix sum in two levels (slices of the hash order, then rows of a
slice), so a source that holds most of the rows is spread over many tasks. Up to ``most_on_driver`` sources the driver
plans over one row for each; beyond, the same plan is made on a table, by sums alone.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.llm.columns import order, spread, words
from tesselwork.sources.scratch import written

MOST_ON_DRIVER = 10_000  # sources; more are planned on a table


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share all of sizes by weight; what exceeds cap x size is shared again among the others by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def awards(wanted: list[float], limits: list[int], seats: int, had: list[int] | None = None) -> list[int]:
    """Sainte-Laguë: the party of each seat in the order of award; ties go to the first; no party beyond its limit.

    ``had``: seats that are awarded already; ``seats`` more follow.
    """
    had = had or [0] * len(wanted)
    heap = [(-w / (2 * had[i] + 1), i, had[i]) for i, w in enumerate(wanted) if w > 0 and limits[i] > had[i]]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < seats:
        _, i, n = heapq.heappop(heap)
        out.append(i)
        if n + 1 < limits[i]:
            heapq.heappush(heap, (-wanted[i] / (2 * n + 3), i, n + 1))
    return out


def apportioned(wanted: list[float], limits: list[int], seats: int) -> np.ndarray:
    """Seats of each party after so many awards: what ``awards`` gives, without a step for each seat.

    The seats whose quotient exceeds a threshold come before all others. The threshold is bisected between
    neighbouring floats, so at most one seat of each party is left to award one by one.
    """
    w = np.array(wanted, dtype=float)
    most = np.where(w > 0, np.array(limits, dtype=np.int64), 0)
    if most.sum() <= seats:
        return most

    def above(q: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = np.minimum(np.floor((w / q + 1) / 2), most).astype(np.int64)
        while (less := (n > 0) & (w / (2 * n - 1) <= q)).any():  # quotients round
            n -= less
        while (more := (n < most) & (w / (2 * n + 1) > q)).any():
            n += more
        return n

    low, high = 0.0, float(w.max())  # above(high) is nothing; above(low) would be all
    while low < (middle := (low + high) / 2) < high:
        if above(middle).sum() <= seats:
            high = middle
        else:
            low = middle
    out = above(high)
    np.add.at(out, np.array(awards(wanted, most.tolist(), seats - int(out.sum()), out.tolist()), dtype=int), 1)
    return out


def plan(sizes: list[int], weights: list[float], cap: int, shards: int, blocks: int, seed: int) -> list[dict]:
    """Per source: size, target, and for each shard the stretch [low, high) of its unrolled line."""
    wanted, total = targets(sizes, weights, cap), sum(sizes)
    least = min((w for w in wanted if w > 0), default=1.0)
    block = max(1, min(total // blocks, int(least // 32)))
    limits = [int(cap * s // block) for s in sizes]
    seats = min(total // block, sum(n for n, w in zip(limits, wanted, strict=True) if w > 0))
    rng = np.random.default_rng(seed)
    out = []
    # Award t of all goes to shard t x shards // seats.
    quota = np.diff([apportioned(wanted, limits, -(-j * seats // shards)) for j in range(shards + 1)], axis=0).T
    for i, size in enumerate(sizes):
        start = int(rng.integers(0, max(1, -(-size // block)))) * block
        edges = start + block * np.concatenate([[0], np.cumsum(quota[i])])
        out.append({"size": size, "target": wanted[i], "block": block, "quota": quota[i].tolist(), "edges": [int(x) for x in edges]})
    return out


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds n: the place of each source by code point, null last, without a task that sees all."""
    ordered = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-order")
    before, at = {}, 0
    for part, rows in sorted(ordered.groupBy("part").count().collect()):  # one row for each partition
        before[part] = at
        at += rows
    starts = ordered.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return ordered.join(F.broadcast(starts), "part").select("source", "words", (F.col("before") + F.col("row")).alias("n"))


def _as_float(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _search(table: DataFrame, least: list[int], most: list[int], value, aims: list[int], ways: int = 16) -> list[int]:
    """For each aim the greatest whole number x in [least, most) with value(j, x), summed over the table, above the
    aim, or least - 1 where there is none; sums must not rise with x. Each round is one aggregation for all aims."""
    low, high = [x - 1 for x in least], list(most)
    while any(h - l > 1 for l, h in zip(low, high, strict=True)):
        tries = [sorted({l + max(1, (h - l) * k // ways) for k in range(1, ways)} - {h}) if h - l > 1 else [] for l, h in zip(low, high, strict=True)]
        flat = [(j, x) for j, xs in enumerate(tries) for x in xs]
        sums = table.agg(*[F.sum(value(j, x)).alias(f"s{i}") for i, (j, x) in enumerate(flat)]).first()
        for (j, x), got in zip(flat, sums, strict=True):
            if got > aims[j]:
                low[j] = max(low[j], x)
            else:
                high[j] = min(high[j], x)
    return low


def plan_table(sizes: DataFrame, weights: tuple[float, ...], cap: int, shards: int, blocks: int, seed: int) -> DataFrame:
    """What ``plan`` makes, for a table (source, words) of any number of sources: source, source_size, target, edges.

    Thresholds are searched by sums over the table: the rate at which targets stop at their caps, and for each shard
    the quotient down to which seats are awarded; seats of that very quotient go to the first sources in order.
    """
    rows = _numbered(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    rows = written(rows.select("source", F.col("words").alias("size"), "n", F.when(F.col("words") > 0, weight).otherwise(0.0).alias("w")), "mix-sources")
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = F.lit(cap) * F.col("size")
    rate, capped = 0.0, None
    while total:  # the rate only rises; each round stops one more source at its cap or is the last
        over = F.lit(rate) * F.col("w") > most
        whole, full, count = rows.agg(F.sum(F.when(~over, F.col("w")).otherwise(0.0)), F.sum(F.when(over, most).otherwise(F.lit(0))), F.sum(over.cast("long"))).first()
        if count == capped or not whole:
            break
        rate, capped = (total - full) / whole, count
    rows = rows.withColumn("target", F.least(most.cast("double"), F.lit(rate) * F.col("w")))
    least = rows.where("target > 0").agg(F.min("target")).first()[0] or 1.0
    block = max(1, min(total // blocks, int(least // 32)))
    rows = written(rows.withColumn("most", F.when(F.col("target") > 0, F.floor(most / F.lit(block))).otherwise(F.lit(0)).cast("long")), "mix-seats")
    top, limit, last = rows.agg(F.max("target"), F.sum("most"), F.max("n")).first() if total else (1.0, 0, 0)
    seats = min(total // block, limit)
    aims = [-(-j * seats // shards) for j in range(1, shards + 1)]

    def won(bits: int) -> Column:
        """Seats of a source whose quotient exceeds this one."""
        return F.least(F.col("most"), F.greatest(F.lit(0), F.ceil((F.col("target") / F.lit(_as_float(bits)) - 1) / 2)).cast("long"))

    high = struct.unpack("<q", struct.pack("<d", float(top)))[0] + 1
    below = _search(rows, [1] * shards, [high] * shards, lambda j, bits: won(bits), aims)
    sure = [won(b + 1) for b in below]
    tied = [(won(b) > w).cast("long") if b else F.lit(0).cast("long") for b, w in zip(below, sure, strict=True)]
    had = rows.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate([*sure, *tied])]).first()
    after = [(had[shards + j] or 0) - (aims[j] - (had[j] or 0)) for j in range(shards)]  # tied sources that get no seat more
    upto = _search(rows, [0] * shards, [(last or 0) + 2] * shards, lambda j, x: F.when(F.col("n") >= x, tied[j]).otherwise(0), after)
    quota = [w + F.when(F.col("n") <= x, t).otherwise(0) for w, t, x in zip(sure, tied, upto, strict=True)]
    begins = F.pmod(F.xxhash64(F.lit(seed), "source"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(block)))) * F.lit(block)
    edges = F.array(begins, *[begins + F.lit(block) * q for q in quota])
    return written(rows.select("source", F.col("size").alias("source_size"), "target", edges.cast("array<long>").alias("edges")), "mix-plan")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    shards: int = 8,
    blocks: int = 65_536,
    seed: int = 40_503,
    rows_per_slice: int = 25_000,
    most_on_driver: int = MOST_ON_DRIVER,
) -> DataFrame:
    """Return doc_id, source, size, source_size, target, taken and by_shard for every row.

    size: words of the text (none for null). ``weights`` repeat over the sources in code-point order, null last.
    taken: words that the mix takes, repeats counted; by_shard: array of (shard, words) where it takes any. A
    document at the end of a run of blocks may be taken in part. Rows of equal content are interchangeable. Sources
    without words get a target of 0; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    out = _mixed(docs, id_col, text_col, source_col, weights, cap, shards, blocks, seed, rows_per_slice, most_on_driver)
    return out.drop("h")


def repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 40_503, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it: its words taken over its
    size, rounded. Options are those of ``mix_sources``.

    Rows without words, and those that the mix passes over, go. Rows that repeat id and text come as often as the one
    of them that is taken most. An empty table stays one.
    """
    defaults = {"weights": (5, 2, 1), "cap": 3, "shards": 8, "blocks": 65_536, "rows_per_slice": 25_000, "most_on_driver": MOST_ON_DRIVER}
    mixed = _mixed(docs, id_col, text_col, source_col, seed=seed, **(defaults | options)).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    key = F.struct(F.col("doc_id").alias("id"), F.col("h"), F.col("size"))
    taken = mixed.select(key.alias("key"), times.alias("times")).where("times > 0").groupBy("key").agg(F.max("times").alias("times"))
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    rows = docs.select(own.alias("own"), F.struct(*docs.columns).alias("row"))
    met = rows.join(taken, F.col("own").eqNullSafe(F.col("key")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select("row.*")


def _mixed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], cap: int, shards: int, blocks: int, seed: int, rows_per_slice: int, most_on_driver: int
) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = written(rows, "mix-rows")
    slices = min(4096, max(64, rows.count() // rows_per_slice))
    rows = rows.withColumn("slice", spread(slices, F.col("h")))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    sizes = written(sums.groupBy("source").agg(F.sum("words").alias("words")), "mix-sizes")
    few = sizes.count() <= most_on_driver
    if few:
        found = sorted(((r.source, r.words) for r in sizes.collect()), key=lambda r: (r[0] is None, r[0] or ""))  # most_on_driver rows
        made = plan([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], cap, shards, blocks, seed)
        table = docs.sparkSession.createDataFrame(
            [(s, p["size"], p["target"], p["edges"]) for (s, _), p in zip(found, made, strict=True)],
            "source string, source_size long, target double, edges array<long>",
        )
    else:
        table = plan_table(sizes, weights, cap, shards, blocks, seed)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    # The table of starts has a row for each source and slice: Spark weighs it at run time.
    line = Window.partitionBy("source", "slice").orderBy(order(F.col("h")), "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("gone", F.coalesce(F.sum("size").over(line), F.lit(0)))
        .alias("r")
        .join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")))
        .select("doc_id", "h", F.col("r.source").alias("source"), "size", (F.col("gone") + F.col("start")).alias("at"))
    )
    table = F.broadcast(table) if few else table  # most_on_driver rows
    both = placed.alias("r").join(table.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    epochs = F.array(*[F.lit(e) for e in range(cap + 1)])

    def overlap(low, high):
        def one(e):
            at = F.col("at") + e * F.col("source_size")
            return F.greatest(F.lit(0), F.least(high, at + F.col("size")) - F.greatest(low, at))

        return F.aggregate(epochs, F.lit(0).cast("long"), lambda acc, e: acc + one(e))

    edge = F.col("edges")
    per_shard = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(j.alias("shard"), overlap(F.get(edge, j), F.get(edge, j + 1)).alias("words"))),
        lambda x: x["words"] > 0,
    )
    return both.select(
        "doc_id", "h", F.col("r.source").alias("source"), "size", "source_size", "target",
        overlap(F.get(edge, F.lit(0)), F.get(edge, F.lit(shards))).alias("taken"), per_shard.alias("by_shard"),
    )
