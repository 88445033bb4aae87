"""Near-duplicate groups by banded MinHash, odd sketches, and confirmation on full shingle sets.

A text's set is hashed to 64-bit shingles. Texts of equal sets are one class, with a number of its own, so copies cost
one hash each. Classes meet in buckets of MinHash bands. Their MinHash samples are also folded into an odd sketch, a
bitmap in which each sample flips one bit; the XOR of two sketches has few ones where similarity is high, so a
population count tells which candidates are worth their full sets. Every link is confirmed on the full sets, which are
made again from the texts of those classes only that a sketch could not tell apart.

Buckets are never gathered. First each member meets only leaders, the least of each of its buckets (an aggregation
and a join); the two most similar leaders are tried. Confirmed links give components. Only buckets that still hold
several components are looked at again: their members are dealt into blocks of bounded size such that each pair of
different components meets in some block. A block first sees sketches alone and names the members that have a
candidate in another component; those come again with their full sets, and a block returns confirmed links between
components alone, so fewer than it has members.

Two texts with similarity s share a band of r samples with probability 1 - (1 - s^r)^b; 30 bands of 5 miss one
link of 0.8 in 150,000, and higher ones far less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselwork.llm.batches import slices
from tesselwork.llm.columns import bounded_broadcast
from tesselwork.operators.graph import components
from tesselwork.sources.scratch import release, written

BANDS, ROWS = 30, 5
SKETCH_BITS = 512
#: XOR ones up to which a candidate's sets are compared. A pair at 0.8 has 54 +- 8 ones; beyond 96 is five deviations.
MOST_ONES = 96
BLOCK = 500  # members of a bucket that are compared in one block

_RANDOM = np.random.default_rng(1009)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> _S)


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words are one run; no words, none.

    Words are runs other than space and U+0009 to U+000D, A to Z in lower case: what bytes.lower and bytes.split do.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(hashed))
    run = np.full(len(hashed) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        run = _mix(run * _C2 + hashed[k : len(hashed) - span + 1 + k])
    return np.unique(run)


def minhash(sh: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sh), 2048):
        np.minimum(out, (sh[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in samples.reshape(BANDS, ROWS).T:
        key = _mix(key * _C1 + row)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as longs: each (place, sample) flips one bit."""
    bit = _mix(samples + np.arange(len(samples), dtype=np.uint64) * _C2) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_similarity(ones: float, samples: int = BANDS * ROWS) -> float:
    """What a population count of an XOR says: 1 + n / 4k ln(1 - 2 ones / n)."""
    return 1 + SKETCH_BITS / (4 * samples) * float(np.log(max(1e-9, 1 - 2 * ones / SKETCH_BITS)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _digest(sh: np.ndarray) -> np.ndarray:
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(sh.tobytes()), dtype=np.int64)


_SIGNED = "doc_id long, h long, h2 long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """doc_id and hashes of a row; size and digest of its set; keys of its bands and its odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for b in slices(batches):
            n, d1, d2, keys, sketches = [], [], [], [], []
            for text in b.column(3):
                sh = shingles(text.as_py(), width)
                digest = _digest(sh)
                n.append(len(sh))
                d1.append(digest[0])
                d2.append(digest[1])
                samples = minhash(sh) if len(sh) else None
                keys.append(none if samples is None else band_keys(samples))
                sketches.append(none if samples is None else odd_sketch(samples))
            cols = [b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), _lists(keys), _lists(sketches)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _SIGNED.split(", ")])

    return rows.mapInArrow(run, _SIGNED)


def _sets(texts: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and full set (sh) of each of these classes, made from the text of one of its rows."""
    wanted = written(nodes.distinct().join(classes, "node").select("node", F.col("pick").alias("h"), "d1", "d2"), "near-wanted")
    rows = texts.join(bounded_broadcast(wanted), "h").select("node", "d1", "d2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, d1, d2, texts_ = (b.column(i).to_pylist() for i in range(4))
            out_node, out = [], []
            for i, text in enumerate(texts_):
                sh = shingles(text, width)
                digest = _digest(sh)
                if digest[0] == d1[i] and digest[1] == d2[i]:  # another row may have the same hash
                    out_node.append(node[i])
                    out.append(sh)
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), _lists(out)], ["node", "sh"])

    found = written(rows.mapInArrow(run, "node long, sh array<long>"), "near-sets")
    if found.count() == found.select("node").distinct().count():
        return found
    once = written(found.dropDuplicates(["node"]), "near-sets")  # rows that repeat id and text
    release(found)
    return once


def _ones(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def similar(common: Column, one: Column, other: Column, percent: int) -> Column:
    return F.lit(100) * common >= F.lit(percent) * (one + other - common)


class _Block:
    """Members of one block, by node, and which pairs a sketch cannot tell apart."""

    def __init__(self, table: pa.Table, percent: int):
        self.table, self.percent = table.sort_by("node"), percent
        as_array = lambda c: np.array(self.table.column(c).combine_chunks().flatten()).reshape(len(self.node), -1)
        self.node = self.table.column("node").to_numpy()
        self.size = self.table.column("n").to_numpy()
        self.bands, self.sketch = as_array("bands"), as_array("sketch").view(np.uint64)
        _, self.comp = np.unique(self.table.column("comp").to_numpy(), return_inverse=True)
        self.band = int(np.flatnonzero(self.bands[0] == self.table.column("key")[0].as_py())[0])

    def candidates(self, i: int) -> np.ndarray:
        """Later members of other components that may be similar; a pair counts in the first band that it shares."""
        rest = np.flatnonzero(self.comp[i + 1 :] != self.comp[i]) + i + 1
        small, large = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
        rest = rest[100 * small >= self.percent * large]
        if self.band:
            rest = rest[~(self.bands[rest, : self.band] == self.bands[i, : self.band]).any(axis=1)]
        return rest[np.bitwise_count(self.sketch[rest] ^ self.sketch[i]).sum(axis=1) <= MOST_ONES]


def _block_suspects(percent: int):
    """The members of a block that have a candidate in another component."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, percent)
        hit = np.zeros(len(block.node), dtype=bool)
        for i in range(len(hit) - 1):
            near = block.candidates(i)
            hit[near] = True
            hit[i] |= len(near) > 0
        return block.table.filter(pa.array(hit)).select(["key", "spot", "node", "comp"])

    return run


def _block_links(percent: int):
    """Links between members of different components of a block, enough to join what they join."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, percent)
        sets = block.table.column("sh").combine_chunks()
        of = lambda i: sets[int(i)].values.to_numpy()
        left, right, comp = [], [], block.comp
        for i in range(len(comp) - 1):
            for j in block.candidates(i):
                if comp[i] == comp[j]:
                    continue
                common = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * common >= percent * (block.size[i] + block.size[j] - common):
                    left.append(block.node[i])
                    right.append(block.node[j])
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _blocks(members: DataFrame, per: DataFrame) -> DataFrame:
    """Deal the members of mixed buckets into blocks: all in one, or chunk by chunk where a bucket is large.

    The largest component of a large bucket needs no pairs within itself: its chunks meet those of the others only.
    """
    both = members.join(per, "key")
    ceil = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(BLOCK))).cast("int")
    both = both.withColumns({"big": F.col("comp") == F.col("top"), "co": ceil(F.col("m") - F.col("in_top")), "cb": ceil(F.col("in_top"))})
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("big"), F.col("cb")).otherwise(F.col("co"))).cast("int")
    both = both.withColumn("c", mine)
    others, bigs = F.sequence(F.lit(0), F.col("co") - 1), F.sequence(F.lit(0), F.col("cb") - 1)
    spot = lambda kind, i, j: F.concat_ws(":", F.lit(kind), i, j)
    spots = (
        F.when(F.col("m") <= BLOCK, F.array(spot("all", F.lit(0), F.lit(0))))
        .when(F.col("big"), F.transform(others, lambda i: spot("big", i, F.col("c"))))
        .otherwise(F.concat(F.transform(others, lambda i: spot("other", F.least(i, F.col("c")), F.greatest(i, F.col("c")))), F.transform(bigs, lambda j: spot("big", F.col("c"), j))))
    )
    return both.select("key", "node", "comp", F.explode(spots).alias("spot"))


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Return doc_id, h and h2 (hashes of id and text), n_shingles, group and component_id for every row.

    group numbers what is linked; it is null for rows without shingles, and another run may number otherwise.
    """
    both = (F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = docs.select(both[0].alias("doc_id"), F.xxhash64(*both).alias("h"), F.xxhash64(F.lit(7), *reversed(both)).alias("h2"), both[1].alias("text"))
    base = written(_signed(texts, width), "near-signed")
    some = base.where("n_shingles > 0").groupBy("d1", "d2")
    one = lambda c: F.first(c).alias(c)  # noqa: E731  (rows of a class have them in common)
    classes = some.agg(F.min("doc_id").alias("first_doc"), F.min("h").alias("pick"), F.first("n_shingles").alias("n"), one("bands"), one("sketch"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # numbers are fixed once they are written

    buckets = classes.select("node", F.explode("bands").alias("key"))
    lead = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    members = written(buckets.join(lead, "key").select("key", "node", "leader"), "near-members")

    side = lambda p, d, *cols: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", *cols)])
    stars = members.where("node <> leader").select(F.col("node").alias("x_node"), F.col("leader").alias("y_node")).distinct()
    stars = stars.join(side("x", classes, "sketch", "n"), "x_node").join(side("y", classes, "sketch", "n"), "y_node").withColumn("ones", _ones(F.col("x_sketch"), F.col("y_sketch")))
    fits = F.lit(100) * F.least("x_n", "y_n") >= F.lit(percent) * F.greatest("x_n", "y_n")
    best = Window.partitionBy("x_node").orderBy("ones", "y_node")  # at most BANDS leaders of a node
    stars = stars.where(fits & (F.col("ones") <= MOST_ONES)).select("x_node", "y_node", F.row_number().over(best).alias("nth"))
    stars = written(stars.where("nth <= 2"), "near-stars")
    sets = _sets(texts, classes, stars.select(F.explode(F.array("x_node", "y_node")).alias("node")), width)

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(side("x", sets, "sh"), "x_node").join(side("y", sets, "sh"), "y_node")
        links = met.where(similar(F.size(F.array_intersect("x_sh", "y_sh")), F.size("x_sh"), F.size("y_sh"), percent))
        return written(links.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")), "near-links")

    links = confirmed(stars.where("nth = 1"))
    second = stars.where("nth = 2").join(links.select(F.col("a").alias("x_node")), "x_node", "left_anti")  # whose best leader was none
    links = links.unionByName(confirmed(second))
    release(sets)
    joined = written(components(links), "near-components")

    labelled = members.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    per = labelled.groupBy("key", "comp").count().groupBy("key")
    per = per.agg(F.max(F.struct("count", "comp")).alias("t"), F.sum("count").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    per = per.select("key", F.col("t.comp").alias("top"), F.col("t.count").alias("in_top"), "m")
    slim = classes.select("node", "n", "bands", "sketch")
    dealt = _blocks(labelled, per).join(slim, "node").select("key", "spot", "node", "comp", "n", "bands", "sketch")
    suspects = dealt.groupBy("key", "spot").applyInArrow(_block_suspects(percent), "key long, spot string, node long, comp long")
    suspects = written(suspects, "near-suspects")
    release(members)
    sets = _sets(texts, classes, suspects.select("node"), width)
    dealt = suspects.join(slim, "node").join(sets, "node").select("key", "spot", "node", "comp", "n", "bands", "sketch", "sh")
    bridges = written(dealt.groupBy("key", "spot").applyInArrow(_block_links(percent), "a long, b long"), "near-bridges")
    release(sets)

    label = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
    ends = bridges.join(label("a"), "a", "left").join(label("b"), "b", "left")
    again = components(ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    again = written(again.withColumnRenamed("node", "was"), "near-components")
    own = classes.select("d1", "d2", "node", "first_doc").join(joined, "node", "left").withColumn("was", F.coalesce("component", "node"))
    own = own.join(again.withColumnRenamed("component", "now"), "was", "left").select("d1", "d2", "first_doc", F.coalesce("now", "was").alias("group"))
    own = written(own, "near-groups")
    ids = own.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    out = base.drop("bands", "sketch").join(own.join(ids, "group").drop("first_doc"), ["d1", "d2"], "left")  # no set, no class
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", "h2", "n_shingles", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Return doc_id, n_shingles, component_id and kept for every row.

    Documents are linked where 100 x intersection >= percent x union of their sets of ``width``-word shingles;
    component_id is the smallest doc_id reachable. Null, empty and blank texts have no shingles and are linked with
    nothing. Rows are linked by their texts: equal rows come out equal, and rows that share an id but not their text
    are each in the group of their own text. A row without an id links others like any row; it gets its group's
    component_id (null if no row there has an id) and is never the one kept. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    out = grouped(docs, id_col, text_col, width, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each group of near-duplicates stays.

    That is the row with the smallest id (rows without an id come last; then by a hash of the text). Of rows that
    repeat id and text one stays, any of them; rows that share only an id are different documents. Rows without
    shingles (null, empty or blank texts) all stay. An empty table stays one.
    """
    rows = written(grouped(docs, id_col, text_col, width, percent), "near-rows").where("group IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"), F.col("h2").alias("h2"))
    first = rows.groupBy("group").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = written(rows.join(first, "group").select("h", "h2", ((F.col("h") == F.col("first.h")) & (F.col("h2") == F.col("first.h2"))).alias("stays")), "near-copies")
    gone = written(met.where("NOT stays").select("h", "h2").distinct(), "near-gone")
    again = written(met.where("stays").groupBy("h", "h2").count().where("count > 1").select("h", "h2"), "near-again")

    both = (F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    marked = docs.select(F.xxhash64(*both).alias("h"), F.xxhash64(F.lit(7), *reversed(both)).alias("h2"), F.struct(*docs.columns).alias("row"))
    left = marked.join(bounded_broadcast(gone), ["h", "h2"], "left_anti")
    if not again.isEmpty():
        repeated = bounded_broadcast(again)
        left = left.join(repeated, ["h", "h2"], "left_anti").unionByName(left.join(repeated, ["h", "h2"], "left_semi").dropDuplicates(["h", "h2"]))
    return left.select("row.*")
