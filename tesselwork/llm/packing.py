"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document's ids plus one closing id are cut into full pieces of the sequence length and a tail. Full pieces are
sequences of their own; tails are packed by first-fit decreasing, with the leftmost sequence that still has room
found by descending a tournament tree of free room. Groups are drawn by a hash of the document, so a group is a
fair sample of lengths whatever the order or source of the input, and packing one is independent of the others. Rows
that repeat id and text are dealt to groups one by one, so that however many there are no group holds them all.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselwork.llm.tokens import id_bytes
from tesselwork.sources.scratch import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp int"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Room:
    """A tournament tree over sequences: each inner node holds the largest free room below it."""

    def __init__(self, sequences: int, length: int):
        self.leaves = 1
        while self.leaves < sequences:
            self.leaves *= 2
        self.tree = [length] * (2 * self.leaves)

    def take(self, need: int) -> tuple[int, int]:
        """The first sequence with room for ``need``, and the room that it had."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        had = tree[at]
        tree[at] = had - need
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return leaf, had


def first_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """Per item (sequence, offset); ties keep the items' order."""
    room, out = Room(len(lengths), length), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        sequence, had = room.take(lengths[i])
        out[i] = (sequence, length - had)
    return out


def _pieces(vocabulary: str, length: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        encode, close, task = id_bytes(vocabulary), (0).to_bytes(4, "little"), TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            cols: list[list] = [[] for _ in range(6)]
            seen: Counter = Counter()
            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                grp = h % groups
                if seen[h]:  # rows that repeat id and text are interchangeable
                    grp = xxhash.xxh3_64_intdigest(f"{h}:{task}:{n}:{seen[h]}") % groups
                seen[h] += 1
                ids = memoryview(encode(text.as_py() or "") + close)
                tokens = len(ids) // 4
                for start in range(0, tokens, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    for col, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), tokens, grp), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.int32()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return run


def _pack(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        lengths, grp = table.column("length").to_pylist(), table.column("grp")[0].as_py()
        tails = [i for i, n in enumerate(lengths) if n < length]
        spots = first_fit_decreasing([lengths[i] for i in tails], length)
        used = max((s for s, _ in spots), default=-1) + 1
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for i, (s, o) in zip(tails, spots, strict=True):
            sequence[i], offset[i] = s, o
        for i, n in enumerate(lengths):
            if n == length:
                sequence[i], used = used, used + 1
        out = table.drop_columns(["grp"])
        out = out.append_column("sequence_id", pa.array([(grp << 32) + s for s in sequence], pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 1024,
    docs_per_group: int = 2048,
    seed: int = 7_919,
) -> DataFrame:
    """Return doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for every piece.

    A null or empty text is the closing id alone. Rows with a null id and repeated rows are packed like any other
    (equal rows come out as equal pieces at different places). An empty table gives no rows. Other columns of
    ``docs`` are not read. ``sequence_id`` is the group times 2^32 plus the sequence within the group.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1).alias("h"),
    )
    pieces = written(rows.mapInArrow(_pieces(vocabulary, length, groups), PIECES), "pack-pieces")  # the groups of repeated rows are fixed here
    return pieces.groupBy("grp").applyInArrow(_pack(length), PLACED)
