"""Generated floor plans with exact truth, as a Spark data source: ``spark.read.format("tesselwork_plans")``.

Options: seeds (how many plans), width, height, rooms (the least side of a room), partitions. Each seed is split by
random cuts into rectangular rooms that fill the plan. One row is one run of a room's cells: plan, y, x0, x1, label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def rooms(seed: int, width: int, height: int, least: int) -> list[tuple[int, int, int, int]]:
    """Rectangles x, y, w, h that tile the plan."""
    draw, open_, done = random.Random(seed), [(0, 0, width, height)], []
    while open_:
        x, y, w, h = open_.pop()
        if max(w, h) < 2 * least or (max(w, h) < 4 * least and draw.random() < 0.3):
            done.append((x, y, w, h))
        elif w >= h:
            cut = draw.randint(least, w - least)
            open_ += [(x, y, cut, h), (x + cut, y, w - cut, h)]
        else:
            cut = draw.randint(least, h - least)
            open_ += [(x, y, w, cut), (x, y + cut, w, h - cut)]
    return sorted(done)


class Seeds(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlanReader(DataSourceReader):
    def __init__(self, options: dict):
        number = lambda k, d: int(options.get(k, d))
        self.seeds, self.width, self.height, self.least, self.parts = number("seeds", 10), number("width", 120), number("height", 80), number("rooms", 12), number("partitions", 8)

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.seeds // self.parts))
        return [Seeds(a, min(self.seeds, a + step)) for a in range(0, self.seeds, step)]

    def read(self, partition: Seeds) -> Iterator[tuple]:
        for seed in range(partition.first, partition.last):
            for label, (x, y, w, h) in enumerate(rooms(seed, self.width, self.height, self.least), 1):
                for row in range(y, y + h):
                    yield seed, row, x, x + w, label


class PlanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tesselwork_plans"

    def schema(self) -> str:
        return "plan int, y int, x0 int, x1 int, label int"

    def reader(self, schema) -> DataSourceReader:
        return PlanReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlanSource)
