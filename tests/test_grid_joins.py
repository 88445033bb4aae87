"""Rows of cells are many more than Spark estimates, so no plan may send them to the driver for a broadcast."""

import re

import pytest
from compare import FOLDER

from tesselwork.plans import catalog, drawing, extra, layout, more, rules  # noqa: F401

#: Queries on grids; those that run rounds over written tables are looked at by the pairs that they begin with.
GRIDS = {
    "connect_ends": catalog.QUERIES["connect_ends"],
    "buildings": catalog.QUERIES["buildings"],
    "first_container": catalog.QUERIES["first_container"],
    "label_to_space": catalog.QUERIES["label_to_space"],
    "reachable": catalog.touching,
    "seeded_grouping": catalog.touching,
    "label_point_votes": catalog.QUERIES["label_point_votes"],
    "point_recovery": catalog.QUERIES["point_recovery"],
    "point_in_polygon": catalog.QUERIES["point_in_polygon"],
}


def broadcast_cells(df) -> list[str]:
    """Lines of a plan where what is broadcast was exploded, with no join between."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [m.start() if (m := re.search("[A-Za-z]", x)) else 0 for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i] or "Join" in lines[j]:
                    break
                if "Generate explode" in lines[j]:
                    out.append(line.strip())
                    break
    return out


@pytest.mark.parametrize("name", sorted(GRIDS))
def test_cells_are_not_broadcast(spark, name):
    df = GRIDS[name](spark, FOLDER)
    assert "Generate explode" in df._jdf.queryExecution().executedPlan().toString()
    assert broadcast_cells(df) == []
