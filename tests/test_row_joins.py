"""Joins with tables of rows: Spark's estimate is the compressed file, so no plan may broadcast them by it."""

from compare import FOLDER

from tesselwork.operators import graph, select
from tesselwork.plans import catalog, layout  # noqa: F401


def broadcast(df) -> list[str]:
    """Subtrees of a plan that are broadcast, each up to the next join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            part = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i] or "Join" in lines[j]:
                    break
                part.append(lines[j].strip())
            out.append("\n".join(part))
    return out


def test_networks_are_not_broadcast_to_their_pairs(spark):
    assert [x for x in broadcast(catalog.QUERIES["buildings"](spark, FOLDER)) if "Aggregate" not in x] == []


def rounds(monkeypatch, module) -> dict[str, list[str]]:
    """What is broadcast in the plans of the tables that a module's rounds write, by their tag."""
    seen, write = {}, module.written
    monkeypatch.setattr(module, "written", lambda df, tag: (seen.setdefault(tag, []).extend(broadcast(df)), write(df, tag))[1])
    return seen


def pairs(spark, n=300_000):
    """Edges 2i, 2i + 1: each half of their nodes is more than a broadcast should hold, though its files are small."""
    return spark.range(n).selectExpr("2 * id AS a", "2 * id + 1 AS b")


def test_rounds_of_reachable_broadcast_no_large_table(spark, monkeypatch):
    seen = rounds(monkeypatch, graph)
    edges = pairs(spark)
    out = graph.reachable(edges, edges.selectExpr("a AS node"))
    assert seen["reach-front"] == []
    assert {tuple(r) for r in out.groupBy("distance").count().collect()} == {(0, 300_000), (1, 300_000)}


def test_rounds_of_seeded_groups_broadcast_no_large_table(spark, monkeypatch):
    seen = rounds(monkeypatch, select)
    edges = pairs(spark)
    items = spark.range(600_000).selectExpr("id", "id % 2 AS size")
    out = select.seeded_groups(items, edges, "id", "size")
    assert [seen[t] for t in ("nms-pairs", "nms-won", "nms-open", "seeds")] == [[], [], [], []]
    assert broadcast(out) == []
    assert out.where("seed <> id - id % 2 + 1").isEmpty() and out.count() == 600_000
