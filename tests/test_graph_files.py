"""Rounds of components write as many files as their edges need, whatever the number of shuffle partitions."""

from pathlib import Path

from tesselwork.operators import graph


def test_a_round_of_few_edges_is_few_files(spark, monkeypatch):
    files, kept = {}, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    write = graph.written

    def counted(df, tag):
        out = write(df, tag)
        files.setdefault(tag, []).append(len(list(Path(out._scratch.removeprefix("file://")).glob("part-*"))))
        return out

    monkeypatch.setattr(graph, "written", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(400).selectExpr("id AS a", "CASE WHEN id % 100 < 99 THEN id + 1 ELSE id END AS b")
        got = {r.node: r.component for r in graph.components(edges).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {n: n // 100 * 100 for n in range(400)}
    assert max(files["large-star"] + files["small-star"]) <= spark.sparkContext.defaultParallelism
