"""Plans of a mix: tiny sources beside huge ones, and apportionment by bisection against awards one by one."""

import random

import pytest

from tesselwork.llm.mixing import apportioned, awards, mix_sources, plan, plan_table, repeated_rows


def test_tiny_sources_beside_a_huge_one_get_their_targets():
    sizes = [5_000_000_000, 200, 6_000, 3]
    for p in plan(sizes, [5, 2, 1, 1], 3, 8, 65_536, 1):
        taken = p["edges"][-1] - p["edges"][0]
        assert taken <= 3 * p["size"] and taken == pytest.approx(p["target"], rel=1 / 32)
        assert taken == p["block"] * sum(p["quota"])


def test_apportionment_equals_awards():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 9)
        wanted = [rng.choice([0, 1, 3, 3, 7.5, rng.random() * 50]) for _ in range(n)]
        limits = [rng.choice([0, 1, 5, 40]) for _ in range(n)]
        order = awards(wanted, limits, 10**6)
        for seats in {0, 1, len(order) // 3, len(order) // 2, len(order), len(order) + 5}:
            assert apportioned(wanted, limits, seats).tolist() == [order[:seats].count(i) for i in range(n)]


def test_plan_equals_awards_dealt_to_shards():
    sizes, weights, shards = [40_000, 900, 0, 12_345], [5, 2, 1, 5], 7
    made = plan(sizes, weights, 3, shards, 512, 1)
    order = awards([p["target"] for p in made], [3 * s // made[0]["block"] for s in sizes], sum(sizes) // made[0]["block"])
    for i, p in enumerate(made):
        assert p["quota"] == [sum(k == i and t * shards // len(order) == j for t, k in enumerate(order)) for j in range(shards)]


def test_plan_on_a_table_equals_the_plan_on_the_driver(spark):
    rng = random.Random(5)
    for sizes in ([40_000, 900, 0, 12_345, 900, 900, 900], [rng.choice([0, 7, 7, 50, rng.randint(1, 5000)]) for _ in range(60)], [3], [0, 0]):
        names = [f"s{i:03}" for i in range(len(sizes) - 1)] + [None]
        made = plan(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3, 8, 512, 1)
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, words long").repartition(3)
        got = {r.source: r for r in plan_table(frame, (5, 2, 1), 3, 8, 512, 1).collect()}
        for name, p in zip(names, made, strict=True):
            r = got[name]
            assert r.source_size == p["size"] and r.target == pytest.approx(p["target"])
            assert [y - x for x, y in zip(r.edges, r.edges[1:])] == [p["block"] * q for q in p["quota"]]


def test_more_sources_than_the_driver_plans(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randint(1, 60)), None if i % 97 == 0 else f"host{i % 150}") for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    by = {}
    for r in mix_sources(frame, most_on_driver=10).collect():
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(by) == 151 and all(abs(taken - target) <= target / 16 + 1 for target, taken in by.values())


def test_rows_of_the_mix_with_clashing_columns(spark):
    docs = [(1, "a b c", "x", 5, 6, 7), (1, "other words for one id", "x", 5, 6, 7), (2, "a b c", None, 5, 6, 7), (3, None, "x", 5, 6, 7), (None, "no id", "y", 5, 6, 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, mix_id int, mix_times int, h int")
    out = repeated_rows(frame)
    assert out.columns == frame.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(docs) and all(got.count(r) <= 3 for r in docs) and got.count(docs[3]) == 0
    assert repeated_rows(frame.limit(0)).collect() == []
