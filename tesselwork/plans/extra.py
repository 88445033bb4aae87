"""The rest of the catalogue: grouping, growth, thresholds, building graphs, cascades, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselwork.functions.text import compact_feet
from tesselwork.operators import evidence, graph, select, sequence
from tesselwork.plans.catalog import TOUCHING, boxes, query, resolve_sql, seeds_sql, touching
from tesselwork.sources.tables import table


@query(f"WITH RECURSIVE {seeds_sql(TOUCHING)} SELECT id, seed FROM walk WHERE id IS NOT NULL")
def seeded_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes grouped around the largest that they touch first; tests hold it against the plain loop."""
    matches = touching(spark, folder).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return select.seeded_groups(boxes(spark, folder), matches, "id", "size")


@query(
    f"WITH RECURSIVE {TOUCHING}, e AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), s AS (SELECT DISTINCT a AS node FROM e WHERE a % 7 = 0), "
    "r AS (SELECT node, node AS label, 0 AS d FROM s UNION SELECT e.b, r.label, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < 12) SELECT node, min({'d': d, 'l': label}).d::INTEGER AS distance, min({'d': d, 'l': label}).l AS label FROM r GROUP BY node HAVING min(d) <= 12"
)
def nearest_label(spark: SparkSession, folder: str) -> DataFrame:
    e = touching(spark, folder).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    starts = e.select(F.explode(F.array("a", "b")).alias("node")).where("node % 7 = 0").distinct().withColumn("label", F.col("node"))
    return graph.nearest_source(e, starts).where("distance <= 12").select("node", "distance", "label")


@query(
    "WITH n AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, sum(n) OVER u AS w, sum(n * p_size) OVER u AS m, sum(n) OVER (PARTITION BY p_type) AS wa, sum(n * p_size) OVER (PARTITION BY p_type) AS ma FROM n WINDOW u AS (PARTITION BY p_type ORDER BY p_size ROWS UNBOUNDED PRECEDING)), "
    "b AS (SELECT p_type, p_size, round_even((m * wa - ma * w)::DOUBLE * (m * wa - ma * w) / (w * (wa - w)), 6) AS v FROM s WHERE w < wa) SELECT p_type, min(p_size) AS threshold FROM b WHERE v = (SELECT max(v) FROM b z WHERE z.p_type = b.p_type) GROUP BY p_type"
)
def otsu_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.otsu(table(spark, folder, "part"), "p_type", "p_size")


@query(
    "WITH l AS (SELECT user_id, event_id, value, lead(value, 1) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, min(event_id) AS at FROM l WHERE abs(a - value) < 0.5::DOUBLE * value AND abs(b - a) < 0.5::DOUBLE * a GROUP BY user_id"
)
def first_plateau(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.first_plateau(table(spark, folder, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.5)


@query(
    "WITH d AS (SELECT p_partkey, (p_partkey * 13 % 1400 + 20)::VARCHAR AS t FROM part), c AS (SELECT p_partkey, left(t, length(t) - 2) AS f2, right(t, 2) AS i2, left(t, length(t) - 1) AS f1, right(t, 1) AS i1 FROM d), "
    "v AS (SELECT p_partkey, coalesce(TRY_CAST(f2 AS INTEGER) BETWEEN 3 AND 30 AND i2::INTEGER <= 11, false) AS two, f1::INTEGER BETWEEN 3 AND 30 AS one, TRY_CAST(f2 AS INTEGER) AS f2, i2::INTEGER AS i2, f1::INTEGER AS f1, i1::INTEGER AS i1 FROM c) "
    "SELECT p_partkey, CASE WHEN two THEN f2 WHEN one THEN f1 END AS feet, CASE WHEN two THEN i2 WHEN one THEN i1 END AS inches FROM v"
)
def compact_inches(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(k, compact_feet((k * 13 % 1400 + 20).cast("string")).alias("s"))
    return rows.select("p_partkey", "s.feet", "s.inches")


@query(
    "WITH e AS (SELECT c_nationkey AS u, s_nationkey AS v, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'N') "
    "SELECT least(u, v) AS a, greatest(u, v) AS b, kind, count(*) AS n FROM e WHERE u <> v GROUP BY ALL"
)
def space_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected edges between containers by kind, one kind left out."""
    t = lambda n: table(spark, folder, n)
    e = t("lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("kind"))
    e = e.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("u")), "o_custkey")
    e = e.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("v")), "l_suppkey").where("u <> v")
    return e.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH g AS (SELECT o_custkey, count(*) AS labels, max(o_totalprice) AS area, bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS open, sum((o_orderstatus = 'P')::INTEGER) AS sized FROM orders GROUP BY o_custkey) "
    "SELECT o_custkey, CASE WHEN labels = 1 AND area BETWEEN 100000 AND 400000 THEN 'wall-region' WHEN labels > 1 AND open THEN 'open-plan-shared' WHEN sized > 2 THEN 'snapped-box' WHEN labels > 1 THEN 'merged-space' WHEN sized > 0 THEN 'rays' END AS method, "
    "CASE WHEN sized > 2 THEN 'printed' WHEN area > 300000 THEN 'scale' ELSE 'pixels' END AS area_source FROM g"
)
def boundary_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The first method that a group's evidence allows."""
    g = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("labels"), F.max("o_totalprice").alias("area"), F.bool_and(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).alias("open"),
        F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("sized"),
    )
    labels, sized, area = F.col("labels"), F.col("sized"), F.col("area")
    method = (
        F.when((labels == 1) & area.between(100_000, 400_000), "wall-region").when((labels > 1) & F.col("open"), "open-plan-shared").when(sized > 2, "snapped-box")
        .when(labels > 1, "merged-space").when(sized > 0, "rays")
    )
    return g.select("o_custkey", method.alias("method"), F.when(sized > 2, "printed").when(area > 300_000, "scale").otherwise("pixels").alias("area_source"))


@query(
    "WITH p AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment AS path, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS path, c_acctbal FROM p) "
    "SELECT path, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM x GROUP BY path"
)
def nested_path_sums(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    p = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = F.array(F.col("r_name"), F.concat_ws("/", "r_name", "n_name"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment"))
    return p.select(F.explode(paths).alias("path"), "c_acctbal").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT l_suppkey, sha256(string_agg(l_orderkey || ':' || l_partkey || ':' || l_linenumber, ';' ORDER BY l_orderkey, l_partkey, l_linenumber)) AS digest FROM lineitem GROUP BY l_suppkey")
def frozen_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One digest for each group's rows in canonical order."""
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_partkey", "l_linenumber")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_orderkey"], r["l_partkey"], r["l_linenumber"])), ";")
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sha2(text, 256).alias("digest"))


@query(
    "WITH t AS (SELECT p_partkey AS id, 2.0::DOUBLE AS f, p_size AS len, p_size * 3 AS area, p_retailprice AS price FROM part) SELECT id, round(len / f, 6) AS length, round(area / (f * f), 6) AS area, price FROM t"
)
def rescale_by_meaning(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths go by the factor, areas by its square, other numbers stay: by the tags of the columns."""
    meaning = {"length": 1, "area": 2, "price": 0}
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("length"), (F.col("p_size") * 3).alias("area"), F.col("p_retailprice").alias("price"))
    return rows.select("id", *[F.round(F.col(c) / F.lit(2.0**power), 6).alias(c) if power else F.col(c) for c, power in meaning.items()])


@query(
    "WITH w AS (SELECT o_custkey % 300 AS line, o_orderkey AS x, CASE WHEN o_orderkey % 3 = 1 THEN 'x' ELSE 'n' END AS kind FROM orders), n AS (SELECT *, lag(kind) OVER v AS pk, lag(x) OVER v AS px, lead(kind) OVER v AS nk, lead(x) OVER v AS nx FROM w WINDOW v AS (PARTITION BY line ORDER BY x)) "
    "SELECT line, px AS first_x, nx AS second_x FROM n WHERE kind = 'x' AND pk = 'n' AND nk = 'n' AND x - px <= 900 AND nx - x <= 900"
)
def dimension_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A sign between two numbers of one line joins its neighbours where both are near."""
    line = Window.partitionBy("line").orderBy("x")
    w = table(spark, folder, "orders").select((F.col("o_custkey") % 300).alias("line"), F.col("o_orderkey").alias("x"), F.when(F.col("o_orderkey") % 3 == 1, "x").otherwise("n").alias("kind"))
    near = w.withColumns({"pk": F.lag("kind").over(line), "px": F.lag("x").over(line), "nk": F.lead("kind").over(line), "nx": F.lead("x").over(line)})
    return near.where("kind = 'x' AND pk = 'n' AND nk = 'n' AND x - px <= 900 AND nx - x <= 900").select("line", F.col("px").alias("first_x"), F.col("nx").alias("second_x"))


_SUBSETS = ("0", "0, 1", "0, 1, 2, 3")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {resolve_sql(p)} SELECT {p.count(',') + 1} AS passes, count(*) AS places, sum((reason <> 'rejected')::INTEGER)::BIGINT AS accepted FROM resolved)" for p in _SUBSETS))
def subset_of_passes(spark: SparkSession, folder: str) -> DataFrame:
    """How many places still resolve to a known reading when only some passes are read."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("place"), F.col("event_type").alias("reading"), (F.dayofmonth("ts") % 4).alias("variant"), ((F.col("event_id") * 7919) % 100).alias("conf"))
    out = None
    for passes in ([0], [0, 1], [0, 1, 2, 3]):
        found = evidence.resolve(e.where(F.col("variant").isin(passes)), "place", "reading", "variant", "conf", ["click", "view"])
        n = found.agg(F.lit(len(passes)).alias("passes"), F.count(F.lit(1)).alias("places"), F.sum((F.col("reason") != "rejected").cast("long")).alias("accepted"))
        out = n if out is None else out.unionByName(n)
    return out
