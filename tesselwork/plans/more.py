"""More queries of the library's own operators: regions, graphs, zones, consensus, texts, documents, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselwork.functions import geometry
from tesselwork.functions.numeric import ratio
from tesselwork.operators import graph, regions, sequence, spatial
from tesselwork.plans.catalog import INTERVALS, RUNS, TOUCHING, intervals, query, runs, touching
from tesselwork.sources import files, plans
from tesselwork.sources.tables import table

# --- run-length rows: a row of cells is a supplier's line, a label the order's last digit


def cells(spark: SparkSession, folder: str, status: str) -> DataFrame:
    """Non-overlapping runs (y, x0, x1, label) of one status: intervals cut at the next one's start."""
    rows = intervals(spark, folder).where(F.col("l_linestatus") == status).groupBy(F.col("l_suppkey").alias("y"), F.col("low").alias("x0")).agg(F.max("high").alias("high"), F.min("l_orderkey").alias("o"))
    end = F.least("high", F.coalesce(F.lead("x0").over(Window.partitionBy("y").orderBy("x0")), F.col("high")))
    return rows.select((F.col("y") % 10).cast("int").alias("plan"), "y", "x0", end.alias("x1"), (F.col("o") % 5).cast("int").alias("label"))


def cells_sql(name: str, status: str) -> str:
    return (
        f"{name}_g AS (SELECT l_suppkey AS y, low AS x0, max(high) AS high, min(l_orderkey) AS o FROM intervals WHERE l_linestatus = '{status}' GROUP BY ALL), "
        f"{name} AS (SELECT (y % 10)::INTEGER AS plan, y, x0, least(high, coalesce(lead(x0) OVER (PARTITION BY y ORDER BY x0), high)) AS x1, (o % 5)::INTEGER AS label FROM {name}_g)"
    )


CELLS = f"{INTERVALS}, {cells_sql('p', 'O')}, {cells_sql('t', 'F')}"
COMMON = (
    f"{CELLS}, pa AS (SELECT plan, label AS found, sum(x1 - x0)::BIGINT AS found_area FROM p GROUP BY ALL), ta AS (SELECT plan, label AS truth, sum(x1 - x0)::BIGINT AS truth_area FROM t GROUP BY ALL), "
    "m AS (SELECT p.plan, p.label AS found, t.label AS truth, sum(least(p.x1, t.x1) - greatest(p.x0, t.x0))::BIGINT AS common FROM p JOIN t ON p.plan = t.plan AND p.y = t.y AND p.x0 < t.x1 AND t.x0 < p.x1 GROUP BY ALL), "
    "common AS (SELECT * FROM m JOIN pa USING (plan, found) JOIN ta USING (plan, truth))"
)


@query(f"WITH {COMMON} SELECT plan, found, truth, common, found_area, truth_area FROM common")
def region_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return regions.overlaps(cells(spark, folder, "O"), cells(spark, folder, "F"), ["plan"])


@query(
    f"WITH {COMMON}, b AS (SELECT *, common / (found_area + truth_area - common) AS iou, common * 5 >= truth_area AS part, common * 10 >= truth_area * 3 AS held FROM common), "
    "h AS (SELECT *, sum(held::INTEGER) OVER (PARTITION BY plan, found) AS holds FROM b) "
    "SELECT plan, truth, round_even(max(iou), 6) AS iou, max(iou) >= 0.7 AS found, sum(part::INTEGER) >= 2 AS split, bool_or(held AND holds >= 2) AS merged FROM h GROUP BY plan, truth"
)
def region_status(spark: SparkSession, folder: str) -> DataFrame:
    return regions.region_status(region_overlaps(spark, folder), ["plan"])


@query(f"WITH {CELLS} SELECT plan, y, x1 AS gap_from, nx AS gap_to FROM (SELECT *, lead(x0) OVER (PARTITION BY plan, y ORDER BY x0) AS nx FROM p) WHERE nx > x1")
def row_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return regions.row_gaps(cells(spark, folder, "O"), ["plan"])


@query(f"WITH {CELLS} SELECT label, count(*) AS runs, sum(x1 - x0)::BIGINT AS cells FROM p WHERE x1 - x0 >= 5 GROUP BY label")
def run_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return regions.long_runs(cells(spark, folder, "O"), 5).groupBy("label").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("x1") - F.col("x0")).alias("cells"))


@query(
    f"WITH {CELLS}, r AS (SELECT 0 AS plan, y, x0, x1, label FROM p), s AS (SELECT least(label, nl) AS a, greatest(label, nl) AS b, 1 AS n FROM (SELECT *, lead(label) OVER w AS nl, lead(x0) OVER w AS nx FROM r WINDOW w AS (PARTITION BY y ORDER BY x0)) WHERE nx = x1 AND nl <> label "
    "UNION ALL SELECT least(d.label, u.label), greatest(d.label, u.label), least(d.x1, u.x1) - greatest(d.x0, u.x0) FROM r d JOIN r u ON d.y = u.y + 1 AND u.x0 < d.x1 AND d.x0 < u.x1 AND u.label <> d.label) "
    "SELECT 0 AS plan, a, b, sum(n)::BIGINT AS length FROM s GROUP BY a, b"
)
def zone_borders(spark: SparkSession, folder: str) -> DataFrame:
    return regions.borders(cells(spark, folder, "O").withColumn("plan", F.lit(0)), ["plan"])


@query()
def generated_rooms(spark: SparkSession, folder: str) -> DataFrame:
    """Components of equal labels over generated plans: one row of plan, label, cells and components each."""
    plans.register(spark)
    rows = spark.read.format("tesselwork_plans").option("seeds", 12).load()
    rows = rows.withColumn("id", (F.col("plan").cast("long") * 1000 + F.col("y")) * 1000 + F.col("x0"))
    touch = regions.touching_runs(rows, ["plan"]).where("label = above_label").select(F.col("id").alias("a"), F.col("above").alias("b"))
    parts = graph.components(touch).select(F.col("node").alias("id"), "component")
    return rows.join(parts, "id", "left").groupBy("plan", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("cells"), F.countDistinct(F.coalesce("component", "id")).alias("components"))


@query()
def generated_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms of generated plans that share a wall, and its length."""
    plans.register(spark)
    return regions.borders(spark.read.format("tesselwork_plans").option("seeds", 12).load(), ["plan"])


# --- graphs


@query(
    f"WITH RECURSIVE {TOUCHING}, e AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), s AS (SELECT DISTINCT a AS node FROM e WHERE a % 10 = 0), "
    "r AS (SELECT node, 0 AS d FROM s UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < (SELECT count(DISTINCT a) FROM e)) SELECT node, min(d)::INTEGER AS distance FROM r GROUP BY node"
)
def reachable(spark: SparkSession, folder: str) -> DataFrame:
    e = touching(spark, folder).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    start = e.select(F.explode(F.array("a", "b")).alias("node")).where("node % 10 = 0")
    return graph.reachable(e, start)


@query(
    f"WITH RECURSIVE {TOUCHING}, r AS (SELECT left_id AS a, right_id AS b, 0 AS turn FROM pairs UNION ALL SELECT a, b, turn + 1 FROM (SELECT r.a, r.b, r.turn, (SELECT list(n) FROM (SELECT n FROM (SELECT a AS n FROM r UNION ALL SELECT b FROM r) GROUP BY n HAVING count(*) = 1)) AS loose FROM r) "
    "WHERE len(loose) > 0 AND NOT list_contains(loose, a) AND NOT list_contains(loose, b)), z AS (SELECT a, b FROM r WHERE turn = (SELECT max(turn) FROM r)), n AS (SELECT n FROM (SELECT a AS n FROM z UNION ALL SELECT b FROM z) GROUP BY n HAVING count(*) = 1) "
    "SELECT a, b FROM z WHERE NOT EXISTS (SELECT 1 FROM n)"
)
def prune_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    e = touching(spark, folder).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return graph.prune_ends(e)


@query(
    "WITH RECURSIVE w AS (SELECT p_partkey AS k, p_partkey % 10 AS c, p_partkey // 10 AS r FROM part), e AS (SELECT DISTINCT ax, ay, bx, by_ FROM (SELECT k, c AS ax, r AS ay, c + 1 AS bx, r AS by_ FROM w UNION ALL SELECT k, c, r, c, r + 1 FROM w) WHERE (k * 7 + bx) % 5 > 0), "
    "h AS (SELECT ax, ay, bx, by_ FROM e UNION SELECT bx, by_, ax, ay FROM e), s AS (SELECT *, concat_ws(',', ax, ay, bx, by_) AS id, concat_ws(',', bx, by_, ax, ay) AS back, atan2(by_ - ay, bx - ax) AS angle FROM h), "
    "t AS (SELECT back AS id, coalesce(lag(id) OVER (PARTITION BY ax, ay ORDER BY angle), last_value(id) OVER (PARTITION BY ax, ay ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM s), "
    "walk AS (SELECT id AS origin, id AS spot, after FROM t UNION ALL SELECT walk.origin, t.id, t.after FROM walk JOIN t ON t.id = walk.after WHERE walk.after <> walk.origin), f AS (SELECT origin, min(spot) AS face FROM walk GROUP BY origin) "
    "SELECT face, count(*) AS sides, sum((ax * by_ - bx * ay) / 2.0::DOUBLE) AS area FROM f JOIN s ON s.id = f.origin GROUP BY face"
)
def planar_faces(spark: SparkSession, folder: str) -> DataFrame:
    """Faces of a brick-like drawing laid out by part keys: ten columns of cells, some walls left out."""
    k = F.col("p_partkey")
    c, r = k % 10, F.floor(k / 10)
    p = table(spark, folder, "part")
    side = lambda x0, y0, x1, y1: F.struct(*[v.cast("long").alias(n) for v, n in ((x0, "ax"), (y0, "ay"), (x1, "bx"), (y1, "by"))])
    walls = p.select(k, F.explode(F.array(side(c, r, c + 1, r), side(c, r, c, r + 1))).alias("e")).where((k * 7 + F.col("e.bx")) % 5 > 0)
    return graph.planar_faces(walls.select("e.*"))


@query(
    f"WITH RECURSIVE {TOUCHING}, e AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), "
    "c AS (SELECT node, min(root) AS component FROM r GROUP BY node), n AS (SELECT component, count(*) AS size, string_agg(node::VARCHAR, '+' ORDER BY node) AS name FROM c GROUP BY component) SELECT component, size, name FROM n WHERE 20 * size >= (SELECT max(size) FROM n)"
)
def merged_spaces(spark: SparkSession, folder: str) -> DataFrame:
    """Components as spaces joined by '+', without those under a twentieth of the largest."""
    parts = graph.components(touching(spark, folder), "left_id", "right_id")
    name = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda n: n.cast("string")), "+")
    n = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"), name.alias("name"))
    most = n.agg(F.max("size").alias("most"))  # one row
    return n.join(F.broadcast(most), F.lit(True)).where("20 * size >= most").drop("most")


@query(
    f"WITH {TOUCHING}, d AS (SELECT n, count(*) AS degree FROM (SELECT left_id AS n FROM pairs UNION ALL SELECT right_id FROM pairs) GROUP BY n) SELECT p_partkey FROM part LEFT JOIN d ON n = p_partkey WHERE NOT (coalesce(degree, 0) = 1 AND p_size % 2 = 0)"
)
def loose_ends_removed(spark: SparkSession, folder: str) -> DataFrame:
    e = touching(spark, folder)
    ends = e.select(F.explode(F.array("left_id", "right_id")).alias("p_partkey")).groupBy("p_partkey").count().where("count = 1")
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    return p.join(ends.join(p.where("p_size % 2 = 0"), "p_partkey"), "p_partkey", "left_anti").select("p_partkey")


@query(
    "WITH p AS (SELECT p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), s AS (SELECT *, CASE WHEN c - lag(c) OVER w <= 120 THEN 0 ELSE 1 END AS n FROM p WINDOW w AS (PARTITION BY p_size ORDER BY c)), "
    "k AS (SELECT *, sum(n) OVER (PARTITION BY p_size ORDER BY c ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT p_size, min(c) AS low, max(c) AS high, count(*) AS n FROM k GROUP BY p_size, k"
)
def single_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters whose neighbours lie within a gap: on a line, a break is a wider step."""
    line = Window.partitionBy("p_size").orderBy("c")
    p = table(spark, folder, "part").select("p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    new = p.withColumn("new", F.when(F.col("c") - F.lag("c").over(line) <= 120, 0).otherwise(1)).withColumn("k", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy("p_size", "k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).drop("k")


# --- votes, zones, consensus


@query(
    "WITH s AS (SELECT o_orderkey % 200 AS opening, o_orderkey % 2 AS side, o_custkey % 4 AS space, min(o_orderkey) AS pos, count(*) AS n FROM orders GROUP BY ALL), "
    "v AS (SELECT opening, side, arg_max(space, n * 1000000000 - pos) AS space FROM s WHERE space > 0 GROUP BY opening, side), w AS (SELECT opening, max(space) FILTER (side = 0) AS a, max(space) FILTER (side = 1) AS b FROM v GROUP BY opening) "
    "SELECT opening, a, b, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a = b THEN 'same_space' WHEN a = 3 OR b = 3 THEN 'room_to_exterior' ELSE 'between_rooms' END AS relation FROM w"
)
def side_relation(spark: SparkSession, folder: str) -> DataFrame:
    """Samples on both sides of an opening vote for a space; the two winners give its relation. Space 3 is outside."""
    o = F.col("o_orderkey")
    votes = table(spark, folder, "orders").groupBy((o % 200).alias("opening"), (o % 2).alias("side"), (F.col("o_custkey") % 4).alias("space")).agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("pos"))
    best = votes.where("space > 0").groupBy("opening", "side").agg(F.max_by("space", F.struct("n", -F.col("pos"))).alias("space"))
    both = best.groupBy("opening").agg(F.max(F.when(F.col("side") == 0, F.col("space"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("space"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    relation = F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same_space").when((a == 3) | (b == 3), "room_to_exterior").otherwise("between_rooms")
    return both.select("opening", "a", "b", relation.alias("relation"))


@query(
    "WITH i AS (SELECT user_id AS space, event_type AS kind, CASE WHEN event_type IN ('click', 'view') THEN 'look' WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS function, value AS w FROM events WHERE value >= 0.3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY space, function, kind ORDER BY w DESC) AS nth FROM i), s AS (SELECT space, function, sum(CASE nth WHEN 1 THEN w WHEN 2 THEN 0.3::DOUBLE * w WHEN 3 THEN 0.3::DOUBLE * w ELSE 0 END) AS support, count(*) AS items, max(w) AS heaviest FROM r GROUP BY space, function) "
    "SELECT space, function, round(support, 4) AS support, items, round(1 - exp(-support / 100), 6) AS confidence, count(*) OVER (PARTITION BY space) >= 2 AS zoned FROM s WHERE support >= 1 AND (items >= 2 OR heaviest >= 8)"
)
def infer_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted items of a space support functions with diminishing returns; two accepted functions make zones."""
    kind = F.col("event_type")
    function = F.when(kind.isin("click", "view"), "look").when(kind == "purchase", "buy").otherwise("other")
    items = table(spark, folder, "events").where("value >= 0.3").select(F.col("user_id").alias("space"), kind.alias("kind"), function.alias("function"), F.col("value").alias("w"))
    ranked = items.withColumn("nth", F.row_number().over(Window.partitionBy("space", "function", "kind").orderBy(F.desc("w"))))
    part = F.when(F.col("nth") == 1, F.col("w")).when(F.col("nth") <= 3, 0.3 * F.col("w")).otherwise(0.0)
    by = ranked.groupBy("space", "function").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("items"), F.max("w").alias("heaviest"))
    taken = by.where("s >= 1 AND (items >= 2 OR heaviest >= 8)")
    zoned = F.count(F.lit(1)).over(Window.partitionBy("space")) >= 2
    return taken.select("space", "function", F.round("s", 4).alias("support"), "items", F.round(1 - F.exp(-F.col("s") / 100), 6).alias("confidence"), zoned.alias("zoned"))


@query(
    "WITH v AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS v FROM lineitem), a AS (SELECT l_suppkey, median(v) AS m FROM v GROUP BY l_suppkey), d AS (SELECT l_suppkey, any_value(m) AS m, median(abs(v - m)) AS mad FROM v JOIN a USING (l_suppkey) GROUP BY l_suppkey) "
    "SELECT l_suppkey, d.m AS middle, d.mad AS spread, sum((abs(v - d.m) <= 1.5 * d.mad)::INTEGER)::BIGINT AS members, 4 * sum((abs(v - d.m) <= 1.5 * d.mad)::INTEGER) >= 3 * count(*) AS reliable FROM v JOIN d USING (l_suppkey) GROUP BY ALL"
)
def robust_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """The median, the median distance from it, and the members within one and a half of that."""
    v = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("v"))
    m = v.groupBy("l_suppkey").agg(F.median("v").alias("middle"))
    d = v.join(m, "l_suppkey").groupBy("l_suppkey", "middle").agg(F.median(F.abs(F.col("v") - F.col("middle"))).alias("spread"))
    near = (F.abs(F.col("v") - F.col("middle")) <= 1.5 * F.col("spread")).cast("long")
    out = v.join(d, "l_suppkey").groupBy("l_suppkey", "middle", "spread").agg(F.sum(near).alias("members"), F.count(F.lit(1)).alias("n"))
    return out.select("l_suppkey", "middle", "spread", "members", (4 * F.col("members") >= 3 * F.col("n")).alias("reliable"))


@query(
    "WITH a AS (SELECT l_returnflag AS g, ((((l_partkey * 7 + 45) % 90) + 90) % 90) - 45 AS angle, CAST(l_quantity AS BIGINT) AS w FROM lineitem), s AS (SELECT g, angle, sum(w) OVER (PARTITION BY g ORDER BY angle RANGE UNBOUNDED PRECEDING) AS so_far, sum(w) OVER (PARTITION BY g) AS whole, count(*) OVER (PARTITION BY g) AS n FROM a) "
    "SELECT g AS flag, CASE WHEN any_value(n) < 4 THEN 0 ELSE min(angle) FILTER (2 * so_far >= whole) END AS skew FROM s GROUP BY g"
)
def estimate_skew(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted median of directions folded to a right angle; none from fewer than four lines."""
    a = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.pmod(F.col("l_partkey") * 7 + 45, F.lit(90)) - 45).alias("angle"), F.col("l_quantity").cast("long").alias("w"))
    a = a.groupBy("flag", "angle").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("lines"))  # ninety angles of a flag at most
    line, whole = Window.partitionBy("flag").orderBy("angle").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("flag")
    s = a.select("flag", "angle", F.sum("w").over(line).alias("so_far"), F.sum("w").over(whole).alias("whole"), F.sum("lines").over(whole).alias("n"))
    reached = F.min(F.when(2 * F.col("so_far") >= F.col("whole"), F.col("angle")))
    return s.groupBy("flag").agg(F.when(F.first("n") < 4, F.lit(0)).otherwise(reached).alias("skew"))


@query(
    "WITH v AS (SELECT user_id, day(ts) % 3 AS rotation, event_type AS variant, count(*) AS n, sum(greatest(value - 2, 0)) AS over FROM events GROUP BY ALL), s AS (SELECT *, round(over + 12 * sqrt(n), 4) AS score FROM v) "
    "SELECT user_id, variant || ':' || rotation AS variant, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, variant, rotation) AS nth FROM s) WHERE nth = 1"
)
def configuration_score(spark: SparkSession, folder: str) -> DataFrame:
    """The pass of each place with the best score: excess confidence plus twelve times the root of its readings; of
    equal ones the first by name and rotation."""
    e = table(spark, folder, "events")
    v = e.groupBy("user_id", (F.dayofmonth("ts") % 3).alias("rotation"), F.col("event_type").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("value") - 2, F.lit(0.0))).alias("over"))
    s = v.withColumn("score", F.round(F.col("over") + 12 * F.sqrt("n"), 4))
    best = s.groupBy("user_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "variant", "rotation")).alias("b"))
    return best.select("user_id", F.concat_ws(":", "b.variant", "b.rotation").alias("variant"), (-F.col("b.less")).alias("score"))


@query(
    "WITH g AS (SELECT o_custkey % 500 AS space, count(DISTINCT o_orderpriority) AS names, count(*) AS points FROM orders GROUP BY 1) SELECT CASE WHEN points < 5 THEN 'missed' WHEN names > 4 THEN 'merged' WHEN names = 1 THEN 'recovered' ELSE 'separated' END AS status, count(*) AS n FROM g GROUP BY 1"
)
def point_status(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders").groupBy((F.col("o_custkey") % 500).alias("space")).agg(F.countDistinct("o_orderpriority").alias("names"), F.count(F.lit(1)).alias("points"))
    status = F.when(F.col("points") < 5, "missed").when(F.col("names") > 4, "merged").when(F.col("names") == 1, "recovered").otherwise("separated")
    return g.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH t AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag AS truth, sum(n) FILTER (l_linestatus = 'O')::BIGINT AS as_o, sum(n) FILTER (l_linestatus = 'F')::BIGINT AS as_f, round(sum(n) FILTER (l_linestatus = 'F') / sum(n), 6) AS share_f FROM t GROUP BY l_returnflag"
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("truth")).pivot("l_linestatus", ["O", "F"]).count()
    return by.select("truth", F.col("O").alias("as_o"), F.col("F").alias("as_f"), F.round(ratio(F.col("F"), F.coalesce("O", F.lit(0)) + F.coalesce("F", F.lit(0))), 6).alias("share_f"))


# --- texts and documents


@query(
    "SELECT p_partkey, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) || (p_partkey % 10)::VARCHAR AS joined, CASE WHEN p_name LIKE '%ring' THEN trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) || ' ' || (p_partkey % 10)::VARCHAR ELSE trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) || (p_partkey % 10)::VARCHAR END AS spaced, "
    "CASE WHEN p_size % 3 = 0 THEN 'DIMENSION' WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt' THEN 'ROOM_LABEL' ELSE 'OTHER' END AS kind FROM part"
)
def normalise_and_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Text as it reads, a number split from a known word, and what kind of text it is."""
    k, name = F.col("p_partkey"), F.col("p_name")
    clean = F.concat(F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " ")), (k % 10).cast("string"))
    spaced = F.when(F.regexp_extract(clean, r"([A-Z]+)[0-9]+$", 1).isin("RING"), F.regexp_replace(clean, r"([A-Z])([0-9]+)$", "$1 $2")).otherwise(clean)
    printed = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("'6\" x 9'"))).otherwise(name)
    kind = F.when(printed.rlike(r"[0-9]+'\s*[0-9]*\"?\s*x"), "DIMENSION").when(F.exists(F.split(printed, " "), lambda w: w.isin("ring", "bolt")), "ROOM_LABEL").otherwise("OTHER")
    return table(spark, folder, "part").select(k, clean.alias("joined"), spaced.alias("spaced"), kind.alias("kind"))


@query(
    "WITH f AS (SELECT p_partkey, round(p_retailprice % 40 * 12)::BIGINT AS inches FROM part) SELECT p_partkey, (inches // 12)::VARCHAR || '''' || CASE WHEN inches % 12 > 0 THEN (inches % 12)::VARCHAR || '\"' ELSE '' END AS text FROM f"
)
def format_feet(spark: SparkSession, folder: str) -> DataFrame:
    """Feet and inches with the carry at twelve."""
    inches = F.round(F.col("p_retailprice") % 40 * 12).cast("long")
    text = F.concat(F.floor(inches / 12).cast("string"), F.lit("'"), F.when(inches % 12 > 0, F.concat((inches % 12).cast("string"), F.lit('"'))).otherwise(""))
    return table(spark, folder, "part").select("p_partkey", text.alias("text"))


@query(
    "WITH s AS (SELECT o_orderkey, 100 + o_orderkey % 900 AS w, 150 + o_custkey % 1200 AS h, 40 + o_orderkey % 400 AS target FROM orders) "
    "SELECT o_orderkey, floor(least(least(greatest(target, 72), 300), sqrt(25000000.0::DOUBLE / (w / 72 * h / 72))))::BIGINT AS dpi FROM s"
)
def planned_dpi(spark: SparkSession, folder: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(o, files.planned_dpi(100 + o % 900, 150 + c % 1200, 40 + o % 400).cast("long").alias("dpi"))


@query(
    "WITH t AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS a, o_custkey % 12 + 1 AS b FROM orders), x AS (SELECT o_orderkey, list_filter(list_concat([a, 3], CASE WHEN b >= a THEN range(a, b + 1) ELSE [] END), lambda n: n <= 10) AS l FROM t) "
    "SELECT o_orderkey, len(list_distinct(l))::INTEGER AS pages, coalesce(list_sum(list_distinct(l)), 0)::BIGINT AS total FROM x"
)
def page_list(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("o_orderkey") % 9 + 1, F.col("o_custkey") % 12 + 1
    pages = files.page_list(F.concat(a, F.lit(", 3,"), a, F.lit(" - "), b), F.lit(10))
    rows = table(spark, folder, "orders").select("o_orderkey", pages.alias("p"))
    return rows.select("o_orderkey", F.size("p").alias("pages"), F.aggregate("p", F.lit(0).cast("long"), lambda s, n: s + n).alias("total"))


@query(
    "WITH b AS (SELECT p_partkey AS id, p_partkey % 50 AS x, p_size AS h FROM part) SELECT id, n, kind, x0, y0, x1, y1 FROM (SELECT id, 1 AS n, 'line' AS kind, x::DOUBLE AS x0, 0.0::DOUBLE AS y0, (x + 5)::DOUBLE AS x1, 0.0::DOUBLE AS y1 FROM b "
    "UNION ALL SELECT id, 2, 'curve', x + 5, 0, x, h FROM b UNION ALL SELECT id, 3, 'line', x, h, x, 0 FROM b)"
)
def vector_paths(spark: SparkSession, folder: str) -> DataFrame:
    x, h = F.col("p_partkey") % 50, F.col("p_size")
    path = F.concat(F.lit("M"), x, F.lit(" 0 L"), x + 5, F.lit(" 0 C 1 2 3 4 "), x, F.lit(" "), h, F.lit(" Z"))
    return files.path_segments(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), path.alias("path")), "id", "path")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT text, lang FROM documents WHERE doc_id % 2 = 0) c WHERE c.text = d.text AND c.lang = d.lang)")
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose content key (digest of text and parameters) a saved table does not hold: here, the even ids."""
    key = F.sha2(F.concat_ws("\x00", "text", "lang"), 256)
    d = table(spark, folder, "documents").select("doc_id", key.alias("key"))
    return d.join(d.where("doc_id % 2 = 0"), "key", "left_anti").select("doc_id")


@query(
    "SELECT o_orderpriority, o_orderkey, printf('%s%05d', left(o_orderpriority, 1), row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)) AS sequence_id FROM orders"
)
def sequence_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Names by kind and place: W00001, W00002 and so on."""
    placed = sequence.numbered(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 10.0)
    return placed.select("o_orderpriority", "o_orderkey", F.format_string("%s%05d", F.substring("o_orderpriority", 1, 1), F.col("nth")).alias("sequence_id"))


@query(
    "SELECT c_custkey, '{\"id\":' || c_custkey || ',\"place\":{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' || CASE WHEN c_acctbal > 5000 THEN ',\"rich\":true' ELSE '' END || '}' AS doc FROM customer"
)
def json_document(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as documents; keys that do not apply are left out."""
    doc = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"), F.when(F.col("c_acctbal") > 5000, F.lit(True)).alias("rich")))
    return table(spark, folder, "customer").select("c_custkey", doc.alias("doc"))


@query(
    "WITH l AS (SELECT p_type AS layer, CASE WHEN p_size % 2 = 0 THEN 'LINE' ELSE 'LWPOLYLINE' END AS entity, p_size > 3 AS ok FROM part) SELECT layer, entity, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS skipped FROM l GROUP BY ALL"
)
def layer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by layer and type, written ones and those skipped for their size."""
    entity = F.when(F.col("p_size") % 2 == 0, "LINE").otherwise("LWPOLYLINE")
    count = lambda c: F.sum(c.cast("long"))
    return table(spark, folder, "part").groupBy(F.col("p_type").alias("layer"), entity.alias("entity")).agg(count(F.col("p_size") > 3).alias("written"), count(F.col("p_size") <= 3).alias("skipped"))


@query(
    f"WITH {RUNS}, l AS (SELECT user_id, max(n) AS longest, count(*) AS runs, sum(n)::BIGINT AS events FROM runs GROUP BY user_id) SELECT user_id, longest, runs, round(least(1.0, longest / (0.4::DOUBLE * events)), 6) AS support FROM l"
)
def longest_run_support(spark: SparkSession, folder: str) -> DataFrame:
    by = runs(spark, folder).groupBy("user_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"), F.sum("n").alias("events"))
    return by.select("user_id", "longest", "runs", F.round(F.least(F.lit(1.0), F.col("longest") / (0.4 * F.col("events"))), 6).alias("support"))


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders), m AS (SELECT o_custkey, median(o_totalprice) AS m, count(*) AS n FROM o GROUP BY o_custkey) SELECT o_orderkey, CASE WHEN n >= 3 AND o_totalprice > 1.8::DOUBLE * m THEN 'opening' ELSE 'door' END AS kind, CASE WHEN n >= 3 THEN round(m / 82, 4) END AS scale FROM o JOIN m USING (o_custkey)"
)
def wide_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members wider than a multiple of their group's median are re-typed; groups of three or more also give a scale."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    m = o.groupBy("o_custkey").agg(F.median("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    wide = (F.col("n") >= 3) & (F.col("o_totalprice") > 1.8 * F.col("m"))
    return o.join(m, "o_custkey").select("o_orderkey", F.when(wide, "opening").otherwise("door").alias("kind"), F.when(F.col("n") >= 3, F.round(F.col("m") / 82, 4)).alias("scale"))


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, sum((o_orderstatus = 'F')::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hits FROM orders) "
    "SELECT o_orderkey FROM o WHERE nth <= 12 AND NOT (nth > 4 AND coalesce(hits, 0) < (nth - 1) / 4.0)"
)
def reading_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a budget lets through: twelve of a group at most, and after four only while a quarter were hits."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hits = F.coalesce(F.sum((F.col("o_orderstatus") == "F").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, folder, "orders").select("o_orderkey", F.row_number().over(line).alias("nth"), hits.alias("hits"))
    return rows.where((F.col("nth") <= 12) & ~((F.col("nth") > 4) & (F.col("hits") < (F.col("nth") - 1) / 4.0))).select("o_orderkey")


@query(
    "WITH b AS (SELECT o_orderkey, 4000 - o_orderkey % 300 AS w, o_orderkey % 90 + 1 AS bw, o_custkey % 500 AS x, o_orderkey % 400 AS y, (o_orderkey % 4) * 90 AS turn FROM orders) "
    "SELECT o_orderkey, CASE turn WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN w - x - bw ELSE w - y - 10 END AS ox, CASE turn WHEN 0 THEN y WHEN 90 THEN w - x - bw WHEN 180 THEN w - y - 10 ELSE x END AS oy FROM b"
)
def box_to_page(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a turned square page back in the page's own frame."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    w, bw, x, y, turn = 4000 - o % 300, o % 90 + 1, c % 500, o % 400, (o % 4) * 90
    ox = F.when(turn == 0, x).when(turn == 90, y).when(turn == 180, w - x - bw).otherwise(w - y - 10)
    oy = F.when(turn == 0, y).when(turn == 90, w - x - bw).when(turn == 180, w - y - 10).otherwise(x)
    return table(spark, folder, "orders").select(o, ox.alias("ox"), oy.alias("oy"))


@query(
    f"WITH {INTERVALS}, d AS (SELECT DISTINCT l_suppkey, l_linenumber, low, high FROM intervals), e AS (SELECT DISTINCT l_suppkey, l_linenumber, pt FROM (SELECT l_suppkey, l_linenumber, unnest([low, high]) AS pt FROM d)), g AS (SELECT l_suppkey, l_linenumber, pt AS low, lead(pt) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY pt) AS high FROM e) "
    "SELECT g.l_suppkey, g.l_linenumber, g.low, g.high, count(*) AS covers FROM g JOIN d ON d.l_suppkey = g.l_suppkey AND d.l_linenumber = g.l_linenumber AND d.low <= g.low AND d.high >= g.high WHERE g.high IS NOT NULL GROUP BY ALL"
)
def elementary_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines cut at every end point; each piece with the number of intervals over it, as a running sum of ends."""
    d = intervals(spark, folder).select("l_suppkey", "l_linenumber", "low", "high").distinct()
    return sequence.elementary(d, ["l_suppkey", "l_linenumber"], "low", "high")


@query(
    "WITH p AS (SELECT c_custkey, c_acctbal, ntile(1) OVER () AS one, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS nth, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS most FROM customer) SELECT c_custkey, nth::INTEGER AS nth FROM p WHERE nth <= 12 AND c_acctbal >= 0.5::DOUBLE * most"
)
def richest_pens(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve largest of each group that reach half of its largest."""
    by = Window.partitionBy("c_nationkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.row_number().over(by.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("nth"), F.max("c_acctbal").over(by).alias("most"))
    return c.where("nth <= 12 AND c_acctbal >= 0.5D * most").select("c_custkey", "nth")


@query(
    "WITH p AS (SELECT p_partkey, (p_partkey * 37) % 997 AS x, (p_partkey * 91) % 211 AS y FROM part), h AS (SELECT s_suppkey, (s_suppkey * 53) % 997 AS sx, (s_suppkey * 17) % 211 AS sy FROM supplier) "
    "SELECT p_partkey, s_suppkey FROM p JOIN h ON abs(x - sx) <= 12 AND abs(y - sy) <= 12 AND (x - sx) ** 2 + (y - sy) ** 2 <= 144"
)
def distance_band(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of points within a distance, by a grid of that distance."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    one = F.lit(0).cast("long")
    p = table(spark, folder, "part").select(k.alias("id"), ((k * 37) % 997).alias("x"), ((k * 91) % 211).alias("y"), one.alias("w"), one.alias("h"))
    h = table(spark, folder, "supplier").select(s.alias("id"), ((s * 53) % 997).alias("x"), ((s * 17) % 211).alias("y"), one.alias("w"), one.alias("h"))
    d = lambda c: (F.col(f"l.{c}") - F.col(f"r.{c}")) * (F.col(f"l.{c}") - F.col(f"r.{c}"))
    return spatial.grid_join(p, h, d("x") + d("y") <= 144, 12, "id", "id", grow=12).select(F.col("left_id").alias("p_partkey"), F.col("right_id").alias("s_suppkey"))


@query(
    "WITH s AS (SELECT s_suppkey, (s_suppkey * 17) % 300 AS x0, (s_suppkey * 31) % 200 AS y0, (s_suppkey * 53) % 310 AS x1, (s_suppkey * 13) % 190 AS y1 FROM supplier), d AS (SELECT *, (x0 - x1) * (50 - 150) - (y0 - y1) * (10 - 290) AS den FROM s) "
    "SELECT s_suppkey, round(((x0 * y1 - y0 * x1) * (10 - 290) - (x0 - x1) * (10 * 150 - 50 * 290)) / den, 6) AS x, round(((x0 * y1 - y0 * x1) * (50 - 150) - (y0 - y1) * (10 * 150 - 50 * 290)) / den, 6) AS y FROM d WHERE den <> 0"
)
def line_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """Where each line crosses one fixed line; parallels do not."""
    k = F.col("s_suppkey")
    own = tuple(((k * a) % b).cast("double") for a, b in ((17, 300), (31, 200), (53, 310), (13, 190)))
    rows = table(spark, folder, "supplier").select(k, geometry.intersection(own, tuple(F.lit(float(v)) for v in (10, 50, 290, 150))).alias("p")).where("p IS NOT NULL")
    return rows.select("s_suppkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
