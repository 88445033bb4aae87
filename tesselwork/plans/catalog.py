"""Queries of the library's own operators on the driver tables, and their DuckDB SQL.

Drawings are not among the tables, so boxes, segments and intervals are derived from keys and sizes by integer
rules that both sides spell out. Each query is registered by its name; its SQL, where SQL can express it, stands
beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselwork.functions import geometry, numeric, text
from tesselwork.operators import evidence, graph, metrics, select, sequence, spatial
from tesselwork.sources.scratch import written
from tesselwork.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- inputs that several queries share


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("id"), ((k * 7919) % 9973 + F.floor(k / 2000) * 10_000).alias("x"), ((k * 104_729) % 1009).alias("y"),
        (F.col("p_size") + 20).cast("long").alias("w"), (F.col("p_size") * 2 + 20).cast("long").alias("h"), F.col("p_size").cast("long").alias("size"),
    )


BOXES = "boxes AS (SELECT p_partkey AS id, (p_partkey * 7919) % 9973 + p_partkey // 2000 * 10000 AS x, (p_partkey * 104729) % 1009 AS y, (p_size + 20)::BIGINT AS w, (p_size * 2 + 20)::BIGINT AS h, p_size::BIGINT AS size FROM part)"


def touching(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    rule = (F.col("l.id") < F.col("r.id")) & (geometry.box_intersection("l", "r") > 0)
    return spatial.grid_join(b, b, rule, 64, "id", "id")


TOUCHING = BOXES + ", pairs AS (SELECT l.id AS left_id, r.id AS right_id FROM boxes l JOIN boxes r ON l.id < r.id AND l.x < r.x + r.w AND r.x < l.x + l.w AND l.y < r.y + r.h AND r.y < l.y + l.h)"


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct intervals on the line of part keys by supplier and line number."""
    q = F.col("l_quantity").cast("long")
    return table(spark, folder, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_linestatus", "l_orderkey", F.col("l_partkey").alias("low"), (F.col("l_partkey") + q).alias("high")
    ).distinct()


INTERVALS = "intervals AS (SELECT DISTINCT l_suppkey, l_linenumber, l_linestatus, l_orderkey, l_partkey AS low, l_partkey + l_quantity::BIGINT AS high FROM lineitem)"


def iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted (status O) and true (status F) intervals of one supplier and line that share a fifth of their union."""
    rows = intervals(spark, folder).withColumn("id", F.concat_ws(":", "l_suppkey", "l_linenumber", "l_orderkey", "low", "high", "l_linestatus"))
    cols = ["id", "l_suppkey", "l_linenumber", "low", "high"]
    met = spatial.band_join(rows.where("l_linestatus = 'O'").select(cols), rows.where("l_linestatus = 'F'").select(cols), ["l_suppkey", "l_linenumber"], "low", 64)
    common = geometry.overlap(F.col("l.low"), F.col("l.high"), F.col("r.low"), F.col("r.high"))
    union = F.greatest("l.high", "r.high") - F.least("l.low", "r.low")
    return met.where((common > 0) & (common * 5 >= union)).select(F.col("l.id").alias("pred"), F.col("r.id").alias("truth"), F.bround(common / union, 6).alias("iou"), F.col("l.l_suppkey").alias("supplier"))


#: The pairs of iou_pairs in SQL, and greedy loops as recursions over ranked rows.
IOU_PAIRS = (
    INTERVALS + ", i AS (SELECT *, concat_ws(':', l_suppkey, l_linenumber, l_orderkey, low, high, l_linestatus) AS id FROM intervals), "
    "q AS (SELECT p.id AS pred, t.id AS truth, p.l_suppkey AS supplier, p.l_linenumber AS line, least(p.high, t.high) - greatest(p.low, t.low) AS common, greatest(p.high, t.high) - least(p.low, t.low) AS whole "
    "FROM i p JOIN i t ON p.l_suppkey = t.l_suppkey AND p.l_linenumber = t.l_linenumber AND p.l_linestatus = 'O' AND t.l_linestatus = 'F' AND p.low < t.high AND t.low < p.high), "
    "pairs AS (SELECT pred, truth, supplier, line, round_even(common / whole, 6) AS iou FROM q WHERE common * 5 >= whole), "
    "turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY supplier, line ORDER BY iou DESC, pred DESC, truth DESC) AS nth FROM pairs), "
    "greedy AS (SELECT supplier, line, 0::BIGINT AS nth, []::VARCHAR[] AS used, NULL::VARCHAR AS pred, NULL::VARCHAR AS truth, NULL::DOUBLE AS iou, false AS took FROM (SELECT DISTINCT supplier, line FROM pairs) "
    "UNION ALL SELECT t.supplier, t.line, t.nth, CASE WHEN list_has_any(g.used, [t.pred, t.truth]) THEN g.used ELSE list_concat(g.used, [t.pred, t.truth]) END, t.pred, t.truth, t.iou, NOT list_has_any(g.used, [t.pred, t.truth]) "
    "FROM greedy g JOIN turns t ON t.supplier = g.supplier AND t.line = g.line AND t.nth = g.nth + 1), matched AS (SELECT pred, truth, iou FROM greedy WHERE took)"
)


def seeds_sql(touching: str) -> str:
    """Boxes by falling size, each kept unless it touches one that is: the list of those kept after each turn."""
    return (
        f"{touching}, near AS (SELECT node, list(other) AS others FROM (SELECT left_id AS node, right_id AS other FROM pairs UNION ALL SELECT right_id, left_id FROM pairs) GROUP BY node), "
        "turns AS MATERIALIZED (SELECT id, coalesce(others, []) AS others, row_number() OVER (ORDER BY size DESC, id) AS nth FROM boxes LEFT JOIN near ON node = id), "
        "walk AS (SELECT 0::BIGINT AS nth, NULL::BIGINT AS id, NULL::BIGINT AS seed, []::BIGINT[] AS seeds UNION ALL SELECT t.nth, t.id, coalesce(list_filter(w.seeds, lambda s: list_contains(t.others, s))[1], t.id), "
        "CASE WHEN list_has_any(w.seeds, t.others) THEN w.seeds ELSE list_append(w.seeds, t.id) END FROM walk w JOIN turns t ON t.nth = w.nth + 1)"
    )


# --- joins


@query(f"WITH {TOUCHING} SELECT left_id, right_id FROM pairs")
def grid_join(spark: SparkSession, folder: str) -> DataFrame:
    return touching(spark, folder)


@query(
    "WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part) "
    "SELECT a.p_partkey AS a, b.p_partkey AS b, abs(a.cents - b.cents) AS apart FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.cents - b.cents) <= 60"
)
def band_join(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    out = spatial.band_join(p, p, ["p_size"], "cents", 60, F.col("l.p_partkey") < F.col("r.p_partkey"))
    return out.select(F.col("l.p_partkey").alias("a"), F.col("r.p_partkey").alias("b"), F.abs(F.col("l.cents") - F.col("r.cents")).alias("apart"))


@query(
    "WITH m AS (SELECT p_partkey, s_suppkey, abs(p_partkey * 5 - s_suppkey * 100) AS d FROM part JOIN supplier ON p_size % 10 = s_suppkey % 10) "
    "SELECT p_partkey, arg_min(s_suppkey, d * 1000000 + s_suppkey) AS s_suppkey, min(d) AS distance FROM m WHERE d <= 5000 GROUP BY p_partkey"
)
def nearest_host(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 10).alias("k"), (F.col("p_partkey") * 5).alias("at"))
    s = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).alias("k"), (F.col("s_suppkey") * 100).alias("at"))
    return spatial.nearest_on_line(p, s, "p_partkey", "s_suppkey", ["k"], "at", 5000)


POINTS = "points AS (SELECT o_orderkey, (o_orderkey * 6151) % 9973 + o_orderkey // 15000 * 10000 AS px, (o_orderkey * 3571) % 1000 AS py FROM orders)"


@query(
    f"WITH {BOXES}, {POINTS}, m AS (SELECT o_orderkey, min({{'area': w * h, 'id': id}}) AS b FROM points JOIN boxes ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY o_orderkey) "
    "SELECT p.o_orderkey, m.b.id AS id FROM points p LEFT JOIN m USING (o_orderkey)"
)
def smallest_holder(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    points = table(spark, folder, "orders").select(o, ((o * 6151) % 9973 + F.floor(o / 15_000) * 10_000).alias("px"), ((o * 3571) % 1000).alias("py"))
    return spatial.smallest_holder(points, boxes(spark, folder), "o_orderkey", "id", 64)


TRIANGLES = "tri AS (SELECT id, x AS ax, y AS ay, x + w AS bx, y AS by_, x + w // 2 AS cx, y + h AS cy FROM boxes)"


@query(
    f"WITH {BOXES}, {POINTS}, {TRIANGLES}, s AS (SELECT o_orderkey, id, (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) AS d1, (cx - bx) * (py - by_) - (cy - by_) * (px - bx) AS d2, (ax - cx) * (py - cy) - (ay - cy) * (px - cx) AS d3 "
    "FROM points JOIN tri ON px BETWEEN ax AND bx AND py BETWEEN ay AND cy) SELECT o_orderkey, id FROM s WHERE d1 >= 0 AND d2 >= 0 AND d3 >= 0"
)
def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    at = lambda v: F.floor(F.col(v) / 64).cast("int")
    points = table(spark, folder, "orders").select(o, ((o * 6151) % 9973 + F.floor(o / 15_000) * 10_000).alias("px"), ((o * 3571) % 1000).alias("py")).withColumns({"cx": at("px"), "cy": at("py")})
    corner = lambda a, b: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    x, y, w, h = (F.col(c) for c in spatial.BOX)
    shapes = boxes(spark, folder).withColumn("shape", F.array(corner(x, y), corner(x + w, y), corner(x + F.floor(w / 2), y + h)))
    return points.join(spatial.cells(shapes, 64), ["cx", "cy"]).where(geometry.contains(F.col("shape"), F.col("px"), F.col("py"))).select("o_orderkey", "id")


@query(
    f"WITH {INTERVALS}, a AS (SELECT * FROM intervals WHERE l_linestatus = 'F'), b AS (SELECT * FROM intervals WHERE l_linestatus = 'O') SELECT l_suppkey, l_linenumber, l_orderkey, low, high, l_linestatus FROM a "
    "UNION ALL SELECT l_suppkey, l_linenumber, l_orderkey, low, high, l_linestatus FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.low < b.high AND b.low < a.high)"
)
def document_text_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = intervals(spark, folder).select("l_suppkey", "l_linenumber", "l_orderkey", "low", "high", "l_linestatus")
    strict = (F.col("f.low") < F.col("s.high")) & (F.col("s.low") < F.col("f.high"))
    return spatial.keep_apart(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), ["l_suppkey", "l_linenumber"], strict)


@query(
    f"WITH {INTERVALS}, m AS (SELECT a.l_suppkey, a.l_linenumber, a.low, a.high, least(a.high, b.high) - greatest(a.low, b.low) AS common, b.low AS b_low, b.high AS b_high FROM (SELECT DISTINCT l_suppkey, l_linenumber, low, high FROM intervals WHERE l_linestatus = 'F') a "
    "JOIN (SELECT DISTINCT l_suppkey, l_linenumber, low, high FROM intervals WHERE l_linestatus = 'O') b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.low < b.high AND b.low < a.high) "
    "SELECT l_suppkey, l_linenumber, low, high, max(struct_pack(common := common, low := b_low, high := b_high)).low AS host_low, max(common) AS common FROM m GROUP BY ALL HAVING 2 * max(common) >= high - low"
)
def best_overlap_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """Each F interval takes the O interval that overlaps it most, if that is half of it."""
    rows = intervals(spark, folder).select("l_suppkey", "l_linenumber", "low", "high", "l_linestatus").distinct()
    met = spatial.band_join(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), ["l_suppkey", "l_linenumber"], "low", 64)
    common = geometry.overlap(F.col("l.low"), F.col("l.high"), F.col("r.low"), F.col("r.high"))
    best = met.select(*[F.col(f"l.{c}").alias(c) for c in ("l_suppkey", "l_linenumber", "low", "high")], F.struct(common.alias("common"), F.col("r.low").alias("low"), F.col("r.high").alias("high")).alias("o"))
    best = best.where("o.common > 0").groupBy("l_suppkey", "l_linenumber", "low", "high").agg(F.max("o").alias("o")).where("2 * o.common >= high - low")
    return best.select("l_suppkey", "l_linenumber", "low", "high", F.col("o.low").alias("host_low"), F.col("o.common").alias("common"))


@query(
    "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 45) "
    "AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')"
)
def context_semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(items.where("l_quantity >= 45"), "o_orderkey", "left_semi").join(items.where("l_returnflag = 'R'"), "o_orderkey", "left_anti")


# --- matching, suppression, graphs


@query(f"WITH RECURSIVE {IOU_PAIRS} SELECT pred, truth, iou FROM matched")
def match_iou(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one matching by falling overlap; tests hold it against the plain greedy loop."""
    return select.greedy_match(iou_pairs(spark, folder), "pred", "truth", "iou")


@query(
    f"WITH RECURSIVE {IOU_PAIRS}, n AS (SELECT l_suppkey AS supplier, sum((l_linestatus = 'O')::INTEGER)::BIGINT AS found, sum((l_linestatus = 'F')::INTEGER)::BIGINT AS truth FROM i GROUP BY l_suppkey), "
    "h AS (SELECT split_part(pred, ':', 1)::BIGINT AS supplier, count(*) AS tp FROM matched GROUP BY 1), c AS (SELECT supplier, coalesce(tp, 0) AS tp, found - coalesce(tp, 0) AS fp, truth - coalesce(tp, 0) AS fn FROM n LEFT JOIN h USING (supplier)) "
    "SELECT *, round_even(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END, 6) AS precision, round_even(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END, 6) AS recall FROM c"
)
def match_iou_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the matching by supplier."""
    rows = intervals(spark, folder).select(F.col("l_suppkey").alias("supplier"), "l_linestatus", F.concat_ws(":", "l_suppkey", "l_linenumber", "l_orderkey", "low", "high", "l_linestatus").alias("id"))
    matched = match_iou(spark, folder)
    both = matched.select(F.col("pred").alias("id")).unionByName(matched.select(F.col("truth").alias("id"))).withColumn("hit", F.lit(True))
    seen = rows.join(both, "id", "left").fillna(False, ["hit"])
    truth = (F.col("l_linestatus") == "F") | F.col("hit")
    found = (F.col("l_linestatus") == "O") | F.col("hit")
    return metrics.precision_recall(seen.where("NOT (hit AND l_linestatus = 'O')"), truth, found, ["supplier"])


@query(f"WITH RECURSIVE {seeds_sql(TOUCHING)} SELECT id FROM walk WHERE seed = id")
def nms_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes by falling size that touch no box kept before; tests hold it against the plain greedy loop."""
    clashes = touching(spark, folder).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return select.keep_first(boxes(spark, folder), clashes, "id", "size")


@query(
    f"WITH RECURSIVE {TOUCHING}, edges AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs), "
    "reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a) SELECT node, min(root) AS component FROM reach GROUP BY node"
)
def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(touching(spark, folder), "left_id", "right_id")


@query(f"WITH {TOUCHING}, e AS (SELECT left_id AS node, right_id AS other FROM pairs UNION ALL SELECT right_id, left_id FROM pairs) SELECT node, count(*) AS degree, min(other) AS first_neighbour FROM e GROUP BY node")
def node_degree(spark: SparkSession, folder: str) -> DataFrame:
    p = touching(spark, folder)
    both = p.select(F.col("left_id").alias("node"), F.col("right_id").alias("other")).unionByName(p.select(F.col("right_id").alias("node"), F.col("left_id").alias("other")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("first_neighbour"))


# --- ordered rows

RUNS = (
    "e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e), "
    "runs AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, run)"
)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    marked = sequence.islands(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {RUNS} SELECT user_id, run, event_type, n, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us FROM runs")
def islands(spark: SparkSession, folder: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return runs(spark, folder).select("user_id", "run", "event_type", "n", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query(f"WITH {RUNS}, g AS (SELECT user_id, run, epoch_us(lead(first_ts) OVER (PARTITION BY user_id ORDER BY run)) - epoch_us(last_ts) AS gap_us FROM runs) SELECT * FROM g WHERE gap_us IS NOT NULL")
def gaps_between_runs(spark: SparkSession, folder: str) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    after = F.lead("first_ts").over(Window.partitionBy("user_id").orderBy("run"))
    return runs(spark, folder).select("user_id", "run", (us(after) - us(F.col("last_ts"))).alias("gap_us")).where("gap_us IS NOT NULL")


@query(
    f"WITH {INTERVALS}, d AS (SELECT DISTINCT l_suppkey, l_linenumber, low, high FROM intervals), s AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS n FROM d), "
    "p AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part FROM s) SELECT l_suppkey, l_linenumber, min(low) AS low, max(high) AS high, count(*) AS parts FROM p GROUP BY l_suppkey, l_linenumber, part"
)
def sweep_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = intervals(spark, folder).select("l_suppkey", "l_linenumber", "low", "high").distinct()
    return sequence.sweep_merge(rows, ["l_suppkey", "l_linenumber"], "low", "high", 2)


@query(
    "WITH c AS (SELECT l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS w FROM lineitem), s AS (SELECT l_suppkey, l_quantity, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS so_far, sum(w) OVER (PARTITION BY l_suppkey) AS whole FROM c) "
    "SELECT l_suppkey, min(l_quantity) AS quantile FROM s WHERE so_far >= 0.2 * whole GROUP BY l_suppkey"
)
def weighted_quantile(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.weighted_quantile(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long"), 0.2)


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.3), 4) AS p30, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY o_orderpriority")
def exact_percentile(spark: SparkSession, folder: str) -> DataFrame:
    out = sequence.percentiles(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", {"p30": 0.3, "middle": 0.5})
    return out.select("o_orderpriority", F.round("p30", 4).alias("p30"), F.round("middle", 4).alias("middle"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY l_suppkey")
def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.upper_median(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), "
    "b AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT o_custkey, n, o_orderkey AS best, o_totalprice AS score FROM c WHERE n = 1 UNION ALL SELECT c.o_custkey, c.n, CASE WHEN c.o_totalprice >= r.score + 50000 THEN c.o_orderkey ELSE r.best END, "
    "CASE WHEN c.o_totalprice >= r.score + 50000 THEN c.o_totalprice ELSE r.score END FROM r JOIN c ON c.o_custkey = r.o_custkey AND c.n = r.n + 1) SELECT * FROM r)) SELECT o_custkey, arg_max(best, n) AS o_orderkey, arg_max(score, n) AS o_totalprice FROM b GROUP BY o_custkey"
)
def hypothesis_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ord"), "o_totalprice")
    return sequence.running_choice(rows, "o_custkey", ["ord"], "o_totalprice", "o_orderkey", 50_000)


@query(
    "WITH h AS (SELECT ((o_custkey * 7) % 36)::INTEGER AS bin, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS mass FROM orders GROUP BY 1), f AS (SELECT range::INTEGER AS bin, coalesce(mass, 0) AS mass FROM range(36) LEFT JOIN h ON h.bin = range) "
    "SELECT f.bin, f.mass FROM f JOIN f a ON a.bin = (f.bin + 35) % 36 JOIN f z ON z.bin = (f.bin + 1) % 36 WHERE f.mass > a.mass AND f.mass >= z.mass AND f.mass >= 0.02 * (SELECT sum(mass) FROM f)"
)
def histogram_peaks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(((F.col("o_custkey") * 7) % 36).cast("int").alias("bin"), F.round("o_totalprice").cast("long").alias("price"))
    return sequence.peaks(rows, "bin", "price", 36, 0.02)


# --- votes and evidence


@query(
    "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS pos FROM customer GROUP BY ALL) SELECT c_nationkey, arg_max(c_mktsegment, n * 1000000000 - pos) AS segment, max(n) AS votes FROM c GROUP BY c_nationkey"
)
def mode_vote(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("pos"))
    return counted.groupBy("c_nationkey").agg(numeric.mode_first("c_mktsegment", "n", "pos").alias("segment"), F.max("n").alias("votes"))


def resolve_sql(passes: str = "0, 1, 2, 3") -> str:
    """The rule of evidence.resolve on events: a pass is a day modulo four."""
    return (
        f"o AS (SELECT user_id AS place, event_type AS reading, day(ts) % 4 AS variant, (event_id * 7919) % 100 AS conf FROM events WHERE day(ts) % 4 IN ({passes})), v AS (SELECT place, reading, variant, max(conf) AS best FROM o GROUP BY ALL), "
        "m AS (SELECT place, reading, avg(conf) AS mean FROM o GROUP BY place, reading), s AS (SELECT place, reading, count(*) AS support, sum(best) AS total, max(best) AS best, reading IN ('click', 'view') AS known FROM v GROUP BY place, reading), "
        "t AS (SELECT *, round_even(total / 100 * CASE WHEN known THEN 1.25 ELSE 1.0 END, 6) AS score FROM s JOIN m USING (place, reading)), "
        "r AS (SELECT *, row_number() OVER w AS rank, first_value(reading) OVER w AS top, first_value(known) OVER w AS top_known FROM t WINDOW w AS (PARTITION BY place ORDER BY score DESC, support DESC, reading)), "
        "f AS (SELECT *, NOT top_known AND known AND best >= 60 AND length(top) >= 3 AND length(top) = length(reading) AND levenshtein(top, reading) = 1 AS fix FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CASE WHEN fix THEN 0 ELSE 1 END, rank) AS pick FROM f), "
        "others AS (SELECT place, string_agg(reading || ':' || support, ',' ORDER BY pick) AS rivals FROM p WHERE pick BETWEEN 2 AND 6 GROUP BY place), "
        "resolved AS (SELECT place, reading, support, score, best, round_even(mean, 6) AS mean, fix AS corrected, CASE WHEN best >= 60 THEN 'confident' WHEN support >= 2 AND mean >= 40 THEN 'supported' WHEN known AND best >= 25 THEN 'known' ELSE 'rejected' END AS reason, "
        "coalesce(rivals, '') AS rivals FROM p LEFT JOIN others USING (place) WHERE pick = 1)"
    )


@query(f"WITH {resolve_sql()} SELECT * FROM resolved")
def evidence_resolve(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    seen = e.select(F.col("user_id").alias("place"), F.col("event_type").alias("reading"), (F.dayofmonth("ts") % 4).alias("variant"), ((F.col("event_id") * 7919) % 100).alias("conf"))
    return evidence.resolve(seen, "place", "reading", "variant", "conf", ["click", "view"])


@query(
    "WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC) AS nth FROM lineitem) "
    "SELECT l_orderkey, round_even(sum(l_quantity * CASE WHEN nth = 1 THEN 1.0::DOUBLE WHEN nth <= 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 4) AS support, count(DISTINCT l_returnflag) AS kinds FROM l GROUP BY l_orderkey"
)
def support_diminishing(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.diminishing(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity", "l_returnflag")


@query(
    "WITH v AS (SELECT l_partkey, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit FROM lineitem), m AS (SELECT a.l_partkey, a.unit AS anchor, count(*) AS votes, median(b.unit) AS middle FROM (SELECT DISTINCT * FROM v) a JOIN v b ON a.l_partkey = b.l_partkey AND abs(b.unit - a.unit) <= 0.18::DOUBLE * a.unit GROUP BY ALL HAVING count(*) >= 3) "
    "SELECT l_partkey, arg_max(anchor, votes * 1000000000 - anchor) AS anchor, max(votes) AS votes, arg_max(middle, votes * 1000000000 - anchor)::DOUBLE AS middle FROM m GROUP BY l_partkey"
)
def scale_consensus(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_partkey", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("unit"))
    return sequence.consensus(rows, "l_partkey", "unit", 0.18, 3)


@query(
    "WITH c AS (SELECT *, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER w AS o, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey)) "
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND p >= 2 AND o < f THEN 'W' ELSE o_orderstatus END AS kind FROM c"
)
def plan_convention(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one kind are re-typed where their group's counts show a convention."""
    whole = Window.partitionBy("o_custkey")
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long")).over(whole)
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", n("P").alias("p"), n("O").alias("o"), n("F").alias("f"))
    kind = F.when((F.col("o_orderstatus") == "P") & (F.col("p") >= 2) & (F.col("o") < F.col("f")), "W").otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", kind.alias("kind"))


# --- scalar rules


@query("SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS DOUBLE) AS half, CAST((((p_partkey * 7 - 5000) % 180) + 180) % 180 AS BIGINT) AS angle FROM part")
def half_even_floor_mod(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", numeric.half_even(F.col("p_size") / 2.0).cast("double").alias("half"), F.pmod(F.col("p_partkey") * 7 - 5000, F.lit(180)).cast("long").alias("angle"))


SEGMENTS = "seg AS (SELECT p_partkey, ((p_partkey * 17) % 300)::DOUBLE AS x0, ((p_partkey * 31) % 200)::DOUBLE AS y0, ((p_partkey * 53) % 310)::DOUBLE AS x1, ((p_partkey * 13) % 190)::DOUBLE AS y1 FROM part)"


@query(
    f"WITH {SEGMENTS}, a AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, fmod(fmod(degrees(atan2(y1 - y0, x1 - x0)), 180.0) + 180.0, 180.0) AS angle FROM seg) "
    "SELECT p_partkey, round(len, 6) AS length, round(angle, 6) AS angle, CASE WHEN least(angle, 180 - angle) <= 10 THEN 'horizontal' WHEN abs(angle - 90) <= 10 THEN 'vertical' ELSE 'diagonal' END AS orientation, "
    "greatest(0, least(x1, 200) - greatest(x0, 100)) AS overlap, round(CASE WHEN len = 0 THEN sqrt((150 - x0) ** 2 + (100 - y0) ** 2) ELSE sqrt((150 - (x0 + t * (x1 - x0))) ** 2 + (100 - (y0 + t * (y1 - y0))) ** 2) END, 6) AS distance "
    "FROM (SELECT *, CASE WHEN len = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((150 - x0) * (x1 - x0) + (100 - y0) * (y1 - y0)) / (len * len))) END AS t FROM a)"
)
def segment_geometry(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(k, *[((k * a) % b).cast("double").alias(c) for a, b, c in ((17, 300, "x0"), (31, 200, "y0"), (53, 310, "x1"), (13, 190, "y1"))])
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    angle = geometry.undirected_angle(*ends)
    return rows.select(
        "p_partkey", F.round(geometry.length(*ends), 6).alias("length"), F.round(angle, 6).alias("angle"), geometry.orientation(angle).alias("orientation"),
        geometry.overlap(F.col("x0"), F.col("x1"), F.lit(100.0), F.lit(200.0)).alias("overlap"), F.round(geometry.point_segment_distance(F.lit(150.0), F.lit(100.0), *ends), 6).alias("distance"),
    )


@query(
    f"WITH {BOXES} SELECT id, round((w * h) / 2.0, 4) AS area, round(w + 2 * sqrt((w / 2.0) ** 2 + h * h), 6) AS perimeter, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM boxes"
)
def polygon_measures(spark: SparkSession, folder: str) -> DataFrame:
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in spatial.BOX)
    shape = F.array(corner(x, y), corner(x + w, y), corner(x + w / 2, y + h))
    rows = boxes(spark, folder).select("id", F.round(geometry.signed_area(shape), 4).alias("area"), F.round(geometry.perimeter(shape), 6).alias("perimeter"), geometry.bounds(shape).alias("b"))
    return rows.select("id", "area", "perimeter", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("WITH b AS (SELECT DISTINCT p_brand FROM part) SELECT x.p_brand AS a, y.p_brand AS b FROM b x JOIN b y ON x.p_brand < y.p_brand AND length(x.p_brand) = length(y.p_brand) AND levenshtein(x.p_brand, y.p_brand) = 1")
def one_substitution(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs one letter apart meet on the word with that letter left out, not each with each."""
    b = table(spark, folder, "part").select("p_brand").distinct()
    word = F.col("p_brand")
    masks = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("\x00"), F.substring(word, i + 1, F.length(word))))
    cut = b.select(word, F.explode(masks).alias("mask"))
    met = cut.alias("x").join(cut.alias("y"), "mask").where(F.col("x.p_brand") < F.col("y.p_brand")).select(F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b")).distinct()
    return met.where(text.one_substitution(F.col("a"), F.col("b")))


@query(
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '..' || left(p_name, 1) || '-' WHEN 1 THEN repeat(left(p_name, 1), 2 + (p_partkey % 3)::INTEGER) WHEN 2 THEN p_name ELSE '' END AS t FROM part), c AS (SELECT *, regexp_replace(t, '[^A-Za-z0-9]', '', 'g') AS core FROM t) "
    "SELECT p_partkey, length(core) <= 1 OR (length(core) >= 3 AND replace(lower(core), lower(left(core, 1)), '') = '') AS noise FROM c"
)
def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    t = F.when(k % 4 == 0, F.concat(F.lit(".."), F.left(name, F.lit(1)), F.lit("-"))).when(k % 4 == 1, F.repeat(F.left(name, F.lit(1)), (2 + k % 3).cast("int"))).when(k % 4 == 2, name).otherwise("")
    return table(spark, folder, "part").select("p_partkey", text.is_noise(t).alias("noise"))


@query(
    "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'm' ELSE 'ft' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN p_size / 4.0 ELSE p_size + (p_partkey % 12) / 12.0 END AS w, CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0 ELSE (p_size % 7 + 1)::DOUBLE END AS h FROM part) "
    "SELECT p_partkey, unit, round(w::DOUBLE, 4) AS width, round(h::DOUBLE, 4) AS height, round((w * h)::DOUBLE, 4) AS area FROM s WHERE least(w, h) >= CASE WHEN unit = 'ft' THEN 2.5 ELSE 0.75 END"
)
def dimension_parse(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    feet = F.concat(size, F.lit("' "), k % 12, F.lit('" x '), size % 7 + 1, F.lit("'"))
    metres = F.concat(F.format_string("%.2f", size / 4.0), F.lit(" x "), F.format_string("%.2f", size / 2.0), F.lit(" m"))
    rows = table(spark, folder, "part").select("p_partkey", text.printed_size(F.when(k % 3 == 0, metres).otherwise(feet)).alias("s")).where(text.plausible_size(F.col("s")))
    return rows.select("p_partkey", "s.unit", F.round("s.width", 4).alias("width"), F.round("s.height", 4).alias("height"), F.round("s.area", 4).alias("area"))


#: Names of things and what they stand for: the lexicon of the query below.
LEXICON = [("red widget", "painted widget"), ("widget", "widget"), ("ring", "ring"), ("small ring", "signet"), ("blue bolt", "painted bolt"), ("bolt", "bolt"), ("hot gear", "drive"), ("gear", "gear"), ("gizmo", "gizmo")]


@query(
    "WITH l(phrase, name) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + "), m AS (SELECT p_partkey, phrase, name FROM part JOIN l ON contains(' ' || p_name || ' ', ' ' || phrase || ' ')) "
    "SELECT p_partkey, arg_min(phrase, lpad((99 - length(phrase))::VARCHAR, 3, '0') || phrase) AS phrase, arg_min(name, lpad((99 - length(phrase))::VARCHAR, 3, '0') || phrase) AS name FROM m GROUP BY p_partkey"
)
def lexicon_match(spark: SparkSession, folder: str) -> DataFrame:
    return text.longest_phrase(table(spark, folder, "part"), "p_partkey", "p_name", LEXICON)


# --- texts, pages, documents


@query(
    "WITH w AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents) "
    "SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{2,}'))) AS ordinary, 100 * len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{2,}'))) >= 80 * len(w) AS usable FROM w"
)
def text_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.array_remove(F.split(F.translate("text", "\n", " "), " "), "").alias("w"))
    plain = F.size(F.filter("w", lambda x: x.rlike("^[a-z]{2,}$")))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), plain.cast("long").alias("ordinary")).withColumn("usable", 100 * F.col("ordinary") >= 80 * F.col("words"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_digest(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return by.where("copies > 1")


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-z][a-z0-9]*')) AS opened, len(regexp_extract_all(html, '</[a-z][a-z0-9]*')) AS closed, len(regexp_extract_all(html, '&[a-z]+;')) AS entities FROM pages")
def html_tokens(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, folder, "pages").select("page_id", count("<[a-z][a-z0-9]*").alias("opened"), count("</[a-z][a-z0-9]*").alias("closed"), count("&[a-z]+;").alias("entities"))


def _runs_of_five(rows: DataFrame, key: str) -> DataFrame:
    """Runs of five words as they stand; a text that repeats one has it as often."""
    words = F.array_remove(F.split(F.translate(F.lower("text"), "\n", " "), " "), "")
    five = rows.select(key, words.alias("w")).where("size(w) >= 5")
    return five.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.concat_ws(" ", F.slice("w", i + 1, 5)))).alias("run"))


MOST_RUNS = 500_000  # of the benchmark: up to here they go to every executor, about 50 MB


def _runs_of_five_sql(name: str, key: str) -> str:
    return (
        f"{name}_w AS (SELECT {key}, list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: x <> '') AS w FROM {name}), "
        f"{name}_r AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM {name}_w WHERE len(w) >= 5))"
    )


@query(
    f"WITH {_runs_of_five_sql('documents', 'doc_id')}, {_runs_of_five_sql('benchmark', 'item_id')}, n AS (SELECT item_id, count(*) AS runs FROM benchmark_r GROUP BY item_id) "
    "SELECT doc_id, item_id, count(*) AS shared, any_value(runs) AS runs FROM documents_r JOIN benchmark_r USING (run) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 2 * count(*) >= any_value(runs)"
)
def benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold half or more of a benchmark text's five-word runs."""
    items = written(_runs_of_five(table(spark, folder, "benchmark"), "item_id").distinct(), "benchmark-runs")
    runs_of = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("runs"))
    sought = F.broadcast(items) if items.count() <= MOST_RUNS else items  # no run that is in no item is shuffled
    met = _runs_of_five(table(spark, folder, "documents"), "doc_id").join(sought, "run")
    shared = met.groupBy("doc_id", "item_id").agg(F.countDistinct("run").alias("shared"))
    return shared.join(runs_of, "item_id").where("2 * shared >= runs").select("doc_id", "item_id", "shared", "runs")


# --- metrics and reports


@query(
    "WITH j AS (SELECT lang, quality = 0 AS truth, n_chars < 900 AS found FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, sum((truth AND found)::INTEGER)::BIGINT AS tp, sum((NOT truth AND found)::INTEGER)::BIGINT AS fp, sum((truth AND NOT found)::INTEGER)::BIGINT AS fn FROM j GROUP BY lang) "
    "SELECT *, round_even(CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END, 6) AS precision, round_even(CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END, 6) AS recall FROM c"
)
def confusion_pr(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    return metrics.precision_recall(rows, F.col("quality") == 0, F.col("n_chars") < 900, ["lang"])


@query(
    "WITH a AS (SELECT DISTINCT c_nationkey AS k, c_custkey % 40 AS m FROM customer), b AS (SELECT DISTINCT s_nationkey AS k, s_suppkey % 40 AS m FROM supplier) "
    "SELECT (SELECT count(*) FROM a JOIN b USING (k, m)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (k, m)) AS only_found, (SELECT count(*) FROM b ANTI JOIN a USING (k, m)) AS only_truth"
)
def set_agreement(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 40).alias("m"))
    b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 40).alias("m"))
    return metrics.set_agreement(a, b, ["k", "m"])


@query(
    "WITH a AS (SELECT o_orderkey, o_orderstatus AS was FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END AS now FROM orders WHERE o_orderkey % 7 <> 0) "
    "SELECT coalesce(was, 'absent') AS was, coalesce(now, 'absent') AS now, count(*) AS n FROM a FULL JOIN b USING (o_orderkey) GROUP BY ALL"
)
def status_diff(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 250_000, "F").otherwise(F.col("o_orderstatus")))
    return metrics.status_changes(o.where("o_orderkey % 5 <> 0"), new, "o_orderkey", "o_orderstatus")


@query(
    "SELECT coalesce(l_returnflag, 'OVERALL') AS flag, coalesce(l_linestatus, 'OVERALL') AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
)
def rollup_overall(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    over = lambda c: F.coalesce(F.col(c), F.lit("OVERALL"))
    return by.select(over("l_returnflag").alias("flag"), over("l_linestatus").alias("status"), "n", "quantity", "price")


@query(
    "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT count(DISTINCT user_id) AS users FROM events) "
    "SELECT strftime(d.day, '%Y-%m-%d') AS day, t.event_type, count(e.event_id) AS n, round(count(e.event_id) / any_value(users), 6) AS per_user FROM d CROSS JOIN t CROSS JOIN u LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day AND e.event_type = t.event_type GROUP BY ALL"
)
def profile_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Mean events of a user by type and day, days without any counting as zero."""
    e = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id")
    counted = e.groupBy("day", "event_type").count()
    grid = metrics.every_pair(e.select("day").distinct(), e.select("event_type").distinct())
    users = e.agg(F.countDistinct("user_id").alias("users"))  # one row
    filled = grid.join(counted, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("count", F.lit(0)).alias("n")).join(F.broadcast(users), F.lit(True))
    return filled.select("day", "event_type", "n", F.round(F.col("n") / F.col("users"), 6).alias("per_user"))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT event_id, user_id, event_type, value FROM r WHERE nth <= 3"
)
def retention_topn(spark: SparkSession, folder: str) -> DataFrame:
    return select.newest(table(spark, folder, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS BIGINT)) AS most FROM events GROUP BY event_type")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query(
    "WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e) "
    "SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k"
)
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of a user's events with gaps under six hours."""
    e = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    by = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return by.select("user_id", "first_us", "last_us", "n")


@query(
    "WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM x GROUP BY label, i), l AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label) "
    "SELECT vec_id, e.label, round(list_cosine_similarity(embedding::DOUBLE[], m), 4) AS similarity FROM embeddings e JOIN l USING (label)"
)
def centroid_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every vector with the mean of its label."""
    e = table(spark, folder, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # one entry for each dimension
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, c = F.col("v"), F.col("c")
    return e.join(centre, "label").select("vec_id", "label", F.round(dot(v, c) / F.sqrt(dot(v, v) * dot(c, c)), 4).alias("similarity"))


@query(
    "SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY r_name, n_name"
)
def topology_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Equi-joins along a chain of containers, rolled up to the outer two."""
    t = lambda n: table(spark, folder, n)
    orders = t("orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1999-01-01'")
    chain = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    chain = chain.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
