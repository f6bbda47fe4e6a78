"""Queries of selection, joins, counts, histograms and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeq.operators import counting, selection, spatial
from latticeq.plans.tables import POINTS, points, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH j AS (SELECT l_partkey, l_orderkey, o_custkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_extendedprice / l_quantity AS unit_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) = 1)
SELECT l_partkey, l_orderkey, o_custkey, unit_price FROM f WHERE unit_price < (SELECT median(unit_price) FROM f) ORDER BY unit_price, l_partkey LIMIT 500
""")
def flagship_select_top(spark, d):
    """Ratio, inner join, first row of each key, below the median, the 500 lowest."""
    scored = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    named = scored.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = selection.first_per_key(named, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"])
    return selection.lowest(selection.below_median(one, "unit_price"), 500, ["unit_price", "l_partkey"]).select("l_partkey", "l_orderkey", "o_custkey", "unit_price")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_named_subset(spark, d):
    listed = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return selection.named_subset(table(spark, d, "supplier"), listed, "s_nationkey").select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_already_used(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return selection.without(table(spark, d, "part"), used, "p_partkey").select("p_partkey", "p_brand")


@query("""
WITH a AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 12), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey >= 18)
SELECT a.k AS first, b.k AS second FROM a, b UNION ALL SELECT b.k, a.k FROM a, b
""")
def cross_pairs_asym(spark, d):
    s = table(spark, d, "supplier")
    return selection.cross_pairs(s.filter("s_nationkey < 12"), s.filter("s_nationkey >= 18"), "s_suppkey")


@query("SELECT a.n_nationkey AS first, b.n_nationkey AS second FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def cross_pairs_sym(spark, d):
    n = table(spark, d, "nation")
    return selection.cross_pairs(n, n, "n_nationkey", symmetric=True)


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, unnest(range(least(3, greatest(0, n - 2)) + 1)) AS "offset" FROM o
""")
def offset_expansion(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return selection.offsets(o, F.col("n"), 3, 2)


@query(f"WITH {POINTS} SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label <> b.label AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 1.2 * (0.01 + 0.002 * (a.label % 5) + 0.01 + 0.002 * (b.label % 5))")
def grid_contacts(spark, d):
    """Pairs of different labels closer than the scaled sum of their radii."""
    p = points(spark, d).withColumn("radius", 0.01 + 0.002 * F.pmod("label", F.lit(5)))
    return spatial.radius_pairs(p, 0.018, 1.2, valid=F.col("l_label") != F.col("r_label")).select(F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"))


@query(f"WITH {POINTS} SELECT a.vec_id, count(b.vec_id) AS n_near FROM p a LEFT JOIN p b ON b.vec_id <> a.vec_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.05*0.05 GROUP BY a.vec_id")
def grid_contact_count(spark, d):
    p = points(spark, d)
    return spatial.contact_counts(p, p, 0.05, "vec_id", within=F.col("l_vec_id") != F.col("r_vec_id"))


@query(f"WITH {POINTS} SELECT vec_id, label FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.label % 2 = 0 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.05*0.05)")
def grid_exists_anti(spark, d):
    """Points that clash with none of the even labels."""
    p = points(spark, d)
    return spatial.range_join(p, p.filter("label % 2 = 0"), 0.05, how="left_anti").select("vec_id", "label")


@query(f"""WITH {POINTS}, o AS (SELECT DISTINCT CAST(floor(x/0.1) AS BIGINT) AS v0, CAST(floor(y/0.1) AS BIGINT) AS v1, CAST(floor(z/0.1) AS BIGINT) AS v2 FROM p WHERE label % 2 = 0)
SELECT v0, v1, v2, count(p.vec_id) AS n FROM o LEFT JOIN p ON p.label % 2 = 1 AND floor(x/0.1) = v0 AND floor(y/0.1) = v1 AND floor(z/0.1) = v2 GROUP BY v0, v1, v2""")
def voxel_occupancy(spark, d):
    p = points(spark, d)
    return spatial.occupancy(p.filter("label % 2 = 0"), p.filter("label % 2 = 1"), 0.1)


@query(f"""WITH {POINTS}, o AS (SELECT DISTINCT floor(x/0.1) AS v0, floor(y/0.1) AS v1, floor(z/0.1) AS v2 FROM p WHERE label % 2 = 0)
SELECT count(*) AS n_outside FROM p WHERE label % 2 = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE floor(x/0.1) = v0 AND floor(y/0.1) = v1 AND floor(z/0.1) = v2)""")
def voxel_outside(spark, d):
    p = points(spark, d)
    return spatial.outside_occupied(p.filter("label % 2 = 0"), p.filter("label % 2 = 1"), 0.1)


@query(f"""WITH {POINTS}, v AS (SELECT vec_id, CAST(floor((x + 1) / 0.1) AS BIGINT) AS i, CAST(floor((y + 1) / 0.1) AS BIGINT) AS j, CAST(floor((z + 1) / 0.1) AS BIGINT) AS k FROM p)
SELECT vec_id, CASE WHEN i BETWEEN 0 AND 19 AND j BETWEEN 0 AND 19 AND k BETWEEN 0 AND 19 THEN k * 400 + j * 20 + i ELSE -1 END AS address FROM v""")
def voxel_address(spark, d):
    return points(spark, d).select("vec_id", spatial.voxel_address("xyz", (-1.0, -1.0, -1.0), 0.1, (20, 20, 20)).alias("address"))


ANGLES = """g AS (SELECT vec_id, CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END AS t, CASE WHEN u < 0 THEN u + 2 * pi() ELSE u END AS u FROM
 (SELECT vec_id, atan2(CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE)) AS t, atan2(CAST(embedding[6] AS DOUBLE), CAST(embedding[7] AS DOUBLE)) AS u FROM embeddings)),
m AS (SELECT a.vec_id AS a, b.vec_id AS b, least(abs(a.t - b.t), 2 * pi() - abs(a.t - b.t)) + least(abs(a.u - b.u), 2 * pi() - abs(a.u - b.u)) AS l1 FROM g a JOIN g b ON a.vec_id < b.vec_id)"""


@query(f"WITH {ANGLES} SELECT a, b, round(l1, 6) AS l1 FROM m WHERE l1 <= 0.2")
def angle_hash_match(spark, d):
    """Pairs whose two angles differ by at most 0.2 together, around the circle."""
    from latticeq.functions.geometry import circular, circular_deviation

    e = table(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    g = e.select("vec_id", circular(F.atan2(at(4), at(5))).alias("t"), circular(F.atan2(at(6), at(7))).alias("u"))
    pairs = spatial.angle_join(g, g, ["t", "u"], 0.2, F.col("l_vec_id") < F.col("r_vec_id"))
    l1 = circular_deviation(F.col("l_t"), F.col("r_t")) + circular_deviation(F.col("l_u"), F.col("r_u"))
    return pairs.select(F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"), F.round(l1, 6).alias("l1"))


KNN = f"""{POINTS}, k AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), b.vec_id) AS nth FROM p a, p b),
e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k WHERE nth <= 8 AND a <> b)"""


def _edges(spark, d):
    p = points(spark, d)
    return spatial.undirected(spatial.nearest(p, p, 8, None, "vec_id"), "l_vec_id", "r_vec_id")


@query(f"WITH {KNN} SELECT a, b FROM e")
def knn_join(spark, d):
    """Undirected edges of the eight nearest neighbours, a point itself included."""
    return _edges(spark, d)


@query(f"WITH {KNN}, s AS (SELECT vec_id FROM p WHERE label = 3), t AS (SELECT a, b FROM e WHERE a IN (SELECT vec_id FROM s) OR b IN (SELECT vec_id FROM s)), near AS (SELECT a AS k FROM t UNION SELECT b FROM t UNION SELECT vec_id FROM s) SELECT a, b FROM e WHERE a IN (SELECT k FROM near) OR b IN (SELECT k FROM near)")
def neighbor_shell(spark, d):
    return spatial.shell(_edges(spark, d), points(spark, d).filter("label = 3"), key="vec_id")


@query("""WITH c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_aggregate(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])), 'sum') AS d2
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND abs(CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) <= 0.08 AND abs(CAST(a.embedding[2] AS DOUBLE) - b.embedding[2]) <= 0.08 AND abs(CAST(a.embedding[3] AS DOUBLE) - b.embedding[3]) <= 0.08)
SELECT a, b, round(sqrt(d2), 6) AS distance FROM c WHERE sqrt(d2) <= 1.3""")
def candidate_verify(spark, d):
    """Pairs in one box of three coordinates, then by the distance in all 64."""
    pairs = spatial.vector_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 0.08, 1.3)
    return pairs.select("a", "b", F.round("distance", 6).alias("distance"))


HIST = """h AS (SELECT l_returnflag, greatest(0, least(9, CAST(floor((l_quantity - 1) / ((51 - 1) / 10.0::DOUBLE)) AS BIGINT))) AS i, greatest(0, least(4, CAST(floor((l_discount - 0) / ((0.1::DOUBLE - 0) / 5)) AS BIGINT))) AS j, count(*) AS n FROM lineitem GROUP BY ALL),
hd AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE) / (((51 - 1) / 10.0::DOUBLE) * ((0.1::DOUBLE - 0) / 5)) AS density FROM h)"""
_HIST = dict(x="l_quantity", y="l_discount", x_range=(1, 51), y_range=(0, 0.1), bins=(10, 5), by=["l_returnflag"])


@query(f"WITH {HIST} SELECT l_returnflag, i, j, n, round(density, 6) AS density FROM hd")
def hist2d_build(spark, d):
    h = counting.histogram2d(table(spark, d, "lineitem"), **_HIST)
    return h.select("l_returnflag", "i", "j", "n", F.round("density", 6).alias("density"))


@query(f"""WITH {HIST}, q AS (SELECT l_orderkey, l_linenumber, l_returnflag, greatest(0, least(9, CAST(floor((l_quantity - 1) / ((51 - 1) / 10.0::DOUBLE)) AS BIGINT))) AS i, greatest(0, least(4, CAST(floor((l_discount - 0) / ((0.1::DOUBLE - 0) / 5)) AS BIGINT))) AS j FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(density, 0), 6) AS density FROM q LEFT JOIN hd USING (l_returnflag, i, j)""")
def hist2d_lookup(spark, d):
    """Density of every row."""
    rows = table(spark, d, "lineitem")
    found = counting.density_lookup(rows, counting.histogram2d(rows, **_HIST), **_HIST)
    return found.select("l_orderkey", "l_linenumber", F.round("density", 6).alias("density"))


@query("""
WITH r AS (SELECT o_orderpriority, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_orderpriority, l_returnflag, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT o_orderpriority, sum(n) AS total FROM c GROUP BY ALL),
b AS (SELECT l_returnflag, sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS share FROM c GROUP BY ALL)
SELECT o_orderpriority, l_returnflag, coalesce(n, 0) AS n, CAST(total AS BIGINT) AS total, round(-log2((coalesce(n, 0) + 1) / CAST(total + 3 AS DOUBLE) / share), 6) AS score
FROM t CROSS JOIN b LEFT JOIN c USING (o_orderpriority, l_returnflag)
""")
def logodds_by_group(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return counting.log_odds(rows, ["o_orderpriority"], "l_returnflag", 3).withColumn("score", F.round("score", 6))


_KINDS = ["signup", "error", "click", "view", "purchase"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def type_counts_pivot(spark, d):
    return counting.zero_filled_counts(table(spark, d, "events"), "user_id", "event_type", _KINDS)


@query("SELECT l_orderkey, count(*) AS n, count(*) / max(l_linenumber) AS per_unit FROM lineitem GROUP BY l_orderkey HAVING count(*) / max(l_linenumber) >= 1.5")
def density_filter(spark, d):
    return counting.per_unit_filter(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 1.5)


SETS = """m AS (SELECT DISTINCT o_custkey AS k, p_brand AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT k, m, count(*) OVER (PARTITION BY k) AS n FROM m),
j AS (SELECT a.k AS a, b.k AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.m = b.m AND a.k <> b.k AND a.k % 100 = 0 GROUP BY 1, 2),
sim AS (SELECT a, b, shared, CASE WHEN greatest(na, nb) < 10 THEN 0.0::DOUBLE ELSE shared / CAST(na + nb - shared AS DOUBLE) END AS jaccard FROM j)"""
def _queried():
    return F.col("o_custkey") % 100 == 0


def _sets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


@query(f"WITH {SETS} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM sim")
def jaccard_pairs(spark, d):
    """Similarity of the brand sets of the query customers (numbers divisible by 100) with those of all others."""
    return counting.set_similarity(_sets(spark, d), "o_custkey", "p_brand", 10, _queried(), 6)


@query(f"WITH {SETS}, k AS (SELECT DISTINCT k FROM m) SELECT x.k AS a, y.k AS b, CASE WHEN x.k = y.k THEN 1.0::DOUBLE ELSE round(coalesce(jaccard, 0), 6) END AS jaccard FROM k x JOIN k y ON x.k % 100 = 0 LEFT JOIN sim ON sim.a = x.k AND sim.b = y.k")
def jaccard_matrix(spark, d):
    """Each query customer with every customer that has orders."""
    return counting.set_matrix(_sets(spark, d), "o_custkey", "p_brand", 10, _queried(), 6)


@query("""SELECT DISTINCT a.l_orderkey, concat_ws('_', a.l_suppkey, b.l_suppkey, b.l_linenumber - a.l_linenumber) AS pair_key
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber BETWEEN 1 AND 3""")
def contact_pair_hash(spark, d):
    return counting.pair_keys(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", 3)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def group_sizes(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


_HASH = "(p_partkey * 1103515245 + 12345) % 2147483648"


@query(f"SELECT p_brand, p_partkey FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT p_brand, p_partkey FROM (SELECT * FROM part WHERE p_brand <> 'Brand#11' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {_HASH}, p_partkey) <= 3)")
def grouped_sample(spark, d):
    """Three parts of each brand; one brand stays whole."""
    return selection.grouped_sample(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], 3, "p_partkey", F.col("p_brand") == "Brand#11")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def topn_per_group(spark, d):
    return selection.top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], 5, [F.desc("p_retailprice"), "p_partkey"])


@query(f"SELECT p_partkey FROM part WHERE {_HASH} < 536870912")
def bernoulli_sample(spark, d):
    return selection.bernoulli(table(spark, d, "part").select("p_partkey"), "p_partkey", 0.25)


@query(f"SELECT p_partkey FROM part ORDER BY {_HASH}, p_partkey LIMIT 100")
def shuffle_take(spark, d):
    return selection.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 100)


@query(f"""SELECT p_partkey, CAST(f AS BIGINT) AS fold, CASE WHEN own = f THEN 'test' WHEN (own + 1) % 5 = f THEN 'validation' ELSE 'train' END AS role
FROM (SELECT p_partkey, ({_HASH} >> 8) % 5 AS own FROM part), (SELECT range AS f FROM range(5))""")
def kfold_split(spark, d):
    return selection.folds(table(spark, d, "part").select("p_partkey"), "p_partkey", 5).withColumn("fold", F.col("fold").cast("long"))


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS n_reads FROM events GROUP BY event_type")
def read_counts(spark, d):
    e = table(spark, d, "events")
    return counting.read_counts(e.select("event_type").distinct(), e.filter("ts < TIMESTAMP_NTZ '2024-01-16'"), "event_type", "event_id")


@query("""WITH c AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS n1, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n2 FROM events GROUP BY event_type)
SELECT event_type, n1, n2, round((n2 / CAST((SELECT sum(n2) FROM c) AS DOUBLE)) / (n1 / CAST((SELECT sum(n1) FROM c) AS DOUBLE)), 6) AS ratio FROM c""")
def enrichment_ratio(spark, d):
    e = table(spark, d, "events")
    library, early = e.select("event_type").distinct(), F.expr("ts < TIMESTAMP_NTZ '2024-01-16'")
    before, after = (counting.read_counts(library, e.filter(c), "event_type", "event_id") for c in (early, ~early))
    return counting.enrichment(before, after, "event_type", "n_reads").withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY l_returnflag")
def weighted_loss(spark, d):
    return counting.weighted_loss(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity").withColumn("loss", F.round("loss", 6))


@query("SELECT l_returnflag, round(-corr(l_quantity, l_extendedprice), 6) AS negative_r, round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def pearson(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return c.select("l_returnflag", F.round(-F.col("r"), 6).alias("negative_r"), F.round(F.col("r") * F.col("r"), 6).alias("r2"))


@query("SELECT lang, round(avg(n_chars) FILTER (quality = 1), 6) AS mean, count(*) FILTER (quality = 1) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def masked_mean(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return counting.masked_mean(rows, ["lang"], F.col("n_chars"), F.col("quality") == 1).withColumn("mean", F.round("mean", 6))


@query("""WITH u AS (SELECT 0 AS part, p_partkey, p_name, p_size FROM part WHERE p_size <= 30 UNION ALL SELECT 1, p_partkey, upper(p_name), p_size + 100 FROM part WHERE p_size >= 20)
SELECT p_partkey, p_name, p_size FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY part) = 1""")
def worker_merge_first_wins(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return selection.merge_first_wins([p.filter("p_size <= 30"), p.filter("p_size >= 20").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 100).alias("p_size"))], "p_partkey")


@query("""WITH u AS (SELECT 0 AS part, p_partkey, p_size FROM part WHERE p_size <= 30 UNION ALL SELECT 1, p_partkey, p_size + 100 FROM part WHERE p_size >= 20)
SELECT p_partkey, p_size FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY part DESC) = 1""")
def topology_merge_last_wins(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return selection.merge_last_wins([p.filter("p_size <= 30"), p.filter("p_size >= 20").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))], "p_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("name"))
    return selection.duplicates(rows, "name").select("name.l_orderkey", "name.l_linenumber", "n")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3 OR (c_nationkey = 5 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def residue_selection(spark, d):
    chosen = selection.selected([("3", set()), ("5", {"BUILDING", "MACHINERY"})], "c_nationkey", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").filter(chosen)


@query("""WITH c AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 5 AS v FROM events)
SELECT user_id, """ + ", ".join(f"count(*) FILTER (v = {k}) AS v{k}, round(count(*) FILTER (v = {k}) / CAST(count(*) FILTER (v BETWEEN 0 AND 4) AS DOUBLE), 6) AS share{k}" for k in range(5)) + " FROM c GROUP BY user_id")
def length_distribution(spark, d):
    """Wide counts and shares of five lengths."""
    e = table(spark, d, "events").select("user_id", (F.floor("value") % 5).alias("v"))
    out = counting.wide_distribution(e, "user_id", "v", list(range(5)))
    return out.select("user_id", *(c for k in range(5) for c in (F.col(f"v{k}"), F.round(f"share{k}", 6).alias(f"share{k}"))))
