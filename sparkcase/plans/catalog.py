"""Registered queries over the driver's tables, each over whole tables, and the SQL that gives the same rows.

The modules ``catalog_cases`` and ``catalog_measures`` add more; ``queries`` has them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphs, measures as m, pooling, taxonomy
from ..operators import adapt, evaluation, index, phases, retrieval, synthesis
from ..sources import dumpers, loaders, store
from .filters import And, Eq, In, Like, Not, Or, Raw, compile_filter

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


def rounded(measure):
    """A measure whose score is rounded, so that both engines rank alike."""
    return lambda x, y: r6(m.scalar(measure)(x, y))


def sql_r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


# Attribute-value retrieval: parts for the mean part of every brand.

BRANDS = "SELECT p_brand AS query_id, avg(p_retailprice) AS price, avg(p_size) AS size, p_brand AS brand FROM part GROUP BY p_brand"


def part_cases(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"))
    return retrieval.cases_of(part, "p_partkey")


def brand_queries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mean = part.groupBy(F.col("p_brand").alias("query_id")).agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    return retrieval.queries_of(mean.withColumn("brand", F.col("query_id")), "query_id")  # an aggregated string would sort all rows


def part_measure(aggregate=None):
    return m.attribute_value({"price": m.linear(100), "size": m.linear(50), "brand": m.equality()}, aggregate or pooling.aggregator("mean", {"price": 2, "size": 1, "brand": 1}))


LIN = "CASE WHEN abs({0} - {1}) > {2} THEN 0e0 ELSE ({2} - abs({0} - {1})) / {2} END"
PART_SIM = f"(({LIN.format('c.p_retailprice', 'q.price', '100e0')}) * 2 + ({LIN.format('c.p_size', 'q.size', '50e0')}) + CASE WHEN c.p_brand = q.brand THEN 1e0 ELSE 0e0 END) / 4"
PART_SCORES = f"SELECT q.query_id, c.p_partkey AS case_id, {sql_r6(PART_SIM)} AS sim FROM part c CROSS JOIN ({BRANDS}) q"


def ranked_sql(scores: str, where: str = "true", order: str = "case_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, {order}) AS rank FROM ({scores})) WHERE {where}"


def plain(scores: DataFrame) -> DataFrame:
    return scores.select("query_id", "case_id", "sim", F.col("rank").cast("bigint").alias("rank"))


@query(ranked_sql(PART_SCORES, "rank <= 5"))
def retrieve_attribute_value(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    return plain(retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=5)).final)


@query(ranked_sql(f"SELECT * FROM ({PART_SCORES}) WHERE sim >= 0.8 AND sim <= 0.9"))
def retrieve_dropout_bounds(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    return plain(retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), min_similarity=0.8, max_similarity=0.9)).final)


@query(ranked_sql(f"SELECT s.query_id, s.case_id, {sql_r6('exp(-0.05e0 * abs(c.p_retailprice - q.price))')} AS sim, s.rank AS o FROM ({ranked_sql(PART_SCORES, 'rank <= 50')}) s JOIN part c ON c.p_partkey = s.case_id JOIN ({BRANDS}) q ON q.query_id = s.query_id", "rank <= 5", "o").replace("SELECT * FROM (SELECT *, row_number()", "SELECT query_id, case_id, sim, rank FROM (SELECT *, row_number()", 1))
def retrieve_mac_fac(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    cheap = retrieval.dropout(retrieval.build(rounded(part_measure())), limit=50)
    fine = retrieval.dropout(retrieval.build(rounded(m.transpose(m.exponential(0.05), lambda c: c["price"]))), limit=5)
    return plain(retrieval.apply_queries(cases, queries, [cheap, fine]).final)


PRICE = f"SELECT q.query_id, c.p_partkey AS case_id, {sql_r6(LIN.format('c.p_retailprice', 'q.price', '100e0'))} AS sim FROM part c CROSS JOIN ({BRANDS}) q"
SIZE = f"SELECT q.query_id, c.p_partkey AS case_id, {sql_r6(LIN.format('c.p_size', 'q.size', '50e0'))} AS sim FROM part c CROSS JOIN ({BRANDS}) q"


def price_and_size():
    price = retrieval.dropout(retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"]))), limit=100)
    size = retrieval.dropout(retrieval.build(rounded(m.transpose(m.linear(50), lambda c: c["size"]))), limit=100)
    return {"price": price, "size": size}


def combined_sql(join: str) -> str:
    both = f"SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.case_id, b.case_id) AS case_id, {sql_r6('(coalesce(a.sim, 0e0) * 3 + coalesce(b.sim, 0e0)) / 4')} AS sim FROM ({ranked_sql(PRICE, 'rank <= 100')}) a {join} ({ranked_sql(SIZE, 'rank <= 100')}) b ON a.query_id = b.query_id AND a.case_id = b.case_id"
    return ranked_sql(both)


def combined(spark, sf_dir, strategy):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    r = retrieval.combine(price_and_size(), pooling.aggregator("mean", {"price": 3, "size": 1}), strategy)
    scores = retrieval.apply_queries(cases, queries, r).steps[-1].scores
    return plain(retrieval.rank(scores.withColumn("sim", r6(F.col("sim"))).withColumn("ord", F.col("case_id"))))


@query(combined_sql("FULL JOIN"))
def retrieve_combine_union(spark, sf_dir):
    return combined(spark, sf_dir, "union")


@query(combined_sql("JOIN"))
def retrieve_combine_intersection(spark, sf_dir):
    return combined(spark, sf_dir, "intersection")


RRF = f"SELECT query_id, case_id, {sql_r6('sum(part)')} AS sim FROM (SELECT query_id, case_id, 0.7e0 / (60 + rank) AS part FROM ({ranked_sql(PRICE, 'rank <= 100')}) UNION ALL SELECT query_id, case_id, 0.3e0 / (60 + rank) AS part FROM ({ranked_sql(SIZE, 'rank <= 100')})) GROUP BY ALL"


@query(ranked_sql(RRF, "rank <= 10"))
def retrieve_rank_fusion(spark, sf_dir):
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    fused = retrieval.reciprocal_rank_fusion([r(paired) for r in price_and_size().values()], 60, (0.7, 0.3))
    return plain(retrieval.rank(fused.withColumn("sim", r6(F.col("sim"))).withColumn("ord", F.col("case_id"))).where("rank <= 10"))


@query(f"WITH s AS ({PRICE}), w AS (SELECT *, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM s) SELECT query_id, case_id, {sql_r6('CASE WHEN lo = hi THEN 1e0 ELSE (sim - lo) / (hi - lo) END')} AS sim FROM w")
def scores_normalized(spark, sf_dir):
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    scores = retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"])))(paired)
    return retrieval.normalize(scores).select("query_id", "case_id", r6(F.col("sim")).alias("sim"))


@query("SELECT a.o_orderkey AS case_id, b.c_custkey AS query_id FROM orders a JOIN customer b ON abs(a.o_totalprice - b.c_acctbal) <= 100")
def pairs_banded(spark, sf_dir):
    cases = retrieval.cases_of(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), "o_orderkey")
    queries = retrieval.queries_of(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "c_custkey")
    return retrieval.banded_pairs(cases, queries, "v", 100.0).select("case_id", "query_id")


@query("SELECT p_partkey FROM part WHERE ((p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND NOT p_type = 'ECONOMY') OR p_name LIKE '%red%') AND p_size > 10")
def filters(spark, sf_dir):
    where = And(Or(And(In("p_brand", ("Brand#1", "Brand#2", "Brand#3")), Not(Eq("p_type", "ECONOMY"))), Like("p_name", "%red%")), Raw("p_size > 10"))
    return table(spark, sf_dir, "part").where(compile_filter(where)).select("p_partkey")


# Scalar measures: each customer with the mean balance of its nation's suppliers.

BALANCES = "SELECT c_custkey, c_acctbal AS x, (SELECT avg(s_acctbal) FROM supplier s WHERE s.s_nationkey = c.c_nationkey) AS y FROM customer c"


def balances(spark, sf_dir):
    mean = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("y"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(mean), F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", F.col("c_acctbal").alias("x"), "y")


@query(f"""SELECT c_custkey, {sql_r6("CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x < 0 OR x > 10000 OR y < 0 OR y > 10000 THEN 0e0 ELSE 1 - abs(x - y) / 10000e0 END")} AS linear_interval,
    {sql_r6("CASE WHEN abs(x - y) < 100 THEN 1e0 WHEN abs(x - y) > 5000 THEN 0e0 ELSE (5000 - abs(x - y)) / 4900e0 END")} AS linear,
    CASE WHEN abs(x - y) <= 1000 THEN 1e0 WHEN y IS NOT NULL THEN 0e0 END AS threshold, {sql_r6("exp(-0.001e0 * abs(x - y))")} AS exponential,
    {sql_r6("1 / (1 + exp((abs(x - y) - 1000e0) / 500e0))")} AS sigmoid FROM ({BALANCES})""")  # fmt: skip
def sim_numbers(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    of = {"linear_interval": m.linear_interval(0, 10000), "linear": m.linear(5000, 100), "threshold": m.threshold(1000), "exponential": m.exponential(0.001), "sigmoid": m.sigmoid(500, 1000)}
    return balances(spark, sf_dir).select("c_custkey", *((f(x, y) if k == "threshold" else r6(f(x, y))).alias(k) for k, f in of.items()))


@query("""WITH q AS (SELECT DISTINCT c_mktsegment AS s FROM customer) SELECT c_custkey, s AS segment, CASE WHEN c_mktsegment = s THEN 1e0 ELSE 0e0 END AS equality,
    CASE WHEN c_mktsegment = s THEN 1e0 WHEN (c_mktsegment, s) IN (('BUILDING', 'MACHINERY'), ('MACHINERY', 'BUILDING')) THEN 0.6e0 WHEN (c_mktsegment, s) IN (('HOUSEHOLD', 'FURNITURE'), ('FURNITURE', 'HOUSEHOLD')) THEN 0.8e0 ELSE 0.1e0 END AS static_table,
    CASE WHEN c_mktsegment = 'BUILDING' AND s = 'BUILDING' THEN 0.5e0 WHEN (c_mktsegment = 'HOUSEHOLD' AND s = 'FURNITURE') OR (s = 'HOUSEHOLD' AND c_mktsegment = 'FURNITURE') THEN 0.25e0 WHEN c_mktsegment = s THEN 1e0 ELSE 0e0 END AS dynamic_table,
    (CASE WHEN c_mktsegment = s THEN 1e0 ELSE 0e0 END + 0.5e0) / 2 AS combine FROM customer CROSS JOIN q""")
def sim_generic(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    segments = customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    x, y = F.col("c_mktsegment"), F.col("segment")
    fixed = m.static_table({("BUILDING", "MACHINERY"): 0.6, ("HOUSEHOLD", "FURNITURE"): 0.8}, default=lambda a, b: F.when(a == b, 1.0).otherwise(0.1))
    chosen = m.dynamic_table({"BUILDING": m.static(0.5), ("HOUSEHOLD", "FURNITURE"): m.static(0.25)}, default=m.equality())
    both = m.combine([m.equality(), m.static(0.5)])
    return customer.crossJoin(F.broadcast(segments)).select("c_custkey", "segment", m.equality()(x, y).alias("equality"), fixed(x, y).alias("static_table"), chosen(x, y).alias("dynamic_table"), both(x, y).alias("combine"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity / 50, l_discount * 10, l_tax * 10 + 0.01] AS a, list_sort([l_quantity / 50, l_discount * 10, l_tax * 10 + 0.01]) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, %s FROM t""" % ", ".join(f"{sql_r6(x)} AS {n}" for n, x in {
    "mean": "(a[1] + a[2] + a[3]) / 3", "geometric_mean": "CASE WHEN list_min(a) = 0 THEN 0 ELSE exp((ln(greatest(a[1], 1e-9)) + ln(greatest(a[2], 1e-9)) + ln(a[3])) / 3) END", "harmonic_mean": "CASE WHEN list_min(a) = 0 THEN 0 ELSE 3 / (1 / a[1] + 1 / greatest(a[2], 1e-9) + 1 / a[3]) END",
    "median": "s[2]", "least": "s[1]", "greatest": "s[3]", "total": "a[1] + a[2] + a[3]", "k_max_2": "s[2]", "minkowski_3": "pow(pow(a[1], 3) + pow(a[2], 3) + pow(a[3], 3), 1 / 3e0)", "euclidean": "sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3])",
    "weighted_max": "greatest(a[1] * 2, a[2], a[3]) * 3 / 4",
}.items()))
def pool_scores(spark, sf_dir):
    a = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10 + 0.01)
    of = {"mean": pooling.mean, "geometric_mean": pooling.geometric_mean, "harmonic_mean": pooling.harmonic_mean, "median": pooling.median, "least": F.array_min, "greatest": F.array_max, "total": pooling.POOLINGS["sum"], "k_max_2": pooling.k_max(2), "minkowski_3": pooling.minkowski(3), "euclidean": pooling.euclidean, "weighted_max": pooling.aggregator("max", (2, 1, 1))}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(r6(f(F.col("a"))).alias(k) for k, f in of.items()))


# Taxonomy: the world's regions and nations; leaves at depth 2.

NATIONS = "SELECT a.n_name AS x, b.n_name AS y, CASE WHEN a.n_name = b.n_name THEN 2 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END AS d FROM nation a CROSS JOIN nation b"


@query(f"SELECT x, y, {sql_r6('2e0 * d / 4')} AS wu_palmer, {sql_r6('CASE WHEN d = 2 THEN 1e0 ELSE d / 2e0 END')} AS weights, {sql_r6('(d + 1) / 3e0')} AS levels, {sql_r6('(4 - 2e0 * (2 - d)) / 4')} AS paths FROM ({NATIONS})")
def sim_taxonomy(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("children")).orderBy("r_name")
    # A taxonomy is a small tree by definition; this one has as many rows as there are regions.
    tree = {"name": "WORLD", "children": [{"name": r["r_name"], "children": list(r["children"])} for r in joined.collect()]}
    of = {"wu_palmer": taxonomy.wu_palmer(), "weights": taxonomy.weights("auto"), "levels": taxonomy.levels(), "paths": taxonomy.paths()}
    names = nation.select("n_name")
    both = names.withColumnRenamed("n_name", "x").crossJoin(F.broadcast(names.withColumnRenamed("n_name", "y")))
    return both.select("x", "y", *(r6(taxonomy.build(tree, f)(F.col("x"), F.col("y"))).alias(k) for k, f in of.items()))


# Strings: all pairs of distinct part names.

NAMES = "SELECT a.p_name AS x, b.p_name AS y FROM (SELECT DISTINCT p_name FROM part) a CROSS JOIN (SELECT DISTINCT p_name FROM part) b"


def name_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.withColumnRenamed("p_name", "x").crossJoin(F.broadcast(names.withColumnRenamed("p_name", "y")))


@query(f"""WITH g AS (SELECT x, y, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS a, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS b,
    list_distinct(string_split(x, ' ')) AS u, list_distinct(string_split(y, ' ')) AS v FROM ({NAMES}))
    SELECT x, y, {sql_r6("len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE")} AS ngram,
    {sql_r6("1 / (1 + 1 - len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v)))::DOUBLE)")} AS jaccard,
    CASE WHEN starts_with(x, string_split(y, ' ')[1]) THEN 1e0 ELSE 0e0 END AS regex, CASE WHEN x LIKE string_split(y, ' ')[1] || ' %' THEN 1e0 ELSE 0e0 END AS glob,
    {sql_r6("jaro_similarity(x, y)")} AS jaro, {sql_r6("jaro_winkler_similarity(x, y)")} AS jaro_winkler FROM g""")
def sim_strings(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    words = lambda c: F.split(c, " ")
    first = F.split(y, " ")[0]
    return name_pairs(spark, sf_dir).select(
        "x", "y", r6(m.ngram(3)(x, y)).alias("ngram"), r6(m.transpose(m.jaccard(), words)(x, y)).alias("jaccard"), m.regex()(x, first).alias("regex"),
        m.glob()(x, F.concat(first, F.lit(" *"))).alias("glob"), r6(m.jaro()(x, y)).alias("jaro"), r6(m.jaro_winkler()(x, y)).alias("jaro_winkler"),
    )


# Sequences: the events of each user against those of the user with the id one higher.


USERS_A_TASK = 200


def user_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("e"))
    mine = events.select("user_id", F.col("e.event_type").alias("kinds"), F.col("e.value").alias("values"))
    after = mine.select((F.col("user_id") - 1).alias("user_id"), F.struct("user_id", "kinds", "values").alias("next"))
    # Pairs are few bytes and much work, so they are dealt to tasks by their number.
    return mine.join(after, "user_id").repartition(max(1, table(spark, sf_dir, "events").select("user_id").distinct().count() // USERS_A_TASK), "user_id")


@query("""WITH u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS k FROM events GROUP BY user_id), p AS (SELECT a.user_id, a.k, b.user_id AS other, b.k AS l FROM u a JOIN u b ON b.user_id = a.user_id + 1)
    SELECT user_id, other, %s AS jaccard, %s AS isolated_mapping FROM p""" % (sql_r6("1 / (2 - len(list_intersect(list_distinct(k), list_distinct(l))) / len(list_distinct(list_concat(k, l)))::DOUBLE)"), sql_r6("list_sum(list_transform(l, lambda q: CASE WHEN list_contains(k, q) THEN 1e0 ELSE 0e0 END)) / len(l)")))
def sim_collections(spark, sf_dir):
    pairs = user_series(spark, sf_dir)
    x, y = F.col("kinds"), F.col("next.kinds")
    return pairs.select("user_id", F.col("next.user_id").alias("other"), r6(m.jaccard()(x, y)).alias("jaccard"), r6(m.isolated_mapping(m.equality())(x, y)).alias("isolated_mapping"))


# Vectors: every embedding against the mean vector of every label.

CENTROIDS = "SELECT label AS query_id, list(v ORDER BY i) AS q FROM (SELECT label, i, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"
VECTORS = f"SELECT vec_id, query_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x, q AS y FROM embeddings CROSS JOIN ({CENTROIDS})"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
COS = f"{_DOT.format('x', 'y')} / (sqrt({_DOT.format('x', 'x')}) * sqrt({_DOT.format('y', 'y')}))"


def centroids(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return cells.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("vector"))


def vector_pairs(spark, sf_dir):
    cases = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return cases.crossJoin(F.broadcast(centroids(spark, sf_dir).withColumnRenamed("vector", "y")))


@query(f"""SELECT vec_id, query_id, {sql_r6(f"greatest(0, least(1, ({COS} + 1) / 2))")} AS cosine, {sql_r6(f"greatest(0, least(1, ({_DOT.format('x', 'y')} + 1) / 2))")} AS dot, {sql_r6(f"1 - acos(greatest(-1, least(1, {COS}))) / pi()")} AS angular,
    {sql_r6("1 / (1 + sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))")} AS euclidean, {sql_r6("1 / (1 + list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))))")} AS manhattan FROM ({VECTORS})""")
def sim_vectors(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    of = {"cosine": m.cosine(), "dot": m.dot(), "angular": m.angular(), "euclidean": m.euclidean(), "manhattan": m.manhattan()}
    return vector_pairs(spark, sf_dir).select("vec_id", "query_id", *(r6(f(x, y)).alias(k) for k, f in of.items()))


@query(ranked_sql(f"SELECT query_id, vec_id AS case_id, {sql_r6(f'1 / (1 + (1 - {COS}))')} AS sim FROM ({VECTORS})", "rank <= 10"))
def search_dense(spark, sf_dir):
    cases = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    scores = index.dense(cases, centroids(spark, sf_dir)).withColumn("sim", r6(F.col("sim")))
    return plain(retrieval.rank(scores).where("rank <= 10"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT event_type, count(*) / 1000e0 AS n FROM events GROUP BY ALL), d AS (SELECT user_id, sum(c.n * q.n) AS dot, sqrt(sum(c.n * c.n)) AS a FROM c JOIN q USING (event_type) GROUP BY user_id)
    SELECT user_id, %s AS sparse_cosine FROM d""" % sql_r6("greatest(0, least(1, (dot / (a * (SELECT sqrt(sum(n * n)) FROM q)) + 1) / 2))"))
def sim_sparse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    vector = F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("v")
    users = events.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(vector)
    whole = events.groupBy("event_type").agg((F.count("*") / 1000.0).alias("n")).agg(vector.alias("w"))
    return users.crossJoin(F.broadcast(whole)).select("user_id", r6(m.sparse_cosine()(F.col("v"), F.col("w"))).alias("sparse_cosine"))


# Evaluation: cosine retrieval by label means, an embedding relevant to its own label.

RUN = f"SELECT query_id, vec_id AS case_id, {sql_r6(f'greatest(0, least(1, ({COS} + 1) / 2))')} AS sim, label FROM ({VECTORS})"


def vector_run(spark, sf_dir):
    scored = vector_pairs(spark, sf_dir).select("query_id", F.col("vec_id").alias("case_id"), r6(m.cosine()(F.col("x"), F.col("y"))).alias("sim"))
    qrels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("case_id"), F.lit(1).alias("rel"))
    return qrels, scored


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, case_id) AS k, CASE WHEN label = query_id THEN 1 ELSE 0 END AS good FROM ({RUN})),
    s AS (SELECT *, sum(good) OVER (PARTITION BY query_id ORDER BY k) AS hits FROM r),
    n AS (SELECT label AS query_id, count(*) AS relevant FROM embeddings GROUP BY label),
    t AS (SELECT n.query_id, relevant, sum(good) AS hits, sum(good * hits / k::DOUBLE) AS ap, sum(good / log2(k + 1)) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(relevant, 20) + 1) x(i)) AS idcg FROM n JOIN s USING (query_id) WHERE k <= 20 GROUP BY ALL)
    SELECT query_id, {sql_r6("hits / 20e0")} AS precision, {sql_r6("hits / relevant::DOUBLE")} AS recall, {sql_r6("CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / 20e0) * (hits / relevant::DOUBLE) / (hits / 20e0 + hits / relevant::DOUBLE) END")} AS f1, {sql_r6("ap / relevant")} AS map, {sql_r6("dcg / idcg")} AS ndcg FROM t""")
def eval_metrics(spark, sf_dir):
    qrels, run = vector_run(spark, sf_dir)
    return evaluation.per_query(qrels, run, k=20).select("query_id", *(r6(F.col(c)).alias(c) for c in evaluation.DEFAULT))


@query(f"""WITH s AS ({PRICE}), z AS ({SIZE}), j AS (SELECT s.query_id, s.case_id, CAST(floor(s.sim * 4) AS INT) AS rel, z.sim FROM s JOIN z USING (query_id, case_id)),
    p AS (SELECT a.query_id, (a.sim - b.sim) * (a.rel - b.rel) > 0 AS ok FROM j a JOIN j b ON a.query_id = b.query_id AND a.case_id < b.case_id AND a.rel <> b.rel)
    SELECT query_id, count(*) FILTER (ok) AS concordant, count(*) FILTER (NOT ok) AS discordant, count(ok) AS total FROM (SELECT DISTINCT query_id FROM j) LEFT JOIN p USING (query_id) GROUP BY query_id""")
def eval_concordances(spark, sf_dir):
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    price = retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"])))(paired)
    size = retrieval.build(rounded(m.transpose(m.linear(50), lambda c: c["size"])))(paired)
    qrels = price.select("query_id", "case_id", F.floor(F.col("sim") * 4).cast("int").alias("rel"))
    return evaluation.concordances(qrels, size.select("query_id", "case_id", "sim")).select("query_id", "concordant", "discordant", "total")


@query(f"SELECT query_id, case_id, CAST(floor((sim - lo) / (hi - lo) * 4 + 1 + 0.5) AS INT) AS rel FROM (SELECT *, min(sim) OVER () AS lo, max(sim) OVER () AS hi FROM ({PRICE}))")
def eval_similarities_to_qrels(spark, sf_dir):
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    scores = retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"])))(paired)
    return evaluation.similarities_to_qrels(scores, max_qrel=5)


# Text index: benchmark passages against all documents.

BM25 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS term FROM benchmark)
    SELECT item_id AS query_id, doc_id AS case_id, floor(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * l / avg_len))) * 1e4 + 0.5) / 1e4 AS sim FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY ALL"""


@query(ranked_sql(BM25, "rank <= 10"))
def search_bm25(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("ord"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = index.bm25(cases, queries, every=False, normalized=False, limit=10, slack=1e-3).withColumn("sim", F.floor(F.col("sim") * 1e4 + 0.5) / 1e4)
    return plain(retrieval.rank(scores).where("rank <= 10"))


@query("SELECT p_partkey AS key, p_name AS value, CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE p_size END AS size FROM part WHERE p_brand <> 'Brand#2' AND NOT (p_type = 'SMALL' AND p_brand <> 'Brand#1')")
def index_mutations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), F.col("p_size").alias("size"), "p_brand", "p_type")
    kept = index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(rows)
    kept.delete(rows.where("p_brand = 'Brand#2'"))
    kept.upsert(rows.where("p_brand = 'Brand#1'").withColumn("size", F.lit(1)))
    kept.delete_where(And(Eq("p_type", "SMALL"), Not(Eq("p_brand", "Brand#1"))))
    return kept.read().select("key", "value", "size")


# Reuse, revise, retain.


@query(f"SELECT query_id, case_id, {sql_r6('(p_retailprice + price) / 2')} AS price, {sql_r6(LIN.format('(p_retailprice + price) / 2', 'price', '100e0'))} AS sim, rank FROM (SELECT s.*, c.p_retailprice, q.price FROM ({ranked_sql(PART_SCORES, 'rank <= 5')}) s JOIN part c ON c.p_partkey = s.case_id JOIN ({BRANDS}) q ON q.query_id = s.query_id)")
def reuse_adapt(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    found = retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=5)).steps[-1].scores
    adapted = phases.reuse(adapt.attribute_value({"price": adapt.aggregate("mean")}), m.transpose(m.linear(100), lambda c: c["price"]))(found)
    return adapted.select("query_id", "case_id", r6(F.col("case.price")).alias("price"), r6(F.col("sim")).alias("sim"), F.col("ord").alias("rank"))


@query(f"""WITH k AS ({ranked_sql(PART_SCORES, 'rank <= 2')}), b AS ({BRANDS}), m AS (SELECT max(p_partkey) AS top FROM part), a AS (SELECT p_partkey AS case_id, p_retailprice AS price, q.query_id, q.price AS y, false AS is_new FROM part CROSS JOIN b q
    UNION ALL SELECT m.top + k.rank, p.p_retailprice, k.query_id, b.price, true FROM k JOIN part p ON p.p_partkey = k.case_id JOIN b USING (query_id) CROSS JOIN m)
    SELECT query_id, case_id, is_new, {sql_r6(LIN.format('price', 'y', '100e0'))} AS sim FROM a WHERE NOT (is_new AND {sql_r6(LIN.format('price', 'y', '100e0'))} < 0.9)""")
def cycle_retain(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    price = rounded(m.transpose(m.linear(100), lambda c: c["price"]))
    keep = phases.retain_dropout(phases.retain(cases, price), min_similarity=0.9)
    done = phases.cycle(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=2), [phases.reuse(None, price)], [], [keep])
    return done.retain.steps[-1].scores.select("query_id", "case_id", "is_new", "sim")


# Prompts, chunks, graphs, sources.


@query(f"SELECT query_id, '## Query\n\n' || query_id || '\n\n## Documents Collection\n\n' || string_agg('### ' || case_id || ' (Rank: ' || rank || ', Similarity: ' || printf('%.3f', floor(sim * 1000 + 0.5) / 1000) || ')\n\n' || case_id, '\n\n' ORDER BY rank) AS prompt FROM ({ranked_sql(PART_SCORES, 'rank <= 5')}) GROUP BY query_id")
def synthesis_prompt(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    found = retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=5)).final
    shown = found.withColumn("case", F.col("case_id").cast("string")).withColumn("query", F.col("query_id"))
    return synthesis.default_prompt(shown, encode=lambda c: c)


@query(f"SELECT query_id, CAST((rank - 1) // 4 + d AS BIGINT) AS chunk, case_id FROM (SELECT *, count(*) OVER (PARTITION BY query_id, (rank - 1) // 4) AS n, max((rank - 1) // 4) OVER (PARTITION BY query_id) AS last FROM ({ranked_sql(PART_SCORES, 'rank <= 10')})) CROSS JOIN (VALUES (-1), (0), (1)) v(d) WHERE d = 0 OR (d = 1 AND (rank - 1) % 4 >= n - 1 AND (rank - 1) // 4 < last) OR (d = -1 AND (rank - 1) % 4 < 1 AND rank > 4)")
def synthesis_chunks(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    found = retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=10)).steps[-1].scores
    return synthesis.chunks(found, 4, 1).select("query_id", F.col("chunk").cast("bigint").alias("chunk"), "case_id")


@query("SELECT doc_id || '-chunk' || (i - 1) AS case_id, paragraphs[i] AS text FROM (SELECT doc_id, p AS paragraphs, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))")
def chunk_documents(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("ord"), F.col("text").alias("case"))
    return retrieval.chunk(cases, lambda c: F.split(c, "\n")).select("case_id", F.col("case").alias("text"))


@query()
def sim_graphs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    key = lambda i: F.concat(F.lit("n"), i.cast("string"))
    nodes = F.transform("t", lambda r, i: F.struct(key(i).alias("key"), r["role"].alias("value")))
    edges = F.transform(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), lambda r, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("key"), key(i).alias("source"), key(i + 1).alias("target"), F.lit(None).cast("string").alias("value")))
    chains = turns.select("conv_id", F.struct(nodes.alias("nodes"), edges.alias("edges")).alias("g"))
    after = chains.select((F.col("conv_id") - 1).alias("conv_id"), F.struct("conv_id", "g").alias("next"))
    pairs = chains.join(after, "conv_id")
    same = graphs.Setting(node_matcher=lambda a, b: a == b)
    of = {"greedy": graphs.graph_measure("greedy", same), "lap": graphs.graph_measure("lap", same), "dtw": graphs.graph_measure("dtw", same)}
    return pairs.select("conv_id", *(r6(f(F.col("g"), F.col("next.g"))["value"]).alias(k) for k, f in of.items()))


@query("SELECT n_nationkey, n_name, n_regionkey, 'csv' AS format FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'json' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'parquet' FROM nation")
def sources_round_trip(spark, sf_dir):
    nation, folder = table(spark, sf_dir, "nation"), store.new_folder(spark)
    dumpers.csv(nation, f"{folder}/csv")
    dumpers.json(nation, f"{folder}/json")
    dumpers.parquet(nation, f"{folder}/parquet")
    back = [loaders.csv(spark, f"{folder}/csv"), spark.read.schema(nation.schema).json(f"{folder}/json"), spark.read.parquet(f"{folder}/parquet")]
    out = None
    for name, df in zip(("csv", "json", "parquet"), back):
        part = df.select(*(F.col(c).cast(nation.schema[c].dataType) for c in nation.columns), F.lit(name).alias("format"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey, list_filter(['size', 'price'], lambda v: (v = 'size' AND NOT p_size >= 10) OR (v = 'price' AND NOT p_retailprice < 950)) AS violations FROM part")
def validate_rows(spark, sf_dir):
    return loaders.validate(table(spark, sf_dir, "part"), {"size": "p_size >= 10", "price": "p_retailprice < 950"}, strict=False).select("p_partkey", "violations")
