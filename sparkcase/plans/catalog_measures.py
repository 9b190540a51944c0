"""Registered queries over measures, poolings, taxonomies and graphs, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import graphs, measures as m, pooling, taxonomy
from ..operators import evaluation, index, retrieval
from ..sources import store
from .catalog import BM25, BRANDS, LIN, NAMES, PRICE, SIZE, brand_queries, name_pairs, part_cases, query, r6, ranked_sql, rounded, sql_r6, table

FOUR = "[l_quantity / 50, l_discount * 10, l_tax * 10, 0.5]"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {FOUR} AS a, list_sort({FOUR}) AS s FROM lineitem),
    n AS (SELECT *, list_transform(a, lambda v: len(list_filter(a, lambda u: u = v))) AS n FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_r6("(a[1] + a[2] + a[3] + a[4]) / 4")} AS fmean, {sql_r6("s[2]")} AS median_low, {sql_r6("s[3]")} AS median_high, {sql_r6("a[list_position(n, list_max(n))]")} AS mode,
    {sql_r6("s[2]")} AS k_min_2, {sql_r6("s[4]")} AS k_min_9, {sql_r6("s[1]")} AS k_max_9, {sql_r6("s[4]")} AS minkowski_inf FROM n""")
def pool_order(spark, sf_dir):
    a = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5))
    of = {**{k: pooling.POOLINGS[k] for k in ("fmean", "median_low", "median_high", "mode")}, "k_min_2": pooling.k_min(2), "k_min_9": pooling.k_min(9), "k_max_9": pooling.k_max(9), "minkowski_inf": pooling.minkowski(float("inf"))}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.cast("array<double>").alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(r6(f(F.col("a"))).alias(k) for k, f in of.items()))


TYPED = f"CASE WHEN {{0}} = 'BUILDING' AND {{1}} = 'BUILDING' THEN {LIN.format('c_acctbal', '1000', '5000e0')} WHEN {{0}} = 'HOUSEHOLD' AND {{1}} = 'FURNITURE' THEN 0.25e0 ELSE 0e0 END"


@query(f"""SELECT c_custkey, s AS segment, {sql_r6(TYPED.format("c_mktsegment", "s"))} AS type_table, {sql_r6(TYPED.format("s", "c_mktsegment"))} AS reversed,
    CASE WHEN (c_mktsegment, s) IN (('BUILDING', 'MACHINERY'), ('MACHINERY', 'BUILDING')) THEN 0.6e0 ELSE 0.1e0 END AS string_table,
    CASE WHEN s = 'MACHINERY' AND c_mktsegment = 'MACHINERY' THEN 0.75e0 ELSE 0.5e0 END AS attribute_table FROM customer CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def sim_tables(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    segments = customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    x, y = F.struct(F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value")), F.struct(F.col("segment").alias("kind"), F.lit(1000.0).alias("value"))
    typed = m.type_table({"BUILDING": m.transpose_value(m.linear(5000)), ("HOUSEHOLD", "FURNITURE"): m.static(0.25)}, default=0.0)
    strings = m.string_table({("building", "MACHINERY"): 0.6}, default=0.1, case_sensitive=False)
    attributes = m.attribute_table({"MACHINERY": m.static(0.75)}, "kind", default=m.static(0.5))
    swapped = m.reverse(m.type_table({"BUILDING": m.transpose(m.linear(5000), lambda c: c["value"]), ("HOUSEHOLD", "FURNITURE"): m.static(0.25)}, default=0.0))
    return customer.crossJoin(F.broadcast(segments)).select("c_custkey", "segment", r6(typed(x, y)).alias("type_table"), r6(swapped(x, y)).alias("reversed"), strings(x["kind"], y["kind"]).alias("string_table"), attributes(x, y).alias("attribute_table"))


PLACES = """SELECT a.n AS x, b.n AS y, a.d AS da, b.d AS db, CASE WHEN a.n = b.n THEN a.d WHEN a.r = b.r THEN 1 ELSE 0 END AS l FROM ({0}) a CROSS JOIN ({0}) b""".format("SELECT 'WORLD' AS n, NULL AS r, 0 AS d UNION ALL SELECT r_name, r_name, 1 FROM region UNION ALL SELECT n_name, r_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey")


@query(f"""SELECT x, y, {sql_r6("CASE WHEN da + db = 0 THEN 1e0 ELSE 2e0 * l / (da + db) END")} AS wu_palmer, {sql_r6("l / 2e0")} AS weights_pessimistic, {sql_r6("CASE WHEN l IN (da, db) THEN (da + db) / 4e0 ELSE l / 2e0 END")} AS weights_average,
    {sql_r6("(l + 1e0) / (greatest(da, db) + 1)")} AS levels_pessimistic, {sql_r6("(l + 1e0) / ((da + db + 2) / 2e0)")} AS levels_average, {sql_r6("(6 - ((da - l) * 2e0 + (db - l))) / 6")} AS paths FROM ({PLACES})""")
def sim_taxonomy_strategies(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("children")).orderBy("r_name")
    # A taxonomy is a small tree by definition; this one has as many rows as there are regions.
    tree = {"name": "WORLD", "children": [{"name": r["r_name"], "children": list(r["children"])} for r in joined.collect()]}
    of = {"wu_palmer": taxonomy.wu_palmer(), "weights_pessimistic": taxonomy.weights("auto", "pessimistic"), "weights_average": taxonomy.weights("auto", "average"), "levels_pessimistic": taxonomy.levels("pessimistic"), "levels_average": taxonomy.levels("average"), "paths": taxonomy.paths(2, 1)}
    names = spark.createDataFrame([(n,) for n in sorted(taxonomy.Taxonomy(tree).entries)], "x string")
    both = names.crossJoin(F.broadcast(names.withColumnRenamed("x", "y")))
    return both.select("x", "y", *(r6(taxonomy.build(tree, f)(F.col("x"), F.col("y"))).alias(k) for k, f in of.items()))


@query(f"""WITH RECURSIVE r AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0::BIGINT) AS known FROM ({NAMES})
    UNION ALL SELECT x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(known[k], CASE WHEN k > 1 AND substr(y, (k - 1)::INT, 1) = substr(x, i + 1, 1) THEN known[k - 1] + 1 ELSE 0 END)))) FROM r WHERE i < length(x))
    SELECT x, y, {sql_r6("2e0 * known[length(y) + 1] / (length(x) + length(y))")} AS levenshtein FROM r WHERE i = length(x)""")
def sim_levenshtein(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("x", "y", r6(m.levenshtein()(F.col("x"), F.col("y"))).alias("levenshtein"))


# Texts as vectors: which of these pairs of letters they contain; all ones where none occurs.

LETTERS = ("qu", "zz", "ck", "ph", "mb", "gh", "ou", "ee", "ll", "rs")
OTHERS = ("an", "ti", "us", "xe", "do", "lo")


def flags(text: str, words) -> str:
    hits = "[" + ", ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN 1e0 ELSE 0e0 END" for w in words) + "]"
    return f"(CASE WHEN list_max({hits}) > 0 THEN {hits} ELSE [{', '.join('1e0' for _ in words)}] END)"


def dot(a: str, b: str, n: int) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(1, n + 1)) + ")"


def cos(a: str, b: str, n: int) -> str:
    return f"{dot(a, b, n)} / (sqrt({dot(a, a, n)}) * sqrt({dot(b, b, n)}))"


_ALL = len(LETTERS) + len(OTHERS)


@query(f"SELECT x, y, {sql_r6(f'greatest(0, least(1, ({cos("u", "v", _ALL)} + 1) / 2))')} AS embedded FROM (SELECT x, y, list_concat({flags('x', LETTERS)}, {flags('x', OTHERS)}) AS u, list_concat({flags('y', LETTERS)}, {flags('y', OTHERS)}) AS v FROM ({NAMES}))")
def sim_embedded(spark, sf_dir):
    embedder = m.concat_embeddings(m.keyword_embedder(LETTERS), m.keyword_embedder(OTHERS))
    return name_pairs(spark, sf_dir).select("x", "y", r6(m.embed(embedder, m.cosine())(F.col("x"), F.col("y"))).alias("embedded"))


@query(f"SELECT DISTINCT p_name AS text, list_aggregate(list_transform({flags('p_name', LETTERS)}, lambda v: v::INT::VARCHAR), 'string_agg', ',') AS vector FROM part")
def embed_cached(spark, sf_dir):
    """Half of the names first, then all: the cache gives the first half, the rest is embedded."""

    def embedder(frames):
        for f in frames:
            hits = [[float(w in t.lower()) for w in LETTERS] for t in f.text]
            yield pd.DataFrame({"text": f.text, "vector": [h if any(h) else [1.0] * len(h) for h in hits]})

    texts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    cache = index.ParquetIndex(spark, store.new_folder(spark))
    index.cached_embeddings(texts.where("p_partkey % 2 = 0"), cache, embedder, "letters")
    return index.cached_embeddings(texts, cache, embedder, "letters").select("text", F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",").alias("vector"))


_DENSE = f"SELECT item_id AS query_id, doc_id AS case_id, 1 / (1 + (1 - {cos('u', 'v', len(LETTERS))})) AS sim FROM (SELECT doc_id, {flags('text', LETTERS)} AS u FROM documents) CROSS JOIN (SELECT item_id, {flags('text', LETTERS)} AS v FROM benchmark)"


@query(f"""WITH f AS (SELECT query_id, case_id, sum(part) AS sim FROM (SELECT query_id, case_id, 0.7e0 / (60 + rank) AS part FROM ({ranked_sql(_DENSE, 'rank <= 40')}) UNION ALL SELECT query_id, case_id, 0.3e0 / (60 + rank) FROM ({ranked_sql(BM25, 'rank <= 40')})) GROUP BY ALL),
    w AS (SELECT *, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM ({ranked_sql('SELECT * FROM f', 'rank <= 10')}))
    SELECT query_id, case_id, {sql_r6("CASE WHEN lo = hi THEN 1e0 ELSE (sim - lo) / (hi - lo) END")} AS sim FROM w""")
def search_hybrid(spark, sf_dir):
    documents, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    embedder = m.keyword_embedder(LETTERS)
    cases = documents.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("ord"), "text")
    queries = passages.select(F.col("item_id").alias("query_id"), "text")
    near = index.dense(cases.withColumn("vector", embedder(F.col("text"))), queries.withColumn("vector", embedder(F.col("text"))), limit=40)
    terms = index.bm25(cases, queries, every=False, normalized=False, limit=40, slack=1e-3).withColumn("sim", F.floor(F.col("sim") * 1e4 + 0.5) / 1e4)
    return index.hybrid(near, terms, 10).select("query_id", "case_id", r6(F.col("sim")).alias("sim"))


# Events of a user against those of the next: assignment, windows and alignments; the tables of the alignments are
# filled by diagonals.

_INF = "1e300"
_D = "(d + 1 - i)"  # place in y of the cell i of the new diagonal
_EDGE = f"i = 0 OR {_D} < 1 OR {_D} > m"
_PX, _PY = "(CASE WHEN i > 1 THEN x[i - 1] ELSE 0 END)", f"(CASE WHEN {_D} > 1 THEN y[{_D} - 1] ELSE 0 END)"
_TX, _TY = "greatest(i - 2, 0)", f"greatest({_D} - 2, 0)"
_TWED = f"""least(abs(x[i] - y[{_D}]) + abs({_PX} - {_PY}) + 0.001e0 * (abs((i - 1) - ({_D} - 1)) + abs({_TX} - {_TY})) + t2[i],
    least(abs(x[i] - {_PX}) + 0.001e0 * ((i - 1) - {_TX}) + 1 + t1[i], abs(y[{_D}] - {_PY}) + 0.001e0 * (({_D} - 1) - {_TY}) + 1 + t1[i + 1]))"""


@query(f"""WITH RECURSIVE u AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS k, list(value::DOUBLE ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
    p AS (SELECT a.user_id, a.k, b.k AS l, a.v AS x, b.v AS y, len(a.v) AS n, len(b.v) AS m FROM u a JOIN u b ON b.user_id = a.user_id + 1),
    r AS (SELECT *, 0::BIGINT AS d, list_transform(range(n + 1), lambda i: {_INF}) AS d2, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 0e0 ELSE {_INF} END) AS d1,
            list_transform(range(n + 1), lambda i: {_INF}) AS t2, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 0e0 ELSE {_INF} END) AS t1,
            list_transform(range(n + 1), lambda i: 0e0) AS s2, list_transform(range(n + 1), lambda i: 0e0) AS s1, 0e0 AS best FROM p
        UNION ALL SELECT user_id, k, l, x, y, n, m, d + 1, d1, nd, t1, nt, s1, ns, CASE WHEN d + 1 - m BETWEEN 0 AND n THEN greatest(best, ns[d + 1 - m + 1]) ELSE best END
        FROM (SELECT *, list_transform(range(n + 1), lambda i: CASE WHEN {_EDGE} THEN {_INF} ELSE abs(x[i] - y[{_D}]) + least(d2[i], d1[i], d1[i + 1]) END) AS nd,
            list_transform(range(n + 1), lambda i: CASE WHEN {_EDGE} THEN {_INF} ELSE {_TWED} END) AS nt,
            list_transform(range(n + 1), lambda i: CASE WHEN {_EDGE} THEN 0e0 ELSE greatest(0e0, s2[i] + CASE WHEN k[i] = l[{_D}] THEN 1e0 ELSE 0e0 END, s1[i + 1] - 1, s1[i] - 1) END) AS ns FROM r WHERE d < n + m)),
    q AS (SELECT *, list_transform(k, lambda a: coalesce(list_position(l, a), 0)) AS pos FROM p),
    c AS (SELECT *, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: coalesce(list_sum(list_transform(range(i + 1, n + 1), lambda j: CASE WHEN pos[i] < pos[j] THEN 1 ELSE -1 END)), 0))), 0) / (n * (n - 1) / 2e0) AS share FROM q)
    SELECT c.user_id, {sql_r6("list_sum(list_transform(list_distinct(c.l), lambda t: least(len(list_filter(c.k, lambda a: a = t)), len(list_filter(c.l, lambda a: a = t))))) / len(c.l)::DOUBLE")} AS mapping,
    {sql_r6("CASE WHEN c.n <> c.m OR c.n < 2 THEN 0e0 WHEN share >= 0 THEN share ELSE -share * 0.5e0 END")} AS correctness,
    {sql_r6("list_max(list_transform(range(abs(c.n - c.m) + 1), lambda h: list_sum(list_transform(range(1, least(c.n, c.m) + 1), lambda i: CASE WHEN (c.n > c.m AND c.k[h + i] = c.l[i]) OR (c.n <= c.m AND c.k[i] = c.l[h + i]) THEN 1e0 ELSE 0e0 END)) / least(c.n, c.m)))")} AS sequence_mapping,
    {sql_r6("1 / (1 + d1[c.n + 1])")} AS dtw, {sql_r6("1 / (1 + t1[c.n + 1])")} AS twed, {sql_r6("least(1e0, best / c.m)")} AS smith_waterman FROM c JOIN r ON r.user_id = c.user_id AND r.d = c.n + c.m""")
def sim_sequences(spark, sf_dir):
    from .catalog import user_series

    pairs = user_series(spark, sf_dir)
    x, y, u, v = F.col("kinds"), F.col("next.kinds"), F.col("values"), F.col("next.values")
    return pairs.select(
        "user_id", r6(m.mapping()(x, y)).alias("mapping"), r6(m.sequence_correctness(0.5)(x, y)).alias("correctness"), r6(m.sequence_mapping(m.equality())(x, y)["value"]).alias("sequence_mapping"),
        r6(m.dtw(pairs=False)(u, v)).alias("dtw"), r6(m.twed(pairs=False)(u, v)).alias("twed"), r6(m.smith_waterman(pairs=False)(x, y)).alias("smith_waterman"),
    )


# Graphs without edges: the best mapping pairs equal labels, as often as both sides have them.

METHODS = ("astar", "greedy", "lap", "qap", "dfs", "vf2")
_SHARE = sql_r6("list_sum(list_transform(list_distinct(l), lambda t: least(len(list_filter(k, lambda a: a = t)), len(list_filter(l, lambda a: a = t))))) / len(l)::DOUBLE")


@query(f"WITH c AS (SELECT conv_id, list(role) AS k FROM conversations GROUP BY conv_id) SELECT conv_id, {', '.join(f'{_SHARE} AS {n}' for n in METHODS)} FROM (SELECT a.conv_id, a.k, b.k AS l FROM c a JOIN c b ON b.conv_id = a.conv_id + 1)")
def sim_graph_nodes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    nodes = F.transform("t", lambda r, i: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("key"), r["role"].alias("value")))
    g = F.struct(nodes.alias("nodes"), F.array().cast("array<struct<key: string, source: string, target: string, value: string>>").alias("edges"))
    bags = turns.select("conv_id", g.alias("g"))
    after = bags.select((F.col("conv_id") - 1).alias("conv_id"), F.col("g").alias("next"))
    same = graphs.Setting(node_matcher=lambda a, b: a == b)
    return bags.join(after, "conv_id").select("conv_id", *(r6(graphs.graph_measure(k, same)(F.col("g"), F.col("next"))["value"]).alias(k) for k in METHODS))


# Evaluation: judgements by price, a run by size.

_JUDGED = f"""s AS ({PRICE}), z AS ({SIZE}), j AS (SELECT s.query_id, s.case_id, CAST(floor(s.sim * 4) AS INT) AS rel, z.sim, row_number() OVER (PARTITION BY s.query_id ORDER BY z.sim DESC, s.case_id) AS k FROM s JOIN z USING (query_id, case_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS ideal, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY k) AS hits2 FROM j),
    q AS (SELECT query_id, count(*) FILTER (rel >= 1 AND k <= 10) AS h, count(*) FILTER (rel >= 1) AS r, count(*) FILTER (rel >= 2) AS r2, sum(CASE WHEN rel >= 2 AND k <= 10 THEN hits2 / k::DOUBLE ELSE 0 END) AS ap, min(k) FILTER (rel >= 1 AND k <= 10) AS first,
        sum(CASE WHEN rel >= 1 AND k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel >= 1 AND ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg, avg(sim) FILTER (k <= 10) AS top FROM o GROUP BY query_id),
    p AS (SELECT a.query_id, a.k <= 50 AND b.k <= 50 AS seen, a.rel <> b.rel AS judged, (a.sim - b.sim) * (a.rel - b.rel) > 0 AS ok, a.rel >= 1 AND b.rel >= 1 AS relevant, sign(a.sim - b.sim) AS x, sign(a.rel - b.rel) AS y FROM j a JOIN j b ON a.query_id = b.query_id AND a.case_id < b.case_id),
    c AS (SELECT query_id, count(*) FILTER (judged AND ok) AS c, count(*) FILTER (judged AND NOT ok) AS d, count(*) FILTER (judged AND seen) AS s, count(*) FILTER (judged) AS t, sum(x * y) FILTER (seen AND relevant) AS xy, sum(abs(x)) FILTER (seen AND relevant) AS nx, sum(abs(y)) FILTER (seen AND relevant) AS ny FROM p GROUP BY query_id)"""
_VALUES = {
    "precision@10": "SELECT avg(h / 10e0) FROM q", "recall@10": "SELECT avg(CASE WHEN r > 0 THEN h / r::DOUBLE ELSE 0 END) FROM q", "map@10-l2": "SELECT avg(CASE WHEN r2 > 0 THEN ap / r2 ELSE 0 END) FROM q", "ndcg@10": "SELECT avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) FROM q",
    "mrr@10": "SELECT avg(coalesce(1e0 / first, 0)) FROM q", "hit_rate@10": "SELECT avg(CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END) FROM q", "hits@10": "SELECT avg(h) FROM q", "mean_score@10": "SELECT avg(top) FROM q",
    "correctness": "SELECT avg(CASE WHEN c + d > 0 THEN (c - d) / (c + d)::DOUBLE ELSE 0 END) FROM c", "completeness@50": "SELECT avg(CASE WHEN t > 0 THEN s / t::DOUBLE ELSE 0 END) FROM c", "kendall_tau@50": "SELECT avg(xy / sqrt(nx * ny::DOUBLE)) FROM c WHERE nx > 0 AND ny > 0",
}


@query(f"WITH {_JUDGED} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {sql_r6(f'({v})')} AS value" for k, v in _VALUES.items()))
def eval_compute(spark, sf_dir):
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    price = retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"])))(paired)
    size = retrieval.build(rounded(m.transpose(m.linear(50), lambda c: c["size"])))(paired)
    qrels = store.stored(price.select("query_id", "case_id", F.floor(F.col("sim") * 4).cast("int").alias("rel")))
    run = store.stored(size.select("query_id", "case_id", "sim"))
    return evaluation.compute(qrels, run, list(_VALUES)).select("metric", r6(F.col("value")).alias("value"))


_PLACED = f"SELECT query_id, case_id, rank FROM ({ranked_sql(PRICE)})"


@query(f"SELECT query_id, case_id, (count(*) OVER (PARTITION BY query_id) - rank + 1)::INT AS rel FROM ({_PLACED})")
def eval_retrieval_to_qrels(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    found = retrieval.apply_queries(cases, queries, retrieval.build(rounded(m.transpose(m.linear(100), lambda c: c["price"]))))
    return evaluation.retrieval_to_qrels(found, max_qrel=None)[0]


@query(f"WITH q AS ({BRANDS}) SELECT query_id, p_partkey AS case_id, {sql_r6('jaro_similarity(p_type, query_id)')} AS sim FROM part CROSS JOIN q")
def score_distinct(spark, sf_dir):
    paired = retrieval.pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("case")), brand_queries(spark, sf_dir).select("query_id", F.col("query_id").alias("query")))
    return retrieval.distinct_scores(paired, m.jaro()).select("query_id", "case_id", r6(F.col("sim")).alias("sim"))
