"""Registered queries over indexes, phases, adaptation, prompts and sources, and their SQL."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from ..functions import measures as m
from ..operators import adapt, index, phases, retrieval, stored, synthesis
from ..sources import dumpers, loaders, store
from .catalog import BRANDS, LIN, PART_SCORES, PRICE, brand_queries, part_cases, part_measure, plain, query, r6, ranked_sql, rounded, sql_r6, table
from .filters import And, Eq, In, Like, Not

_PRICE = rounded(m.transpose(m.linear(100), lambda c: c["price"]))


def part_rows(spark, sf_dir):
    return part_cases(spark, sf_dir).select(F.col("case_id").alias("key"), "case.*")


CHANGED = "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice, p_size, p_brand FROM part WHERE p_brand <> 'Brand#3'"


@query(ranked_sql(PART_SCORES.replace("FROM part c", f"FROM ({CHANGED}) c"), "rank <= 5"))
def retrieve_persist(spark, sf_dir):
    """Queries without cases, answered from an index that was changed after it was put."""
    rows, kept = part_rows(spark, sf_dir), index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(rows)
    kept.patch(upsert=rows.where("brand = 'Brand#2'").withColumn("price", F.col("price") + 1), delete=rows.where("brand = 'Brand#3'"))
    retriever = stored.Persisted(retrieval.dropout(retrieval.build(rounded(part_measure())), limit=5), kept, ["price", "size", "brand"])
    return plain(retriever.apply_queries(brand_queries(spark, sf_dir)).final)


@query("SELECT p_partkey AS key, CASE WHEN p_brand = 'Brand#4' THEN 'none' ELSE p_brand END AS brand, CASE WHEN p_brand = 'Brand#1' THEN p_retailprice * 2 ELSE p_retailprice END AS price, p_size::DOUBLE AS size FROM part WHERE p_brand <> 'Brand#2'")
def index_put_again(spark, sf_dir):
    """A put over an index writes what differs; a replacement by filter comes on top."""
    rows, kept = part_rows(spark, sf_dir), index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(rows)
    changed = rows.where("brand != 'Brand#2'").withColumn("price", F.when(F.col("brand") == "Brand#1", F.col("price") * 2).otherwise(F.col("price")))
    kept.put(changed)
    kept.put(changed)
    kept.replace_where(Eq("brand", "Brand#4"), changed.where("brand = 'Brand#4'").withColumn("brand", F.lit("none")))
    return kept.read().select("key", "brand", "price", "size")


@query("SELECT p_partkey AS key, p_brand IN ('Brand#1', 'Brand#2') AS changed FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def index_diff(spark, sf_dir):
    """Keys that a put would delete, and those that it would write."""
    rows, kept = part_rows(spark, sf_dir), index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(rows)
    stale, changed = kept.diff(rows.where("brand != 'Brand#3'").withColumn("size", F.when(F.col("brand").isin("Brand#1", "Brand#2"), F.col("size") + 1).otherwise(F.col("size"))))
    return stale.select("key", F.lit(False).alias("changed")).unionByName(changed.select("key", F.lit(True).alias("changed")))


@query("SELECT p_partkey AS key FROM part WHERE p_name LIKE '%e%' AND NOT p_brand IN ('Brand#1', 'Brand#5')")
def index_keys_where(spark, sf_dir):
    kept = index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_brand"))
    return kept.keys_where(And(Like("p_name", "%e%"), Not(In("p_brand", ("Brand#1", "Brand#5")))))


_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_FOUND = f"""WITH d AS (SELECT p_partkey AS k, {_TERMS.format("p_name || ' ' || p_type")} AS t FROM part WHERE p_brand <> 'Brand#1'), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
    p AS (SELECT k, term, count(*) AS tf, any_value(l) AS l FROM (SELECT k, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT p_name AS query_id, unnest({_TERMS.format("p_name")}) AS term FROM part),
    s AS (SELECT query_id, k AS case_id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * l / a))) AS sim FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY ALL),
    w AS (SELECT *, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM s)"""


@query(f"{_FOUND} SELECT query_id, case_id, {sql_r6('CASE WHEN hi - lo < 1e-9 THEN 1e0 ELSE (sim - lo) / (hi - lo) END')} AS sim FROM w")
def search_storage_sparse(spark, sf_dir):
    """Every name of a part against the indexed names and types, filtered and scaled."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("value"), "p_brand")
    retriever = stored.StorageRetriever(index.ParquetIndex(spark, store.new_folder(spark)), "sparse", where=Not(Eq("p_brand", "Brand#1")))
    retriever.put(rows)
    queries = part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    return retriever.apply_queries(queries).select("query_id", "case_id", r6(F.col("sim")).alias("sim"))


_TOP2 = ranked_sql(PART_SCORES, "rank <= 2")


@query(f"""WITH n AS (SELECT k.query_id, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY k.query_id, k.rank) AS case_id, p_retailprice AS price FROM ({_TOP2}) k JOIN part ON p_partkey = k.case_id), b AS ({BRANDS})
    SELECT b.query_id, n.case_id, n.query_id = b.query_id AS is_new, {sql_r6(LIN.format('n.price', 'b.price', '100e0'))} AS sim FROM n JOIN b ON n.query_id <= b.query_id
    UNION ALL SELECT b.query_id, p_partkey, false, {sql_r6(LIN.format('p_retailprice', 'b.price', '100e0'))} FROM part CROSS JOIN b""")
def retain_indexed(spark, sf_dir):
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    kept = index.ParquetIndex(spark, store.new_folder(spark))
    kept.put(part_rows(spark, sf_dir))
    found = retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=2)).steps[-1].scores
    return phases.retain_indexed(kept, _PRICE, ["price", "size", "brand"])(store.stored(found)).select("query_id", "case_id", "is_new", "sim")


_MEAN = "(p_retailprice + price) / 2"


@query(f"SELECT query_id, case_id, {sql_r6(f'({_MEAN} + price) / 2')} AS price, {sql_r6(LIN.format(f'(({_MEAN} + price) / 2)', 'price', '100e0'))} AS sim FROM (SELECT s.*, c.p_retailprice, q.price FROM ({ranked_sql(PART_SCORES + ' WHERE c.p_size >= 10', 'rank <= 3')}) s JOIN part c ON c.p_partkey = s.case_id JOIN ({BRANDS}) q ON q.query_id = s.query_id)")
def system_cycle(spark, sf_dir):
    """A system with named phases over some of its cases; reuse and revision both go half the way to the query."""
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    half = adapt.attribute_value({"price": adapt.aggregate("mean")})
    price = m.transpose(m.linear(100), lambda c: c["price"])
    system = phases.System(cases, {"top": retrieval.dropout(retrieval.build(rounded(part_measure())), limit=3)}, {"half": phases.reuse(half, price)}, {"again": phases.revise(half, price)})
    done = system.cycle(queries, cases.where("case.size >= 10")).final
    return done.select("query_id", "case_id", r6(F.col("case.price")).alias("price"), r6(F.col("sim")).alias("sim"))


_S = lambda a: LIN.format(f"({a})", "y", "100e0")


@query(f"""WITH a AS (SELECT p_partkey, query_id, p_retailprice AS c0, price AS y FROM part CROSS JOIN ({BRANDS})), b AS (SELECT *, CASE WHEN {_S("(c0 + y) / 2")} >= {_S("c0")} + 0.01e0 THEN (c0 + y) / 2 ELSE c0 END AS c1 FROM a),
    d AS (SELECT *, CASE WHEN {_S("c1 + 20")} >= {_S("c1")} + 0.01e0 THEN c1 + 20 ELSE c1 END AS c2 FROM b) SELECT p_partkey, query_id, {sql_r6("c2")} AS price, {sql_r6("y")} AS other FROM d""")
def adapt_pipe(spark, sf_dir):
    """A change is accepted only if it brings the price nearer to that of the query."""
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    gated = adapt.pipe([adapt.aggregate("mean"), lambda case, query: case + 20], m.linear(100), delta=0.01, compare_to="query")
    x, y = F.col("case.price"), F.col("query.price")
    return paired.select(F.col("case_id").alias("p_partkey"), "query_id", r6(gated(x, y)).alias("price"), r6(adapt.null("query")(x, y)).alias("other"))


_STARTS = "CASE WHEN starts_with(p_type, 'S') THEN {0} ELSE p_name END"


@query(f"""SELECT p_partkey, {_STARTS.format("regexp_replace(p_name, '[aeiou]', '#', 'g')")} AS whole, {_STARTS.format("regexp_replace(regexp_replace(p_name, '[aeiou]', '#'), '[aeiou]', '#')")} AS twice,
    {_STARTS.format("regexp_replace(p_name, '[aeiou]', '<' || substr(p_type, 1, 2) || '>', 'g')")} AS called FROM part""")
def adapt_strings(spark, sf_dir):
    x, y = F.col("p_name"), F.col("p_type")
    of = {"whole": adapt.regex("[aeiou]", "^S", "#"), "twice": adapt.regex("[aeiou]", "^S", "#", count=2), "called": adapt.regex("[aeiou]", "^S.", lambda case, query: f"<{query[0]}>")}
    return table(spark, sf_dir, "part").select("p_partkey", *(f(x, y).alias(k) for k, f in of.items()))


@query(f"SELECT query_id, case_id, sim FROM ({PART_SCORES}) JOIN part ON p_partkey = case_id AND p_brand = query_id")
def retrieve_membership(spark, sf_dir):
    """Each query has cases of its own."""
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    own = cases.select(F.col("case.brand").alias("query_id"), "case_id")
    return retrieval.apply_queries(cases, queries, retrieval.build(rounded(part_measure())), membership=own).steps[-1].scores.select("query_id", "case_id", "sim")


@query(f"SELECT s.query_id, s.case_id, s.sim, c.p_size AS size FROM ({PRICE}) s JOIN part c ON c.p_partkey = s.case_id")
def retrieve_transpose(spark, sf_dir):
    """Scored by the price alone; whole cases come back."""
    paired = retrieval.pairs(part_cases(spark, sf_dir), brand_queries(spark, sf_dir))
    scores = retrieval.transpose(retrieval.build(rounded(m.linear(100))), lambda v: v["price"])(paired)
    return scores.select("query_id", "case_id", "sim", F.col("case.size").cast("int").alias("size"))


@query(f"SELECT s.query_id, s.case_id, {sql_r6("len(list_intersect(list_distinct(string_split(p_type, '')), list_distinct(string_split(p_brand, '')))) / 10e0")} AS sim FROM ({ranked_sql(PART_SCORES, 'rank <= 20')}) s JOIN (SELECT p_partkey, p_type FROM part WHERE p_type <> 'SMALL') c ON c.p_partkey = s.case_id JOIN (SELECT DISTINCT p_brand FROM part) q ON p_brand = s.query_id")
def retrieve_rerank(spark, sf_dir):
    """The first 20 of each query rescored by a Python function of whole lists of texts; a null drops the case."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    cases, queries = retrieval.cases_of(part, "p_partkey"), brand_queries(spark, sf_dir)
    first = retrieval.dropout(retrieval.build(rounded(part_measure())), limit=20)
    text = lambda c: F.coalesce(F.get_json_object(F.to_json(c), "$.type"), F.get_json_object(F.to_json(c), "$.brand"))
    again = retrieval.rerank(first, lambda q, texts: [None if t == "SMALL" else len(set(t) & set(q)) / 10 for t in texts], text)
    return retrieval.apply_queries(cases, queries, again).steps[-1].scores.select("query_id", "case_id", r6(F.col("sim")).alias("sim"))


@query(f"""WITH c AS (SELECT query_id, (rank - 1) // 4 AS chunk, upper(string_agg('case ' || case_id, ', ' ORDER BY rank)) AS response FROM ({ranked_sql(PART_SCORES, 'rank <= 10')}) GROUP BY ALL)
    SELECT query_id, 'Merge.\n\n## Partial Results\n\n' || string_agg('### Result ' || (chunk + 1) || '\n\n' || response, '\n\n' ORDER BY chunk) AS prompt FROM c GROUP BY query_id""")
def synthesis_pooling(spark, sf_dir):
    """The ranking in chunks, a response to each from a Python generator, and the prompt that pools them."""
    cases, queries = part_cases(spark, sf_dir), brand_queries(spark, sf_dir)
    found = retrieval.apply_queries(cases, queries, retrieval.dropout(retrieval.build(rounded(part_measure())), limit=10)).steps[-1].scores
    parts = synthesis.chunks(found, 4).groupBy("query_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "case_id"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("case "), x["case_id"].cast("string"))), ", ")
    prompts = parts.select(F.struct("query_id", "chunk").alias("query_id"), lines.alias("prompt"))
    answers = synthesis.generate(prompts, synthesis.pipe(str.upper, str.strip)).select("query_id.query_id", "query_id.chunk", "response")
    return synthesis.pooling_prompt(answers, "Merge.")


@query("""SELECT n_nationkey, '```json\n' || to_json({'name': n_name, 'region': n_regionkey}) || '\n```' AS text FROM nation""")
def dump_markdown(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", dumpers.markdown(dumpers.as_json(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("text"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS format, n_nationkey, n_name FROM nation" for k in ("json", "list", "toml", "yaml", "xml", "directory")))
def sources_by_suffix(spark, sf_dir):
    """The nations through files of each format that is read by its suffix, and through a directory of files."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    shared = store.shared_folder(spark)
    folder = tempfile.mkdtemp(dir=shared[len("file:") :].replace("//", "/") if shared.startswith("file:") else shared)
    for suffix in ("toml", "yaml"):
        dumpers.path(nation, f"{folder}/rows.{suffix}")
    rows = {r["key"]: {"name": r["name"]} for r in nation.toLocalIterator()}  # a table of fixed size
    for name, text in {"rows.json": json.dumps(rows), "list.json": json.dumps([{"n": int(k), **v} for k, v in rows.items()]), "rows.xml": "<r>" + "".join(f"<n{k}><name>{v['name']}</name></n{k}>" for k, v in rows.items()) + "</r>"}.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    dumpers.path(nation.select(F.concat("key", F.lit(".json")).alias("key"), F.to_json(F.struct("name")).alias("value")), f"{folder}/many")
    read = lambda name: loaders.path(spark, f"{folder}/{name}")
    parts = {"json": read("rows.json"), "list": read("list.json").withColumn("key", F.col("n")), "toml": read("rows.toml"), "yaml": read("rows.yaml"), "xml": read("rows.xml").withColumn("key", F.substring("key", 2, 9)), "directory": read("many").withColumn("name", F.get_json_object("value", "$.name"))}
    out = None
    for k, df in parts.items():
        part = df.select(F.lit(k).alias("format"), F.col("key").cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("name").alias("n_name"))
        out = part if out is None else out.unionByName(part)
    return out
