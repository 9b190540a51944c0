import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkcase.functions import measures as m, pooling
from sparkcase.operators import adapt, evaluation, index, phases, retrieval, stored, synthesis
from sparkcase.plans import queries as catalog
from sparkcase.plans.catalog import brand_queries
from sparkcase.plans.filters import And, Eq, In, Like, Not, Or, compile_filter
from sparkcase.sources import dumpers, loaders
from sparkcase.streaming import retention


@pytest.fixture(scope="module")
def cars(spark):
    rows = spark.createDataFrame([(0, 12000, 2008), (1, 9000, 2012), (2, 11000, 2010)], "k long, price int, year int")
    query = spark.createDataFrame([(7, 10000, 2010)], "k long, price int, year int")
    return retrieval.cases_of(rows, "k"), retrieval.queries_of(query, "k")


CARS = m.attribute_value({"price": m.linear(100000), "year": m.linear(50)})


def test_ranking(cars):
    rows = retrieval.apply_queries(*cars, retrieval.build(CARS)).final.orderBy("rank").collect()
    assert [r.case_id for r in rows] == [2, 1, 0]
    assert [r.sim for r in rows] == pytest.approx([0.995, 0.975, 0.97])


def test_ties_keep_the_order(spark, cars):
    rows = retrieval.apply_queries(*cars, retrieval.build(m.static(0.5))).final.orderBy("rank").collect()
    assert [r.case_id for r in rows] == [0, 1, 2]


def test_dropout_and_chain(cars):
    first = retrieval.dropout(retrieval.build(CARS), limit=2)
    second = retrieval.build(m.static(1.0))
    rows = retrieval.apply_queries(*cars, [first, second]).final.orderBy("rank").collect()
    assert [r.case_id for r in rows] == [2, 1]
    bounds = retrieval.dropout(retrieval.build(CARS), min_similarity=0.975, max_similarity=0.98)
    assert [r.case_id for r in retrieval.apply_queries(*cars, bounds).final.collect()] == [1]
    assert retrieval.apply_queries(*cars, retrieval.dropout(retrieval.build(CARS), limit=0)).final.count() == 0


def test_combine(cars):
    a = retrieval.dropout(retrieval.build(CARS), limit=2)
    b = retrieval.dropout(retrieval.build(m.transpose(m.linear(100000), lambda c: c["price"])), limit=1)
    union = retrieval.apply_queries(*cars, retrieval.combine([a, b])).final
    assert {r.case_id for r in union.collect()} == {1, 2}
    assert [r.case_id for r in retrieval.apply_queries(*cars, retrieval.combine([a, b], strategy="intersection")).final.collect()] == [1]


def test_where_and_single_query(cars):
    found = retrieval.apply_query(cars[0], {"price": 10000, "year": 2010}, retrieval.build(CARS), "price int, year int", where=In("case_id", (0, 1))).final
    assert [r.case_id for r in found.orderBy("rank").collect()] == [1, 0]


def test_banded_pairs_lose_nothing(spark):
    a = retrieval.cases_of(spark.range(200).select("id", (F.col("id") * 7 % 101).cast("double").alias("v")), "id")
    b = retrieval.queries_of(spark.range(50).select("id", (F.col("id") * 3 % 97).cast("double").alias("v")), "id")
    on = retrieval.linear_band("v", 10.0, 0.0, 0.5)
    want = {(r.case_id, r.query_id) for r in retrieval.pairs(a, b, on=on).collect()}
    got = [(r.case_id, r.query_id) for r in retrieval.banded_pairs(a, b, "v", 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rerank_and_distinct_scores(cars):
    r = retrieval.rerank(retrieval.build(CARS), lambda q, texts: [float(len(t) % 7) if "2008" not in t else None for t in texts], lambda c: F.to_json(c))
    assert {x.case_id for x in retrieval.apply_queries(*cars, r).final.collect()} == {1, 2}
    paired = retrieval.pairs(*cars).select("query_id", "case_id", "ord", F.col("case.year").alias("case"), F.col("query.year").alias("query"))
    assert {r.case_id: r.sim for r in retrieval.distinct_scores(paired, m.linear(10)).collect()} == pytest.approx({0: 0.8, 1: 0.8, 2: 1.0})


def test_filters(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb"), (3, None)], "n int, s string")
    keys = lambda f: [r.n for r in df.where(compile_filter(f)).orderBy("n").collect()]
    assert keys(Like("s", "a!%b", "!")) == [1]
    assert keys(Like("s", "a%b")) == [1, 2]
    assert keys(And()) == [1, 2, 3] and keys(Or()) == [] and keys(In("n", ())) == []
    assert keys(Not(Eq("s", "axb"))) == [1]
    with pytest.raises(TypeError):
        compile_filter("n = 1")


def test_adapt(spark):
    df = spark.createDataFrame([(10, 20, "Alice is 25 years old.", "Peter is 30 years old.")], "x int, y int, a string, b string")
    x, y, a, b = (F.col(c) for c in "xyab")
    row = df.select(adapt.aggregate("mean", 3, 0.5)(x, y), adapt.regex(r"\d+", r"\d+", "NUMBER")(a, b), adapt.pipe([lambda p, q: p + q, lambda p, q: p * q])(F.lit(2), F.lit(3)), adapt.null("query")(x, y)).first()
    assert row[:] == (20.0, "Alice is NUMBER years old.", 15, 20)
    gated = adapt.pipe([lambda p, q: p + 1, lambda p, q: p + 100], m.linear(10))
    assert df.select(gated(x, y)).first()[0] == 11


def test_adapt_regex_options(spark):
    df = spark.createDataFrame([("a1b22c", "xx7"), ("none", "xx7"), (None, "xx7"), ("a1b22c", "xx")], "a string, b string")
    run = lambda *how, **more: [r[0] for r in df.select(adapt.regex(r"\d+", r"\d", *how, **more)(F.col("a"), F.col("b"))).collect()]
    assert run("$1\\") == ["a$1\\b$1\\c", "none", None, "a1b22c"]
    assert run("N", count=1) == ["aNb22c", "none", None, "a1b22c"]
    assert run(lambda c, q: f"<{c[0]}{q[0]}>") == ["a<17>b<227>c", "none", None, "a1b22c"]
    assert run("N", pos=3)[0] == "a1b22c" and run("N", endpos=2)[0] == "a1b22c" and run("N", pos=2, endpos=3)[0] == "aNbNc"


def test_cycle_and_retain(cars):
    cases, queries = cars
    keep = phases.retain_dropout(phases.retain(cases, CARS), min_similarity=0.98)
    done = phases.cycle(cases, queries, retrieval.dropout(retrieval.build(CARS), limit=2), [phases.reuse(None, CARS)], [], [keep])
    assert {r.case_id for r in done.final.collect()} == {0, 1, 2, 3}
    system = phases.System(cases, {"r": retrieval.build(CARS)})
    assert system.retrieve(queries, [0, 1]).final.count() == 2


def test_eval(spark):
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 0), ("z", "a", 1)], "query_id string, case_id string, rel int")
    run = spark.createDataFrame([("q", "a", 0.9), ("q", "c", 0.8), ("q", "b", 0.5)], "query_id string, case_id string, sim double")
    got = {r.metric: r.value for r in evaluation.compute(qrels, run, ["precision@2", "recall@2", "map", "correctness", "completeness", "mean_score@2", "kendall_tau"]).collect()}
    assert got == pytest.approx({"precision@2": 0.5, "recall@2": 0.5, "map": (1 + 2 / 3) / 2, "correctness": 1 / 3, "completeness": 1.0, "mean_score@2": 0.85, "kendall_tau": 1.0})
    assert evaluation.parse_metric("map@5-l2") == ("map", 5, 2)
    assert evaluation.generate_metrics(["map"], [5], [2]) == ["map@5-l2"]
    ranks = {r.case_id: r.rel for r in evaluation.similarities_to_qrels(run).collect()}
    assert ranks == {"a": 3, "c": 2, "b": 1}
    assert evaluation.score_metric(qrels, run, lambda a, b: float(len(a))).first()[0] == 3.0


def test_index(spark, tmp_path):
    store = index.ParquetIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="put first"):
        store.read()
    rows = spark.createDataFrame([("a", "red sedan car"), ("b", "blue sky"), ("c", "red apple fruit"), ("quote's::0", "x")], "key string, value string")
    store.put(rows)
    store.delete_where(Eq("key", "quote's::0"))
    assert {r.key for r in store.keys_where(Like("value", "%red%")).collect()} == {"a", "c"}
    stale, changed = store.diff(rows.where("key != 'b'").withColumn("value", F.upper("value")))
    assert [r.key for r in stale.collect()] == ["b"] and changed.count() == 3
    store.patch(upsert=spark.createDataFrame([("d", "green")], "key string, value string"), delete=rows.where("key = 'a'"))
    assert {r.key for r in store.read().collect()} == {"b", "c", "d"}
    with pytest.raises(ValueError):
        store.patch(upsert=rows, delete=rows)
    assert [r.key for r in store.stream_rows()] == ["b", "c", "d"]
    vectors = index.cached_embeddings(rows.select(F.col("value").alias("text")), index.ParquetIndex(spark, str(tmp_path / "cache")), lambda frames: (f.assign(vector=[[1.0]] * len(f)) for f in frames), "m")
    assert vectors.count() == 4


def test_index_buckets_versions_and_conflicts(spark, tmp_path):
    store = index.ParquetIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = spark.range(40).select(F.col("id").alias("key"), F.lit("a").alias("value"))
    store.put(rows)
    before, (_, old) = store.read(), store._latest()
    store.upsert(rows.where("key = 7").withColumn("value", F.lit("b")))
    _, new = store._latest()
    assert sum(old["folders"][b] != new["folders"][b] for b in old["folders"]) == 1
    assert before.where("value = 'b'").count() == 0 and store.read().where("value = 'b'").count() == 1
    store.put(rows)
    assert store.read().where("value = 'b'").count() == 0 and store._versions() == [0, 1, 2]
    store.put(rows)
    assert store._versions() == [0, 1, 2]
    with pytest.raises(index.IndexConflict):
        store._commit(2, new)
    assert store._latest()[1] != new
    store.replace_where(In("key", (1, 2)), spark.createDataFrame([(2, "new"), (99, "new")], "key long, value string"))
    assert {r.key for r in store.read().where("value = 'new'").collect()} == {2, 99} and store.read().count() == 40
    store.patch()
    store.delete(rows.where("key = 1000"))
    assert store.prune(keep=1) == 0 and store.prune(keep=1, older_than=-1.0) > 0
    assert len(store._versions()) == 1 and store.read().count() == 40
    store.delete_where(In("key", tuple(range(100))))
    assert store.has_index() and store.read().count() == 0


def test_index_stays_readable_while_it_is_written(spark, tmp_path):
    import threading

    store = index.ParquetIndex(spark, str(tmp_path / "index"), buckets=2)
    rows = spark.range(50).select(F.col("id").alias("key"), F.lit(0).alias("version"))
    store.put(rows)
    wrong, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen = store.read().groupBy("version").count().collect()
            if len(seen) != 1 or seen[0][1] != 50:
                wrong.append(seen)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 5):
        store.upsert(rows.withColumn("version", F.lit(v)))
    done.set()
    reader.join()
    assert not wrong


def test_stored_retrieval(spark, cars, tmp_path):
    store = index.ParquetIndex(spark, str(tmp_path / "cars"), key="k", buckets=2)
    kept = stored.Persisted(retrieval.build(CARS), store)
    with pytest.raises(ValueError, match="put first"):
        kept.apply_queries(cars[1])
    store.put(cars[0].select(F.col("case_id").alias("k"), "case.*"))
    assert [r.case_id for r in kept.apply_queries(cars[1]).final.orderBy("rank").collect()] == [2, 1, 0]
    assert [r.case_id for r in kept.apply_queries(cars[1], cars[0].where("case_id = 1")).final.collect()] == [1]
    assert [r.case_id for r in kept.apply_queries(cars[1], cars[0].where("false"), where=In("case_id", (0,))).final.collect()] == [0]
    keep = phases.retain_indexed(store, CARS, ["price", "year"])
    queries = cars[1].unionByName(cars[1].withColumn("query_id", F.col("query_id") + 1))
    found = retrieval.apply_queries(cars[0], queries, retrieval.dropout(retrieval.build(CARS), limit=1)).steps[-1].scores
    rows = {(r.query_id, r.case_id): r.is_new for r in keep(found).collect()}
    assert rows == {**{(q, c): False for q in (7, 8) for c in (0, 1, 2)}, (7, 3): True, (8, 3): False, (8, 4): True}
    assert {r.k for r in store.read().collect()} == {0, 1, 2, 3, 4}


def test_storage_retriever(spark, tmp_path):
    texts = spark.createDataFrame([("a", "red sedan car"), ("b", "blue sky"), ("c", "red apple fruit")], "key string, value string")
    queries = spark.createDataFrame([(0, "red car"), (1, "sky")], "query_id int, text string")
    embed = m.keyword_embedder(["red", "blue", "green", "car", "sky", "fruit"])
    store = index.ParquetIndex(spark, str(tmp_path / "texts"), buckets=2)
    near = stored.StorageRetriever(store, "dense", embed, limit=1)
    with pytest.raises(ValueError, match="put first"):
        near.apply_queries(queries)
    near.put(texts)
    best = lambda r, **how: {x.query_id: x.case_id for x in r.apply_queries(queries, **how).where("rank = 1").collect()}
    assert best(near) == {0: "a", 1: "b"} and best(near, cases=texts.where("key != 'a'"))[0] == "c"
    near.upsert(texts.where("key = 'b'").withColumn("value", F.lit("red car")))
    near.delete(texts.where("key = 'a'"))
    assert best(near)[0] == "b"
    near.upsert(texts)
    sparse = stored.StorageRetriever(store, "sparse", limit=2)
    assert best(sparse) == {0: "a", 1: "b"}
    assert best(stored.StorageRetriever(store, "hybrid", embed, limit=2, where=Not(Eq("key", "a")))) == {0: "c", 1: "b"}
    with pytest.raises(ValueError, match="needs an index"):
        sparse.apply_queries(queries, cases=texts)
    for wrong in (("dense",), ("hybrid", embed), ("other", embed)):
        with pytest.raises(ValueError):
            stored.StorageRetriever(store, *wrong)


def test_bm25_counts_cases_without_terms(spark):
    cases = spark.createDataFrame([("a", 0, "red red car"), ("b", 1, ""), ("c", 2, None), ("d", 3, "!?"), ("e", 4, "car")], "case_id string, ord int, text string")
    queries = spark.createDataFrame([(0, "red car")], "query_id int, text string")
    import math

    idf = lambda n: math.log(1 + (5 - n + 0.5) / (n + 0.5))
    part = lambda tf, size: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / 1.0))  # noqa: E731  the null text has no length
    got = {r.case_id: r.sim for r in index.bm25(cases, queries, every=False, normalized=False).collect()}
    assert got == pytest.approx({"a": idf(1) * part(2, 3) + idf(2) * part(1, 3), "e": idf(2) * part(1, 1)})


def test_search(spark):
    cases = spark.createDataFrame([("a", 0, "red sedan car"), ("b", 1, "blue sky"), ("c", 2, "red apple fruit")], "case_id string, ord int, text string")
    queries = spark.createDataFrame([(0, "red")], "query_id int, text string")
    assert {r.case_id for r in index.bm25(cases, queries, every=False).collect()} == {"a", "c"}
    assert {r.case_id: r.sim for r in index.bm25(cases, queries).collect()}["b"] == 0.0
    embed = m.keyword_embedder(["red", "blue", "green", "car", "sky", "fruit"])
    near = index.dense(cases.withColumn("vector", embed(F.col("text"))), spark.createDataFrame([(0, "red car")], "query_id int, text string").withColumn("vector", embed(F.col("text"))), limit=1)
    assert near.first().case_id == "a"
    both = index.hybrid(near.drop("rank"), index.bm25(cases, queries, every=False), 2)
    assert {r.case_id for r in both.collect()} == {"a", "c"}


def test_prompt_and_chunks(spark, cars):
    found = retrieval.apply_queries(*cars, retrieval.build(CARS)).final
    prompt = synthesis.default_prompt(found, "Compare.").first().prompt
    assert prompt.startswith("Compare.\n\n## Query") and prompt.index("### 2 (Rank: 1, Similarity: 0.995)") < prompt.index("### 1 (Rank: 2")
    parts = synthesis.chunks(found, 2, 1)
    assert {(r.chunk, r.case_id) for r in parts.collect()} == {(0, 2), (0, 1), (0, 0), (1, 0), (1, 1)}
    out = synthesis.generate(synthesis.default_prompt(found), synthesis.pipe(str.upper)).first()
    assert out.response == out.prompt.upper()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, ("x", 1)), (1, ("y", None))], "key long, v struct<a:string,b:int>")
    assert dumpers.flatten(df).columns == ["key", "v.a", "v.b"]
    dumpers.file(df, str(tmp_path / "a.csv"))
    assert loaders.csv(spark, str(tmp_path / "a.csv")).count() == 2
    dumpers.file(dumpers.flatten(df).toDF("key", "a", "b"), str(tmp_path / "a.yaml"))
    assert {r.a for r in loaders.path(spark, str(tmp_path / "a.yaml")).collect()} == {"x", "y"}
    dumpers.file(dumpers.flatten(df).toDF("key", "a", "b"), str(tmp_path / "a.toml"))
    assert {r.a for r in loaders.file(spark, str(tmp_path / "a.toml")).collect()} == {"x", "y"}
    (tmp_path / "b.json").write_text('[{"n": 1}, {"n": 2}]')
    assert sorted((r.key, r.n) for r in loaders.file(spark, str(tmp_path / "b.json")).collect()) == [(0, 1), (1, 2)]
    (tmp_path / "c.xml").write_text("<r><i><n>1</n></i><i><n>2</n></i></r>")
    assert loaders.file(spark, str(tmp_path / "c.xml"), row_tag="i").count() == 2
    with pytest.raises(ValueError):
        loaders.file(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        loaders.path(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="invalid row"):
        loaders.validate(df, {"small": "v.b < 5"}).collect()


def test_directories_and_xml(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "plain", "b.json": '{"x": 1}', "c.toml": "x = 1", "d.yaml": "x: 1", "e.csv": "x,y\n1,2\n", "f.xml": "<r><x n='1'>t</x><y>1</y><y>2</y></r>", "g.bin": "no"}.items():
        (tmp_path / "in" / name).write_text(text)
    got = {r.key: r.value for r in loaders.path(spark, str(tmp_path / "in")).collect()}
    assert got.pop("a") == "plain"
    assert {k: json.loads(v) for k, v in got.items()} == {"b": {"x": 1}, "c": {"x": 1}, "d": {"x": 1}, "e": {"0": {"x": "1", "y": "2"}}, "f": {"x": {"@n": "1", "#text": "t"}, "y": ["1", "2"]}}
    (tmp_path / "rows.xml").write_text("<r><one><n>1</n></one><two><n>2</n></two></r>")
    assert {r.key: r.n for r in loaders.file(spark, str(tmp_path / "rows.xml")).collect()} == {"one": "1", "two": "2"}
    dumpers.path(spark.createDataFrame([("x.txt", "one"), ("y.txt", "two")], "key string, value string"), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"x.txt": "one", "y.txt": "two"}
    (tmp_path / "t.csv").write_text("a,b,0.5\n")
    df = spark.createDataFrame([("B", "a")], "x string, y string")
    assert df.select(m.string_table(str(tmp_path / "t.csv"), case_sensitive=False)(F.col("x"), F.col("y"))).first()[0] == 0.5

    class Frame:
        def to_arrow(self):
            import pyarrow as pa

            return pa.table({"v": ["x", "y"]})

    assert {(r.key, r.v) for r in loaders.from_polars(spark, Frame()).collect()} == {(0, "x"), (1, "y")}


REUSER = phases.reuse(None, CARS)


def test_command_line_reuse(spark, tmp_path):
    from sparkcase import cli

    for name in ("cases", "queries"):
        (tmp_path / f"{name}.json").write_text('[{"price": 1000, "year": 2000}, {"price": 2000, "year": 2001}]')
    cli.main(["reuse", str(tmp_path / "cases.json"), str(tmp_path / "queries.json"), "--reuser", "tests.test_operators:REUSER", "--output", str(tmp_path / "out.parquet")])
    assert {(r.query_id, r.case_id): r.rank for r in spark.read.parquet(str(tmp_path / "out.parquet")).collect()} == {(0, 0): 1, (0, 1): 2, (1, 1): 1, (1, 0): 2}


def test_eval_of_steps_and_scaling(spark, cars):
    found = retrieval.apply_queries(*cars, [retrieval.build(CARS), retrieval.dropout(retrieval.build(CARS), limit=2)])
    qrels = evaluation.retrieval_to_qrels(found)
    assert [{r.case_id: r.rel for r in q.collect()} for q in qrels] == [{2: 5, 1: 2, 0: 1}, {2: 5, 1: 1}]
    got = {(r.step, r.metric): r.value for r in evaluation.retrieval_metrics(qrels[0], found, ["recall", "precision"]).collect()}
    assert got == pytest.approx({(0, "recall"): 1, (0, "precision"): 1, (1, "recall"): 2 / 3, (1, "precision"): 1})
    row = spark.range(1).select(evaluation.normalize_and_scale(F.lit(3.0), F.lit(1.0), F.lit(5.0), 10, 20), evaluation.normalized(F.lit(3.0), F.lit(1.0), F.lit(1.0)), *(evaluation.rounded(F.lit(2.5), k) for k in ("nearest", "floor", "ceil"))).first()
    assert row[:] == (15.0, 0.0, 3, 2, 3)
    with pytest.raises(ValueError):
        evaluation.rounded(F.lit(1.0), "up")


def test_rank_measures_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    qrels = [(q, c, rng.randrange(3)) for q in range(4) for c in range(12)]
    run = [(q, c, rng.randrange(5) / 4) for q in range(4) for c in range(12) if rng.random() < 0.7]
    sims = {(q, c): s for q, c, s in run}
    got = {r.query_id: r[1:] for r in evaluation.concordances(spark.createDataFrame(qrels, "query_id int, case_id int, rel int"), spark.createDataFrame(run, "query_id int, case_id int, sim double")).collect()}
    taus = []
    for q in range(4):
        pairs = [(sims.get((q, a)), sims.get((q, b)), r, s) for (_, a, r), (_, b, s) in itertools.combinations([x for x in qrels if x[0] == q], 2)]
        judged = [(x, y, r, s) for x, y, r, s in pairs if r != s]
        both = [p for p in judged if p[0] is not None and p[1] is not None]
        agree = sum((x - y) * (r - s) > 0 for x, y, r, s in both)
        assert got[q] == (agree, len(both) - agree, len(judged))
        seen = [(x, y, r, s) for x, y, r, s in pairs if x is not None and y is not None and min(r, s) >= 1]
        na, nb = sum(x != y for x, y, _, _ in seen), sum(r != s for _, _, r, s in seen)
        if na and nb:
            taus.append(sum(((x > y) - (x < y)) * ((r > s) - (r < s)) for x, y, r, s in seen) / (na * nb) ** 0.5)
    assert evaluation.kendall_tau(spark.createDataFrame(qrels, "query_id int, case_id int, rel int"), spark.createDataFrame(run, "query_id int, case_id int, sim double")).first()[0] == pytest.approx(sum(taus) / len(taus))


def test_stream_retains(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one", 0), ("a", "two", 1), ("b", "x", 0)], "key string, value string, ord int")
    rows.write.parquet(str(tmp_path / "in"))
    store = index.ParquetIndex(spark, str(tmp_path / "index"))
    retention.retain_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "check")).awaitTermination()
    assert {r.key: r.value for r in store.read().collect()} == {"a": "two", "b": "x"}


def test_pairs_are_dealt_to_tasks(spark):
    cases = retrieval.cases_of(spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("v")), "id")
    queries = retrieval.queries_of(spark.range(25).select("id", F.col("id").cast("double").alias("v")), "id")
    paired = retrieval.pairs(cases, queries)
    sizes = [r["count"] for r in paired.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_500_000 and max(sizes) < 1.2 * retrieval.TASK_PAIRS
    top = retrieval.dropout(retrieval.build(m.transpose(m.linear(100), lambda c: c["v"])), limit=2)(paired).where("query_id = 3")
    assert [(r.case_id, r.rank) for r in top.orderBy("rank").collect()] == [(3, 1), (10, 2)]


def test_dealing_holds_no_whole_file(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 8000)
    cases = retrieval.cases_of(spark.range(0, 1_000_000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("v")), "id")
    queries = retrieval.queries_of(spark.range(2).select("id", F.col("id").cast("double").alias("v")), "id")
    sc, paired = spark.sparkContext, retrieval.pairs(cases, queries)
    sc.setJobGroup("dealing", "")
    try:
        paired.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker().getJobIdsForGroup("dealing")
    of_stages = [store.taskList(s, 0, 10_000) for s in {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}]
    tasks = [x.taskMetrics().get() for found in of_stages for x in (found.apply(i) for i in range(found.size())) if x.taskMetrics().isDefined()]
    read = [x.shuffleReadMetrics().recordsRead() for x in tasks]
    assert sum(r > 0 for r in read) >= 250 and max(read) < 1.2 * retrieval.TASK_PAIRS
    assert max(x.peakExecutionMemory() for x in tasks) < 60 << 20  # a page has 32


def test_last_task_ranks_groups_not_tasks(spark):
    scores = spark.range(0, 60_000, 1, 300).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("case_id"), F.col("id").alias("ord"), F.lit(0).alias("case"), F.lit(0).alias("query"), (F.col("id") * 7919 % 50).cast("double").alias("v"))
    top = retrieval.dropout(lambda p: p.withColumn("sim", F.col("v")), limit=50)(scores)
    sc = spark.sparkContext
    sc.setJobGroup("ranking", "")
    try:
        got = top.select("case_id", "rank").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    for q in (0, 1):
        want = sorted(range(q, 60_000, 2), key=lambda i: (-(i * 7919 % 50), i))[:50]
        assert [r.case_id for r in sorted(got, key=lambda r: r["rank"]) if r.case_id % 2 == q] == want
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker().getJobIdsForGroup("ranking")
    last = store.taskList(max(s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds), 0, 1000)
    read = [last.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(last.size())]
    assert 0 < sum(read) <= 2 * 50 * retrieval.GROUPS  # of each of 300 tasks before


def test_brand_queries_are_not_sorted(spark):
    sf = "/root/testdata/sf0.001"
    queries = brand_queries(spark, sf)
    got = queries.select("query_id", "query.brand").collect()
    assert "SortAggregate" not in queries._jdf.queryExecution().executedPlan().toString()
    assert all(r.query_id == r.brand for r in got) and len(got) == spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().count()


@pytest.mark.parametrize("weights", [None, (2, 1, 1)])
@pytest.mark.parametrize("kind", ["mean", "sum"])
def test_scores_are_pooled_in_generated_code(spark, kind, weights, monkeypatch):
    rows = spark.createDataFrame([(0.1, 0.2, 0.3), (-0.0, -0.0, -0.0), (1e300, 0.7, None), (float("nan"), 1.0, 2.0)], "a double, b double, c double").repartition(1)
    pool = lambda: rows.select(pooling.aggregator(kind, weights)([F.col(c) for c in "abc"]).alias("v"))
    made = pool()
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.collect()
    monkeypatch.setattr(pooling, "ADDED", 0)  # by arrays
    assert repr(got) == repr(pool().collect())


def test_rerank_makes_its_candidates_once(spark):
    cases = retrieval.cases_of(spark.range(6).select("id", F.col("id").cast("string").alias("v")), "id")
    queries = retrieval.queries_of(spark.range(2).select("id", F.lit("q").alias("v")), "id")
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(v):
        made.add(len(v))
        return v.astype(float)

    again = retrieval.rerank(retrieval.dropout(lambda p: p.withColumn("sim", counted(F.col("case")["v"])), limit=3), lambda q, texts: [1.0] * len(texts), lambda c: c["v"])
    assert retrieval.apply_queries(cases, queries, again).steps[-1].scores.count() == 6
    assert made.value in (6, 12)  # of the cases, or of the pairs


def test_ideal_ranking_counts_equal_judgements(spark):
    import math

    rels = [3] * 4 + [2] * 3 + [1] * 5 + [0] * 8
    qrels = spark.createDataFrame([("a", i, r) for i, r in enumerate(rels)] + [("none", 0, 0)], "query_id string, case_id int, rel int")
    run = spark.createDataFrame([("a", i, float(i)) for i in range(20)] + [("none", 0, 1.0)], "query_id string, case_id int, sim double")
    for k in (0, 5, 9, 50):
        for level in (1, 2):
            n = k or len(rels)
            gain = lambda order: sum(r / math.log2(i + 2) for i, r in enumerate(order[:n]) if r >= level)
            got = {r.query_id: (r.ndcg, r.recall) for r in evaluation.per_query(qrels, run, k, level).collect()}
            assert got["a"][0] == pytest.approx(gain(rels[::-1]) / gain(rels)) and got["none"] == (0.0, 0.0)
    plan = evaluation.per_query(qrels, run, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") <= 2  # the run alone is ranked


def test_bm25_within_rows_equals_joins(spark, monkeypatch):
    texts = [(0, "a b c a d"), (1, None), (2, ""), (3, "b b e"), (4, "a b c a d"), (5, "x y z"), *((i, "d " * (i % 7) + "c a") for i in range(6, 40))]
    cases = spark.createDataFrame(texts, "case_id long, text string").withColumn("ord", F.col("case_id"))
    queries = spark.createDataFrame([("p", "A b"), ("q", "c c d"), ("r", "none"), ("s", None)], "query_id string, text string")
    key = lambda rows: {(r.query_id, r.case_id): r.sim for r in rows}
    for every in (False, True):
        with monkeypatch.context() as c:
            c.setattr(index, "ASKED_CELLS", -1)
            joined = key(index.bm25(cases, queries, every=every, normalized=False).collect())
        got = key(index.bm25(cases, queries, every=every, normalized=False).collect())
        assert got.keys() == joined.keys() and all(got[k] == pytest.approx(joined[k]) for k in got)
    got = key(index.bm25(cases, queries, every=False, normalized=False).collect())
    assert got["p", 0] == got["p", 4]
    some = key(index.bm25(cases, queries, every=False, normalized=False, limit=3, slack=1e-3).collect())
    best = lambda scores, q: sorted((-round(v, 4), k) for (p, k), v in scores.items() if p == q)[:3]
    assert all(best(some, q) == best(got, q) for q in "pqr")


def test_bm25_shuffles_no_terms(spark):
    cases = spark.createDataFrame([(i, "a b c") for i in range(50)], "case_id long, text string").withColumn("ord", F.col("case_id"))
    queries = spark.createDataFrame([("p", "a b")], "query_id string, text string")
    plan = index.bm25(cases, queries, every=False, normalized=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_dense_limit_keeps_the_first_of_equal_vectors(spark, monkeypatch):
    cases = spark.range(60).select(F.col("id").alias("case_id"), (100 - F.col("id")).alias("ord"), F.when(F.col("id") % 4 < 3, F.array(F.lit(1.0), (F.col("id") % 4).cast("double"))).alias("vector"))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0])], "query_id int, vector array<double>")
    whole = retrieval.rank(index.dense(cases, queries)).where("rank <= 20")
    key = lambda rows: sorted((r.query_id, r.rank, r.case_id, r.sim) for r in rows.collect())
    assert key(index.dense(cases, queries, limit=20)) == key(whole) and whole.count() == 40
    met, crossed = [], index.crossed
    monkeypatch.setattr(index, "crossed", lambda c, q: met.append(c.count()) or crossed(c, q))
    assert key(index.dense(cases, queries, limit=5)) == key(whole.where("rank <= 5")) and met == [20]


def test_banded_pairs_by_cells(spark, monkeypatch):
    cases = retrieval.cases_of(spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 99.99, 100.0, -50.0, 1e6, None, float("nan"), 0.1, 0.3, 250.0])], "k long, v double"), "k")
    queries = retrieval.queries_of(spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.0, 200.0, -150.0, 349.9, None, float("nan"), 0.2, 0.4])], "k long, v double"), "k")
    monkeypatch.setattr(retrieval, "MEMBERS", 1)
    for reach in (100.0, 0.1, 1e9):
        got = retrieval.banded_pairs(cases, queries, "v", reach)
        want = cases.crossJoin(queries).where(F.abs(F.col("case.v") - F.col("query.v")) <= reach)
        pick = lambda df: sorted(map(tuple, df.select("case_id", "query_id").collect()))
        assert pick(got) == pick(want) and got.columns == ["case_id", "ord", "case", "query_id", "query"]
    assert retrieval.banded_pairs(cases, queries.where("false"), "v", 1.0).count() == 0


#: The queries of findings on the memory of one task: all pairs of a file of parts were made and sorted in one task.
DEALT = ["retain_indexed", "retrieve_combine_intersection", "reuse_adapt", "retrieve_mac_fac", "retrieve_attribute_value", "synthesis_chunks", "synthesis_pooling", "synthesis_prompt"]


@pytest.mark.parametrize("name", DEALT)
def test_query_deals_its_pairs(spark, monkeypatch, name):
    sizes, made = [], retrieval.pairs

    def spied(*args, **more):
        out = made(*args, **more)
        sizes.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(retrieval, "TASK_PAIRS", 1000, raising=False)
    monkeypatch.setattr(retrieval, "pairs", spied)
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES[name](spark, sf).toPandas()
    parts = spark.read.parquet(f"{sf}/part.parquet")
    assert sum(sizes) == parts.count() * parts.select("p_brand").distinct().count() > 4000 and max(sizes) < 2000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()[list(got.columns)]
    key = [c for c in got.columns if c not in ("sim", "price")]
    pd.testing.assert_frame_equal(*(d.sort_values(key, ignore_index=True) for d in (got, want)), check_dtype=False, rtol=0, atol=1.1e-6)
