import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcase.functions import graph_search, graphs, kernels, measures as m, pooling, taxonomy


def one(spark, measure, x, y, kind):
    df = spark.createDataFrame([(x, y)], f"x {kind}, y {kind}")
    return df.select(m.value_of(measure, measure(F.col("x"), F.col("y")))).first()[0]


@pytest.mark.parametrize(
    "measure, x, y, kind, expected",
    [
        (m.linear_interval(1950, 2000), 1950, 1975, "int", 0.5),
        (m.linear(100), 50, 60, "int", 0.9),
        (m.threshold(10), 50, 60, "int", 1.0),
        (m.threshold(10), 50, 61, "int", 0.0),
        (m.exponential(0.1), 50, 60, "int", 0.36787944117144233),
        (m.sigmoid(1, 10), 50, 60, "int", 0.5),
        (m.sigmoid(1, 10), 50, 58, "int", 0.8807970779778823),
        (m.levenshtein(), "kitten", "sitting", "string", 0.6153846153846154),
        (m.levenshtein(0.8), "kitten", "sitting", "string", 0.0),
        (m.jaro(), "kitten", "sitting", "string", 0.746031746031746),
        (m.jaro_winkler(), "kitten", "sitting", "string", 0.746031746031746),
        (m.ngram(3), "kitten", "sitting", "string", 0.125),
        (m.ngram(3), "a", "b", "string", None),
        (m.regex(), "Test1", "T.st[0-9]", "string", 1.0),
        (m.regex(), "Test2", "T.st[3-6]", "string", 0.0),
        (m.glob(), "Test1", "Test?", "string", 1.0),
        (m.glob(), "Test2", "Test[3-9]", "string", 0.0),
        (m.glob(case_sensitive=False), "ABC", "a*", "string", 1.0),
        (m.jaccard(), list("abcd"), list("abc"), "array<string>", 0.8),
        (m.mapping(), ["Mon", "Tue", "Wed"], ["Mon", "Tue", "Sun"], "array<string>", 2 / 3),
        (m.mapping(), ["Mon"], ["Mon", "Tue", "Wed"], "array<string>", 1 / 3),
        (m.isolated_mapping(m.equality()), ["a", "b"], ["a", "c"], "array<string>", 0.5),
        (m.sequence_correctness(0.5), ["Mon", "Tue", "Wed"], ["Mon", "Wed", "Tue"], "array<string>", 1 / 3),
        (m.sequence_mapping(m.equality(), exact=True), ["a", "b"], ["a", "c"], "array<string>", 0.5),
        (m.sequence_mapping(m.equality()), ["z", "a", "b"], ["a", "b"], "array<string>", 1.0),
        (m.dtw(), [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], "array<double>", 0.5),
        (m.dtw(), [1.0, 2.0, 3.0], [3.0, 4.0, 5.0], "array<double>", 1 / 7),
        (m.dtw(), [], [1.0], "array<double>", 0.0),
        (m.twed(), [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], "array<double>", 0.33322225924691773),
        (m.twed(), [1.0, 2.0, 3.0], [3.0, 4.0, 5.0], "array<double>", 0.11106175033318526),
        (m.smith_waterman(), list("abcde"), list("abde"), "array<string>", 0.75),
        (m.smith_waterman(), list("abcde"), list("fghe"), "array<string>", 0.25),
        (m.sparse_dot(), {0: 1.0, 1: 2.0}, {0: 3.0, 1: 4.0}, "map<int,double>", 1.0),
        (m.sparse_cosine(), {0: 1.0}, {1: 1.0}, "map<int,double>", 0.5),
        (m.cosine(), [1.0, 0.0], [0.0, 0.0], "array<double>", 0.0),
        (m.combine([m.equality(), m.static(0.5)]), "a", "a", "string", 0.75),
        (m.combine([m.equality(), m.static(0.5)]), "a", "b", "string", 0.25),
        (m.static_table({("a", "b"): 0.5}, default=0.0), "b", "a", "string", 0.5),
        (m.static_table({(1, 2): 0.5}, symmetric=False, default=0.1), 2, 1, "int", 0.1),
    ],
)
def test_golden(spark, measure, x, y, kind, expected):
    got = one(spark, measure, x, y, kind)
    assert got == expected if expected is None else got == pytest.approx(expected)


def test_missing_table_pair_is_an_error(spark):
    with pytest.raises(Exception, match="not in the table"):
        one(spark, m.static_table({("a", "b"): 0.5}), "a", "c", "string")


def test_attribute_value_and_default(spark):
    df = spark.createDataFrame([(("John", 25), ("John", 30)), (("Ann", None), ("Ann", 30))], "x struct<name:string,age:int>, y struct<name:string,age:int>")
    f = m.attribute_value({"name": m.equality(), "age": m.equality()}, default=0.25)
    rows = [r.s for r in df.select(f(F.col("x"), F.col("y")).alias("s")).collect()]
    assert (rows[0].value, rows[0].attributes.name, rows[0].attributes.age) == (0.5, 1.0, 0.0)
    assert rows[1].value == 0.625
    strict = m.attribute_value({"age": m.equality()})
    with pytest.raises(Exception, match="age is null"):
        df.select(strict(F.col("x"), F.col("y"))).collect()


def test_pooling(spark):
    a = [0.5, 0.25, 0.5, 1.0]
    df = spark.createDataFrame([(a,)], "a array<double>")
    import statistics as s

    expected = {"mean": s.fmean(a), "geometric_mean": s.geometric_mean(a), "harmonic_mean": s.harmonic_mean(a), "median": s.median(a), "median_low": s.median_low(a), "median_high": s.median_high(a), "mode": s.mode(a), "min": min(a), "max": max(a), "sum": sum(a)}
    row = df.select(*(pooling.POOLINGS[k](F.col("a")).alias(k) for k in expected)).first()
    assert {k: row[k] for k in expected} == pytest.approx(expected)
    assert df.select(pooling.k_min(2)(F.col("a")), pooling.k_max(9)(F.col("a")), pooling.aggregator("mean", (1, 1, 2, 0))(F.col("a"))).first()[:] == pytest.approx((0.5, 0.25, (0.5 + 0.25 + 1.0) / 4))


TREE = {"name": "root", "weight": 0.0, "children": [{"name": "vw", "weight": 0.2, "children": [{"name": "audi", "children": ["a3", "a4"]}, "porsche"]}, {"name": "other", "children": ["bmw"]}]}


def test_taxonomy(spark):
    t = taxonomy.Taxonomy(TREE)
    e = t.entries
    assert taxonomy.wu_palmer()(t, e["audi"], e["porsche"]) == 0.5
    assert taxonomy.wu_palmer()(t, e["audi"], e["bmw"]) == 0.0
    assert taxonomy.weights("auto")(t, e["audi"], e["vw"]) == 1.0
    assert taxonomy.levels()(t, e["audi"], e["bmw"]) == pytest.approx(1 / 3)
    assert taxonomy.paths()(t, e["audi"], e["vw"]) == pytest.approx(5 / 6)
    assert one(spark, taxonomy.build(TREE), "a3", "a4", "string") == pytest.approx(2 / 3)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, k = rng.integers(1, 5, 2)
        s = rng.random((n, k))
        t = s if n <= k else s.T
        best = max(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))
        assert kernels.assignment_value(s) == pytest.approx(best)


def test_graph_search_finds_the_optimum():
    random.seed(0)

    def graph():
        n = random.randint(1, 4)
        return {"nodes": [(f"n{i}", random.choice("ABC")) for i in range(n)], "edges": [(f"e{i}", f"n{random.randrange(n)}", f"n{random.randrange(n)}", None) for i in range(random.randint(0, 4))]}

    setting = graphs.Setting(node_matcher=lambda a, b: a == b)
    for _ in range(25):
        x, y = graph(), graph()
        best = graphs.similarity(x, y, "brute_force", setting)["value"]
        assert graphs.similarity(x, y, "qap", setting)["value"] == pytest.approx(best)
        assert graphs.similarity(x, y, "astar", setting, partial_mapping=True)["value"] == pytest.approx(best)
        for method in ("greedy", "lap", "vf2", "astar"):
            assert graphs.similarity(x, y, method, setting)["value"] <= best + 1e-9


@pytest.mark.parametrize("heuristic", list(graph_search.HEURISTICS))
@pytest.mark.parametrize("selection", list(graph_search.SELECTIONS))
def test_every_heuristic_and_selection_is_optimal(heuristic, selection):
    rng = random.Random(heuristic + selection)
    setting = graphs.Setting(node_sim=lambda a, b: 1.0 if a == b else 0.3, node_matcher=lambda a, b: (a < "C") == (b < "C"))
    for k in range(12):
        x, y = (
            {"nodes": [(f"n{i}", rng.choice("ABC")) for i in range(n)], "edges": [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", None) for i in range(rng.randint(0, 4))]}
            for n in (rng.randint(1, 4), rng.randint(1, 4))
        )
        best = graphs.similarity(x, y, "brute_force", setting)["value"]
        for start in ("empty", "unique"):
            found = graphs.similarity(x, y, "astar", setting, heuristic=heuristic, selection=selection, start=start, partial_mapping=True)["value"]
            assert found == pytest.approx(best) if heuristic != "h4" else found <= best + 1e-9
        assert graphs.similarity(x, y, "astar", setting, heuristic=heuristic, selection=selection, beam_width=2, pathlength_weight=2)["value"] <= best + 1e-9


def test_search_successors_and_starts():
    x, y = chain("AB"), chain("AB")
    problem = graphs.Problem(x, y, graphs.Setting(node_matcher=lambda a, b: a == b))
    empty, unique = graph_search.init_empty(problem), graph_search.init_unique_matches(problem)
    assert unique.nodes == {"n0": "n0", "n1": "n1"} and unique.edges == {"e0": "e0"}
    search = graph_search.Search(problem, partial_mapping=True)
    assert [s.nodes for s in search.expand_node(empty, "n0")] == [{"n0": "n0"}, {}]
    assert [s.edges for s in search.expand_edge(empty, "e0")] == [{}]
    both = search.expand_edge_with_nodes(empty, "e0")[0]
    assert both.nodes == unique.nodes and both.edges == unique.edges and search.finished(both)
    assert graph_search.init_from(graph_search.lap)(problem) == unique
    assert graphs.METHODS["dfs"](problem, roots=lambda case, query: ("n1", "n1"))["n1"] == "n1"
    with pytest.raises(ValueError, match="roots"):
        graphs.METHODS["dfs"](problem, roots=lambda case, query: ("n0", "n1"))


@pytest.mark.parametrize("handling", ["ignore", "worstcase", "greedy", "optimal"])
def test_lap_weighs_deletions_and_insertions(handling):
    """The assignment against all partial mappings of the nodes."""
    rng = random.Random(handling)
    for _ in range(30):
        x, y = ({"nodes": [(f"n{i}", rng.random()) for i in range(n)], "edges": [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", None) for i in range(rng.randint(0, 3))]} for n in (rng.randint(1, 3), rng.randint(1, 3)))
        setting = graphs.Setting(node_sim=lambda a, b: 1 - abs(a - b), node_deletion=0.4, node_insertion=0.3, edge_deletion=0.6, edge_insertion=0.2)
        problem = graphs.Problem(x, y, setting)
        table, mine, theirs, _ = graph_search.assignment_costs(problem, graph_search.init_empty(problem), handling)
        n, m = len(mine), len(theirs)

        def cost(mapping):
            return sum(table[i][mapping[i]] if i in mapping else table[i][m + i] for i in range(n)) + sum(table[n + j][j] for j in range(m) if j not in mapping.values())

        every = [dict(zip(rows, columns)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k)]
        found = graph_search.lap(problem, handling)
        assert cost({mine.index(a): theirs.index(b) for a, b in found.items()}) == pytest.approx(min(map(cost, every)))


def test_limits_and_null_graphs(spark):
    dense = {"nodes": [(f"n{i}", 0) for i in range(9)], "edges": [(f"e{i}{j}", f"n{i}", f"n{j}", None) for i in range(9) for j in range(9) if i != j]}
    for method, how in (("astar", {"max_states": 50, "partial_mapping": True}), ("dfs", {"max_states": 50}), ("vf2", {"max_visits": 50}), ("qap", {"timeout": 0.05})):
        assert 0 <= graphs.similarity(dense, dense, method, **how)["value"] <= 1
    df = spark.createDataFrame([(([("a", "v")], []), None), (([("a", "v")], []), ([("b", "v")], []))], f"x {graphs.GRAPH}, y {graphs.GRAPH}")
    assert [r[0] for r in df.select(graphs.graph_measure("astar")(F.col("x"), F.col("y"))["value"]).collect()] == [None, 1.0]


def chain(text):
    return {"nodes": [(f"n{i}", c) for i, c in enumerate(text)], "edges": [(f"e{i}", f"n{i}", f"n{i + 1}", None) for i in range(len(text) - 1)]}


def test_graph_chains():
    assert graphs.similarity(chain("ABC"), chain("ABC"), "qap")["value"] == 1.0
    for method in ("dtw", "twed", "smith_waterman"):
        assert graphs.similarity(chain("ABC"), chain("ABC"), method)["value"] == 1.0
    assert graphs.is_sequential(chain("ABC"))
    assert not graphs.is_sequential({"nodes": [("a", 1), ("b", 1)], "edges": []})
    assert '"n0" -> "n1"' in graphs.to_dot(chain("AB"))


def test_graph_baseline():
    y = {"nodes": [("q1", ("Person", "Alice")), ("q2", ("Company", "Acme Corp"))], "edges": [("e", "q1", "q2", "works")]}
    setting = graphs.Setting(node_sim=lambda a, b: 1.0 if a[1] == b[1] else 0.2, node_matcher=lambda a, b: a[0] == b[0])
    x = {"nodes": [("n1", ("Person", "Alice")), ("n2", ("Company", "Other"))], "edges": [("e", "n1", "n2", "works")]}
    assert graphs.similarity(x, y, "astar", setting)["value"] == pytest.approx(0.6)
    assert graphs.similarity({"nodes": x["nodes"][:1], "edges": []}, y, "astar", setting)["value"] == pytest.approx(1 / 3)


def test_alignments_of_many_pairs_equal_those_of_one():
    import numpy as np

    from sparkcase.functions import kernels

    r = np.random.default_rng(5)
    sizes = [(0, 0), (0, 3), (3, 0), (1, 1), *zip(r.integers(1, 40, 30), r.integers(1, 40, 30))]
    x, y = [r.random(n) * 9 for n, _ in sizes], [r.random(n) * 9 for _, n in sizes]
    a, b = [list(r.choice(list("abcd"), len(v))) for v in x], [list(r.choice(list("abce"), len(v))) for v in y]
    apart = lambda p, q: abs(p - q)
    assert list(kernels.dtw_values(x, y)) == [kernels.dtw(*p, apart)[0] for p in zip(x, y)]
    assert list(kernels.twed_values(x, y)) == [kernels.twed(*p, apart)[0] for p in zip(x, y)]
    assert list(kernels.smith_waterman_values(a, b)) == [kernels.smith_waterman(*p, lambda p, q: float(p == q))[0] for p in zip(a, b)]
    for v in [np.array([]), np.array([1.0]), np.array([np.nan, 2, 1, np.nan, 2, 3])]:
        assert kernels.rising(v) == sum(v[i] < v[j] for i in range(len(v)) for j in range(i + 1, len(v)))


def test_alignments_without_pairs(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([1.0, 2.0, 5.0], [1.0, 4.0], ["a", "b", "a"], ["a", "a"]), (None, [1.0], None, ["a"]), ([nan], [1.0], ["a"], [None]), ([], [1.0], [], ["a"])], "x array<double>, y array<double>, k array<string>, l array<string>")
    x, y, k, el = F.col("x"), F.col("y"), F.col("k"), F.col("l")
    for measure, a, b in ((m.dtw, x, y), (m.twed, x, y), (m.smith_waterman, k, el)):
        got = rows.select(measure()(a, b)["value"].cast("string").alias("p"), measure(pairs=False)(a, b).cast("string").alias("q")).collect()
        assert all(r.p == r.q or {r.p, r.q} == {None, "NaN"} for r in got)
