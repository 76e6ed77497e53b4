import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import expr
from larkspur.graph import property_graph as pg
from larkspur.operators import joins, relational


def test_erf(spark):
    xs = [-4.0, -1.5, -0.1, 0.0, 0.3, 1.0, 2.4, 2.6, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(expr.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-12)


def test_single_join_checks(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, "x"), (1, "y")], "b int, v string")
    with pytest.raises(Exception, match="more than one row"):
        joins.single_join(left, right, [("a", "b")], ["v"], check=True).collect()


def test_collection_join(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, "y"), (1, "x")], "b int, v string")
    rows = {r["a"]: [x["v"] for x in r["collected"]] for r in joins.collection_join(left, right, [("a", "b")], ["v"]).collect()}
    assert rows == {1: ["x", "y"], 2: []}


def test_pagerank_and_triangles(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 4), (4, 1), (0, 3)], "src int, dst int")
    got = {r["node"]: r["rank"] for r in pg.pagerank(e, 60).collect()}
    rank = dict.fromkeys(range(5), 0.2)
    out = {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}
    for _ in range(60):
        rank = {v: 0.03 + 0.85 * sum(rank[a] / out[a] for a, b in [(0, 1), (1, 2), (2, 4), (3, 4), (4, 1), (0, 3)] if b == v) for v in rank}
    assert got == pytest.approx(rank, abs=1e-9)
    t = spark.createDataFrame([(0, 2), (1, 0), (1, 2), (1, 4), (2, 4), (2, 3)], "src int, dst int")
    assert sorted(map(tuple, pg.triangles(t).collect())) == [(1, 0, 2), (1, 2, 4)]


def test_kmeans(spark):
    pts = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (10, 10), (0, 1), (1, 0), (10, 11), (11, 10)])]
    rows = sorted((r["n"], [round(c, 4) for c in r["center"]]) for r in pg.kmeans(spark.createDataFrame(pts, "id int, features array<double>"), 2).collect())
    assert rows == [(3, [0.3333, 0.3333]), (3, [10.3333, 10.3333])]


def test_set_operations_align(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,), (3_000_000_000,)], "y bigint")
    out = relational.union(a, b)
    assert out.columns == ["x"] and sorted(r[0] for r in out.collect()) == [1, 3_000_000_000]
    with pytest.raises(ValueError):
        relational.union(a, b.withColumn("z", F.lit(1)))


def test_observed_rows(spark):
    df, seen = relational.tracked(spark.range(10).filter("id > 3"), "n")
    df.collect()
    assert seen.get["rows"] == 6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_builtin_graphs(spark):
    assert pg.triangles(pg.builtin(spark, "standard")).count() == 2
    t = pg.builtin(spark, "propertygraph")
    assert (pg.node_count(t).first()[0], pg.edge_count(t).first()[0], pg.properties(t).count()) == (3, 2, 3)
    assert pg.node_count(pg.empty(spark)).first()[0] == 0


def test_expansions(spark):
    t = pg.builtin(spark, "propertygraph")
    start = pg.identifier(t, "http://example.org/b").withColumnRenamed("node", "n")
    assert [r["other"]["lex"][-1] for r in pg.node_expansion(start, t, "n").collect()] == ["c"]
    assert [r["other"]["lex"][-1] for r in pg.node_expansion(start, t, "n", outgoing=False).collect()] == ["a"]
    assert sorted(r["node"]["lex"][-1] for r in pg.edge_expansion(pg.edges(t), to=False).collect()) == ["a", "b"]


@pytest.mark.parametrize("flip", [False, True])
def test_triangles_from_every_corner(spark, flip):
    """The same triangles whichever corner the pairs of edges meet at; repeated edges and loops change nothing."""
    import itertools
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(50)} | {(0, i) for i in range(1, 30)}
    edges = {(b, a) for a, b in edges} if flip else edges
    want = sorted((a, b, d) for (a, b), (c, d) in itertools.product(edges, edges) if b == c and (a, d) in edges)
    got = pg.triangles(spark.createDataFrame([*edges, *edges], "src int, dst int")).collect()
    assert sorted(map(tuple, got)) == want


def test_triangles_shuffle_no_pairs_of_edges(spark):
    """A hub between many nodes: its pairs of edges are not shuffled, whichever corner it is."""
    many = 1500
    edges = [(i, -1) for i in range(many)] + [(-1, many + i) for i in range(many)] + [(i, many + i) for i in range(0, many, 3)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = pg.triangles(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sorted(map(tuple, got)) == [(i, -1, many + i) for i in range(0, many, 3)]
    assert written() - before < 1_000_000


@pytest.mark.parametrize("kind", ["int", "string"])
def test_triangles_in_small_rounds_and_tiles(spark, monkeypatch, kind):
    """Several rounds of closing edges, lists cut into tiles and few pairs at a time; ends of any type, some null."""
    import itertools
    import random

    for name, value in {"CLOSING": 20, "TILE": 3, "PAIRS": 5}.items():
        monkeypatch.setattr(pg, name, value)
    rng = random.Random(5)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(70)}
    want = sorted((a, b, d) for (a, b), (c, d) in itertools.product(edges, edges) if b == c and (a, d) in edges)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int").selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst")
    out = pg.triangles(df)
    assert [t for _, t in out.dtypes] == [kind] * 3
    assert sorted(tuple(map(int, r)) for r in out.collect()) == want
    assert pg.triangles(df.limit(0)).count() == 0
