"""Graph-pattern queries over triples made from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..graph import property_graph as pg
from ..sparql.engine import GraphStore, run
from ..sources import turtle
from .registry import register

EX = "http://example.org/"
G = "http://example.org/graph"
G2 = "http://example.org/orders"
PREFIX = f"PREFIX ex: <{EX}> PREFIX xsd: <{terms.XSD}> "


def store(spark, d) -> GraphStore:
    """Nations, regions, suppliers and customers as the default graph, orders as a second one.

    Supplier edges carry degrees: (key % 10 + 1) / 10."""
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    ex = lambda n: EX + n
    nation = turtle.from_table(read("nation"), G, "n_nationkey", EX + "n", {ex("name"): ("n_name", terms.STRING), ex("in"): ("n_regionkey", "iri:" + EX + "r"), ex("key"): ("n_nationkey", terms.XSD + "int")})
    region = turtle.from_table(read("region"), G, "r_regionkey", EX + "r", {ex("label"): ("r_name", terms.STRING)})
    degree = (F.col("s_suppkey") % 10 + 1) / 10
    supplier = turtle.from_table(read("supplier"), G, "s_suppkey", EX + "s", {ex("of"): ("s_nationkey", "iri:" + EX + "n"), ex("sname"): ("s_name", terms.STRING)}, degree)
    customer = turtle.from_table(read("customer"), G, "c_custkey", EX + "c", {ex("lives"): ("c_nationkey", "iri:" + EX + "n"), ex("segment"): ("c_mktsegment", terms.STRING)})
    orders = turtle.from_table(read("orders"), G2, "o_orderkey", EX + "o", {ex("by"): ("o_custkey", "iri:" + EX + "c"), ex("status"): ("o_orderstatus", terms.STRING), ex("priority"): ("o_orderpriority", terms.STRING)})
    s = GraphStore(spark)
    s.add(G, nation.unionByName(region).unionByName(supplier).unionByName(customer))
    s.add(G2, orders)
    s.default = G
    s.counts = {ex("name"): 25.0, ex("in"): 25.0, ex("key"): 25.0, ex("label"): 5.0}
    return s


def iri(kind: str, key: str) -> str:
    return f"'<{EX}{kind}' || {key} || '>'"


def lit(c: str) -> str:
    return f"""'"' || {c} || '"'"""


def num(c: str, dt: str = "integer") -> str:
    return f"""'"' || {c} || '"^^<{terms.XSD}{dt}>'"""


def sparql(name, text, sql):
    register(name, sql)(lambda spark, d: run(store(spark, d), PREFIX + text))


sparql("sparql_triple", "SELECT ?n ?name { ?n ex:name ?name }", f"SELECT {iri('n', 'n_nationkey')} AS n, {lit('n_name')} AS name FROM nation")
sparql("sparql_bgp_chain", "SELECT ?s ?label { ?s ex:of ?n . ?n ex:in ?r . ?r ex:label ?label }", f"SELECT {iri('s', 's_suppkey')} AS s, {lit('r_name')} AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("sparql_bgp_star", "SELECT ?n ?name ?k { ?n ex:name ?name ; ex:key ?k ; ex:in ex:r2 }", f"SELECT {iri('n', 'n_nationkey')} AS n, {lit('n_name')} AS name, {num('n_nationkey', 'int')} AS k FROM nation WHERE n_regionkey = 2")
sparql("sparql_predicate_variable", "SELECT ?p (COUNT(*) AS ?c) { ?x ?p ?y } GROUP BY ?p", f"SELECT * FROM (SELECT '<{EX}name>' AS p, {num('count(*)')} AS c FROM nation UNION ALL SELECT '<{EX}in>', {num('count(*)')} FROM nation UNION ALL SELECT '<{EX}key>', {num('count(*)')} FROM nation UNION ALL SELECT '<{EX}label>', {num('count(*)')} FROM region UNION ALL SELECT '<{EX}of>', {num('count(*)')} FROM supplier UNION ALL SELECT '<{EX}sname>', {num('count(*)')} FROM supplier UNION ALL SELECT '<{EX}lives>', {num('count(*)')} FROM customer UNION ALL SELECT '<{EX}segment>', {num('count(*)')} FROM customer)")
sparql("sparql_blank_node", "SELECT DISTINCT ?r { _:x ex:in ?r }", f"SELECT DISTINCT {iri('r', 'n_regionkey')} AS r FROM nation")
sparql(
    "sparql_optional",
    "SELECT ?n ?s { ?n ex:in ex:r1 . OPTIONAL { ?s ex:of ?n . ?s ex:sname ?nm } }",
    f"SELECT {iri('n', 'n_nationkey')} AS n, {iri('s', 's_suppkey')} AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
)
sparql(
    "sparql_optional_then_join",
    "SELECT ?r ?n ?s { ?r ex:label ?l . OPTIONAL { ?n ex:in ?r . FILTER(?l = \"ASIA\") } ?s ex:of ?n }",
    f"""WITH o AS (SELECT r_regionkey AS r, n_nationkey AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_name = 'ASIA')
        SELECT {iri('r', 'r')} AS r, {iri('n', 's_nationkey')} AS n, {iri('s', 's_suppkey')} AS s FROM o JOIN supplier ON n IS NULL OR n = s_nationkey""",
)
sparql("sparql_filter", "SELECT ?n ?k { ?n ex:key ?k . FILTER(?k >= 5 && ?k < 9.5 || ?k = 20) }", f"SELECT {iri('n', 'n_nationkey')} AS n, {num('n_nationkey', 'int')} AS k FROM nation WHERE (n_nationkey >= 5 AND n_nationkey < 9.5) OR n_nationkey = 20")
sparql("sparql_filter_functions", 'SELECT ?n { ?n ex:name ?x . FILTER(STRSTARTS(?x, "I") && !BOUND(?z)) }', f"SELECT {iri('n', 'n_nationkey')} AS n FROM nation WHERE n_name LIKE 'I%'")
sparql("sparql_union", "SELECT ?x ?v { { ?x ex:name ?v } UNION { ?x ex:label ?v } }", f"SELECT {iri('n', 'n_nationkey')} AS x, {lit('n_name')} AS v FROM nation UNION ALL SELECT {iri('r', 'r_regionkey')}, {lit('r_name')} FROM region")
sparql("sparql_union_disjoint", "SELECT ?a ?b { { ?a ex:in ex:r0 } UNION { ?b ex:label ?l } }", f"SELECT {iri('n', 'n_nationkey')} AS a, NULL AS b FROM nation WHERE n_regionkey = 0 UNION ALL SELECT NULL, {iri('r', 'r_regionkey')} FROM region")
sparql("sparql_bind", "SELECT ?n ?twice ?bad { ?n ex:key ?k . ?n ex:name ?x . BIND(?k * 2 + 1 AS ?twice) BIND(?x / 2 AS ?bad) }", f"SELECT {iri('n', 'n_nationkey')} AS n, {num('(n_nationkey * 2 + 1)')} AS twice, CAST(NULL AS VARCHAR) AS bad FROM nation")
sparql("sparql_bind_str_cast", "SELECT ?n ?t ?f { ?n ex:key ?k . BIND(STR(?k) AS ?t) BIND(xsd:int(?t) AS ?f) }", f"SELECT {iri('n', 'n_nationkey')} AS n, {lit('n_nationkey')} AS t, {num('n_nationkey', 'int')} AS f FROM nation")
sparql("sparql_group", "SELECT ?r ?n { ?r ex:label ?l . { ?n ex:in ?r . ?n ex:key ?k . FILTER(?k < 10) } }", f"SELECT {iri('r', 'n_regionkey')} AS r, {iri('n', 'n_nationkey')} AS n FROM nation WHERE n_nationkey < 10")
sparql(
    "sparql_graph_join",
    f"SELECT ?st (COUNT(?o) AS ?c) {{ ?c2 ex:segment ?seg . GRAPH <{G2}> {{ ?o ex:by ?c2 . ?o ex:status ?st }} }} GROUP BY ?st",
    f"SELECT {lit('o_orderstatus')} AS st, {num('count(*)')} AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus",
)
sparql("sparql_minus", "SELECT ?n { ?n ex:name ?x . MINUS { ?n ex:in ex:r3 } }", f"SELECT {iri('n', 'n_nationkey')} AS n FROM nation WHERE n_regionkey <> 3")
sparql(
    "sparql_aggregates",
    "SELECT ?r (COUNT(?k) AS ?c) (SUM(?k) AS ?s) (MIN(?k) AS ?lo) (MAX(?k) AS ?hi) { ?n ex:in ?r . ?n ex:key ?k } GROUP BY ?r",
    f"SELECT {iri('r', 'n_regionkey')} AS r, {num('count(*)')} AS c, {num('sum(n_nationkey)')} AS s, {num('min(n_nationkey)', 'int')} AS lo, {num('max(n_nationkey)', 'int')} AS hi FROM nation GROUP BY n_regionkey",
)
sparql("sparql_count_distinct", "SELECT (COUNT(DISTINCT ?r) AS ?c) (COUNT(*) AS ?all) { ?n ex:in ?r }", f"SELECT {num('count(DISTINCT n_regionkey)')} AS c, {num('count(*)')} AS \"all\" FROM nation")
sparql("sparql_sum_error", "SELECT (SUM(?x) AS ?s) (COUNT(?x) AS ?c) { ?n ex:name ?x }", f"SELECT CAST(NULL AS VARCHAR) AS s, {num('count(*)')} AS c FROM nation")
sparql("sparql_empty_aggregate", "SELECT (COUNT(*) AS ?c) (SUM(?k) AS ?s) (MIN(?k) AS ?m) (GROUP_CONCAT(?k) AS ?g) { ?n ex:nothing ?k }", f"SELECT {num(chr(39) + '0' + chr(39))} AS c, {num(chr(39) + '0' + chr(39))} AS s, CAST(NULL AS VARCHAR) AS m, '\"\"' AS g")
sparql("sparql_group_concat", 'SELECT ?r (GROUP_CONCAT(?x; SEPARATOR="|") AS ?g) { ?n ex:in ?r . ?n ex:name ?x } GROUP BY ?r', f"SELECT {iri('r', 'n_regionkey')} AS r, {lit(chr(34) + 'g' + chr(34))} AS g FROM (SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS g FROM nation GROUP BY n_regionkey)")
sparql("sparql_having", "SELECT ?n { ?s ex:of ?n } GROUP BY ?n HAVING(COUNT(?s) > 4)", f"SELECT {iri('n', 's_nationkey')} AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 4")
sparql("sparql_group_expr", "SELECT ?h (COUNT(*) AS ?c) { ?n ex:key ?k . ?n ex:in ?r } GROUP BY (?k * 0 AS ?h)", f"SELECT {num(chr(39) + '0' + chr(39))} AS h, {num('count(*)')} AS c FROM nation")
sparql("sparql_order_limit", "SELECT ?n ?k { ?n ex:key ?k } ORDER BY DESC(?k) LIMIT 7 OFFSET 2", f"SELECT {iri('n', 'n_nationkey')} AS n, {num('n_nationkey', 'int')} AS k FROM nation ORDER BY n_nationkey DESC LIMIT 7 OFFSET 2")
sparql("sparql_distinct", "SELECT DISTINCT ?r { ?n ex:in ?r }", f"SELECT DISTINCT {iri('r', 'n_regionkey')} AS r FROM nation")
sparql("sparql_describe", "DESCRIBE ex:n3", f"SELECT {iri('n', '3')} AS subject, * FROM (SELECT '<{EX}name>' AS predicate, {lit('n_name')} AS object FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<{EX}in>', {iri('r', 'n_regionkey')} FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<{EX}key>', {num('n_nationkey', 'int')} FROM nation WHERE n_nationkey = 3)")
sparql("sparql_describe_where", "DESCRIBE ?r WHERE { ?n ex:in ?r . ?n ex:key ?k . FILTER(?k = 8) }", f"SELECT {iri('r', 'r_regionkey')} AS subject, '<{EX}label>' AS predicate, {lit('r_name')} AS object FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 8")
sparql("sparql_select_star", "SELECT * { ?r ex:label ?l }", f"SELECT {iri('r', 'r_regionkey')} AS r, {lit('r_name')} AS l FROM region")

D = "((s_suppkey % 10 + 1) / 10.0)"


def fuzzy(name, text, sql):
    """Degrees are compared as doubles rounded to 5 places, so that single precision does not show."""

    def q(spark, d):
        df = run(store(spark, d), PREFIX + text)
        return df.withColumn("t", F.round(F.regexp_extract("t", r'"([^"]*)"', 1).try_cast("double"), 5)) if "t" in df.columns else df

    register(name, sql)(q)


fuzzy("fuzzy_degree", "SELECT ?s ?t { TRUTH ?t OF { ?s ex:of ?n . ?s ex:sname ?x } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(CAST({D} * {D} AS DOUBLE), 5) AS t FROM supplier")
fuzzy("fuzzy_very", "SELECT ?s ?t { TRUTH ?t OF VERY { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(CAST({D} * {D} AS DOUBLE), 5) AS t FROM supplier")
fuzzy("fuzzy_extremely", "SELECT ?s ?t { TRUTH ?t OF EXTREMELY { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(CAST({D} * {D} * {D} AS DOUBLE), 5) AS t FROM supplier")
fuzzy("fuzzy_more_or_less", "SELECT ?s ?t { TRUTH ?t OF MORE_OR_LESS { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(sqrt({D}), 5) AS t FROM supplier")
fuzzy("fuzzy_not", "SELECT ?s ?t { TRUTH ?t OF NOT { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(CAST(1 - {D} AS DOUBLE), 5) AS t FROM supplier")
fuzzy("fuzzy_threshold", "SELECT ?s { TRUTH 0.45 OF { ?s ex:of ?n . ?n ex:in ex:r1 } }", f"SELECT {iri('s', 's_suppkey')} AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND {D} >= 0.45")
fuzzy("fuzzy_threshold_very", "SELECT ?s { TRUTH 0.45 OF VERY { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s FROM supplier WHERE {D} * {D} >= 0.45")
fuzzy("fuzzy_threshold_not", "SELECT ?s { TRUTH 0.45 OF NOT { ?s ex:of ?n } }", f"SELECT {iri('s', 's_suppkey')} AS s FROM supplier WHERE 1 - {D} >= 0.45")
fuzzy("fuzzy_optional", "SELECT ?n ?s ?t { ?n ex:in ex:r1 . TRUTH ?t OF { OPTIONAL { ?s ex:of ?n } } }", f"SELECT {iri('n', 'n_nationkey')} AS n, {iri('s', 's_suppkey')} AS s, round(CAST({D} AS DOUBLE), 5) AS t FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
fuzzy("fuzzy_union", "SELECT ?x ?t { TRUTH ?t OF { { ?x ex:of ex:n1 } UNION { ?x ex:label ?l } } }", f"SELECT {iri('s', 's_suppkey')} AS x, round(CAST({D} AS DOUBLE), 5) AS t FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT {iri('r', 'r_regionkey')}, 1.0 FROM region")
fuzzy("fuzzy_nested", "SELECT ?s ?t { TRUTH ?t OF VERY { ?s ex:sname ?x . TRUTH ?inner OF NOT { ?s ex:of ?n } } }", f"SELECT {iri('s', 's_suppkey')} AS s, round(CAST({D} * {D} * {D} * {D} AS DOUBLE), 5) AS t FROM supplier")


# -- property-graph operators


def _graph(spark, d):
    return store(spark, d).triples().filter(F.col("g") == G)


@register("graph_counts", f"SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS edges")
def graph_counts(spark, d):
    t = _graph(spark, d)
    return pg.node_count(t).join(pg.edge_count(t)).select("nodes", "edges")  # one row beside one row


@register("graph_properties", f"SELECT '<{EX}' || p || '>' AS p, n FROM (SELECT 'name' AS p, count(*) AS n FROM nation UNION ALL SELECT 'key', count(*) FROM nation UNION ALL SELECT 'label', count(*) FROM region UNION ALL SELECT 'sname', count(*) FROM supplier UNION ALL SELECT 'segment', count(*) FROM customer)")
def graph_properties(spark, d):
    return pg.properties(_graph(spark, d)).groupBy(terms.render(F.col("p")).alias("p")).agg(F.count("*").alias("n"))


@register("graph_node_expansion", f"SELECT {iri('n', 'n_nationkey')} AS n, {iri('s', 's_suppkey')} AS other FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT {iri('n', 'n_nationkey')}, {iri('c', 'c_custkey')} FROM nation JOIN customer ON c_nationkey = n_nationkey")
def graph_node_expansion(spark, d):
    t = _graph(spark, d)
    start = t.filter(F.col("p.lex") == EX + "name").select(F.col("s").alias("n"))
    return pg.node_expansion(start, t, "n", outgoing=False).select(terms.render(F.col("n")).alias("n"), terms.render(F.col("other")).alias("other"))


@register("graph_edge_expansion", f"SELECT {iri('n', 's_nationkey')} AS node FROM supplier")
def graph_edge_expansion(spark, d):
    return pg.edge_expansion(pg.edges(_graph(spark, d)), label=EX + "of").select(terms.render(F.col("node")).alias("node"))


@register("graph_identifier", f"SELECT '<{EX}n7>' AS node")
def graph_identifier(spark, d):
    return pg.identifier(_graph(spark, d), EX + "n7").select(terms.render(F.col("node")).alias("node"))


def _name(kind, key):
    return F.concat(F.lit(kind), key)


def _links(spark, d, node=_name):
    """Trade of all orders: customers to their suppliers and parts, suppliers to parts."""
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    sold = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, s, p = (node(kind, F.col(key)) for kind, key in (("c", "o_custkey"), ("s", "l_suppkey"), ("p", "l_partkey")))
    ends = F.explode(F.array(F.struct(c.alias("src"), s.alias("dst")), F.struct(c.alias("src"), p.alias("dst")), F.struct(s.alias("src"), p.alias("dst"))))
    return sold.select(ends.alias("e")).select("e.src", "e.dst").distinct()


LINKS = """(SELECT DISTINCT src, dst FROM (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


@register("graph_triangles", f"WITH e AS {LINKS} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")
def graph_triangles(spark, d):
    kinds = "csp"
    code = lambda kind, key: key.cast("bigint") * 4 + kinds.index(kind)
    found = pg.triangles(_links(spark, d, code))
    name = lambda c: _name(F.substring(F.lit(kinds), F.col(c).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)), F.shiftright(c, 2))
    return found.select(*(name(c).alias(c) for c in "abc"))


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(
        f", r{i + 1} AS (SELECT nodes.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.got, 0) AS rank FROM nodes LEFT JOIN (SELECT e.dst AS node, sum(r{i}.rank / o.out) AS got FROM e JOIN o USING (src) JOIN r{i} ON r{i}.node = e.src GROUP BY 1) g USING (node))"
        for i in range(rounds)
    )
    return f"WITH e AS {LINKS}, o AS (SELECT src, count(*) AS out FROM e GROUP BY 1), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes){steps} SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@register("graph_pagerank", _pagerank_sql(5))
def graph_pagerank(spark, d):
    return pg.pagerank(_links(spark, d), 5).select("node", F.round("rank", 8).alias("rank"))


@register("graph_kmeans", None)
def graph_kmeans(spark, d):
    points = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("features"))
    return pg.kmeans(points, 4, 5)
