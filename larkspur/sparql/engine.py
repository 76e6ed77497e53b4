"""Graph store, statements and solution modifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..sources import turtle
from .parser import AGGREGATES, SparqlError, parse  # noqa: F401
from .planner import DEG, Plan, Planner, col

#: DESCRIBE of one of these IRIs changes a setting.
SETTINGS = ("persists", "initialize", "defaultGraph", "capacity", "nodeCapacity", "edgeCapacity", "propCapacity")


class GraphStore:
    """Named graphs as one DataFrame of triples (g, s, p, o, truth)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs: dict = {}
        self.counts: dict = {}
        self.default: str | None = None
        self.settings: dict = {}

    def add(self, graph: str, triples: DataFrame) -> None:
        """Registers a graph; its columns are those of turtle.read()."""
        self.graphs[graph] = triples.select(F.lit(graph).alias("g"), "s", "p", "o", F.coalesce(F.col("truth"), F.lit(1.0)).cast("float").alias("truth"))
        if self.default is None:
            self.default = graph

    def load(self, path: str, graph: str) -> None:
        self.add(graph, turtle.read(self.spark, path, graph))

    def analyze(self) -> None:
        """Counts triples per predicate for join ordering: a row per predicate."""
        rows = self.triples().filter(F.col("p.kind") == 1).groupBy("p.lex").count().collect()
        self.counts = {r["lex"]: float(r["count"]) for r in rows}

    def triples(self) -> DataFrame:
        out = None
        for df in self.graphs.values():
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], "g string, " + turtle.TRIPLES)


def split(text: str) -> list:
    """Statements between semicolons at brace depth 0, outside strings, IRIs and comments."""
    out, depth, now = [], 0, []
    for t in re.findall(r"#[^\n]*|<[^<>\s]*>|\"{3}.*?\"{3}|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|.", text, re.S):
        if t.startswith("#"):
            now.append("\n")
            continue
        depth += (t in "{(") - (t in "})") if len(t) == 1 else 0
        if t == ";" and depth == 0:
            out.append("".join(now))
            now = []
        else:
            now.append(t)
    out.append("".join(now))
    return [s.strip() for s in out if s.strip()]


def run(store: GraphStore, text: str) -> DataFrame | None:
    """Runs statements; the last one's rows, None for LOAD and settings."""
    out = None
    for statement in split(text):
        load = re.match(r"LOAD\s+<file://([^>]*)>\s+INTO\s+GRAPH\s+<([^>]*)>\s*$", statement, re.I)
        setting = re.match(r"DESCRIBE\s+<(?:settings?:|[^>]*[/#])(" + "|".join(SETTINGS) + r")[=/]([^>]*)>\s*$", statement, re.I)
        if load:
            store.load(load[1], load[2])
            out = None
        elif setting:
            store.settings[setting[1]] = setting[2]
            if setting[1] == "defaultGraph":
                store.default = setting[2]
            out = None
        else:
            out = query(store, statement)
    return out


def _aggregates(e, found: dict):
    """Replaces aggregates by columns and collects them."""
    if isinstance(e, tuple):
        if e and e[0] == "agg":
            name = found.setdefault(e, f"agg_{len(found)}")
            return ("aggregated", name)
        return tuple(_aggregates(x, found) for x in e)
    return e


def _resolve(e, grouped: dict):
    """Expressions over a grouped plan: keys and aggregates become columns."""
    if isinstance(e, tuple):
        if e and e[0] == "aggregated":
            return ("column", F.col(e[1]))
        if e in grouped:
            return ("column", F.col(grouped[e]))
        return tuple(_resolve(x, grouped) if isinstance(x, tuple) else x for x in e)
    return e


def query(store: GraphStore, text: str) -> DataFrame:
    """SELECT or DESCRIBE; all columns are strings, in the lexical form of terms."""
    q = parse(text)
    planner = Planner(store.triples(), store.default, store.counts)
    if q["kind"] == "DESCRIBE":
        return _describe(store, planner, q)
    plan = planner.group(q["where"], store.default)
    select = q["select"]
    found: dict = {}
    if select == "*":
        names = [v for v in plan.vars if not v.startswith(" ")]
        select = [(("var", v), v) for v in names]
    outputs = [(_aggregates(e, found), n) for e, n in select]
    having = [_aggregates(e, found) for e in q["having"]]
    order = [(_aggregates(e, found), d) for e, d in q["order"]]
    scope = planner._scope(plan)
    if q["group"] or found:
        keys, grouped, df = [], {}, plan.df
        for i, (e, name) in enumerate(q["group"]):
            key = f"key_{i}"
            if name and e[0] != "var" and name in plan.vars:
                raise SparqlError(f"?{name} is bound already")
            df = df.withColumn(key, planner.value(e, scope))
            keys.append(key)
            grouped[e] = key
            if name:
                grouped[("var", name)] = key
        earlier: set = set()
        for e, n in outputs:
            loose = planner._vars(_strip(e, grouped)) - {v[1] for v in grouped if v[0] == "var"} - earlier
            earlier |= {n}
            if loose:
                raise SparqlError(f"?{sorted(loose)[0]} is neither grouped nor aggregated")
            if e[0] != "var" and ("var", n) in grouped:
                raise SparqlError(f"?{n} is bound already")
        aggs = [planner.aggregate(e, scope).alias(n) for e, n in found.items()]
        df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        later: dict = {}
        for e, n in outputs:  # an expression may use the names before it
            df = df.withColumn("o_" + n, planner.value(_resolve(e, grouped), later))
            later[n] = F.col("o_" + n)
        for e in having:
            df = df.filter(F.coalesce(planner.truthy(_resolve(e, grouped), later), F.lit(False)))
        sorts = [(planner.value(_resolve(e, grouped), later), d) for e, d in order]
    else:
        extended = dict(scope)
        df = plan.df
        exprs = []
        for e, n in outputs:
            if e[0] != "var" and n in plan.vars:
                raise SparqlError(f"?{n} is bound already")
            exprs.append(planner.value(e, extended).alias("o_" + n))
            if e[0] != "var":
                extended[n] = planner.value(e, scope)
        df = df.select("*", *exprs)
        sorts = [(planner.value(e, extended), d) for e, d in order]
    final = [F.col("o_" + n) for _, n in outputs]
    keys = [k for t, d in sorts for k in terms.order_keys(t, d)]
    shown = [terms.render(c).alias(n) for c, (_, n) in zip(final, outputs, strict=True)]
    if q["distinct"]:
        # order keys are functions of the selected terms where DISTINCT applies
        df = df.dropDuplicates(["o_" + n for _, n in outputs])
    if keys:
        df = df.orderBy(*keys)
    if q["offset"]:
        df = df.offset(q["offset"])
    if q["limit"] is not None:
        df = df.limit(q["limit"])
    return df.select(*shown)


def _strip(e, grouped: dict):
    """e without its grouped parts and aggregates."""
    if isinstance(e, tuple):
        if e in grouped or (e and e[0] == "aggregated"):
            return ()
        return tuple(_strip(x, grouped) if isinstance(x, tuple) else x for x in e)
    return e


def _describe(store: GraphStore, planner: Planner, q: dict) -> DataFrame:
    """Outgoing triples, in the default graph, of the described terms."""
    triples = store.triples().filter(F.col("g") == store.default) if store.default else store.triples()
    wanted = None
    plan: Plan | None = planner.group(q["where"], store.default) if q["where"] is not None else None
    names = [t[1] for t in q["select"] if t[0] == "var"] or ([v for v in plan.vars if not v.startswith(" ")] if plan and not q["select"] else [])
    for t in q["select"]:
        if t[0] == "iri":
            one = planner.spark.range(1).select(terms.id_key(terms.iri(t[1])).alias("k"))
            wanted = one if wanted is None else wanted.unionByName(one)
    for v in names:
        one = plan.df.select(terms.id_key(F.col(col(v))).alias("k"))
        wanted = one if wanted is None else wanted.unionByName(one)
    if wanted is None:
        raise SparqlError("nothing to describe")
    out = triples.join(wanted.distinct(), terms.id_key(F.col("s")) == F.col("k"), "left_semi")
    return out.select(terms.render(F.col("s")).alias("subject"), terms.render(F.col("p")).alias("predicate"), terms.render(F.col("o")).alias("object")).distinct()
