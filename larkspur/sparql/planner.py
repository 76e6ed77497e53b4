"""Graph patterns as DataFrames.

Every variable is a column holding a term; a variable that each row of a plan is
sure to bind is ``certain``.  Joins on certain variables are equi-joins by value;
where a shared variable may be unbound, NULL is compatible with anything and the
merged value is the one that is bound.  Inside TRUTH blocks a column holds the
product of the degrees of the triples matched so far.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from .parser import SparqlError, UnsupportedFeature

DEG = "deg"


@dataclass
class Plan:
    df: DataFrame | None
    vars: list = field(default_factory=list)
    certain: set = field(default_factory=set)


def col(name: str) -> str:
    return "v_" + name


class Planner:
    def __init__(self, triples: DataFrame, default_graph: str | None, counts: dict | None = None):
        self.triples, self.default, self.counts = triples, default_graph, counts or {}
        self.spark = triples.sparkSession

    # -- patterns

    def unit(self) -> Plan:
        return Plan(self.spark.range(1).select(F.lit(None).cast("double").alias(DEG)))

    def triple(self, pattern, graph) -> Plan:
        df = self.triples.filter(F.col("g") == graph) if graph is not None else self.triples.filter("g is null")
        places: dict = {}
        for part, t in zip("spo", pattern, strict=True):
            c = F.col(part)
            if t[0] == "iri":
                df = df.filter((c["kind"] == 1) & (c["lex"] == t[1]))
            else:
                places.setdefault(t[1] if t[0] == "var" else f" {t[1]}", []).append(part)
        for parts in places.values():
            for other in parts[1:]:
                df = df.filter(terms.value_key(F.col(parts[0])) == terms.value_key(F.col(other)))
        df = df.select(*(F.col(parts[0]).alias(col(name)) for name, parts in places.items()), F.col("truth").cast("double").alias(DEG))
        return Plan(df, list(places), set(places))

    def weight(self, pattern, bound: set) -> float:
        """Estimated rows: triples of the predicate, fewer for each end that is constant or bound."""
        s, p, o = pattern
        n = self.counts.get(p[1], 1.0) if p[0] == "iri" else sum(self.counts.values()) or 10.0
        for t in (s, o):
            if t[0] == "iri" or t[1] in bound:
                n = max(1.0, n / 100)
        return n

    def bgp(self, patterns: list, graph, start: Plan | None) -> Plan:
        """Joins the triples greedily: cheapest connected pattern next."""
        plan, left = start, list(patterns)
        while left:
            bound = set(plan.vars) if plan else set()
            linked = [t for t in left if not bound or any(x[0] != "iri" and (x[1] if x[0] == "var" else " " + x[1]) in bound for x in t)] or left
            best = min(linked, key=lambda t: self.weight(t, bound))
            left.remove(best)
            one = self.triple(best, graph)
            plan = self.join(plan, one) if plan else one
        return plan

    def join(self, a: Plan, b: Plan, how: str = "inner", condition=None) -> Plan:
        shared = [v for v in a.vars if v in b.vars]
        right = b.df.select(*(F.col(col(v)).alias("r_" + v) for v in b.vars), F.col(DEG).alias("r_deg"))
        sure = [v for v in shared if v in a.certain and v in b.certain]
        conds = [terms.value_key(F.col(col(v))) == terms.value_key(F.col("r_" + v)) for v in sure]
        for v in shared:
            if v not in sure:
                x, y = F.col(col(v)), F.col("r_" + v)
                conds.append(x.isNull() | y.isNull() | (terms.value_key(x) == terms.value_key(y)))
        if condition is not None:
            conds.append(condition(a, b))
        on = reduce(lambda x, y: x & y, conds) if conds else None
        if how == "minus":
            overlap = [F.col(col(v)).isNotNull() & F.col("r_" + v).isNotNull() for v in shared]
            if not shared:
                return a
            return Plan(a.df.join(right, on & reduce(lambda x, y: x | y, overlap), "left_anti"), a.vars, a.certain)
        if on is None:
            df = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), "left")
        else:
            df = a.df.join(right, on, "left" if how == "left" else "inner")
        degree = F.when(F.col(DEG).isNull() & F.col("r_deg").isNull(), None).otherwise((F.coalesce(F.col(DEG), F.lit(1.0)).cast("float") * F.coalesce(F.col("r_deg"), F.lit(1.0)).cast("float")).cast("double"))
        out = [F.col(col(v)).alias(col(v)) if v not in b.vars or v in sure else F.coalesce(F.col(col(v)), F.col("r_" + v)).alias(col(v)) for v in a.vars]
        out += [F.col("r_" + v).alias(col(v)) for v in b.vars if v not in a.vars]
        certain = set(a.certain) | (b.certain if how == "inner" else set())
        return Plan(df.select(*out, degree.alias(DEG)), [*a.vars, *(v for v in b.vars if v not in a.vars)], certain)

    def group(self, elements: list, graph) -> Plan:
        plan: Plan | None = None
        for i, e in enumerate(elements):
            kind = e[0]
            if kind == "triples":
                plan = self.bgp(e[1], graph, plan)
            elif kind in ("group", "graph", "truth", "union"):
                if kind == "group":
                    one = self.group(e[1], graph)
                elif kind == "graph":
                    one = self.group(e[2], e[1])
                elif kind == "union":
                    one = self.union([self.group(g, graph) for g in e[1]])
                else:
                    one = self.truth(e, graph)
                plan = self.join(plan, one) if plan else one
            elif kind == "optional":
                inner = list(e[1])
                lifted = []
                own = self._names(inner)
                while inner and inner[-1][0] == "filter" and not self._vars(inner[-1][1]) <= own:
                    lifted.append(inner.pop()[1])  # a filter on outer variables is part of the join
                one = self.group(inner, graph)
                cond = (lambda fs: lambda a, b: reduce(lambda x, y: x & y, [F.coalesce(self.truthy(f, self._scope(a, b)), F.lit(False)) for f in fs]))(lifted) if lifted else None
                plan = self.join(plan or self.unit(), one, "left", cond)
            elif kind == "minus":
                plan = self.join(plan or self.unit(), self.group(e[1], graph), "minus")
            elif kind == "filter":
                if plan is None:
                    if i == 0 and len(elements) > 1:
                        raise SparqlError("a group can't begin with FILTER")
                    plan = self.unit()
                plan = Plan(plan.df.filter(F.coalesce(self.truthy(e[1], self._scope(plan)), F.lit(False))), plan.vars, plan.certain)
            elif kind == "bind":
                plan = plan or self.unit()
                if e[2] in plan.vars:
                    raise SparqlError(f"?{e[2]} is bound already")
                value = self.value(e[1], self._scope(plan))
                plan = Plan(plan.df.withColumn(col(e[2]), value), [*plan.vars, e[2]], plan.certain | ({e[2]} if e[1][0] in ("lit", "iri") else set()))
        return plan or self.unit()

    def union(self, parts: list) -> Plan:
        names = list(dict.fromkeys(v for p in parts for v in p.vars))
        frames = [p.df.select(*((F.col(col(v)) if v in p.vars else F.lit(None).cast(terms.TERM)).alias(col(v)) for v in names), DEG) for p in parts]
        return Plan(reduce(DataFrame.unionByName, frames), names, set.intersection(*(p.certain for p in parts)))

    def truth(self, e, graph) -> Plan:
        _, what, hedge, inner = e
        plan = self.group(inner, graph)
        degree = hedged(F.col(DEG), hedge)
        if isinstance(what, float):
            return Plan(plan.df.filter(F.coalesce(degree, F.lit(1.0 if hedge != "NOT" else 0.0)).cast("float") >= F.lit(what).cast("float")), plan.vars, plan.certain)
        if what in plan.vars:
            raise SparqlError(f"?{what} is bound already")
        bound = F.when(degree.isNotNull(), terms.term(2, degree.cast("float").cast("string"), terms.XSD + "float", None, degree.cast("float")))
        return Plan(plan.df.withColumn(col(what), bound), [*plan.vars, what], plan.certain)

    # -- names

    def _vars(self, e) -> set:
        if not isinstance(e, tuple) or not e:
            return set()
        return {e[1]} if e[0] == "var" else set().union(*(self._vars(x) for x in e))

    def _names(self, elements) -> set:
        out = set()
        for e in elements:
            if e[0] == "triples":
                out |= {x[1] for t in e[1] for x in t if x[0] == "var"}
            elif e[0] == "union":
                out |= set().union(*(self._names(g) for g in e[1]))
            elif e[0] in ("group", "optional"):
                out |= self._names(e[1])
            elif e[0] == "graph":
                out |= self._names(e[2])
            elif e[0] == "truth":
                out |= self._names(e[3]) | ({e[1]} if isinstance(e[1], str) else set())
            elif e[0] == "bind":
                out.add(e[2])
        return out

    @staticmethod
    def _scope(a: Plan, b: Plan | None = None) -> dict:
        scope = {v: F.col("r_" + v) for v in b.vars} if b else {}
        return scope | {v: F.coalesce(F.col(col(v)), scope[v]) if v in scope else F.col(col(v)) for v in a.vars}

    # -- expressions

    def value(self, e, scope: dict) -> Column:
        """The term an expression yields; NULL on error."""
        kind = e[0]
        if kind == "column":
            return e[1]
        if kind == "var":
            return scope.get(e[1], F.lit(None).cast(terms.TERM))
        if kind == "iri":
            return terms.iri(e[1])
        if kind == "lit":
            return terms.literal(e[1], e[2])
        if kind == "arith":
            return terms.arithmetic(e[1], self.value(e[2], scope), self.value(e[3], scope))
        if kind == "cast":
            return terms.cast(self.value(e[2], scope), e[1])
        if kind == "call" and e[1] == "STR":
            t = self.value(e[2], scope)
            return terms.literal(F.when(t["kind"] != 0, t["lex"]))
        if kind == "call" and e[1] == "LANG":
            t = self.value(e[2], scope)
            return terms.literal(F.when(t["kind"] == 2, F.coalesce(t["lang"], F.lit(""))))
        return terms.boolean(self.truthy(e, scope))

    def truthy(self, e, scope: dict) -> Column:
        """The boolean an expression yields; NULL on error."""
        kind = e[0]
        if kind == "or":
            return self.truthy(e[1], scope) | self.truthy(e[2], scope)
        if kind == "and":
            return self.truthy(e[1], scope) & self.truthy(e[2], scope)
        if kind == "not":
            return ~self.truthy(e[1], scope)
        if kind == "cmp":
            return terms.compare(e[1], self.value(e[2], scope), self.value(e[3], scope))
        if kind == "call":
            if e[1] == "BOUND":
                return self.value(e[2], scope).isNotNull()
            if e[1] == "STRSTARTS":
                a, b = self.value(e[2], scope), self.value(e[3], scope)
                return F.when((a["kind"] == 2) & (b["kind"] == 2), F.startswith(a["lex"], b["lex"]))
            if e[1] == "LANGMATCHES":
                a, b = F.lower(self.value(e[2], scope)["lex"]), F.lower(self.value(e[3], scope)["lex"])
                return F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-"))))
        if kind == "agg":
            raise SparqlError("an aggregate stands outside SELECT, HAVING and ORDER BY")
        return terms.truth_value(self.value(e, scope))

    # -- aggregation

    def aggregate(self, e, scope: dict) -> Column:
        """An aggregate over a group as a term."""
        _, name, distinct, arg, separator = e
        if arg is None:
            return terms.number(F.count_distinct(*(terms.id_key(c) for c in scope.values())) if distinct and scope else F.count(F.lit(1)), terms.XSD + "integer")
        t = self.value(arg, scope)
        key = terms.id_key(t)
        if name == "COUNT":
            return terms.number(F.count_distinct(key) if distinct else F.count(key), terms.XSD + "integer")
        if name in ("SUM", "AVG"):
            num = t["num"]
            wrong = F.max(F.when(num.isNull(), 1).otherwise(0))
            rank = F.coalesce(F.max(terms._rank(t)), F.lit(0))
            if distinct:  # terms differ by identity, so equal values of unlike terms count each
                each = F.collect_set(F.struct(key.alias("k"), num.alias("n")))
                total, n = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["n"]), F.size(each)
            else:
                total, n = F.sum(num), F.count(key)
            if name == "AVG":
                total, rank = F.when(n > 0, F.try_divide(total, n)).otherwise(0.0), F.greatest(rank, F.when(n > 0, 1).otherwise(0))
            dt = F.element_at(F.array(*map(F.lit, (terms.XSD + "integer", terms.XSD + "decimal", terms.XSD + "float", terms.XSD + "double"))), rank + 1)
            return F.when(F.coalesce(wrong, F.lit(0)) == 0, terms.number(F.coalesce(total, F.lit(0.0)), dt))
        if name in ("MIN", "MAX"):
            keyed = F.struct(F.coalesce(t["kind"], F.lit(-1)).alias("a"), F.coalesce(t["num"], F.lit(float("inf"))).alias("b"), t["lex"].alias("c"), t.alias("t"))
            picked = F.when(t.isNotNull(), keyed)
            return (F.min(picked) if name == "MIN" else F.max(picked))["t"]
        if name == "SAMPLE":
            return F.any_value(t, F.lit(True))
        text = F.when(t["kind"] != 0, t["lex"])
        values = F.collect_set(F.struct(key.alias("k"), text.alias("x"))) if distinct else F.collect_list(F.when(text.isNotNull(), F.struct(key.alias("k"), text.alias("x"))))
        return terms.literal(F.array_join(F.transform(F.array_sort(values), lambda v: v["x"]), separator))


def hedged(degree: Column, hedge: str | None) -> Column:
    if hedge is None:
        return degree
    if hedge == "VERY":
        out = degree.cast("float") * degree.cast("float")
    elif hedge == "EXTREMELY":
        out = degree.cast("float") * degree.cast("float") * degree.cast("float")
    elif hedge == "MORE_OR_LESS":
        out = F.sqrt(degree)
    elif hedge == "NOT":
        out = F.lit(1.0).cast("float") - degree.cast("float")
    else:
        raise UnsupportedFeature(f"hedge {hedge}")
    return out.cast("double")
