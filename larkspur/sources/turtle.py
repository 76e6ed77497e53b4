"""Turtle and Fuzzy-Turtle: files become rows (s, p, o, truth).

In the fuzzy dialect a truth degree {d}, 0 <= d <= 1, may follow an object outside
collections; triples without one have degree 1.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms

_TOKENS = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<iri><[^<>"{}|^`\s]*>)|(?P<degree>\{\s*[-+0-9.eE]+\s*\})|(?P<bnode>_:[\w.\-]*[\w\-])|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<hat>\^\^)|(?P<at>@[A-Za-z][\w\-]*)|(?P<name>[A-Za-z_À-￿][\w.\-]*(?<!\.)|(?=:))?(?P<local>:(?:[\w\-%\\~!$&'()*+,;=/?#@]|\.(?=[\w:%\-]))*)?(?<=.)|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


class TurtleError(ValueError):
    pass


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


def _lex(text: str):
    at = 0
    while at < len(text):
        c = text[at]
        if c in ".;,[]()" and not (c == "." and at + 1 < len(text) and text[at + 1].isdigit()):
            yield "mark", c
            at += 1
            continue
        m = _TOKENS.match(text, at)
        if not m or m.end() == at:
            raise TurtleError(f"unexpected {text[at : at + 20]!r}")
        kind = m.lastgroup
        if kind in ("name", "local"):
            kind = "name"
        if kind != "space":
            yield kind, m.group()
        at = m.end()


class Parser:
    """One document; triples() gives (s, p, o, degree) with terms (kind, lex, dt, lang)."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.tokens = [*_lex(text), ("end", "")]
        self.at, self.base, self.scope = 0, base, scope
        self.prefixes: dict = {}
        self.out: list = []
        self.fresh = 0

    def peek(self):
        return self.tokens[self.at]

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, mark):
        kind, value = self.next()
        if value != mark:
            raise TurtleError(f"expected {mark!r}, found {value!r}")

    def triples(self) -> list:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            word = value.lower()
            if word in ("@prefix", "prefix", "@base", "base") and kind in ("at", "name"):
                self.next()
                if word.endswith("prefix"):
                    name = self.next()[1]
                    self.prefixes[name.rstrip(":")] = self.iri(self.next())
                else:
                    self.base = self.iri(self.next())
                if word.startswith("@"):
                    self.expect(".")
                continue
            if value == "[":
                subject = self.node(False)
                if self.peek()[1] != ".":
                    self.predicates(subject)
            else:
                self.predicates(self.node(False))
            self.expect(".")
        return self.out

    def iri(self, token) -> str:
        kind, value = token
        if kind == "iri":
            ref = _unescape(value[1:-1])
            return urljoin(self.base, ref) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", ref) else ref
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"expected an IRI, found {value!r}")

    def blank(self, label=None):
        if label is None:
            self.fresh += 1
            label = f"anon{self.fresh}"
        return (0, f"{self.scope}{label}", None, None)

    def predicates(self, subject) -> None:
        while True:
            kind, value = self.next()
            verb = (1, RDF + "type", None, None) if value == "a" else (1, self.iri((kind, value)), None, None)
            while True:
                o = self.node(True)
                degree = 1.0
                if self.peek()[0] == "degree":
                    degree = float(self.next()[1][1:-1])
                    if not 0 <= degree <= 1:
                        raise TurtleError(f"degree {degree} is not between 0 and 1")
                self.out.append((subject, verb, o, degree))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
                ended = self.peek()[1] in (".", "]", ";")
                if not ended:
                    break
            else:
                return
            if self.peek()[1] in (".", "]"):
                return

    def node(self, as_object: bool):
        kind, value = self.next()
        if value == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.predicates(node)
            self.expect("]")
            return node
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node(True))
                if self.peek()[0] == "degree":
                    raise TurtleError("a degree is not allowed in a collection")
            self.next()
            rest = (1, RDF + "nil", None, None)
            for item in reversed(items):
                cell = self.blank()
                self.out += [(cell, (1, RDF + "first", None, None), item, 1.0), (cell, (1, RDF + "rest", None, None), rest, 1.0)]
                rest = cell
            return rest
        if kind == "bnode":
            return self.blank(value[2:])
        if kind == "iri" or (kind == "name" and ":" in value):
            return (1, self.iri((kind, value)), None, None)
        if not as_object:
            raise TurtleError(f"{value!r} can't be a subject")
        if kind in ("string", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "at":
                return (2, text, terms.LANG_STRING, self.next()[1][1:].lower())
            if self.peek()[0] == "hat":
                self.next()
                return (2, text, self.iri(self.next()), None)
            return (2, text, terms.STRING, None)
        if kind == "number":
            dt = "double" if re.search("[eE]", value) else "decimal" if "." in value else "integer"
            return (2, value, terms.XSD + dt, None)
        if value in ("true", "false"):
            return (2, value, terms.XSD + "boolean", None)
        raise TurtleError(f"unexpected {value!r}")


def parse(text: str, base: str = "", scope: str = "") -> list:
    return Parser(text, base, scope).triples()


def _with_num(t):
    kind, lex, dt, lang = t
    num = None
    if dt in terms.NUMERIC:
        try:
            num = float(lex)
        except ValueError:
            num = None
    return {"kind": kind, "lex": lex, "dt": dt, "lang": lang, "num": num}


TRIPLES = f"s {terms.TERM}, p {terms.TERM}, o {terms.TERM}, truth float"


def read(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Triples (g, s, p, o, truth) of the files at path, each parsed where it is read."""

    def parsed(batches):
        import pandas as pd

        for pdf in batches:
            for text in pdf["value"]:
                rows = [(_with_num(s), _with_num(p), _with_num(o), d) for s, p, o, d in parse(text, path)]
                yield pd.DataFrame(rows, columns=["s", "p", "o", "truth"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(parsed, TRIPLES)
    return rows.dropDuplicates(["s", "p", "o"]).select(F.lit(graph).alias("g"), "s", "p", "o", "truth")


def from_rows(spark: SparkSession, graph: str, triples: list) -> DataFrame:
    """A small graph from parsed triples."""
    rows = [(graph, _with_num(s), _with_num(p), _with_num(o), float(d)) for s, p, o, d in triples]
    return spark.createDataFrame(rows, "g string, " + TRIPLES)


def from_table(df: DataFrame, graph: str, subject: str, base: str, properties: dict, truth=None) -> DataFrame:
    """Triples of a table: one subject IRI per row (base + key), one predicate per property.

    properties: {predicate name: (column, None for an IRI of another base, or a datatype)};
    ("column", "iri:<base>") makes an IRI object.  truth: Column with the degree.

    Every property is a branch of a union with a constant predicate, so a pattern with
    a constant predicate scans that branch alone, and of its table two columns."""
    s = terms.iri(F.concat(F.lit(base), F.col(subject).cast("string")))
    degree = (F.lit(1.0) if truth is None else truth).cast("float")
    parts = []
    for name, (column, kind) in properties.items():
        c = F.col(column).cast("string")
        o = terms.iri(F.concat(F.lit(kind[4:]), c)) if kind.startswith("iri:") else terms.literal(c, kind)
        kept = df.filter(F.col(subject).isNotNull() & F.col(column).isNotNull())
        parts.append(kept.select(F.lit(graph).alias("g"), s.alias("s"), terms.iri(name).alias("p"), o.alias("o"), degree.alias("truth")))
    return reduce(DataFrame.unionByName, parts)
