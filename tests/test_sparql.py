import random

import pytest

from larkspur.functions import terms
from larkspur.sources import turtle
from larkspur.sparql import engine
from larkspur.sparql.parser import SparqlError, UnsupportedFeature, parse
from tests import naive_sparql

P = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture(scope="module")
def triples():
    rng = random.Random(5)
    lines = [f":n{rng.randrange(12)} :{rng.choice('pqr')} :n{rng.randrange(12)} ." for _ in range(60)]
    lines += [f':n{i} :age {rng.choice([1, 2, 3.0, 7])} .' for i in range(0, 12, 2)] + [':n1 :age "old" .', ":n3 :p :n3 .", "_:b :p :n1 ."]
    return list(dict.fromkeys(turtle.parse("@prefix : <http://e/> . " + "\n".join(lines))))


@pytest.fixture(scope="module")
def store(spark, triples):
    s = engine.GraphStore(spark)
    s.add("g", turtle.from_rows(spark, "g", triples))
    s.analyze()
    return s


def lexical(t):
    if t is None:
        return None
    if t[0] == 1:
        return f"<{t[1]}>"
    if t[0] == 0:
        return f"_:{t[1]}"
    return f'"{t[1]}"' if t[2] == terms.STRING else f'"{t[1]}"^^<{t[2]}>'


PATTERNS = [
    "?a :p ?b",
    "?a :p ?b . ?b :q ?c",
    "?a :p ?a",
    "?a ?x :n1",
    "?a :p ?b . ?b :p ?c . ?a :p ?c",
    "?a :p _:z . _:z :q ?c",
    "?a :p ?b . OPTIONAL { ?b :age ?g }",
    "?a :p ?b . OPTIONAL { ?b :age ?g } ?c :age ?g",
    "?a :p ?b . OPTIONAL { ?b :age ?g } OPTIONAL { ?a :age ?g }",
    "?a :age ?g . FILTER(?g > 1 && ?g <= 3)",
    "?a :age ?g . FILTER(!(?g = 3) || ?a != :n4)",
    "?a :p ?b . OPTIONAL { ?b :age ?g } FILTER(!BOUND(?g))",
    "{ ?a :p ?b } UNION { ?a :q ?b }",
    "{ ?a :p ?b } UNION { ?c :q ?d } UNION { ?a :r ?d }",
    "{ ?a :p ?b } UNION { ?c :age ?g } ?a :q ?z",
    "?a :p ?b . MINUS { ?b :age ?g }",
    "?a :age ?g . ?b :age ?g",
    "?a :p ?b . { ?b :q ?c . OPTIONAL { ?c :age ?g } }",
]


@pytest.mark.parametrize("pattern", PATTERNS, ids=range(len(PATTERNS)))
def test_patterns(store, triples, pattern):
    text = P + "SELECT * { " + pattern + " }"
    df = engine.run(store, text)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    _, sols = naive_sparql.solve(triples, text)
    numeric = lambda v: v if v is None or "XMLSchema" not in v else float(v.split('"')[1])
    want = sorted((tuple(lexical(s.get(v)) for v in df.columns) for s in sols), key=repr)
    norm = lambda rows: sorted((tuple(map(numeric, r)) for r in rows), key=repr)
    assert norm(got) == norm(want)


def test_arithmetic_and_binding(store, triples):
    text = P + "SELECT ?a ?v ?e { ?a :age ?g . BIND(?g * 2 - 1 AS ?v) BIND(?g / 0 AS ?e) }"
    got = {r["a"]: (None if r["v"] is None else float(r["v"].split('"')[1]), r["e"]) for r in engine.run(store, text).collect()}
    _, sols = naive_sparql.solve(triples, text)
    assert got == {lexical(s["a"]): (float(s["v"][1]) if "v" in s else None, None) for s in sols}


def one(store, text):
    return [tuple(r) for r in engine.run(store, P + text).collect()]


def test_aggregates(spark):
    s = engine.GraphStore(spark)
    s.add("g", turtle.from_rows(spark, "g", turtle.parse('@prefix : <http://e/> . :a :v 1, 2, 2.5 ; :t "x" . :b :v 4 ; :t "y", "z" . :c :t "w" .')))
    integer, decimal = f"^^<{terms.XSD}integer>", f"^^<{terms.XSD}decimal>"
    assert sorted(one(s, "SELECT ?k (COUNT(?v) AS ?n) (SUM(?v) AS ?s) (AVG(?v) AS ?a) { ?k :v ?v } GROUP BY ?k")) == [
        ("<http://e/a>", f'"3"{integer}', f'"5.5"{decimal}', f'"{5.5 / 3}"{decimal}'),
        ("<http://e/b>", f'"1"{integer}', f'"4"{integer}', f'"4.0"{decimal}'),
    ]
    assert one(s, "SELECT (SUM(?t) AS ?s) (COUNT(*) AS ?n) { ?k :t ?t }") == [(None, f'"4"{integer}')]
    assert one(s, "SELECT (COUNT(*) AS ?n) (MIN(?x) AS ?m) (GROUP_CONCAT(?x) AS ?g) { ?k :no ?x }") == [(f'"0"{integer}', None, '""')]
    assert one(s, 'SELECT (GROUP_CONCAT(?t; SEPARATOR=",") AS ?g) { :b :t ?t }') == [('"y,z"',)]
    assert one(s, "SELECT ?k (COUNT(?v) AS ?n) { ?k :v ?v } GROUP BY ?k HAVING(?n > 1)") == [("<http://e/a>", f'"3"{integer}')]
    assert one(s, "SELECT ?k (SUM(?v) AS ?x) (?x * 2 AS ?y) { ?k :v ?v . FILTER(?k = :b) } GROUP BY ?k") == [("<http://e/b>", f'"4"{integer}', f'"8"{integer}')]
    assert one(s, "SELECT ?t { ?k :t ?t } ORDER BY DESC(?t) LIMIT 2 OFFSET 1") == [('"y"',), ('"x"',)]
    with pytest.raises(SparqlError):
        one(s, "SELECT ?k ?v (COUNT(*) AS ?n) { ?k :v ?v } GROUP BY ?k")


FUZZY = '@prefix : <http://e/> . :bob :drinks :coffee {0.9}, :tea {0.4} ; a :Person {0.95} . :cup2 :drinks :coffee {0.6} . :daria :drinks :coffee {0.8} ; a :Person .  :eve a :Person .'


@pytest.fixture(scope="module")
def fuzzy(spark):
    s = engine.GraphStore(spark)
    s.add("f", turtle.from_rows(spark, "f", turtle.parse(FUZZY)))
    return s


@pytest.mark.parametrize(("hedge", "want"), [("", (0.9, 0.6, 0.8)), ("VERY", (0.81, 0.36, 0.64)), ("EXTREMELY", (0.729, 0.216, 0.512)), ("MORE_OR_LESS", (0.9487, 0.7746, 0.8944)), ("NOT", (0.1, 0.4, 0.2)), ("<http://h/very>", (0.81, 0.36, 0.64))])
def test_hedges(fuzzy, hedge, want):
    rows = one(fuzzy, f"SELECT ?x ?t {{ TRUTH ?t OF {hedge} {{ ?x :drinks :coffee }} }}")
    got = {k.strip("<>").rsplit("/")[-1]: float(v.split('"')[1]) for k, v in rows}
    assert got == pytest.approx(dict(zip(("bob", "cup2", "daria"), want, strict=True)), abs=1e-4)


def degree(v):
    return None if v is None else round(float(v.split('"')[1]), 4)


def test_scopes(fuzzy):
    rows = {r[0]: (degree(r[1]), degree(r[2])) for r in one(fuzzy, "SELECT ?x ?i ?o { TRUTH ?o OF VERY { ?x a :Person . TRUTH ?i OF NOT { ?x :drinks :coffee } } }")}
    assert rows == {"<http://e/bob>": (0.1, 0.731), "<http://e/daria>": (0.2, 0.64)}
    rows = {r[0]: degree(r[1]) for r in one(fuzzy, "SELECT ?x ?t { ?x a :Person . TRUTH ?t OF NOT { OPTIONAL { ?x :drinks :coffee } } }")}
    assert rows == {"<http://e/bob>": 0.1, "<http://e/daria>": 0.2} or rows["<http://e/bob>"] == 0.1
    assert sorted(r[0] for r in one(fuzzy, "SELECT ?x { TRUTH 0.7 OF VERY { ?x :drinks :coffee } }")) == ["<http://e/bob>"]
    assert sorted(r[0] for r in one(fuzzy, "SELECT ?x { TRUTH 0.3 OF NOT { ?x :drinks :coffee } }")) == ["<http://e/cup2>"]
    assert len(one(fuzzy, "SELECT ?x ?t { TRUTH ?t OF { { ?x :drinks :tea } UNION { ?x a :Person } } }")) == 4


@pytest.mark.parametrize("bad", ["SELECT ?a { ?a :p 5 }", "ASK { ?a :p ?b }", "SELECT ?a { ?a :p ?b FILTER(REGEX(?a, 'x')) }", "SELECT ?a { GRAPH ?g { ?a :p ?b } }", "SELECT ?t { TRUTH ?t OF <http://h/somewhat> { ?a :p ?b } }"])
def test_unsupported(bad):
    with pytest.raises(UnsupportedFeature):
        parse(P + bad)


@pytest.mark.parametrize("bad", ["SELECT ?a ?a { ?a :p ?b }", "SELECT ?a { ?a nope:p ?b }", "SELECT { ?a :p ?b }", "SELECT ?a { ?a :p ?b", "SELECT ?a { TRUTH 1.5 OF { ?a :p ?b } }"])
def test_errors(bad):
    with pytest.raises(SparqlError):
        parse(P + bad)


def test_statements_and_formats(spark, tmp_path):
    from larkspur.session import Engine
    from larkspur.sources.tabular import format_rows

    (tmp_path / "g.ttl").write_text('@prefix : <http://e/> . :a :p "v;1"@en, :b .')
    e = Engine(spark)
    df = e.sparql(f"LOAD <file://{tmp_path}/g.ttl> INTO GRAPH <http://g> ; # comment ;\nDESCRIBE <http://e/a>")
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("<http://e/a>", "<http://e/p>", '"v;1"@en'), ("<http://e/a>", "<http://e/p>", "<http://e/b>")]
    for kind, part in (("csv", "subject,predicate,object"), ("tsv", "subject\tpredicate"), ("json", '"xml:lang": "en"'), ("xml", 'xml:lang="en"')):
        assert part in format_rows(df.columns, rows, kind)
