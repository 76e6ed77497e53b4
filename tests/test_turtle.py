import pytest

from larkspur.functions import terms
from larkspur.sources import turtle


def test_syntax():
    text = '''@prefix ex: <http://e/> . @base <http://b/> .
    ex:a ex:p 1, 2.50, 1e3, true, "x\\n\\u00e9"@EN ; a ex:T ; . # end
    <rel> ex:q [ ex:r ( 1 "two" ) ], """long "quote" text"""^^ex:dt .
    _:n1 ex:p <http://x/y> .'''
    rows = turtle.parse(text)
    objects = [o for s, p, o, _ in rows if s[1] == "http://e/a"]
    assert [o[1] for o in objects] == ["1", "2.50", "1e3", "true", "x\né", "http://e/T"]
    assert [o[2] for o in objects][:4] == [terms.XSD + t for t in ("integer", "decimal", "double", "boolean")]
    assert objects[4][3] == "en"
    assert ("http://b/rel", "http://e/q") in {(s[1], p[1]) for s, p, _, _ in rows}
    assert sum(p[1].endswith("first") for _, p, _, _ in rows) == 2
    assert any(o[2] == "http://e/dt" and o[1] == 'long "quote" text' for _, _, o, _ in rows)


def test_degrees():
    rows = turtle.parse("@prefix : <http://e/> . :a :p :b {0.5}, :c ; :q 1 {1.0} .")
    assert [d for *_, d in rows] == [0.5, 1.0, 1.0]
    for bad in (":a :p :b {1.5} .", ":a :p ( :b {0.5} ) .", ":a :p", "x:a :p :b ."):
        with pytest.raises(turtle.TurtleError):
            turtle.parse("@prefix : <http://e/> . " + bad)


def test_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <http://e/> . :a :p 5, 5, 6 .")
    df = turtle.read(spark, f"file://{tmp_path}/a.ttl", "g")
    assert sorted(r["o"]["num"] for r in df.collect()) == [5.0, 6.0]
