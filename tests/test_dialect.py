import pytest

from larkspur.plans import dialect
from larkspur.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.sql(
        """CREATE TABLE integers(i int); INSERT INTO integers VALUES (1), (2), (3), (NULL);
           CREATE TABLE dups(i int not null); INSERT INTO dups VALUES (1), (1), (2), (2), (3), (3);
           CREATE TABLE pairs(a int, b varchar(10), primary key (a)); INSERT INTO pairs VALUES (1, 'x'), (2, 'y'), (4, 'z')"""
    )
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


CASES = [
    ("SELECT i FROM integers ORDER BY i", [(1,), (2,), (3,), (None,)]),
    ("SELECT i FROM integers ORDER BY i DESC", [(None,), (3,), (2,), (1,)]),
    ("SELECT i FROM integers ORDER BY i DESC NULLS LAST", [(None,), (3,), (2,), (1,)]),
    ("SELECT 7 / 2 AS x, 7 / 2.0 AS y, -7 / 2 AS z", [(3.0, 3.5, -3.0)]),
    ("SELECT 12 / 2 / 3 * 2 AS x", [(4.0,)]),
    ("SELECT substring('hello', -1, 3) AS a, substr('hello', 2) AS b, substring('hello' FROM 2 FOR 3) AS c", [("h", "ello", "ell")]),
    ("SELECT i FROM integers WHERE i NOT IN (SELECT i FROM integers WHERE i IS NULL OR i = 2) ORDER BY 1", [(1,), (3,), (None,)]),
    ("SELECT i FROM integers WHERE i > ALL (SELECT a FROM pairs WHERE a < 3)", [(3,)]),
    ("SELECT i FROM integers WHERE i = SOME (SELECT a FROM pairs) ORDER BY i", [(1,), (2,)]),
    ("SELECT b FROM pairs WHERE b LIKE ANY (SELECT 'x%')", [("x",)]),
    ("SELECT a, EXISTS (SELECT 1 FROM integers WHERE i = a) AS e FROM pairs ORDER BY a", [(1, True), (2, True), (4, False)]),
    ("SELECT i, sum(i) OVER (ORDER BY i) AS s FROM dups ORDER BY 1, 2", [(1, 1), (1, 2), (2, 4), (2, 6), (3, 9), (3, 12)]),
    ("SELECT (SELECT count(*) FROM pairs WHERE a > i) AS n, i FROM integers ORDER BY i", [(2, 1), (1, 2), (1, 3), (0, None)]),
    ("SELECT (SELECT min(a) FROM pairs WHERE a > i) AS n FROM integers ORDER BY n", [(2,), (4,), (4,), (None,)]),
    ("SELECT i, count(*) AS n FROM dups GROUP BY ROLLUP(i) ORDER BY i", [(1, 2), (2, 2), (3, 2), (None, 6)]),
    ("FROM dups |> AGGREGATE count(*) AS n GROUP BY ROLLUP(i) |> WHERE n > 2", [(None, 6)]),
    ("FROM dups |> SELECT DISTINCT i |> WHERE i > 1 |> ORDER BY i DESC |> LIMIT 1", [(3,)]),
    ("SELECT i FROM dups INTERSECT ALL SELECT i FROM integers ORDER BY 1", [(1,), (2,), (3,)]),
    ("SELECT i FROM dups EXCEPT ALL SELECT i FROM integers ORDER BY 1", [(1,), (2,), (3,)]),
    ("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, y) ORDER BY x", [(1, "a"), (2, None)]),
    ("SELECT regexp_replace('abcb', '(b)', '<\\1>') AS r", [("a<b>c<b>",)]),
    ("SELECT a.i FROM integers a FULL OUTER JOIN dups b ON a.i = b.i WHERE b.i IS NULL", [(None,)]),
    ("WITH t(k) AS (SELECT i FROM dups) SELECT DISTINCT k FROM t ORDER BY k", [(1,), (2,), (3,)]),
    ("SELECT sum(DISTINCT i) AS s, count(DISTINCT i) AS n, avg(DISTINCT i) AS a FROM dups", [(6, 3, 2.0)]),
]


@pytest.mark.parametrize(("sql", "want"), CASES, ids=range(len(CASES)))
def test_results(engine, sql, want):
    got = rows(engine, sql)
    key = (lambda r: r) if "ORDER BY" not in sql else None
    assert (sorted(got, key=repr) if key else got) == (sorted(want, key=repr) if key else want)


def test_tokens_and_statements():
    assert dialect.tokens("a--x\n /* ; */ 'it''s' || b") == ["a", "'it''s'", "||", "b"]
    assert dialect.statements("SELECT ';'; -- no;\nSELECT 2") == ["SELECT ';'", "SELECT 2"]
    with pytest.raises(ValueError):
        dialect.rewrite("SELECT (1")


def test_inserts_and_keys(engine):
    assert engine.keys["pairs"] == ["a"] and engine.required["pairs"] == ["a"]
    with pytest.raises(ValueError):
        engine.sql("INSERT INTO pairs (a) VALUES (9)")
    with pytest.raises(Exception, match="NULL in column"):
        engine.sql("INSERT INTO dups VALUES (CAST(NULL AS int))")


def test_copy_and_persist(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a|b\n1|"x\ny"\n2|\n')
    e = Engine(spark, f"file://{tmp_path}/db")
    e.sql(f"SET persist = 1; CREATE TABLE t(a int, b text); COPY t FROM '{tmp_path}/t.csv' csv delimiter '|' header")
    want = [(1, "x\ny"), (2, None)]
    assert rows(e, "SELECT a, b FROM t ORDER BY a") == want
    again = Engine.open(spark, f"file://{tmp_path}/db")
    assert rows(again, "SELECT a, b FROM t ORDER BY a") == want


def test_functions(engine):
    got = rows(engine, "CREATE FUNCTION plus1(x int) RETURNS int LANGUAGE c AS $$ return x+1; $$; SELECT plus1(i) AS v FROM integers ORDER BY v")
    assert got == [(2,), (3,), (4,), (None,)]
    got = rows(engine, "CREATE OR REPLACE FUNCTION plus1(x int) RETURNS bool LANGUAGE c AS $$ return x % 2 == 0 || x > 2; $$; SELECT plus1(i) AS v FROM dups ORDER BY i")
    assert got == [(False,), (False,), (True,), (True,), (True,), (True,)]
    with pytest.raises(ValueError, match="text"):
        engine.sql("CREATE FUNCTION f(x text) RETURNS int LANGUAGE c AS $$ return 1; $$")
