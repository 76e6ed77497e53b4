import json
import threading
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pytest

from larkspur.endpoint import serve
from larkspur.session import Engine
from larkspur.sources import turtle
from larkspur.sparql.engine import GraphStore


@pytest.fixture(scope="module")
def url(spark):
    e = Engine(spark)
    e.graphs = GraphStore(spark)
    e.graphs.add("g", turtle.from_rows(spark, "g", turtle.parse('@prefix : <http://e/> . :a :p "x"@en, :b .')))
    server = serve(e)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_formats(url):
    q = quote("SELECT ?o { <http://e/a> <http://e/p> ?o }")
    body = json.load(urlopen(Request(f"{url}/sparql?query={q}", headers={"Accept": "application/json"})))
    assert {b["o"]["type"] for b in body["results"]["bindings"]} == {"uri", "literal"}
    text = urlopen(Request(f"{url}/sparql", data=b"SELECT ?o { ?s ?p ?o }", headers={"Accept": "text/csv", "Content-Type": "application/sparql-query"})).read().decode()
    assert text.splitlines()[0] == "o" and len(text.splitlines()) == 3


@pytest.mark.parametrize(("query", "status"), [("ASK { ?a ?b ?c }", 501), ("SELECT { }", 400)])
def test_errors(url, query, status):
    with pytest.raises(HTTPError) as e:
        urlopen(f"{url}/sparql?query={quote(query)}")
    assert e.value.code == status
