import hashlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import suffixes


def brute(rows, length=400):
    data = [(doc, (t or "").encode()) for doc, t, *_ in rows]
    times = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for doc, d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def short(corpus):
    """The corpus without its longest text, for the brute force."""
    return [(d, t[:9000] if t and len(t) > 9000 else t, *x) for d, t, *x in corpus]


@pytest.mark.parametrize("hot", [2000, 2])
def test_matches_brute_force(spark, short, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_ROWS", hot)
    df = spark.createDataFrame(short, "doc_id bigint, text string, lang string, source string")
    assert rows_of(suffixes.removed(df)) == brute(short)


def test_ranks_sort_suffixes():
    rng = np.random.default_rng(4)
    for n in [1, 2, 7, 8, 9, 10, 50, 301]:
        t = rng.integers(1, 4, n).astype(np.int64)
        order = np.argsort(suffixes.ranks(t, 10**6)).tolist()
        assert order == sorted(range(n), key=lambda i: t[i:].tolist())


def test_anchors_cover_every_start():
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    h, pos, lo, hi = suffixes.anchors(data)
    assert lo[0] == 0 and hi[-1] == len(data) - 399 and (lo[1:] == hi[:-1]).all()
    assert ((pos >= lo) & (pos + suffixes.K <= hi - 1 + 400)).all()


def test_pieces_change_nothing(monkeypatch, spark):
    rng = np.random.default_rng(6)
    part = bytes(rng.integers(97, 123, 700).astype(np.uint8)).decode()
    rows = [(i, part[i : i + 600] + str(i) + part) for i in range(4)]
    monkeypatch.setattr(suffixes, "PIECE", 512)
    monkeypatch.setattr(suffixes, "_tables", None)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(suffixes.removed(df)) == brute(rows)
    monkeypatch.undo()
    suffixes._tables = None


def test_text_output_and_empty(docs, empty):
    r = suffixes.removed(docs, with_text=True).filter("doc_id = 95").first()
    assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(e - s for s, e in r["spans"]) == r["n_removed"] > 0
    assert suffixes.removed(empty).count() == 0
